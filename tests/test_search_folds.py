"""Search without regard to diacritics."""

import pytest
from pyspark.sql import functions as F

from daybook.functions import text
from daybook.operators import search


@pytest.mark.parametrize("query", ['"für"', '"fur"', '"für"', '"FÜR"', '"fü"*'])
def test_every_spelling_is_found(spark, query):
    rows = spark.createDataFrame([(1, "nur für dich"), (2, "nur fur dich"), (3, "nur für dich"), (4, "nur FÜR dich"), (5, "nur dich")], "date_id long, title string")
    assert {x.date_id for x in search.search(rows, query, {"title": 1}).collect()} == {1, 2, 3, 4}


def test_tokens_fold_as_the_query_does(spark):
    given = "İstanbul Ångström ǘ Łódź straße ́ été 한글"
    row = spark.createDataFrame([(given,)], "t string").select(text.fold(F.col("t")).alias("f"), text.tokens(F.col("t")).alias("t")).first()
    assert row.f == text.folded(given)
    assert row.t == ["istanbul", "angstrom", "u", "łodz", "straße", "ete", "한글"]


def test_highlight_marks_every_spelling(spark):
    rows = spark.createDataFrame([("für, fur, für, Fürst",)], "t string")
    assert rows.select(search.highlight(F.col("t"), '"für"')).first()[0] == "<mark>für</mark>, <mark>fur</mark>, <mark>für</mark>, Fürst"
