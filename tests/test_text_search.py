"""Words, keys and search on small cases."""

import pytest
from pyspark.sql import functions as F

from daybook.functions import hashing, text
from daybook.operators import catalogue, search


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("given", "found"),
    [
        ("some 150,000-kilometer jets, 2.5 across", ["some", "150,000-kilometer", "jets", "across"]),
        ("gravity--the real problem--wins", ["gravity", "the", "real", "problem", "wins"]),
        ("M31 is 2.5 million light years away, in 1995", ["m31", "is", "million", "light", "years", "away", "in"]),
        ("it’s Néb 'quoted'", ["it's", "néb", "quoted"]),
        ("", []),
    ],
)
def test_words(spark, given, found):
    assert values(spark, text.words, given) == [found]


def test_sentences(spark):
    given = {"Dr. J. Smith looked up. Then he left.": 2, "It ended.. Then it began?! And stopped...": 3, "no point": 1, "": 0, "...": 1, "It is 2.5 m. and small. ": 1, 'He said "Go!" Then left. x': 1}
    assert values(spark, text.sentences, *given) == list(given.values())
    assert values(spark, text.sentences, None) == [0]


def test_keys_ignore_scheme_fragment_and_closing_slash(spark):
    urls = ["http://www.Example.org/", "https://www.example.org/#top", "https://www.example.org", "http://a.org:8080/x/?id=1", "http://a.org:8080/x?id=2"]
    assert values(spark, text.link_key, *urls) == ["www.example.org/"] * 3 + ["a.org:8080/x?id=1", "a.org:8080/x?id=2"]
    assert values(spark, text.host, urls[0], "mailto:x") == ["example.org", ""]


def test_summary_and_escape(spark):
    assert values(spark, lambda c: text.summary(c, 12), "short", "The ringed, planet glows") == ["short", "The ringed…"]
    assert values(spark, text.escape_html, "<a & 'b'>") == ["&lt;a &amp; &#39;b&#39;&gt;"]


def test_published_hash_values(spark):
    assert hashing.hash64(b"") == 0xCBF29CE484222325
    assert hashing.hash64(b"nebula") == 0x9C5E59083FBC0EE6
    assert values(spark, lambda c: hashing.salted(c, 0), "nebula", None) == ["2da88849e7af2686", None]
    assert hashing.word_hash(1, "nebula") == "9e82832964457621"


@pytest.fixture(scope="module")
def titles(spark):
    rows = [(1, "star cluster in blue", "a galaxy"), (2, "cluster of a star", "hubble galaxy"), (3, "galaxy", None), (4, "star clusters", "nothing")]
    return spark.createDataFrame(rows, "date_id long, title string, body string")


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("star cluster", {1, 2, 4}),
        ('star "cluster"', {1, 2}),
        ('"star cluster"', {1}),
        ('"star cluster"*', {1, 4}),
        ("galaxy -hubble x OR hubble", {2}),
        ("galaxy NOT hubble", {1, 3}),
        ("-star", set()),
        ("... OR", set()),
        ("gal*", {1, 2, 3}),
        ("cluster OR galaxy", {1, 2, 3}),
    ],
)
def test_grammar(titles, query, found):
    assert {r.date_id for r in search.search(titles, query, {"title": 10, "body": 1}).collect()} == found


def test_title_hits_rank_first(titles):
    rows = search.search(titles, '"hubble" OR "blue"', {"title": 10, "body": 1}).orderBy("score").collect()
    assert [r.date_id for r in rows] == [1, 2]
    assert rows[0].hits_title and not rows[0].hits_body and rows[1].hits_body


def test_highlight(spark):
    assert values(spark, lambda c: search.highlight(c, "nebula cl"), "A Nebula, nebulas, clouds.") == ["A <mark>Nebula</mark>, nebulas, <mark>clouds</mark>."]


def test_word_catalogue(spark):
    entries = spark.createDataFrame([(1, "the ringed planet the planet"), (2, "the ringed moon"), (3, None)], "date_id long, text string")
    listing = catalogue.word_listing(catalogue.words(catalogue.entry_words(entries)), limit=2).collect()
    assert [(r.word, r.total, r.entries) for r in listing] == [("the", 3, 2), ("planet", 2, 1)]
    assert [r.word for r in catalogue.word_listing(catalogue.words(catalogue.entry_words(entries)), pattern="ring*").collect()] == ["ringed"]
    assert [r.word for r in catalogue.word_listing(catalogue.words(catalogue.entry_words(entries)), pattern="%").collect()] == []


def test_nearest_rank_and_buckets(spark):
    rows = spark.createDataFrame([(x,) for x in (3, 1, 0, 2)], "words long")
    assert {r.p: r.value for r in catalogue.nearest_rank(rows, "words", (0, 50, 99)).collect()} == {0: 0, 50: 2, 99: 3}
    bands = spark.createDataFrame([(10,), (199,)], "words long")
    assert [(r.low, r.entries) for r in catalogue.length_buckets(bands).orderBy("band").collect()] == [(0, 1), (50, 0), (100, 0), (150, 1)]
    assert catalogue.length_buckets(bands.limit(0)).count() == 1
