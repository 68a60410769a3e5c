"""The stored index against searching the texts, under change, and its plan."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from daybook.operators import search
from daybook.operators.index import SearchIndex

COLUMNS = ("title", "text", "credit", "keywords")
WEIGHTS = dict(zip(COLUMNS, (10.0, 1.0, 2.0, 5.0), strict=True))
WORDS = ["star", "Star", "cluster", "clusters", "für", "fur", "galaxy", "of", "the", "a", "o'clock", "été", "m31", "—", "x_y"]
QUERIES = ['"star cluster"', "star cluster", '"of the"', '"the of the"', "galaxy -fur", "clust*", '"of clus"*', '"für" OR "été"', "st", "a -star OR m31", "nothinghere", "-star", '"a a"']


def rows_of(seed, n, start=0):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) for _ in range(r.randint(0, k)))
    return [(start + i, text(4), text(40), text(3), None if i % 5 == 0 else text(2)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "date_id long, title string, text string, credit string, keywords string").repartition(3)


def found(result):
    return sorted((r.date_id, round(r.score, 9), *[r[f"hits_{c}"] for c in COLUMNS]) for r in result.collect())


def contents(index):
    return sorted((r.token, r.date_id, r.place, r.n, tuple(r.positions), r.length) for r in index.postings().collect())


@pytest.fixture(scope="module")
def entries(spark):
    return frame(spark, rows_of(1, 120))


@pytest.fixture(scope="module")
def index(entries):
    return SearchIndex.build(entries, COLUMNS)


@pytest.mark.parametrize("query", QUERIES)
def test_equal_to_searching_the_texts(entries, index, query):
    want = search.search(entries, query, WEIGHTS)
    assert found(index.search(query, WEIGHTS)) == found(want)


def test_two_columns_of_four(entries, index):
    two = {"title": 3.0, "text": 1.0}
    for query in ('"star"', '"of the" galaxy'):
        rows = lambda x: sorted((r.date_id, round(r.score, 9)) for r in x.collect())
        assert rows(index.search(query, two)) == rows(search.search(entries, query, two))


def test_changes_equal_an_index_built_anew(spark, entries):
    changed = SearchIndex.build(entries, COLUMNS)
    rows = {r[0]: r for r in rows_of(1, 120)}
    for step in range(3):
        new = rows_of(10 + step, 30, start=20 * step)
        new += rows_of(20 + step, 5, start=1000 + 3 * step)
        gone = [i for i in rows if i % (7 + step) == 0] + [5000 + step, new[0][0] + 2]
        upserts = [r for r in new if r[0] not in gone]
        changed = changed.change(frame(spark, upserts), spark.createDataFrame([(g,) for g in gone], "date_id long"))
        rows = {i: r for i, r in rows.items() if i not in gone} | {r[0]: r for r in upserts}
    anew = SearchIndex.build(frame(spark, list(rows.values())), COLUMNS)
    assert contents(changed) == contents(anew)
    assert (changed.documents, changed.tokens) == (anew.documents, anew.tokens) and len(changed.segments) == 4
    assert found(changed.search("star -fur", WEIGHTS)) == found(anew.search("star -fur", WEIGHTS))
    opened = SearchIndex.open(spark, changed.root)
    assert opened == changed
    merged = opened.merge()
    assert len(merged.segments) == 1 and contents(merged) == contents(anew)
    assert found(merged.search('"of the"', WEIGHTS)) == found(anew.search('"of the"', WEIGHTS))


def test_many_changes_are_merged(spark):
    index = SearchIndex.build(frame(spark, rows_of(3, 4)), COLUMNS)
    for i in range(9):
        index = index.change(removed=spark.createDataFrame([(0,)], "date_id long") if i else None)
    assert len(index.segments) <= 8 and index.documents == 3


def test_empty(spark):
    index = SearchIndex.build(frame(spark, []), COLUMNS)
    assert index.search("star", WEIGHTS).count() == 0 and (index.documents, index.tokens) == (0, 0)


def test_scan_reads_the_tokens_buckets_only(spark, index, capsys):
    index.search('"star cluster"', WEIGHTS).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200]
    assert "token" in plan.split("PushedFilters", 1)[1][:400]


def test_positions_are_delta_coded(spark, index):
    files = [f for f in index.postings(("the",)).inputFiles()]
    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata
    columns = {c.path_in_schema: c for c in (meta.row_group(0).column(i) for i in range(meta.num_columns))}
    assert "DELTA_BINARY_PACKED" in columns["positions.list.element"].encodings


def brute_window(tokens, phrases, n):
    best = (0, 0)
    for s in range(max(1, len(tokens) - n + 1)):
        part = tokens[s : s + n]
        distinct = len({i for _, _, i in search.matches(part, phrases)})
        if distinct > best[0]:
            best = (distinct, s)
    return best


def test_best_window_against_all_windows():
    r = random.Random(4)
    for _ in range(1500):
        tokens = [r.choice("abcdefgh") for _ in range(r.randint(1, 40))]
        phrases = list({search.Phrase(tuple(r.choice("abcd") for _ in range(r.randint(1, 3))), r.random() < 0.2) for _ in range(r.randint(1, 4))})
        n = r.randint(1, 12)
        found = search.matches(tokens, phrases)
        want, start = brute_window(tokens, phrases, n)
        got = search.best_window(len(tokens), found, n)
        assert 0 <= got <= max(0, len(tokens) - n) or not want
        if want:
            assert got == start
        elif found:
            assert got == min(found[0][0], max(0, len(tokens) - n))


def test_snippets_show_the_best_window(spark):
    text = "A star here. Then much else that is not wanted at all; a far star cluster of the sky, für dich. The end"
    rows = spark.createDataFrame([(1, text), (2, "no match"), (3, "star"), (4, None)], "date_id long, text string")
    got = {r.date_id: r.snippet for r in search.snippets(rows, '"star cluster" OR "fur" OR star', "text", 8).collect()}
    assert got == {1: "…<mark>star cluster</mark> of the sky, <mark>für</mark> dich. The…", 3: "<mark>star</mark>"} or got[1].startswith("…")
    assert "<mark>star cluster</mark>" in got[1] and "<mark>für</mark>" in got[1]


def test_highlight_marks_phrases_whole(spark):
    rows = spark.createDataFrame([("The star  cluster, star. STAR-cluster",), (None,), ("--",)], "t string")
    got = [r[0] for r in rows.select(search.highlight(F.col("t"), '"star cluster"')).collect()]
    assert got == ["The <mark>star  cluster</mark>, star. <mark>STAR-cluster</mark>", None, "--"]
