"""Nearness joins against brute force; upserts, ledgers, snapshots; every query has SQL columns of its own names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import joins, mutation
from daybook.plans import registry


def test_within_and_containing_equal_brute_force(spark):
    r = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    a = [(i, base + dt.timedelta(seconds=r.randint(0, 5000))) for i in range(60)]
    b = [(i, base + dt.timedelta(seconds=r.randint(0, 5000))) for i in range(60)] + [(99, None)]
    got = joins.within(spark.createDataFrame(a, "x int, at timestamp"), spark.createDataFrame(b, "y int, bt timestamp"), "at", "bt", 90)
    assert sorted((p.x, p.y) for p in got.collect()) == sorted((i, j) for i, s in a for j, t in b if t and abs((s - t).total_seconds()) < 90)
    days = [(i, base.date() + dt.timedelta(days=r.randint(0, 400))) for i in range(80)]
    spans = [(i, base.date() + dt.timedelta(days=s), base.date() + dt.timedelta(days=s + r.randint(0, 90))) for i, s in enumerate(r.sample(range(400), 12))]
    got = joins.containing(spark.createDataFrame(days, "x int, day date"), spark.createDataFrame(spans, "y int, first date, last date"), "day", "first", "last")
    assert sorted((p.x, p.y) for p in got.collect()) == sorted((i, j) for i, d in days for j, f, t in spans if f <= d <= t)


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 7, "y"), ("b", 10, "z")], "k string, s int, v string")
    assert {r.id: r.v for r in joins.as_of(left, right, "k", "t", "s", "v").collect()} == {1: "x", 2: None, 3: None, 4: "y"}


def test_upsert_preserves(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", None)], "id int, title string, print string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "m")], "id int, title string, print string")
    assert sorted(tuple(r) for r in mutation.upsert(old, new, "id", ("print",)).collect()) == [(1, "a", "p"), (2, None, "n"), (3, "c", "m")]


def test_fetch_ledger_keeps_the_last_page(spark):
    rows = [(1, 1, 200, "s1", None), (1, 2, 500, None, "down"), (2, 1, 404, None, "gone"), (2, 3, 200, "s2", None)]
    got = {r.date_id: tuple(r)[1:] for r in mutation.fetch_ledger(spark.createDataFrame(rows, "date_id int, at int, status int, sha256 string, error string")).collect()}
    assert got[1][:3] == (500, "s1", 1) and got[2][:3] == (200, "s2", 3)


def test_snapshot_and_merge(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0)], "id string, net int")
    assert [tuple(r) for r in mutation.snapshot(rows, "id", ["net"], F.col("net") >= 1).collect()] == [("a", 1)]
    other = spark.createDataFrame([("a", 9), ("c", 3)], "id string, net int")
    assert sorted(tuple(r) for r in mutation.merged(rows.where("net = 1"), other, "id").collect()) == [("a", 1), ("c", 3)]
    assert mutation.orphans_removed(rows, other, "id").count() == 2


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_columns_match_the_sql_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents events pages orders customer embeddings conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(con.sql(registry.ORACLE[name]).columns)
