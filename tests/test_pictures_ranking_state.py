"""Near prints and groups, run changes, ranking, ledgers and streams."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import insight, pictures, ranking
from daybook.sources import feeds
from daybook.streaming import ledger


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_near_pairs_and_groups_equal_brute_force(spark):
    r = random.Random(1)
    prints = [r.getrandbits(64) for _ in range(40)]
    for x in prints[:20]:
        for _ in range(2):
            y = x
            for b in r.sample(range(64), r.randint(0, 10)):
                y ^= 1 << b
            prints.append(y)
    prints += [0, (1 << 64) - 1, 3]
    rows = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(prints)], "id long, print long")
    distinct = sorted({signed(x) for x in prints if 4 <= x.bit_count() <= 60})
    want = {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 8}
    pairs = pictures.near_pairs(rows)
    assert {(x.a, x.b) for x in pairs.collect()} == want
    roots = {x.member: x.root for x in pictures.groups(pairs).collect()}
    label = {x: x for p in want for x in p}
    for _ in label:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert roots == label


def test_near_pairs_send_nothing_through_the_driver(spark):
    rows = spark.createDataFrame([(i, i * 0x9E3779B97F4A7C1 % (1 << 62)) for i in range(20)], "id long, print long")
    plan = pictures.near_pairs(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {x.root for x in pictures.groups(edges).collect()} == {0}


def test_appearances(spark):
    runs = spark.createDataFrame([(1, 10, "a", None), (1, 30, "a", "x"), (1, 31, "b", "x"), (2, 5, "q", "q")], "grp int, date_id int, title string, file string")
    got = {(x.grp, x.date_id): (x.days_since, x.t, x.f) for x in pictures.appearances(runs, {"t": "title", "f": "file"}).collect()}
    assert got == {(1, 10): (None, False, False), (1, 30): (20, False, True), (1, 31): (1, True, False), (2, 5): (None, False, False)}


def votes_of(spark, *rows):
    return spark.createDataFrame([(a, b, o) for a, b, o, n in rows for _ in range(n)], "left long, right long, outcome string")


@pytest.mark.parametrize(("wins", "losses", "ties"), [(7, 3, 0), (6, 2, 2)])
def test_difference_of_two(spark, wins, losses, ties):
    half = [(1, 2, "left", wins), (1, 2, "right", losses), (1, 2, "tie", ties), (2, 1, "right", wins), (2, 1, "left", losses), (2, 1, "tie", ties), (3, 3, "tie", 4)]
    got = {x.picture: x for x in ranking.fit(votes_of(spark, *half), sigma=math.inf).collect()}
    assert abs(got[1].score - got[2].score - math.log(7 / 3)) < 1e-9
    assert got[1].comparisons == 20 and abs(got[1].side_bias) < 1e-9


def test_prior_keeps_a_clean_sweep_finite(spark):
    got = {x.picture: x.score for x in ranking.fit(votes_of(spark, (1, 2, "left", 10), (2, 1, "right", 10))).collect()}
    assert 0 < got[1] - got[2] < 6


@pytest.mark.parametrize(("rows", "want"), [([(2.0, 0.1), (1.95, 0.1), (0.5, 0.1)], [1, 1, 2]), ([(2.0, 0.05), (1.0, 0.8)], [1, 1])])
def test_tiers(spark, rows, want):
    scores = spark.createDataFrame([(i, s, e, 10) for i, (s, e) in enumerate(rows)], "picture long, score double, stderr double, comparisons long")
    assert [x.tier for x in ranking.tiers(ranking.board(scores)).orderBy("picture").collect()] == want


def test_progress():
    assert ranking.progress(9582, 50_000) == [("screen", 47_910, 47_910), ("contend", 25_000, 2_090), ("settle", 15_000, 0)]


def test_gaps(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 5, 6, 9)], "date date")
    assert sorted((x["first"].day, x["last"].day, x.days) for x in insight.gap_runs(insight.missing_days(days)).collect()) == [(3, 4, 2), (7, 8, 2)]
    assert insight.missing_days(days.limit(0)).count() == 0


def test_delivery_is_recorded_once(spark, tmp_path):
    book, source = str(tmp_path / "ledger"), str(tmp_path / "notices")
    spark.createDataFrame([("kp", "a")], "topic string, key string").write.parquet(book)
    sent = []
    schema = "topic string, key string, id long"
    for rows in ([("kp", "a", 1), ("kp", "b", 2), ("kp", "b", 3)], [("kp", "b", 4), ("sky", "b", 5)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ledger.deliver(stream, book, lambda due: sent.extend(sorted(r.id for r in due.collect())), str(tmp_path / "check")).awaitTermination()
    assert sent == [2, 5]
    assert spark.read.parquet(book).count() == 3


def test_sticky_cohort(spark):
    at = dt.datetime(2024, 1, 1)
    casts = spark.createDataFrame([(1, at, "x"), (1, at + dt.timedelta(hours=1), "y"), (1, at + dt.timedelta(hours=30), "z"), (2, at, "q")], "voter long, at timestamp, cohort string")
    got = [x.cohort for x in ledger.sticky_cohorts(casts, 86_400).orderBy("voter", "at").collect()]
    assert got == ["x", "x", "z", "q"]


def test_feeds(spark, tmp_path):
    body = {"results": [{"id": "1", "name": "n", "net": "2026-01-01T00:00:00Z", "pad": {"name": "P", "location": {"name": "L"}}}, {"id": None, "name": "x", "net": "2026-01-01T00:00:00Z"}]}
    rows = feeds.launches(spark.createDataFrame([(json.dumps(body),), ("not json",)], "body string")).collect()
    assert [(x.id, x.pad, x.provider) for x in rows] == [("1", "P, L", None)]
    day = {"0": {"DateStamp": "d", "R": {"Scale": "2", "Text": " "}, "S": {"Scale": None, "Text": "t"}, "G": {"Scale": "x", "Text": "none"}}}
    assert [tuple(x) for x in feeds.scales(spark.createDataFrame([(json.dumps(day),)], "body string")).collect()] == [("0", "R", 2, None)]
    kp = spark.createDataFrame([("2026-01-03 00:00:00.000", 4.0), ("2026-01-02T03:00:00", 5.0), ("2025-12-01 00:00:00", 3.0), ("bad", 1.0), ("2026-01-03 00:00:00", None)], "time_tag string, kp double")
    assert sorted(x.kp for x in feeds.readings(kp, "2026-01-04").collect()) == [4.0, 5.0]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "2024-01-02.html").write_bytes(b"x")
    (tmp_path / "a" / "other.html").write_bytes(b"y")
    assert [str(x.date) for x in feeds.archived_pages(spark, str(tmp_path)).collect()] == ["2024-01-02"]


def test_strict_baseline(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("date,category,score,ess,comparisons\n2024-01-01,sky,1.5,2.0,3\n")
    assert feeds.baseline(spark, str(good)).first().score == 1.5
    bad = tmp_path / "bad.csv"
    bad.write_text("date,category,score,ess,comparisons\n2024-01-01,sky,1.5,-2.0,3\n")
    with pytest.raises(ValueError, match="weights"):
        feeds.baseline(spark, str(bad))


def test_once_on_a_table(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "key string, at int")
    assert ledger.once(rows, "at", "key", "1 hour").select(F.count("*")).first()[0] == 2
