"""Ephemeris goldens and puzzles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daybook.functions import hashing, sky
from daybook.operators import puzzles


@pytest.mark.parametrize(
    ("k", "at"),
    [(-283.0, dt.datetime(1977, 2, 18, 3, 36)), (329.0, dt.datetime(2026, 8, 12, 17, 37)), (323.5, dt.datetime(2026, 3, 3, 11, 38))],
)
def test_syzygies(spark, k, at):
    got = spark.range(1).select(sky.syzygy_instant(F.lit(k)).alias("t")).first().t
    assert abs((got - at).total_seconds()) < 180


def test_sun_and_moon(spark):
    rows = spark.createDataFrame([(dt.datetime(2026, 3, 20, 14, 46),), (dt.datetime(2026, 8, 12, 17, 37),), (dt.datetime(2026, 3, 3, 11, 38),)], "at timestamp")
    jd = sky.julian_date(F.col("at"))
    a, b, c = rows.select(sky.sun_longitude(jd).alias("s"), sky.illumination(jd).alias("i"), sky.phase_name(jd).alias("p")).collect()
    assert min(a.s, 360 - a.s) < 0.01
    assert b.i < 0.01 < 0.99 < c.i and (b.p, c.p) == ("new moon", "full moon")
    assert rows.select(F.max(F.abs(sky.from_julian(jd).cast("double") - F.col("at").cast("double"))).alias("d")).first().d < 0.01


def test_turnings_of_a_year(spark):
    days = spark.range(365).select((F.col("id") + 2461041.5).alias("jd"))  # 2026-01-01
    found = [str(r.d)[:10] for r in days.where(sky.equinox_crossings(F.col("jd"))).select(sky.from_julian(F.col("jd")).alias("d")).orderBy("d").collect()]
    assert found == ["2026-03-20", "2026-06-21", "2026-09-23", "2026-12-21"]


def test_cloze(spark):
    rows = spark.createDataFrame([(1, "The crab is 6,500 light-years away. The nebula glows!"), (2, None), (3, "")], "date_id long, text string")
    one, two, three = puzzles.cloze(rows, frozenset({"the", "is", "away"}), 0).orderBy("date_id").collect()
    assert (one.hidden, one.distinct_hidden, two.hidden, three.pieces) == (4, 4, 0, [])
    assert "".join(p.shown or "#" * p.length for p in one.pieces) == "The #### is 6,500 ########### away. The ###### #####!"
    assert {p.hash for p in one.pieces if p.hash} == {hashing.word_hash(0, w) for w in ("crab", "light-years", "nebula", "glows")}


def test_draw_is_deterministic(spark):
    pool = spark.range(50).withColumnRenamed("id", "date_id")
    first = [r.date_id for r in puzzles.draw(pool, "day 1", 7).collect()]
    assert first == [r.date_id for r in puzzles.draw(pool.repartition(9), "day 1", 7).collect()] != [r.date_id for r in puzzles.draw(pool, "day 2", 7).collect()]
    assert len(set(first)) == 7


def test_streaks_and_scores(spark):
    days = [("a", dt.date(2024, 1, d)) for d in (1, 2, 3, 7, 7)] + [("b", dt.date(2024, 1, 3))]
    got = {(r.game, r["first"].day, r.days) for r in puzzles.streaks(spark.createDataFrame(days, "game string, day date")).collect()}
    assert got == {("a", 1, 3), ("a", 7, 1), ("b", 3, 1)}
    assert spark.range(1).select(puzzles.date_score(F.lit(8.0), F.lit(100.0)).alias("s")).first().s == 500


def test_turning_points_and_distance(spark):
    one = spark.range(1).select(sky.turning_point(F.lit(1962), 1).alias("june"), sky.moon_distance(F.lit(2448724.5)).alias("km"), sky.turning_instant(F.lit(2026), 0).alias("march")).first()
    assert abs(one.june - 2437837.39245) < 0.0001 and abs(one.km - 368409.7) < 5
    assert abs((one.march - dt.datetime(2026, 3, 20, 14, 46)).total_seconds()) < 90


def test_eclipses_of_two_years(spark):
    k = spark.range(618, 668).select((F.col("id") / 2).alias("k"))
    found = sky.eclipses(k).where("kind is not null").selectExpr("kind", "string(date(at)) as day").collect()
    assert {(r.day, r.kind) for r in found if r.day >= "2025" and r.day < "2027"} == {
        ("2025-03-14", "total lunar"), ("2025-03-29", "partial solar"), ("2025-09-07", "total lunar"), ("2025-09-21", "partial solar"),
        ("2026-02-17", "annular solar"), ("2026-03-03", "total lunar"), ("2026-08-12", "total solar"), ("2026-08-28", "partial lunar"),
    }
