"""Budgets: the stream against the table, and the table against a plain walk."""

import datetime as dt
import random

import pytest

from daybook.streaming.budgets import OUT, budgets, within_budgets

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "vote_id long, voter string, cohort string, voted_at timestamp"


def cast(n=160, seed=5):
    r = random.Random(seed)
    return [(i, r.choice("abc"), r.choice(["x", "y", None]), T0 + dt.timedelta(seconds=r.randrange(0, 20000))) for i in range(n)]


def plain(votes, place, limit, window):
    out, asked, used = {}, {}, {}
    for v in sorted(votes, key=lambda v: (v[3], v[0])):
        k = v[place]
        since = v[3] - dt.timedelta(seconds=window)
        asked[k] = [t for t in asked.get(k, []) if t >= since] + [v[3]]
        used[k] = [t for t in used.get(k, []) if t >= since]
        refused = len(used[k]) >= limit
        used[k] += [] if refused else [v[3]]
        out[v[0]] = (len(asked[k]), len(used[k]), refused)
    return out


def told(rows):
    return {r.vote_id: (r.asked, r.used, r.refused) for r in rows}


def test_table_equals_a_plain_walk(spark):
    votes = cast()
    got = budgets(spark.createDataFrame(votes, SCHEMA), "voter", 3, 1800).collect()
    want = plain(votes, 1, 3, 1800)
    assert told(got) == want and any(x[2] for x in want.values())


def test_cohorts_are_asked_after_voters(spark):
    votes = cast()
    got = {r.vote_id: r.refused_by for r in within_budgets(spark.createDataFrame(votes, SCHEMA), 4, 5, 1800).collect()}
    by_voter = plain(votes, 1, 4, 1800)
    left = [v for v in votes if not by_voter[v[0]][2] and v[2] is not None]
    by_cohort = plain(left, 2, 5, 1800)
    want = {v[0]: "voter" if by_voter[v[0]][2] else "cohort" if by_cohort.get(v[0], (0, 0, False))[2] else None for v in votes}
    assert got == want and {"voter", "cohort", None} <= set(got.values())


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def test_stream_equals_the_table_and_empties_its_state(rocks, tmp_path):
    """Files come in any order within the lateness; each run is a restart from the checkpoint."""
    spark, votes = rocks, sorted(cast(60), key=lambda v: v[3])
    r = random.Random(1)
    parts = [votes[i : i + 20] for i in range(0, len(votes), 20)]
    late = [parts[0], parts[1] + parts[2][:3], parts[2][3:]]
    flush = [(9000 + i, "z", None, T0 + dt.timedelta(days=3 + i)) for i in range(3)]
    out = []
    for number, part in enumerate([*late, flush[:1], flush[1:2], flush[2:]]):
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = (
            budgets(stream, "voter", 2, 1800, "3 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
        out.append(spark.read.schema(OUT).parquet(str(tmp_path / "out")).count())
    got = told(x for x in spark.read.schema(OUT).parquet(str(tmp_path / "out")).collect() if x.key != "z")
    assert got == told(budgets(spark.createDataFrame(votes, SCHEMA), "voter", 2, 1800).collect())
    assert out[0] < len(parts[0])  # votes wait for the watermark
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "check"))
    assert {row.key[0] for row in held.select("key").collect()} <= {"z"}
    used = spark.read.format("statestore").option("stateVarName", "used").load(str(tmp_path / "check"))
    assert {row.key[0] for row in used.select("key").collect()} <= {"z"}
