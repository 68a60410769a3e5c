"""Structured Streaming jobs: a ledger of sent notices, feeds of latest values, budgets; with their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unsent(notices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Notices whose (topic, key) isn't in the ledger, each once: the first by id."""
    first = W.partitionBy("topic", "key").orderBy("id")
    fresh = notices.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh.join(ledger, ["topic", "key"], "left_anti")


def deliver(notices: DataFrame, ledger_path: str, send, checkpoint: str) -> StreamingQuery:
    """Send what isn't in the ledger, then write it there: at least once, never forgotten. ``send`` gets a DataFrame."""

    def batch(rows: DataFrame, number: int) -> None:
        spark: SparkSession = rows.sparkSession
        ledger = spark.read.schema("topic string, key string").parquet(ledger_path)
        due = unsent(rows, ledger).checkpoint()
        send(due)
        due.select("topic", "key").write.mode("append").parquet(ledger_path)

    return notices.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(nonces: DataFrame, at: str, key: str, life: str) -> DataFrame:
    """Each key once within its life, counted from the use that was accepted; later repeats are new.

    On a stream the state of a key goes when the watermark passes the end of its life.  On a table the uses of one
    key, which a sound client never makes many of, are walked in order of time by one task.
    """
    if nonces.isStreaming:
        return nonces.withWatermark(at, life).dropDuplicatesWithinWatermark([key])
    seconds = F.expr(f"cast(interval {life} as interval day to second)")
    marked = nonces.withColumn("_from", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_until", F.unix_micros(F.col(at).cast("timestamp") + seconds))

    def accepted(rows: pd.DataFrame) -> pd.DataFrame:
        rows, keep, until = rows.sort_values("_from", kind="stable"), [], None
        for begin, end in zip(rows["_from"], rows["_until"], strict=True):
            fresh = until is None or begin > until
            until = end if fresh else until
            keep.append(fresh)
        return rows[keep]

    return marked.groupBy(key).applyInPandas(accepted, marked.schema).drop("_from", "_until")


def latest(readings: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Last value of each feed by time, ties by value."""
    return readings.groupBy(by).agg(F.max(at).alias("at"), F.max_by(value, F.struct(at, value)).alias("value"))


def sticky_cohorts(casts: DataFrame, ttl_seconds: int) -> DataFrame:
    """(voter, at, cohort): the cohort that holds after each cast, replaced only when older than its life.

    ``casts`` has voter, at (timestamp) and cohort; the same fold runs on a table and, per key, on a stream.
    """

    def fold(held: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, list]:
        out = []
        for at, cohort in zip(rows["at"], rows["cohort"], strict=True):
            if held is None or (at - held[1]).total_seconds() > ttl_seconds:
                held = cohort, at
            out.append(held[0])
        return held, out

    schema = "voter long, at timestamp, cohort string"
    if not casts.isStreaming:

        def group(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["at", "cohort"])
            return rows.assign(cohort=fold(None, rows)[1])[["voter", "at", "cohort"]]

        return casts.select("voter", F.col("at").cast("timestamp").alias("at"), "cohort").groupBy("voter").applyInPandas(group, schema)

    def stream(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        for rows in frames:
            rows = rows.sort_values(["at", "cohort"])
            held, out = fold(held, rows)
            yield rows.assign(cohort=out)[["voter", "at", "cohort"]]
        if held is not None:
            state.update(held)
            # a cohort that is over needs no state; the watermark has to pass its end
            over = int(held[1].timestamp() * 1000) + 1000 * ttl_seconds + 1
            state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))

    timed = casts.withWatermark("at", "1 hour")
    return timed.groupBy("voter").applyInPandasWithState(stream, schema, "cohort string, at timestamp", "append", GroupStateTimeout.EventTimeTimeout)
