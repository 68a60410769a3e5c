"""Joins on nearness and containment as equi-joins on time buckets, so no pair outside a bucket is ever built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(at: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def within(left: DataFrame, right: DataFrame, left_at: str, right_at: str, seconds: int) -> DataFrame:
    """All pairs less than ``seconds`` apart; each right row is filed in its bucket and both neighbours."""
    near = F.explode(F.array(*[_bucket(right_at, seconds) + d for d in (-1, 0, 1)]))
    apart = F.abs(F.unix_micros(F.col(left_at).cast("timestamp")) - F.unix_micros(F.col(right_at).cast("timestamp")))
    met = left.withColumn("__bucket", _bucket(left_at, seconds)).join(right.withColumn("__bucket", near), "__bucket")
    return met.where(apart < seconds * 1_000_000).drop("__bucket")


def containing(points: DataFrame, spans: DataFrame, at: str, first: str, last: str, days: int = 32) -> DataFrame:
    """Each point with the spans of days that hold it, ends included; a span is filed in every bucket that it touches."""
    number = lambda c: F.floor(F.unix_date(F.col(c)) / days).cast("long")
    filed = spans.withColumn("__bucket", F.explode(F.sequence(number(first), number(last))))
    met = points.withColumn("__bucket", number(at)).join(filed, "__bucket")
    return met.where((F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last))).drop("__bucket")


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of the same key at or before its time: one union and one window, no range join."""
    from pyspark.sql import Window as W

    sides = left.withColumns({"__at": F.col(left_at), "__value": F.lit(None).cast(right.schema[value].dataType), "__left": F.lit(True)})
    events = right.select(F.col(key), F.col(right_at).alias("__at"), F.col(value).alias("__value"), F.lit(False).alias("__left"))
    line = W.partitionBy(key).orderBy("__at", "__left", "__value").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = sides.unionByName(events, allowMissingColumns=True).withColumn(value, F.last("__value", ignorenulls=True).over(line))
    return filled.where("__left").drop("__at", "__value", "__left")
