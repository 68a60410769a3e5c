"""Tables that change: keyed upserts with columns that survive, ledgers of attempts, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, preserve: tuple[str, ...] = ()) -> DataFrame:
    """``new`` over ``old`` by key; columns in ``preserve`` keep the old value where there is one."""
    fresh = new.select(F.col(key).alias("__key"), F.struct(*[F.col(c) for c in new.columns]).alias("__new"))
    met = old.join(fresh, F.col(key) == F.col("__key"), "full_outer")

    def value(c: str):
        if c == key:
            return F.coalesce(key, "__key")
        if c in preserve:
            return F.coalesce(F.col(c), F.col("__new")[c]) if c in new.columns else F.col(c)
        return F.when(F.col("__key").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)) if c in new.columns else F.col(c)

    return met.select(*[value(c).alias(c) for c in old.columns])


def fetch_ledger(attempts: DataFrame) -> DataFrame:
    """(date_id, status, sha256, fetched_at, error) from attempts in order of ``at``: a failure keeps the last page's facts."""
    good = F.col("status") == 200
    return attempts.groupBy("date_id").agg(
        F.max_by("status", "at").alias("status"), F.max_by("sha256", F.when(good, F.col("at"))).alias("sha256"),
        F.max(F.when(good, F.col("at"))).alias("fetched_at"), F.max_by("error", "at").alias("error"),
    )


def snapshot(rows: DataFrame, key: str, order: list[str], keep) -> DataFrame:
    """A feed that replaces its predecessor: rows that pass ``keep``, the first of each key."""
    first = W.partitionBy(key).orderBy(*order)
    return rows.where(keep).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def orphans_removed(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_semi")


def merged(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Union by key; a row that is already there wins."""
    return own.unionByName(other.join(own.select(key), key, "left_anti").dropDuplicates([key]))
