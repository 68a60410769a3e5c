"""Mixing sources to target weights, with DataFrame functions only.

Each source gets a budget of words from its weight.  Rows get hash-random keys, each source is cut into key
ranges and sorted inside them, prefix sums over ranges and rows place every document on a line from 0 to the
size of its source, and the budget is a cut on that line; budgets above one source size repeat whole epochs.
Rows that are equal in id, source and text are counted before the shuffle and travel as one.

The targets need one row per source in one place, aggregated with map-side combine before it: right for sources that
number up to some millions (crawls, not pages).

Defined results: null text has size 0; a null source is a source of its own, ordered last; rows with equal ids
are placed one by one (ties by id, size, then a hash of the row); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

KEY_SPACE = 1 << 62


def sized(docs: DataFrame, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Slim table of distinct rows: id, source, size in words, row key, random key and how many rows are equal."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        common.word_count(F.col("text").cast("string")).alias("size"),
        common.row_key(columns or ["doc_id", "text", "source"]).alias("row_key"),
    )
    slim = slim.groupBy("doc_id", "source", "size", "row_key").agg(F.count("*").alias("_rows"))
    return slim.withColumn("_key", F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed)), F.lit(KEY_SPACE)))


def targets(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last.

    Levels are filled exactly: sources are ordered by the level at which they reach their limit, and those below
    the final level stay at ``max_epochs`` sizes.  The table has one row per source, aggregated with map-side
    combine before these windows.
    """
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(max_epochs))
    line = W.orderBy("_level", F.col("source").asc_nulls_last())
    upto, rest = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    filled = (
        sources.withColumn("_weight", weight)
        .withColumn("_level", limit / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_limited", F.coalesce(F.sum(limit).over(upto), F.lit(0.0)))
        .withColumn("_free", F.sum("_weight").over(rest))
        .withColumn("_fill", (F.col("_total") - F.col("_limited")) / F.col("_free"))
    )
    # the level is right at the first source, in this order, that stays below its limit
    level = F.min(F.when(F.col("_fill") < F.col("_level"), F.struct("_level", "_fill"))).over(everything)["_fill"]
    target = F.when(level.isNull(), limit).otherwise(F.least(limit, F.col("_weight") * level))
    return filled.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it.  Rows equal in all columns come out together."""
    spark = docs.sparkSession
    key = {"__id": F.col("doc_id").cast("long"), "__key": common.row_key(docs.columns)}
    with common.only_last(spark):
        taken = placed(docs, columns=docs.columns, **options)
        taken = taken.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "copies", "_rows")
        taken = taken.groupBy("__id", "__key").agg(F.sum("copies").alias("__copies"), F.max("_rows").alias("__rows")).where("__copies > 0")
        taken = common.materialise(taken, "taken")
    on = ["__id", "__key"]

    def joined(rows: DataFrame, part: DataFrame) -> DataFrame:
        right = part.select(F.col("__id").alias("__i"), F.col("__key").alias("__k"), "__copies")
        return rows.withColumns(key).join(right, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__k")))

    single = joined(docs, taken.where("__rows = 1"))
    several = joined(docs, taken.where("__rows > 1")).dropDuplicates(on)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")
    return single.unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns], copies).drop("__copy")


def placed(
    docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0, columns: list[str] | None = None
) -> DataFrame:
    """``mix``, and ``_rows``: how many rows are equal in ``columns``.  Equal rows lie one behind the other on the line."""
    rows = common.materialise(sized(docs, seed, columns), "mix")
    budget = targets(rows, weights, share, max_epochs).withColumnRenamed("source", "_s")
    lines = common.running_sums(rows.withColumn("_all", F.col("size") * F.col("_rows")), "source", "_key", ["doc_id", "size", "row_key"], "_all", "_before")
    out = common.attach(lines, budget, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_all")
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    left = F.col("target") - epochs * F.col("source_size")
    out = out.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)))
    # the document that holds the cut is taken if most of it lies before the cut
    copies = epochs + (F.col("_before") + F.col("_nth") * F.col("size") + F.col("size") / 2 < left).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_key", "_before", "_nth")


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, row_key, source_size, target, copies, taken): ``copies`` is how often the mix repeats a row.

    Options are those of ``placed``.
    """
    return placed(docs, **options).drop("_rows")
