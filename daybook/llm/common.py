"""Shared pieces of the training-data operators: work tables, word rules and rank sums."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are not ASCII white space; ``bytes.split()`` follows the same rule.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir`` or ``setCheckpointDir``.

    Only a session whose executors are the driver itself may go without; it gets a temporary folder.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="daybook-"))
    return _own_dir[0]


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/daybook/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors.

    The shuffle files of the job go as soon as the table is written, since nothing reads them again.
    """
    path = work_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    for made in _watching:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, buckets: int):
    """``df`` as a table of one file per hash bucket of ``key``, so that grouping by ``key`` needs no shuffle.

    The table lies in the warehouse and is dropped at the end of the block.
    """
    spark, name = df.sparkSession, f"daybook_bucketed_{uuid.uuid4().hex}"
    try:
        with shuffles_removed(spark):
            df.repartition(buckets, key).write.option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name, format="parquet")
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete work tables that no later plan reads."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/daybook/" in name:
                _remove(df.sparkSession, name)


_watching: list[list[str]] = []


@contextmanager
def only_last(spark: SparkSession):
    """Delete the work tables that the block writes, but for the last one; for blocks that end in ``materialise``."""
    made: list[str] = []
    _watching.append(made)
    try:
        yield
    finally:
        # by identity: nested blocks may hold equal lists
        _watching[:] = [x for x in _watching if x is not made]
        for name in made[:-1]:
            _remove(spark, name)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings that hold while the block's jobs run; those of before come back."""
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def batches_of(spark: SparkSession, size: int = 16 << 20, rows: int | None = None):
    """Bound the bytes (and rows) of an Arrow batch while the block's jobs run."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    if rows:
        wanted["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(rows)
    return _settings(spark, wanted)


def shuffles_removed(spark: SparkSession):
    """Delete the shuffle files of each of the block's jobs when it ends, not when the driver collects garbage."""
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def row_key(columns: list[str], seed: int = 0) -> Column:
    """A hash of a row's values that tells a null from its neighbour's; to be used together with the id."""
    parts: list[Column] = [F.lit(seed)]
    for c in columns:
        parts += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`")]
    return F.xxhash64(*parts)


def word_count(text: Column) -> Column:
    """Number of words, null text counts 0; ASCII white space only, evaluated in the JVM."""
    words = F.regexp_count(text, F.lit(WORD_PATTERN))
    return F.coalesce(words, F.lit(0)).cast("long")


def running_sums(rows: DataFrame, group: str, key: str, tie: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that come earlier in order of ``key``.

    ``key`` holds uniform random non-negative longs below 2**62.  Each group is cut into about sqrt(n) equal
    ranges of the key, so neither a range nor the list of ranges of a group holding billions of rows is large:
    range totals are aggregated with map-side combine, their prefix sums come from a window over the few
    ranges of a group, and a second window orders the rows inside each range.
    ``rows`` should be a materialised, slim table as it is read three times.
    """
    from pyspark.sql import Window as W

    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    sizes = sizes.select(F.col(group).alias("_g"), F.ceil(F.sqrt("_n")).cast("long").alias("_ranges"))
    ranged = attach(rows, sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    ranged = ranged.withColumn("_range", F.expr(f"{key} div (4611686018427387904L div _ranges)")).drop("_ranges")
    totals = ranged.groupBy(group, "_range").agg(F.sum(value).alias("_total"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(group, "_range").orderBy(key, *tie).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    return joined.withColumn(out, F.col("_inner") + F.col("_offset")).drop("_inner", "_offset", "_g", "_r", "_range")


#: Rows of a table of group parameters that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def attach(df: DataFrame, small: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table with one row per group: broadcast once its size is checked, else a shuffled join that AQE splits."""
    small = materialise(small, "groups")
    if small.limit(rows + 1).count() <= rows:
        return df.join(F.broadcast(small), on, how)
    return df.join(small.hint("merge"), on, how)


#: A key that holds more than this share of the rows counts as hot, so there are fewer hot keys than this.
HOT_SHARE = 2_000


def join_split(big: DataFrame, small: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """Join ``big`` to ``small`` on ``key``, where ``rows`` in ``small`` is how many rows of ``big`` a key has.

    The few keys that hold more than 1/HOT_SHARE of the rows each are broadcast, so no task gathers one; the others
    are shuffled.  ``small`` has one row a key and should be a materialised table, as it is read three times.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    limit = max(1000, total // HOT_SHARE)
    hot = F.broadcast(small.where(F.col(rows) > limit).drop(rows))
    cold = small.where(F.col(rows) <= limit).drop(rows)
    spread = big.join(hot, key)
    gathered = big.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return spread.unionByName(gathered)
