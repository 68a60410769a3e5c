"""What readers have read, as bitmaps: a row per reader and 64 ids in a row of which some were read.

A bitmap is a long, so a reader with few reads has few and narrow rows, and sums of them stay in fixed space; increments
are combined with ``or``, so reads may come twice and in any order.  Filters and prefix counts look a bit up, or count
the bits of a piece, without listing what was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids in a bitmap: bucket b holds ids from b * 64.
SPAN = 64


def _bucket(date_id: Column) -> Column:
    return F.shiftright(date_id.cast("long"), 6)


def _bit(date_id: Column) -> Column:
    return F.pmod(date_id, F.lit(SPAN)).cast("int")


def read_sets(reads: DataFrame) -> DataFrame:
    """(reader, bucket, bitmap) of reads (reader, date_id)."""
    at = F.col("date_id")
    rows = reads.select("reader", _bucket(at).alias("bucket"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(at)).alias("bit"))
    return rows.groupBy("reader", "bucket").agg(F.bit_or("bit").alias("bitmap"))


def merged(*sets: DataFrame) -> DataFrame:
    """Read sets of several times as one."""
    both = sets[0]
    for s in sets[1:]:
        both = both.unionByName(s)
    return both.groupBy("reader", "bucket").agg(F.bit_or("bitmap").alias("bitmap"))


def holds(bitmap: Column, date_id: Column) -> Column:
    """Whether the bit of an id is set; no bitmap holds nothing."""
    return F.coalesce(F.getbit(bitmap, _bit(date_id)) == 1, F.lit(False))


def unread(entries: DataFrame, sets: DataFrame, reader) -> DataFrame:
    """Entries that a reader hasn't read: one bitmap a bucket is met."""
    own = sets.where(F.col("reader") == reader).select("bucket", "bitmap")
    met = entries.withColumn("bucket", _bucket(F.col("date_id"))).join(own, "bucket", "left")
    return met.where(~holds(F.col("bitmap"), F.col("date_id"))).drop("bucket", "bitmap")


def read_before(sets: DataFrame, date_id: int) -> DataFrame:
    """(reader, n): how many ids up to and with this one each reader has read, from whole bitmaps and a piece of one."""
    bucket, bit = date_id // SPAN, date_id % SPAN
    piece = F.col("bitmap").bitwiseAND(F.lit((1 << (bit + 1)) - 1 if bit < SPAN - 1 else -1).cast("long"))
    n = F.when(F.col("bucket") < bucket, F.bit_count("bitmap")).when(F.col("bucket") == bucket, F.bit_count(piece)).otherwise(0)
    return sets.groupBy("reader").agg(F.sum(n).alias("n"))
