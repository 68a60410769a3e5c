"""Pictures that run again: near fingerprints, their groups, and what changed from run to run."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RADIUS = 8
LEAST_BITS = 4


def sign_prints(vectors: DataFrame) -> DataFrame:
    """(id, print): one bit per coordinate above 0, as a long, of vectors of at most 64 coordinates."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = F.aggregate(F.transform("embedding", bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return vectors.select(F.col("vec_id").alias("id"), bits.alias("print"))


#: A print is cut into so many blocks; prints within the radius agree in ``BLOCKS - radius`` of them.
BLOCKS = 11


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance) of all different prints of 64 bits within ``radius``, flat prints left out.

    Prints within the radius agree in all but ``radius`` blocks, so an equi-join on every choice of the others finds
    each pair; longer keys meet fewer strangers than single bands.  A pair counts in the first choice that it agrees
    in.  Equal prints are one class, expanded to their members by the caller.
    """
    detailed = prints.where((F.bit_count("print") >= LEAST_BITS) & (F.bit_count("print") <= 64 - LEAST_BITS)).select("print").distinct()
    blocks = max(BLOCKS, radius + 1)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [_signed((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    choices = list(combinations(range(blocks), blocks - radius))
    kept = [_signed(sum(masks[i] & (1 << 64) - 1 for i in choice)) for choice in choices]
    # for every set of blocks that differ, the first choice without any of them
    first = [next((n for n, c in enumerate(choices) if not any(differ >> i & 1 for i in c)), -1) for differ in range(1 << blocks)]
    # the optimiser takes the filed rows to be as few as the prints and would send them all through the driver
    filed = detailed.select("print", F.posexplode(F.array(*[F.lit(m).cast("long") for m in kept])).alias("choice", "mask"))
    filed = filed.select("print", "choice", F.col("print").bitwiseAND(F.col("mask")).alias("key"))
    both = filed.withColumnRenamed("print", "a").hint("merge").join(filed.withColumnRenamed("print", "b"), ["choice", "key"])
    near = both.withColumn("differ", F.col("a").bitwiseXOR(F.col("b"))).where((F.col("a") < F.col("b")) & (F.bit_count("differ") <= radius))
    changed = sum((F.when(F.col("differ").bitwiseAND(F.lit(m).cast("long")) != 0, 1 << i).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    own = F.get(F.lit(first), changed)
    return near.where(own == F.col("choice")).select("a", "b", F.bit_count("differ").alias("distance"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def groups(edges: DataFrame, checkpoint=None) -> DataFrame:
    """(member, root): connected components by hooking to the smallest neighbour and halving paths until nothing moves.

    ``checkpoint`` cuts the lineage of a round; by default the session's reliable checkpoint.
    """
    checkpoint = checkpoint or (lambda df: df.checkpoint())
    pairs = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpoint(pairs.groupBy(F.col("a").alias("member")).agg(F.min("b").alias("m")).select("member", F.least("member", "m").alias("root")))
    while True:
        seen = pairs.join(labels, pairs.b == labels.member).groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(seen, labels.member == seen.a).select("member", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("member").alias("_m"), F.col("root").alias("_r"))
        moved = checkpoint(hooked.join(jump, hooked.root == jump._m, "left").select("member", F.least("root", F.coalesce("_r", "root")).alias("root"), "was"))
        if moved.where("root <> was").limit(1).count() == 0:
            return moved.select("member", "root")
        labels = moved.select("member", "root")


def appearances(runs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Per run of a group: days since the run before and a flag per field that changed; the first run has none.

    ``runs`` has grp, date_id and the columns that ``fields`` maps flags to.
    """
    before = W.partitionBy("grp").orderBy("date_id")
    first = F.row_number().over(before) == 1
    flags = [(~first & ~F.col(c).eqNullSafe(F.lag(c).over(before))).alias(flag) for flag, c in fields.items()]
    return runs.select("grp", "date_id", (F.col("date_id") - F.lag("date_id").over(before)).alias("days_since"), *flags)


def group_listing(runs: DataFrame) -> DataFrame:
    """(grp, shown, first, last, titles) of groups."""
    return runs.groupBy("grp").agg(F.count("*").alias("shown"), F.min("date_id").alias("first"), F.max("date_id").alias("last"), F.count_distinct("title").alias("titles"))


