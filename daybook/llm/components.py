"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the vertex; no neighbour list is gathered.  A vertex with very many links
is a hot key: its minimum is combined on the map side, and ``common.join_split`` broadcasts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ``m``, the least of each ``u`` and its neighbours; one row a vertex with ``m``)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
    least = common.materialise(least, "least")
    return common.join_split(edges, least, "u", "rows"), least


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    held, first = _with_least(both)
    large = common.materialise(held.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
    held, second = _with_least(large)
    small = held.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = common.materialise(small.union(second.select("u", F.col("m").alias("v"))).distinct(), "edges")
    common.discard(first, second, large)
    return out


def components(pairs: DataFrame) -> DataFrame:
    """(member, root) of every vertex that isn't the smallest of its component; ``pairs`` has columns a and b."""
    edges = pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.materialise(edges, "edges")
    mark = None
    while True:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == mark or not row["n"]:
            return edges.select(F.col("u").alias("member"), F.col("v").alias("root"))
        mark, last = (row["n"], row["s"]), edges
        edges = _round(edges)
        common.discard(last)
