"""Tables of keyed rows that change in place: only the parts that a change touches are written anew."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work


@dataclass(frozen=True)
class Keyed:
    """Rows dealt by a hash of ``key`` into ``count`` parts, each a folder of some version of the table.

    A change reads the parts that hold its keys and writes them under a new version; the other parts stay where they
    are, and the old version stays readable until ``forget``.  The driver holds one path a part.
    """

    spark: SparkSession
    root: str
    key: str
    schema: str
    count: int
    version: int = 0
    parts: Mapping[int, str] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: DataFrame, key: str, count: int = 32, root: str | None = None) -> Keyed:
        spark = rows.sparkSession
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return cls(spark, root or work.fresh(spark, "keyed"), key, schema, count)._written(rows, {})

    def part(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.count)).cast("int")

    def _written(self, rows: DataFrame, others: Mapping[int, str]) -> Keyed:
        path = f"{self.root}/v{self.version}"
        rows.withColumn("__part", self.part()).repartition(self.count, "__part").write.partitionBy("__part").option("compression", "zstd").parquet(path)
        made = self.spark.read.schema(self.schema + ", __part int").parquet(path).select("__part").distinct().collect()
        return replace(self, parts={**others, **{r[0]: path for r in made}})

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        paths = [f"{self.parts[p]}/__part={p}" for p in sorted(self.parts if parts is None else set(parts) & set(self.parts))]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, changes: DataFrame) -> list[int]:
        return [r[0] for r in changes.select(self.part()).distinct().collect()]

    def change(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> Keyed:
        """The table after ``combine(rows, changes)`` of the parts that hold a key of ``changes``."""
        parts = self.touched(changes)
        if not parts:
            return self
        names = [c for c in self.spark.createDataFrame([], self.schema).columns]
        after = combine(self.rows(parts), changes).select(*[f"`{c}`" for c in names])
        return replace(self, version=self.version + 1)._written(after, {p: v for p, v in self.parts.items() if p not in parts})

    def forget(self) -> None:
        """Delete the versions that no part is read from."""
        used = set(self.parts.values())
        for v in range(self.version):
            if f"{self.root}/v{v}" not in used:
                work.remove(self.spark, f"{self.root}/v{v}")
