"""Packing by optimal length buckets.

Texts are tokenised and documents longer than the context split into pieces without loss.  The histogram of piece
lengths is aggregated over all rows; it has at most ``context`` entries whatever the input, so the driver runs the
dynamic program over it that chooses the bucket boundaries with the least padding.  The histogram also says how many
shards of a bounded size each bucket needs; pieces are dealt to the shards of their bucket by hash.  The dealt pieces are
written as a bucketed table, so that neither the first table of pieces nor the shuffle is left when the batches are
written.  A shard orders its pieces by hash, every ``token_budget // boundary`` of them make a batch, and the shard is
written as

* ``<shard>.ids``: little-endian ids, ``rows x boundary``, padded at the end of each row, batch after batch;
* ``<shard>.len``: little-endian int32, the tokens of each row.

Only the last batch of a shard may have fewer rows.  ``padding`` reports what the boundaries cost.

Defined results: null and empty texts have length 0 and give no piece; rows with equal ids are packed one by
one (those equal in id and text go to one shard); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bfd_packing, common, files

CONTEXT, BUCKETS, TOKEN_BUDGET = 4096, 12, 65_536
SHARD_BYTES = 16 << 20
#: Files of the table of dealt pieces at most; beyond it one holds several shards.
MOST_FILES = 20_000
ROW = "doc_id long, piece long, start long, n_tokens long, bucket_len long, shard string, batch long, slot long"


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Bucket upper ends, ascending, that minimise the padding ``sum(count * (end - length))``; O(buckets * n^2)."""
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, float)[order], np.asarray(counts, float)[order]
    size = len(x)
    if not size:
        return []
    rows = np.concatenate([[0.0], np.cumsum(n)])
    # padded tokens of a bucket over entries j..i-1 are x[i-1] * (rows[i] - rows[j]); real tokens are constant
    best = np.full(size + 1, np.inf)
    best[0] = 0.0
    choice = []
    for _ in range(min(buckets, size)):
        nxt, arg = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
        nxt[0] = 0.0
        for i in range(1, size + 1):
            cost = best[:i] + x[i - 1] * (rows[i] - rows[:i])
            arg[i] = int(np.argmin(cost))
            nxt[i] = cost[arg[i]]
        choice.append(arg)
        best = nxt
    ends, i = [], size
    for arg in reversed(choice):
        if i == 0:
            break
        ends.append(int(x[i - 1]))
        i = int(arg[i])
    return sorted(set(ends))


def _by_length(length: Column, values: dict[int, int]) -> Column:
    """The value of the smallest boundary that holds ``length``."""
    out = F.lit(None).cast("long")
    for end in sorted(values, reverse=True):
        out = F.when(length <= end, F.lit(values[end]).cast("long")).otherwise(out)
    return out


def _write(folder: str, token_budget: int, wide: bool, pad: int):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("ids").to_pylist()
        keys = list(zip(table.column("key").to_pylist(), ids, strict=True))
        order = sorted(range(len(ids)), key=keys.__getitem__)
        table, ids = table.take(pa.array(order)), [ids[i] for i in order]
        width, n = int(table.column("bucket_len")[0].as_py()), len(ids)
        lengths = np.array([len(x) // kind.itemsize for x in ids], "<i4")
        matrix = np.full((n, width), pad, kind)
        for row, x in zip(matrix, ids, strict=True):
            row[: len(x) // kind.itemsize] = np.frombuffer(x, kind)
        name = files.fresh(folder, "")
        files.write_all(f"{name}.ids", matrix.tobytes())
        files.write_all(f"{name}.len", lengths.tobytes())
        place, per_batch = np.arange(n), max(1, token_budget // width)
        columns = [table.column(c).combine_chunks() for c in ("doc_id", "piece", "start")]
        columns += [pa.array(lengths.astype(np.int64)), table.column("bucket_len").combine_chunks(), pa.array([name] * n), pa.array(place // per_batch), pa.array(place % per_batch)]
        return pa.Table.from_arrays(columns, [x.split()[0] for x in ROW.split(", ")])

    return run


def read_batch(shard: str, bucket_len: int, batch: int, *, token_budget: int = TOKEN_BUDGET, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(padded ids, tokens of each row) of a written batch."""
    per_batch = max(1, token_budget // bucket_len)
    matrix = np.frombuffer(files.read_all(f"{shard}.ids"), "<u4" if wide else "<u2").reshape(-1, bucket_len)
    lengths = np.frombuffer(files.read_all(f"{shard}.len"), "<i4")
    return matrix[batch * per_batch : (batch + 1) * per_batch], lengths[batch * per_batch : (batch + 1) * per_batch]


def pack(
    docs: DataFrame, folder: str | None = None, *, path: str | None = None, context: int = CONTEXT, buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET, wide: bool = False, pad: int = 0, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket_len, shard, batch, slot); a batch is (shard, batch), its files are written.

    ``shard`` is the path of the files, in ``folder``; ``path`` names a vocabulary file that all executors have.
    """
    spark = docs.sparkSession
    folder = folder or common.work_path(spark, "buckets")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 4 if wide else 2
    with common.only_last(spark), common.batches_of(spark, 4 << 20, rows=500):
        pieces = common.materialise(slim.mapInArrow(bfd_packing.encoded(path, context, wide), bfd_packing.PIECE), "pieces")
        rows = pieces.withColumn("n_tokens", F.expr(f"octet_length(ids) div {width}"))
        found = {r[0]: r[1] for r in rows.groupBy("n_tokens").count().collect()}  # at most ``context`` rows
        ends = boundaries(list(found), list(found.values()), buckets)
        held = {end: sum(n for size, n in found.items() if low < size <= end) for low, end in zip([0, *ends], ends, strict=False)}
        shards = {end: max(1, -(-n * end * width // shard_bytes)) for end, n in held.items()}
        rows = rows.withColumn("bucket_len", _by_length(F.col("n_tokens"), {end: end for end in ends}))
        rows = rows.withColumn("key", F.xxhash64("doc_id", "piece", "ids"))
        deal = F.pmod(F.xxhash64("key", F.lit(1)), _by_length(F.col("n_tokens"), shards))
        dealt = rows.withColumn("place", F.shiftleft("bucket_len", 32) + deal)
        tasks = min(MOST_FILES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(shards.values())))
        with common.bucketed(dealt.drop("n_tokens"), "place", tasks) as table:
            common.discard(pieces)
            packed = table.groupBy("place").applyInArrow(_write(folder, token_budget, wide, pad), ROW)
            return common.materialise(packed, "batches")


def padding(packed: DataFrame) -> DataFrame:
    """(bucket_len, n_rows, n_tokens, n_padding) of each bucket."""
    sums = packed.groupBy("bucket_len").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))
    return sums.withColumn("n_padding", F.col("bucket_len") * F.col("n_rows") - F.col("n_tokens"))
