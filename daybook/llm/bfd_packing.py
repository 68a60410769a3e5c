"""Best-fit-decreasing packing of token ids into fixed rows, written as binary matrices.

Texts are tokenised, documents longer than a row are split without loss, and pieces are dealt at random to shards
of a bounded number of bytes (a text never has more tokens than bytes).  Each shard is packed by itself: pieces in
falling order of length go to the row with the least room that still holds them, found in a segment tree over the
room left, one leaf per capacity.  A shard's outcome is one file of row-major ids, padded, and one of segment ends
and position resets:

* ``<shard>.ids``: little-endian ids, ``rows x context``, two bytes an id (four for vocabularies over 65,536);
* ``<shard>.cu``: little-endian int64: the number of rows, then for every row its number of ends followed by the
  cumulative segment lengths ``0, l1, l1 + l2, ...``;
* ``<shard>.reset``: int64 offsets into the flat matrix at which the position starts from 0 again.

Defined results: null and empty texts have no token and no piece; rows with equal ids are packed one by one (those
that are equal in id and text as well go to one shard); which shard a piece goes to depends on its id, number and
tokens only; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, files

CONTEXT = 4096
SHARD_BYTES = 16 << 20
VOCABULARY = "byte_bpe_50k.tiktoken"
SEGMENT = "doc_id long, piece long, start long, n_tokens long, shard string, row long, offset long"


class RoomTree:
    """Which capacities 1..top have an open row; ``least(n)`` is the smallest that holds ``n``."""

    def __init__(self, top: int):
        self.size = 1 << (top + 1 - 1).bit_length() if top else 1
        while self.size <= top:
            self.size *= 2
        self.held = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        if not room:
            return
        self.rows.setdefault(room, []).append(row)
        node = self.size + room
        while node:
            self.held[node] += 1
            node >>= 1

    def take(self, room: int) -> int:
        row = self.rows[room].pop()
        node = self.size + room
        while node:
            self.held[node] -= 1
            node >>= 1
        return row

    def least(self, need: int) -> int:
        """The smallest capacity of ``need`` or more with an open row, 0 if there is none."""
        node = self.size + need
        if self.held[node]:
            return need
        while node > 1:
            if not node & 1 and self.held[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.held[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return 0


def best_fit(lengths: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row of each piece, offset in it, number of rows); lengths are 1..context, ties keep their order."""
    tree, n_rows = RoomTree(context), 0
    row, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.least(n)
        if room:
            at = tree.take(room)
        else:
            room, at, n_rows = context, n_rows, n_rows + 1
        row[i], offset[i] = at, context - room
        tree.add(room - n, at)
    return row, offset, n_rows


@cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE = "doc_id long, piece long, start long, ids binary"


def encoded(path: str | None, context: int, wide: bool):
    """Task function: (doc_id, text) to ``PIECE`` rows of at most ``context`` little-endian ids."""
    kind = np.dtype("<u4" if wide else "<u2")
    names = ["doc_id", "piece", "start", "ids"]

    def run(batches):
        own = encoder(path or vocabulary_path())
        if own.max_token_value >= 1 << 8 * kind.itemsize:
            raise ValueError("this vocabulary needs wide=True")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = own.encode_to_numpy(text, disallowed_special=()).astype(kind) if text else ()
                rows += [(doc_id, k, at, ids[at : at + context].tobytes()) for k, at in enumerate(range(0, len(ids), context))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    return run


def _pack(folder: str, context: int, wide: bool, pad: int):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=list(zip(table.column("doc_id").fill_null(-1).to_pylist(), table.column("piece").to_pylist(), table.column("ids").to_pylist(), strict=True)).__getitem__)
        table = table.take(pa.array(order))
        ids = table.column("ids").to_pylist()
        lengths = np.array([len(x) // kind.itemsize for x in ids], np.int64)
        row, offset, n_rows = best_fit(lengths, context)
        matrix = np.full(n_rows * context, pad, kind)
        for i, (r, o) in enumerate(zip(row.tolist(), offset.tolist(), strict=True)):
            matrix[r * context + o : r * context + o + lengths[i]] = np.frombuffer(ids[i], kind)
        resets = np.sort(row * context + offset)
        ends: list[list[int]] = [[0] for _ in range(n_rows)]
        for i in np.lexsort([offset, row]).tolist():
            ends[row[i]].append(int(offset[i] + lengths[i]))
        cumulative = [n_rows] + [x for e in ends for x in (len(e), *e)]
        name = files.fresh(folder, "")
        files.write_all(f"{name}.ids", matrix.tobytes())
        files.write_all(f"{name}.cu", np.array(cumulative, "<i8").tobytes())
        files.write_all(f"{name}.reset", resets.astype("<i8").tobytes())
        shard = pa.array([name] * len(ids), pa.string())
        columns = [*(table.column(c) for c in ("doc_id", "piece", "start")), pa.array(lengths), shard, pa.array(row), pa.array(offset)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [x.split()[0] for x in SEGMENT.split(", ")])

    return run


def read_shard(shard: str, context: int = CONTEXT, *, wide: bool = False) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(id matrix, cumulative segment lengths of each row, position of every id) of a written shard."""
    matrix = np.frombuffer(files.read_all(f"{shard}.ids"), "<u4" if wide else "<u2").reshape(-1, context)
    flat = np.frombuffer(files.read_all(f"{shard}.cu"), "<i8")
    ends, at = [], 1
    for _ in range(int(flat[0])):
        ends.append(flat[at + 1 : at + 1 + flat[at]])
        at += 1 + int(flat[at])
    resets = np.frombuffer(files.read_all(f"{shard}.reset"), "<i8")
    start = np.zeros(matrix.size, np.int64)
    start[resets] = resets
    return matrix, ends, (np.arange(matrix.size) - np.maximum.accumulate(start)).reshape(matrix.shape)


def pack(docs: DataFrame, folder: str | None = None, *, path: str | None = None, context: int = CONTEXT, wide: bool = False, pad: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, piece, start, n_tokens, shard, row, offset) of every piece; ``shard`` is the path of its files, in ``folder``.

    ``path`` names a vocabulary file of byte-pair ranks that all executors have.  The rows are committed before they
    are returned, and name only files of tasks that ended well.
    """
    spark = docs.sparkSession
    folder = folder or common.work_path(spark, "packed")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    pieces = slim.mapInArrow(encoded(path, context, wide), PIECE)
    # by what a piece is, so that the packing is the same however the table is split; null ids spread as well
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(shards)))
    packed = dealt.groupBy("deal").applyInArrow(_pack(folder, context, wide, pad), SEGMENT)
    with common.batches_of(spark, 4 << 20, rows=500):
        return common.materialise(packed, "segments")
