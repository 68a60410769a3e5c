"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find near fingerprints.

``fingerprint`` hashes every three-word term of a text to 64 bits; each term votes on every bit with a whole-number
weight, the number of binary digits of its count, and the sign of the sum is the bit (a tie is 0).  The sums are
exact, so no order or processor changes a bit.  Two fingerprints of texts whose terms make the angle ``a`` differ in
about ``64 * a / pi`` bits.

``next_edits`` fingerprints every text and its edited text, whose second half is the start of the next document.
Rows are range-sorted by id once (texts travel compressed), every task walks through its range in order, and only
the last row of a range is finished in a second, small step with the first row of the following range.

``near_counts`` cuts 64 bits into blocks.  At most ``radius`` blocks differ between two fingerprints within the
radius, so each is filed in one table per choice of the other blocks, under these blocks' bits, and every near pair
meets in a table; equal fingerprints are one class throughout.  Each class gets the number of other classes within
the radius.  A pair counts in the first of the tables that it meets in and is never put out; a place of a table with
many classes is cut into parts and its pairs of parts are spread over tasks.  ``near_pairs`` puts the pairs out.

Defined results: null text is empty; a text without words has the fingerprint 0, one or two words make one term;
rows with equal ids are ordered by a hash of their text; null ids come last; the row after the last is the first;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BITS = 64
TERM_WORDS = 3
RADIUS, BLOCKS = 3, 6
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 300_000
_PIECE = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def term_hashes(text: str, words_known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the terms of a text, in order."""
    words = text.encode().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words_known) > _CACHE_WORDS:
        words_known.clear()
    try:
        ids = [words_known[w] for w in words]
    except KeyError:
        for w in words:
            if w not in words_known:
                words_known[w] = xxhash.xxh3_64_intdigest(w)
        ids = [words_known[w] for w in words]
    h = np.array(ids, np.uint64)
    n = min(TERM_WORDS, len(h))
    key = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        key = _mixed(key * _STEP + h[k : len(h) - n + 1 + k])
    return key


def fingerprint(terms: np.ndarray) -> int:
    """The signs of the weighted votes of all terms."""
    if not len(terms):
        return 0
    distinct, counts = np.unique(terms, return_counts=True)
    weights = np.frexp(counts)[1].astype(np.float32)
    votes = np.zeros(BITS)
    for at in range(0, len(distinct), _PIECE):  # whole numbers below 2**24 are exact in float32
        bits = np.unpackbits(distinct[at : at + _PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += weights[at : at + _PIECE] @ bits.astype(np.float32)
    signs = 2 * votes > weights.sum(dtype=np.float64)
    return int.from_bytes(np.packbits(signs).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as many code points of the next text, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in DIGEST.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


class _Walk:
    """Finishes rows one behind the other."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> int:
        return fingerprint(term_hashes(text, self.known))

    def row(self, doc_id: int | None, text: str, own: int, following: str, after: int) -> tuple:
        new = edited(text, following)
        changed = self.of(new)
        digest = hashlib.sha256(new.encode()).hexdigest()
        return doc_id, len(text), digest, f"{own:016x}", f"{changed:016x}", likeness(own, changed), likeness(own, after)


def _columns(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _packed(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [squeeze.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(texts, pa.binary())], ["doc_id", "tie", "packed"])


def _walk(batches):
    expand, walk = zstandard.ZstdDecompressor(), _Walk()
    first = last = None
    part = None
    names, kinds = [*_NAMES, "part", "head", "tail"], [*_KINDS, pa.int32(), pa.binary(), pa.binary()]
    for batch in batches:
        rows = []
        for doc_id, packed, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "part")), strict=True):  # noqa: B007
            text = expand.decompress(packed).decode()
            own = walk.of(text)
            if last is None:
                first = packed
            else:
                rows.append((*walk.row(last[0], last[1], last[2], text, own), None, None, None))
            last = doc_id, text, own, packed
        yield _columns(rows, names, kinds)
    if last is not None:
        yield _columns([(last[0], None, None, None, None, None, None, part, first, last[3])], names, kinds)


def _edges(batches):
    expand, walk = zstandard.ZstdDecompressor(), _Walk()
    for batch in batches:
        rows = []
        for doc_id, tail, head in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tail", "head")), strict=True):
            text, following = expand.decompress(tail).decode(), expand.decompress(head).decode()
            rows.append(walk.row(doc_id, text, walk.of(text), following, walk.of(following)))
        yield _columns(rows, _NAMES, _KINDS)


def next_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row of ``docs``."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = slim.withColumn("tie", F.xxhash64("text")).mapInArrow(_packed, "doc_id long, tie long, packed binary")
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    ranged = packed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    walked = ranged.select("doc_id", "packed", F.spark_partition_id().alias("part")).mapInArrow(_walk, f"{DIGEST}, part int, head binary, tail binary")
    with common.batches_of(spark, 8 << 20):
        walked = common.materialise(walked, "walked")
        # one edge a range: what follows its last row is the first row of the range after it
        edges = walked.where("part is not null")
        line = W.orderBy("part")
        after = edges.select("part", F.coalesce(F.lead("part").over(line), F.first("part").over(line)).alias("_after"))
        heads = edges.select(F.col("part").alias("_after"), "head")
        met = edges.select("part", "doc_id", "tail").join(after, "part").join(heads, "_after")
        ends = common.materialise(met.select("doc_id", "tail", "head").mapInArrow(_edges, DIGEST), "edges")
    return walked.where("part is null").select(*_NAMES).unionByName(ends)


def _block_masks(blocks: int) -> list[int]:
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def as_long(column: str = "fingerprint") -> Column:
    """A fingerprint's 16 hex digits as a long of the same bits."""
    high = F.conv(F.substring(column, 1, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(F.conv(F.substring(column, 9, 8), 16, 10).cast("long"))


#: Classes at one place of a table that are compared by one task.
PART_CLASSES = 4096


def _filed(classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(table, key, part, low, high, class): in every group of (table, key, low, high) lie at most two parts."""
    masks = _block_masks(blocks)
    tables = [_signed(sum(masks[i] for i in kept)) for kept in combinations(range(blocks), blocks - radius)]
    filed = classes.select("class", F.posexplode(F.array(*[F.lit(m) for m in tables])).alias("table", "mask"))
    filed = filed.select("table", F.col("class").bitwiseAND(F.col("mask")).alias("key"), "class")
    crowded = filed.groupBy("table", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > PART_CLASSES)
    crowded = crowded.select(F.col("table").alias("_t"), F.col("key").alias("_k"), F.ceil(F.col("_n") / PART_CLASSES).cast("int").alias("_parts"))
    parted = common.attach(filed, crowded, (F.col("table") == F.col("_t")) & (F.col("key") == F.col("_k")))
    parted = parted.withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("class"), F.col("_parts")).cast("int"))
    met = parted.select("table", "key", "part", "class", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    return met.select("table", "key", "part", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"), "class")


def _compared(radius: int, blocks: int, pairs: bool):
    """Classes of one place lie one behind the other; each is held against those behind it, a step at a time."""
    masks = np.array(_block_masks(blocks), np.uint64)
    kept = [sum(1 << i for i in c) for c in combinations(range(blocks), blocks - radius)]
    # for every set of blocks that differ, the first table whose blocks all agree
    first = np.array([next((t for t, k in enumerate(kept) if not k & diff), -1) for diff in range(1 << blocks)])
    names = ["a", "b", "distance"] if pairs else ["class", "near"]
    group = ("table", "key", "low", "high")

    def compare(col: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(col["class"])
        x = col["class"].view(np.uint64)
        same_place = np.ones(max(0, n - 1), bool)
        for g in group:
            same_place &= col[g][1:] == col[g][:-1]
        place = np.concatenate([[0], np.cumsum(~same_place)]) if n else np.empty(0, np.int64)
        near, found, at, step = np.zeros(n, np.int64), [], np.arange(n), 0
        while True:
            step += 1
            at = at[at + step < n]
            at = at[place[at] == place[at + step]]
            if not len(at):
                break
            other = at + step
            diff = x[at] ^ x[other]
            distance = np.bitwise_count(diff)
            ok = (distance <= radius) & ((col["low"][at] == col["high"][at]) | (col["part"][at] != col["part"][other]))
            ok = np.flatnonzero(ok)
            changed = ((diff[ok, None] & masks) != 0) @ (1 << np.arange(blocks))
            ok = ok[first[changed] == col["table"][at[ok]]]
            near += np.bincount(at[ok], minlength=n) + np.bincount(other[ok], minlength=n)
            if pairs:
                found.append((at[ok], other[ok], distance[ok]))
        if pairs:
            a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in (0, 1))
            a, b = col["class"][a], col["class"][b]
            distance = np.concatenate([f[2] for f in found] or [np.empty(0, np.uint8)]).astype(np.int64)
            columns = [np.minimum(a, b), np.maximum(a, b), distance]
        else:
            columns = [col["class"][near > 0], near[near > 0]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches):
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            col = {c: batch.column(c).to_numpy() for c in (*group, "part", "class")}
            if held is not None:
                col = {c: np.concatenate([held[c], col[c]]) for c in col}
            # the last place may go on in the next batch
            n = len(col["class"])
            cut = n
            while cut and all(col[g][cut - 1] == col[g][n - 1] for g in group):
                cut -= 1
            yield compare({c: v[:cut] for c, v in col.items()})
            held = {c: v[cut:] for c, v in col.items()}
        if held is not None:
            yield compare(held)

    return run, "a long, b long, distance long" if pairs else "class long, near long"


def _met(classes: DataFrame, radius: int, blocks: int, pairs: bool) -> DataFrame:
    if not 0 <= radius < blocks <= 16:
        raise ValueError("the radius must be below the number of blocks, and these at most 16")
    place = ["table", "key", "low", "high"]
    run, kind = _compared(radius, blocks, pairs)
    return _filed(classes, radius, blocks).repartition(*place).sortWithinPartitions(*place).mapInArrow(run, kind)


def near_counts(classes: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(class, n_near) of the classes with others within ``radius`` bits; ``classes`` has distinct longs in ``class``."""
    return _met(classes, radius, blocks, False).groupBy("class").agg(F.sum("near").alias("n_near"))


def near_pairs(classes: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (a, b, distance) of classes within ``radius`` bits, a < b as longs, each once."""
    return _met(classes, radius, blocks, True)


def fingerprinted(docs: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``next_edits`` with ``n_near``: the number of other fingerprints within ``radius`` bits of the row's own."""
    spark = docs.sparkSession
    with common.only_last(spark):
        rows = next_edits(docs).withColumn("class", as_long())
        classes = common.materialise(rows.groupBy("class").agg(F.count("*").alias("_rows")), "classes")
        near = common.materialise(near_counts(classes.select("class"), radius=radius, blocks=blocks), "near")
        near = common.materialise(classes.join(near, "class", "left").select("class", "_rows", F.coalesce("n_near", F.lit(0)).alias("n_near")), "near")
        return common.materialise(common.join_split(rows, near, "class", "_rows").drop("class"), "fingerprints")
