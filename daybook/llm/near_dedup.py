"""Near-duplicate detection with SetSketch registers.

A document's set holds its distinct five-word shingles.  Each register is a truncated minimum on an exponential
scale: ``K_i = clip(1 - floor(log_b(min over the set of h_i(x) / a)), 0, q + 1)``.  Registers of a union are the
larger of the two registers, and equal registers are as likely as the sets are alike, so bands of register
values find candidates.  The joint likelihood of the counts of smaller, equal and larger registers (the two set
sizes are known) drops candidates that can't reach the threshold, and the full sets confirm the rest exactly.

Only connectivity is asked for, so the links of a group of copies are not all expanded:

1. documents with equal sets collapse to one class (map-side combine);
2. every class is compared with the most central class of its bands, one pair a class;
3. the links so far give components; classes in a band that spans several are open, and whatever linked pair is
   left has open classes of two components at its ends.  These pairs are found without a cap by an exact prefix
   join over the open classes: sets that reach the threshold share one of their rarest shingles, at places that
   leave room for the overlap they need.  Large groups of copies are one component by then, or pruned by place.  What this join
   compares is bounded by the pairs of open classes of different components that share one of the rarest quarter
   of their shingles; a passage that is frequent comes last in the order and is no such shingle.

Bands and classes that hold very many rows are joined by a broadcast of those few keys (``common.join_split``), so
no task gathers one.

With 48 bands of 4 registers a pair at similarity 0.75 stays unseen with probability 1e-8.

Defined results: null and empty texts have no shingle, link with nothing and are kept; one to four words make
one shingle of the whole sequence; rows with the same id are one vertex, each row keeps its own count; a row
with a null id links with nothing, has a null component and is kept; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

SHINGLE = 5
BANDS, ROWS = 48, 4
#: SetSketch parameters: base, rate and number of values.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
_rng = np.random.default_rng(20_240)
_MUL = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BAND_SALT = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 500_000
#: Shingles are ordered by how often their first bits occur, in so many slots.
FREQUENCY_BITS = 15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text; ``cache`` holds word hashes."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > _CACHE_WORDS:
        cache.clear()
    try:
        ids = [cache[w] for w in words]
    except KeyError:
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        ids = [cache[w] for w in words]
    h = np.array(ids, np.uint64)
    n = min(SHINGLE, len(h))
    key = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        key = _mixed(key * _STEP + h[k : len(h) - n + 1 + k])
    return np.unique(key)


def sketch(values: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set of hashes."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_MUL), np.uint32(0xFFFFFFFF))
    for part in np.array_split(x, max(1, len(x) // 512)):  # keeps the product in the processor's cache
        y = part[:, None] * _MUL + _ADD
        y ^= y >> np.uint32(15)
        np.minimum(low, y.min(axis=0), out=low)
    minima = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(1 - np.floor(np.log(minima) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    rows = registers.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for k in range(ROWS):
        key = _mixed(key ^ ((rows[:, k] + np.uint64(1)) * _BAND_SALT[:, k]))
    return key.view(np.int64)


def _sketches(batches):
    cache: dict[bytes, int] = {}
    for batch in batches:
        sizes, classes, registers = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text, cache)
            sizes.append(len(s))
            classes.append(class_of(s))
            registers.append(sketch(s).tobytes() if len(s) else None)
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(registers, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "cls", "registers"])


def class_of(values: np.ndarray) -> int:
    """64-bit digest of a set; among 1e10 different sets about 3 pairs are expected to share one."""
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, cls, registers), one row per row of ``docs``, without a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_sketches, "doc_id long, n_shingles long, cls long, registers binary")


def _sets(batches):
    cache: dict[bytes, int] = {}
    for batch in batches:
        found = [shingles(t, cache) for t in batch.column("text").to_pylist()]
        items = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), items], ["cls", "items"])


def _bands(batches):
    for batch in batches:
        keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch.column("registers").to_pylist()]
        if keys:
            cls = np.repeat(batch.column("cls").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(cls)], ["band", "cls"])


def likelihood_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity of register rows, and how much less likely ``threshold`` is (log ratio).

    The likelihood of the joint counts is concave in the similarity; a grid of 200 values is exact enough.
    """
    larger, smaller = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - larger - smaller
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.concatenate([np.linspace(0, 1, 200)[None, :] * top, np.minimum(threshold, top)], axis=1)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    pa_, pb = np.maximum(p(u - v * grid), 1e-12), np.maximum(p(v - u * grid), 1e-12)
    like = larger * np.log(pa_) + smaller * np.log(pb) + equal * np.log(np.maximum(1 - pa_ - pb, 1e-12))
    best = like.argmax(1)
    rows = np.arange(len(best))
    return grid[rows, best], like[rows, best] - like[:, -1]


def _likely(threshold: float, slack: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column
            a, b = (np.frombuffer(b"".join(col(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            n_a, n_b = (col(c).to_numpy().astype(float) for c in ("na", "nb"))
            estimate, ratio = likelihood_estimate(a.astype(np.int32), b.astype(np.int32), n_a, n_b, threshold)
            keep = pa.array((estimate >= threshold) | (ratio <= slack))
            yield pa.RecordBatch.from_arrays([col("a").filter(keep), col("b").filter(keep)], ["a", "b"])

    return run


class _Verifier:
    """Confirms candidate pairs of classes on their full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, threshold: float, slack: float):
        self.docs, self.classes, self.percent, self.slack = docs, classes, round(100 * threshold), slack

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and registers allow the threshold."""
        side = lambda c: self.classes.select(F.col("cls").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
        near = (100 * F.col("na") >= self.percent * F.col("nb")) & (100 * F.col("nb") >= self.percent * F.col("na"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
        return sized.mapInArrow(_likely(self.percent / 100, self.slack), "a long, b long")

    def sets(self, ends: DataFrame) -> DataFrame:
        """(cls, items): the full shingle sets of distinct classes, from the text of their owners."""
        owners = ends.join(self.classes.select("cls", "owner"), "cls").select(F.col("owner").alias("doc_id")).distinct()
        found = self.docs.join(owners, "doc_id", "left_semi").select("text").mapInArrow(_sets, "cls long, items array<long>")
        # an id can stand for several texts; only the classes asked for stay
        return common.materialise(found.join(ends, "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    def confirm(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The links among distinct ``pairs`` (a, b)."""
        likely = common.materialise(self.likely(pairs), "likely")
        own = sets or self.sets(likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct())
        left = likely.join(own.withColumnsRenamed({"cls": "a", "items": "ia"}), "a")
        both = left.join(own.withColumnsRenamed({"cls": "b", "items": "ib"}), "b")
        shared = F.size(F.array_intersect("ia", "ib"))
        checked = both.select("a", "b", shared.alias("i"), (F.size("ia") + F.size("ib")).alias("s"))
        links = common.materialise(checked.where(100 * F.col("i") >= self.percent * (F.col("s") - F.col("i"))).select("a", "b"), "links")
        common.discard(likely, *([] if sets else [own]))
        return links


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Add ``comp``, the component of ``cls``."""
    named = roots.withColumnRenamed("member", "_m")
    return rows.join(named, F.col("cls") == F.col("_m"), "left").withColumn("comp", F.coalesce("root", "cls")).drop("_m", "root")


def near_duplicates(docs: DataFrame, *, threshold: float = 0.75, slack: float = 18.0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    ``slack`` is the log likelihood ratio below which a candidate is still confirmed: a true link is lost by it
    with probability about exp(-slack).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with common.only_last(spark), common.batches_of(spark, 8 << 20):
        rows = common.materialise(sketched(docs), "sketches")
        usable = rows.where("n_shingles > 0 and doc_id is not null")
        classes = usable.groupBy("cls").agg(F.min("doc_id").alias("owner"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"), F.count("*").alias("n"))
        classes = common.materialise(classes, "classes")
        links = _links(docs, classes, threshold, slack)
        # vertices are the smallest ids of the classes, so the root of a component is its smallest id
        owned = classes.select("cls", "owner")
        by_owner = links.join(owned.withColumnsRenamed({"cls": "a", "owner": "oa"}), "a").join(owned.withColumnsRenamed({"cls": "b", "owner": "ob"}), "b")
        edges = by_owner.select(F.col("oa").alias("a"), F.col("ob").alias("b"))
        # rows with one id are one vertex
        shared = usable.groupBy("doc_id").agg(F.min("cls").alias("_a"), F.max("cls").alias("_z")).where("_a != _z").select("doc_id")
        ties = usable.join(shared, "doc_id").select("doc_id", "cls").distinct().join(owned, "cls")
        edges = edges.union(ties.select(F.col("doc_id").alias("a"), F.col("owner").alias("b")))
        roots = components.components(edges)
        # one row a class: its root; copies take it from there
        held = owned.join(roots, F.col("owner") == F.col("member"), "left").select("cls", F.coalesce("root", "owner").alias("component_id"))
        held = common.materialise(held.join(classes.select("cls", "n"), "cls"), "held")
        plain = usable.select("doc_id", "n_shingles", "cls")
        named = common.join_split(plain, held, "cls", "n").select("doc_id", "n_shingles", "component_id")
        alone = rows.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        out = named.unionByName(alone)
        return common.materialise(out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))), "components")


def _central_pairs(hits: DataFrame) -> DataFrame:
    """(a, b): each class with the most central class of its bands, the one that meets the most others in all bands."""
    score = hits.groupBy("cls").agg(F.sum("n").alias("score"))
    ranked = hits.join(score, "cls").groupBy("band").agg(F.max(F.struct("score", "cls")).alias("top"), F.count("*").alias("rows"))
    best = common.join_split(hits.select("band", "cls"), common.materialise(ranked, "ranked"), "band", "rows").where(F.col("top.cls") != F.col("cls")).groupBy("cls").agg(F.max("top").alias("top"))
    return best.select(F.least("cls", "top.cls").alias("a"), F.greatest("cls", "top.cls").alias("b")).distinct()


def _open_classes(hits: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp) of the classes in a band that spans several components."""
    held = common.materialise(_labelled(hits.select("band", "cls"), components.components(links)), "held")
    parts = held.groupBy("band").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count("*").alias("rows")).where("_low != _high")
    parts = common.materialise(parts.select("band", "rows"), "mixed")
    return common.materialise(common.join_split(held, parts, "band", "rows").select("cls", "comp").distinct(), "open")


def _frequency(batches):
    total = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for batch in batches:
        items = batch.column("items").flatten().to_numpy().view(np.uint64)
        total += np.bincount((items >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


def _prefixes(common_slots: np.ndarray, percent: int):
    """The first shingles of each set, rarest first: two sets that reach the threshold share one of theirs."""

    def run(batches):
        for batch in batches:
            columns = [[], [], [], [], []]
            for cls, comp, items in zip(batch.column("cls").to_pylist(), batch.column("comp").to_pylist(), batch.column("items"), strict=True):
                own = np.array(items.values).view(np.uint64)
                order = np.lexsort((own, common_slots[own >> np.uint64(64 - FREQUENCY_BITS)]))
                size = len(own)
                n = size - -(-percent * size // 100) + 1
                for c, x in zip(columns, (own[order[:n]].view(np.int64), np.full(n, cls), np.full(n, comp), np.full(n, size), np.arange(n)), strict=True):
                    c.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], ["token", "cls", "comp", "size", "at"])

    return run


def _rest(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open classes in different components that may reach the threshold; exact, none is left out.

    Any order of the shingles would do; rarest first keeps shared passages out of the prefixes.  A shingle shared at
    places i and j leaves at most ``min(size - i)`` in common, which the join's own condition checks, so pairs that
    only share the frequent part of a large group of copies are never put out.
    """
    counts = sets.select("items").mapInArrow(_frequency, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    slots = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for slot, n in counts.collect():  # at most 2**FREQUENCY_BITS rows
        slots[slot] = n
    tokens = opened.join(sets, "cls").mapInArrow(_prefixes(slots, percent), "token long, cls long, comp long, size long, at long")
    tokens = common.materialise(tokens, "tokens")
    parts = tokens.groupBy("token", "comp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    within = tokens.join(mixed.select("token", "main"), "token")
    few = within.where("comp != main").select("token", F.col("cls").alias("x"), F.col("comp").alias("cx"), F.col("size").alias("sx"), F.col("at").alias("ix"))
    every = within.select("token", F.col("cls").alias("y"), F.col("comp").alias("cy"), F.col("size").alias("sy"), F.col("at").alias("iy"))
    overlap = F.least(F.col("sx") - F.col("ix"), F.col("sy") - F.col("iy"))
    enough = (100 + percent) * overlap >= percent * (F.col("sx") + F.col("sy"))
    across = few.join(every, "token").where((F.col("cx") != F.col("cy")) & enough)
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _links(docs: DataFrame, classes: DataFrame, threshold: float, slack: float) -> DataFrame:
    """Links (a, b) between classes that leave the same components as all links."""
    verifier = _Verifier(docs, classes, threshold, slack)
    banded = classes.select("registers", "cls").mapInArrow(_bands, "band long, cls long")
    shared = banded.groupBy("band").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = common.materialise(shared.withColumn("n", F.col("rows")), "bands")
    hits = common.materialise(common.join_split(banded, shared, "band", "rows"), "hits")
    links = verifier.confirm(_central_pairs(hits))
    opened = _open_classes(hits, links)
    sets = verifier.sets(opened.select("cls"))
    more = verifier.confirm(_rest(opened, sets, verifier.percent), sets)
    common.discard(hits)
    return links.union(more)
