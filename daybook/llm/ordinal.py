"""Ordinal cumulative-link regression on graded ratings, over hashed text.

A rating has grades 0 .. K-1.  The model is ``P(grade <= k) = sigmoid(threshold_k - x.w)``: one weight vector over
hashed text features, shared by all grades, and K-1 ordered thresholds.  It gives every document its expected
grade and the probability of the highest grade, which selects.

Features of a text are the hashed words (lower case, without punctuation at the ends), the punctuation that ends
words, and steps of three shares: words in capitals, repeated words and words with signs, each present or not.

``fit`` reads at most about ``sample_rows`` rated documents, chosen by a hash of their id; features in fewer than
``MIN_DOCS`` of them get no weight.  One task fits the model; scoring reads every document, without a shuffle, and
what it broadcasts are 2**18 weights of 4 bytes, whatever the input.

Defined results: null or empty text, and text without words, has expected grade 0, tail probability 0 and isn't
kept; rows with equal ids are scored one by one; several ratings of one id count as their lowest; ratings with a
null in either column are left out; without any rating no model is fitted, and the prior (equal grades) decides
nothing: everything with words is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HASH_BITS = 18
SIZE = 1 << HASH_BITS
GRADES = 3
SAMPLE_ROWS = 16_000
MIN_DOCS = 5
ROUNDS = 150
MIN_TAIL = 0.5
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CACHE_WORDS = 300_000


def _bucket(kind: bytes, value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + value) & (SIZE - 1)


def _codes(word: bytes) -> int:
    """Bucket of the word, bucket + 1 of the signs that end it (0: none) and whether it is in capitals."""
    bare = word.strip(_PUNCTUATION)
    lowered = bare.lower()
    end = word[len(word.rstrip(_PUNCTUATION)) :]
    capitals = len(bare) > 1 and bare != lowered and bare.upper() == bare
    signs = _bucket(b"end:", end) + 1 if end else 0
    return _bucket(b"word:", lowered) | signs << HASH_BITS | int(capitals) << (2 * HASH_BITS + 1)


def features(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct feature buckets of a whole text; none if it has no words."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.int32)
    if len(known) > _CACHE_WORDS:
        known.clear()
    try:
        codes = np.array([known[w] for w in words], np.int64)
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = _codes(w)
        codes = np.array([known[w] for w in words], np.int64)
    own = codes & (SIZE - 1)
    signs = (codes >> HASH_BITS) & (2 * SIZE - 1)
    distinct = np.unique(own)
    shares = {b"caps": (codes >> (2 * HASH_BITS + 1)).sum() / len(own), b"signs": np.count_nonzero(signs) / len(own), b"distinct": len(distinct) / len(own)}
    steps = [_bucket(name + b":", str(int(10 * share)).encode()) for name, share in shares.items()]
    steps.append(_bucket(b"length:", str(len(own).bit_length()).encode()))
    return np.unique(np.concatenate([distinct, np.unique(signs[signs > 0]) - 1, steps])).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def probabilities(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """(rows, grades) from the scores ``x.w``."""
    below = _sigmoid(thresholds[None, :] - score[:, None])
    full = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
    return np.diff(full, axis=1)


def in_order(steps: np.ndarray) -> np.ndarray:
    """Thresholds from a first value and logarithms of steps, so that they stay in order."""
    return np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))


def loss_and_gradient(w: np.ndarray, steps: np.ndarray, rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Penalised mean negative log likelihood and its slope in the weights and the steps."""
    n, thresholds = len(grade), in_order(steps)
    score = np.bincount(rows, weights=w[cols], minlength=n)
    below = _sigmoid(thresholds[None, :] - score[:, None])
    full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
    slope = full * (1 - full)
    at = np.arange(n)
    p = np.maximum(full[at, grade + 1] - full[at, grade], 1e-12)
    upper, lower = slope[at, grade + 1] / p, slope[at, grade] / p
    by_score = (upper - lower) / n
    by_threshold = np.array([(lower[grade == k + 1].sum() - upper[grade == k].sum()) / n for k in range(len(steps))])
    chain = np.array([by_threshold.sum()] + [by_threshold[k:].sum() * math.exp(steps[k]) for k in range(1, len(steps))])
    gradient = np.concatenate([np.bincount(cols, weights=by_score[rows], minlength=len(w)) + ridge * w, chain])
    return float(-np.log(p).mean() + ridge / 2 * w @ w), gradient


def fit_cumulative(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, grades: int = GRADES, rounds: int = ROUNDS, ridge: float = 2e-4, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by penalised maximum likelihood, full-batch Adam; features are present (rows, cols) pairs."""
    n = len(grade)
    weights = np.zeros(SIZE)
    shares = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 0.5 / n, 1 - 0.5 / n)
    start = np.log(shares / (1 - shares))
    steps = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    used = np.flatnonzero(np.bincount(cols, minlength=SIZE) >= MIN_DOCS)
    place = np.full(SIZE, -1)
    place[used] = np.arange(len(used))
    inside = place[cols] >= 0
    rows, cols = rows[inside], place[cols[inside]]
    w = np.zeros(len(used))
    moments = [np.zeros(len(w) + len(steps)) for _ in range(2)]
    for t in range(1, rounds + 1):
        _, gradient = loss_and_gradient(w, steps, rows, cols, grade, ridge)
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        w, steps = w - move[: len(w)], steps - move[len(w) :]
    weights[used] = w
    return weights, in_order(steps)


def ratings(labels: DataFrame) -> DataFrame:
    """(rated, grade): 0 poor and toxic, 1 one of both, 2 neither."""
    both = labels.where("quality is not null and toxic is not null and doc_id is not null")
    grade = F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")
    return both.groupBy(F.col("doc_id").cast("long").alias("rated")).agg(F.min(F.greatest(F.lit(0), F.least(F.lit(GRADES - 1), grade))).alias("grade"))


def _featured(batches):
    known: dict[bytes, int] = {}
    for batch in batches:
        found = [features(t, known).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(found, pa.binary())], ["grade", "features"])


def _fit(grades: int, rounds: int):
    def run(table: pa.Table) -> pa.Table:
        grade = table.column("grade").to_numpy().astype(np.int64)
        found = [np.frombuffer(x, np.int32) for x in table.column("features").to_pylist()]
        order = np.lexsort([[xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in found], grade])  # sums don't depend on the order of arrival
        found, grade = [found[i] for i in order], grade[order]
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        weights, thresholds = fit_cumulative(rows, np.concatenate(found).astype(np.int64), grade, grades, rounds)
        return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "thresholds": pa.array([thresholds.tolist()], pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, rated: DataFrame, *, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray] | None:
    """(weights, thresholds) from a sample of about ``sample_rows`` rated documents; None without any."""
    total = rated.count()
    if not total:
        return None
    cut = int(min(1.0, sample_rows / total) * (1 << 30))
    chosen = rated.where(F.pmod(F.xxhash64("rated", F.lit(9)), F.lit(1 << 30)) < cut)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = common.attach(texts, chosen, F.col("doc_id") == F.col("rated"), "inner", rows=2 * sample_rows).select("text", F.col("grade").cast("int").alias("grade"))
    found = sample.mapInArrow(_featured, "grade int, features binary").where(F.octet_length("features") > 0)
    with common.batches_of(docs.sparkSession):
        model = found.groupBy().applyInArrow(_fit(GRADES, rounds), "weights binary, thresholds array<double>").collect()
    return (np.frombuffer(model[0]["weights"], np.float32), np.array(model[0]["thresholds"])) if model else None


def _scored(model, min_tail: float):
    def run(batches):
        weights, thresholds = model.value
        known: dict[bytes, int] = {}
        for batch in batches:
            found = [features(t, known) for t in batch.column("text").to_pylist()]
            some = np.array([len(x) > 0 for x in found], bool)
            p = probabilities(np.array([float(weights[x].sum(dtype=np.float64)) for x in found]), thresholds) * some[:, None]
            expected = p @ np.arange(p.shape[1])
            tail = p[:, -1]
            kept = some & (tail >= min_tail)
            columns = [batch.column("doc_id"), pa.array(expected), pa.array(tail), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail", "kept"])

    return run


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, *, min_tail: float = MIN_TAIL) -> DataFrame:
    """(doc_id, expected_grade, tail, kept), one row per row of ``docs``; kept if the highest grade is likely enough."""
    spark = docs.sparkSession
    if model is None:
        even = np.arange(1, GRADES) / GRADES
        model, min_tail = (np.zeros(SIZE, np.float32), np.log(even / (1 - even))), 0.0
    shared = spark.sparkContext.broadcast(model)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(_scored(shared, min_tail), "doc_id long, expected_grade double, tail double, kept boolean")
    with common.batches_of(spark):
        return common.materialise(scored, "graded")
