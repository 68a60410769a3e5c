"""Quality rules: robust multivariate outliers per language and source.

``text_statistics`` counts words, symbols, repeated lines and repeated word windows of every whole text.
``robust_verdicts`` turns the counts into a vector of transformed rates, finds a minimum-covariance-determinant
(MCD) estimate per language and source and rejects vectors by their Mahalanobis distance.

*Cells.*  Coordinates are whole multiples of 1/256 between -16 and 16.  Equal vectors of a language and source become
one weighted cell before anything else is computed, so all further steps read a table of cells, which grows far slower
than the documents, and every sum is a sum of whole numbers: exact, whatever the order of arrival.

*Search.*  Two robust starts per group, each followed by concentration steps (estimate, rank by distance, keep the
closer half) until no determinant falls any more, or ``MAX_STEPS``.  A step is one grouped aggregation over
(group, start, distance bin): the bins of the closer half add up to the next estimate.  The closer half holds all
cells up to and with the bin of the median.  The start with the smallest determinant wins.

*Levels.*  Every language and source, every language and the whole table get estimates of their own at any size.  A
language's is drawn towards the whole's, and a language and source's towards its language's, by the weight n / (n + k)
on its own, n its documents and k = ``PRIOR_ROWS``; so small groups lean on their language without a limit in size.

*Limit.*  Standard deviations have floors (``FLOORS``, what counting alone makes such rates vary); the squared distance
is compared with the chi-square quantile of ``TAIL``.

Defined results: null text counts as no words; null language or source is a group of its own; rows with equal ids
are judged one by one; a table without a row that passes the base rule rejects by the base rule only; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations


import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
KEYS = ("doc_id", "lang", "source")
SPACES = " \t\n\v\f\r"
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
#: Vector coordinates and the least standard deviation each is given.
FLOORS = {"v_length": 0.04, "v_symbols": 0.06, "v_lines": 0.15, "v_repeats": 0.12}
NAMES = list(FLOORS)
CELL, EDGE = 256, 16
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
PRIOR_ROWS = 100
MAX_STEPS = 20
#: Share of rows of a normal group beyond the limit.
TAIL = 1e-6


def chi_square(tail: float) -> float:
    """The value that a chi-square variable with 4 degrees of freedom exceeds with probability ``tail``."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if math.exp(-middle / 2) * (1 + middle / 2) > tail else (low, middle)
    return high


CHI2_MEDIAN = chi_square(0.5)
#: Distance bins per unit of the logarithm.
BINS = 50


def repeat_words(words: list, window: int = 3) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    if len(words) <= window:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key = ids[: len(ids) - window + 1]
    for k in range(1, window):
        key = np.unique(key, return_inverse=True)[1] if len(seen) > 2_000_000 else key
        key = key * len(seen) + ids[k : len(ids) - window + 1 + k]
        if len(seen) > 2_000_000:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words), bool)
    for k in range(window):
        cover[k : k + len(twice)] |= twice
    return int(cover.sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    spaces = sum(map(text.count, SPACES))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines), repeat_words(words)


def _statistics(batches):
    names = [x.split()[0] for x in STATISTICS.split(", ")]
    for batch in batches:
        rows = [statistics_of(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        counts = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in (*KEYS, "row_key")] + counts, [*KEYS, "row_key", *names])


def text_statistics(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts of every whole text, one row per row of ``docs``, without a shuffle; ``row_key`` is a hash of ``columns``."""
    key = common.row_key(columns or ["doc_id", "text", "lang", "source"]).alias("row_key")
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), key)
    return slim.mapInArrow(_statistics, f"doc_id long, lang string, source string, row_key long, {STATISTICS}")


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """Add the coordinates in whole cells."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    rates = {
        "v_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "v_symbols": F.sqrt(F.col("n_symbols") / words),
        "v_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "v_repeats": F.sqrt(F.col("n_repeat_words") / words),
    }
    return stats.withColumns({c: F.round(F.least(F.greatest(v, F.lit(-EDGE)), F.lit(EDGE)) * CELL).cast("long") for c, v in rates.items()})


def _named(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("-"))


LEVELS = ("whole", "language", "own")


def group_name(level: str) -> Column:
    """Name of the group: the whole table, a language, or a language and source."""
    return {"whole": lambda: F.lit("*"), "language": lambda: _named("lang"), "own": lambda: F.concat_ws("\x1f", _named("lang"), _named("source"))}[level]()


def cells(rows: DataFrame) -> DataFrame:
    """(grp, v_..., n): the distinct vectors of every group of every level, with their numbers of rows."""
    counted = rows.groupBy("lang", "source", *NAMES).agg(F.count("*").alias("n"))
    split = counted.select(*NAMES, "n", F.explode(F.array(*map(group_name, LEVELS))).alias("grp"))
    return split.groupBy("grp", *NAMES).agg(F.sum("n").alias("n"))


def moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Row counts, sums and products of whole cells."""
    sums = {f"s{i}": F.sum(F.col(c) * F.col("n")) for i, c in enumerate(NAMES)}
    sums |= {f"q{i}_{j}": F.sum(F.col(NAMES[i]) * F.col(NAMES[j]) * F.col("n")) for i, j in PAIRS}
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *[v.alias(k) for k, v in sums.items()])


MOMENTS = ["n", *[f"s{i}" for i in range(len(NAMES))], *[f"q{i}_{j}" for i, j in PAIRS]]


def floored(cov: np.ndarray) -> np.ndarray:
    """The covariance with each standard deviation raised to its floor, correlations as they are."""
    own = np.sqrt(np.diag(cov))
    wide = np.maximum(own, list(FLOORS.values()))
    correlation = cov / np.where(own > 0, own, 1)[:, None] / np.where(own > 0, own, 1)[None, :]
    np.fill_diagonal(correlation, 1)
    return (correlation * 0.999 + 0.001 * np.eye(len(NAMES))) * wide[:, None] * wide[None, :]


def estimate(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(centre, covariance) in rates, from whole sums."""
    n = int(row["n"])
    total = [int(row[f"s{i}"]) for i in range(len(NAMES))]
    cov = np.zeros((len(NAMES),) * 2)
    for i, j in PAIRS:
        # whole numbers of any length, so the difference is exact
        cov[i, j] = cov[j, i] = (int(row[f"q{i}_{j}"]) * n - total[i] * total[j]) / n / n / CELL / CELL
    return np.array([t / n / CELL for t in total]), cov


ESTIMATE = "grp string, start int, n long, logdet double, centre array<double>, precision array<double>, cov array<double>"


def _estimates(batches):
    """One row per group and start."""
    for frame in batches:
        out = []
        for row in frame.to_dict("records"):
            centre, cov = estimate(row)
            wide = floored(cov)
            out.append((row["grp"], int(row["start"]), int(row["n"]), float(np.linalg.slogdet(wide)[1]), centre.tolist(), np.linalg.inv(wide).ravel().tolist(), cov.ravel().tolist()))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ESTIMATE.split(", ")])


def squared_distance(centre: str = "centre", precision: str = "precision") -> Column:
    d = [F.col(c) / CELL - F.col(centre)[i] for i, c in enumerate(NAMES)]
    p = len(NAMES)
    terms = [d[i] * d[j] * F.col(precision)[i * p + j] * (1 if i == j else 2) for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def distance_bin(d2: Column) -> Column:
    return F.floor(F.log1p(1000 * F.greatest(d2, F.lit(0.0))) * BINS)


def _closer_half(ranked: DataFrame) -> DataFrame:
    """The next estimates from rows with ``bin``: all bins up to and with that of the median."""
    binned = moments(ranked, ["grp", "start", "bin"])
    line = W.partitionBy("grp", "start").orderBy("bin")
    before = F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    all_rows = F.sum("n").over(W.partitionBy("grp", "start"))
    near = binned.withColumns({"_before": before, "_all": all_rows}).where(2 * F.col("_before") < F.col("_all"))
    return near.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in MOMENTS]).mapInPandas(_estimates, ESTIMATE)


def _middle(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, middle): the exact weighted lower median of a whole-number column."""
    counted = rows.groupBy(*by, value).agg(F.sum("n").alias("n"))
    line = W.partitionBy(*by).orderBy(value)
    counted = counted.withColumns({"_upto": F.sum("n").over(line), "_all": F.sum("n").over(W.partitionBy(*by))})
    return counted.where(2 * F.col("_upto") >= F.col("_all")).groupBy(*by).agg(F.min(value).alias("middle"))


def _long(rows: DataFrame, value=lambda c: F.col(c)) -> DataFrame:
    """(grp, axis, x, n): a row per coordinate."""
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), value(c).alias("x")) for i, c in enumerate(NAMES)])).alias("_a")
    return rows.select("grp", "n", axes).select("grp", "n", "_a.axis", "_a.x")


def _by_axis(rows: DataFrame, out: str) -> DataFrame:
    """(_g, out_0, out_1, ...) from (grp, axis, middle)."""
    return rows.groupBy(F.col("grp").alias("_g")).agg(*[F.max(F.when(F.col("axis") == i, F.col("middle"))).alias(f"{out}_{i}") for i in range(len(NAMES))])


def mcd(rows: DataFrame, steps: int = MAX_STEPS) -> DataFrame:
    """``ESTIMATE`` of the best start of every group; ``rows`` are cells."""
    middle = _by_axis(_middle(_long(rows), "x", ["grp", "axis"]), "m")
    placed = common.attach(rows, middle, F.col("grp") == F.col("_g")).drop("_g")
    spread = _by_axis(_middle(_long(placed, lambda c: F.abs(F.col(c) - F.col(f"m_{NAMES.index(c)}"))), "x", ["grp", "axis"]), "w")
    placed = common.attach(placed, spread, F.col("grp") == F.col("_g")).drop("_g")
    z = [(F.col(c) - F.col(f"m_{i}")) / CELL / F.greatest(F.col(f"w_{i}") * (1.4826 / CELL), F.lit(f)) for i, (c, f) in enumerate(FLOORS.items())]
    starts = F.array(
        F.struct(F.lit(0).alias("start"), distance_bin(sum((x * x for x in z[1:]), z[0] * z[0])).alias("bin")),
        F.struct(F.lit(1).alias("start"), distance_bin(F.greatest(*[F.abs(x) for x in z])).alias("bin")),
    )
    ranked = placed.select("grp", *NAMES, "n", F.explode(starts).alias("_s")).select("grp", *NAMES, "n", "_s.start", "_s.bin")
    fit = common.materialise(_closer_half(ranked), "mcd")
    for _ in range(steps):
        known = fit.select(F.col("grp").alias("_g"), "start", "centre", "precision")
        ranked = common.attach(rows, known, F.col("grp") == F.col("_g")).withColumn("bin", distance_bin(squared_distance()))
        after = common.materialise(_closer_half(ranked.select("grp", "start", *NAMES, "n", "bin")), "mcd")
        moved = after.alias("a").join(fit.alias("b"), ["grp", "start"]).where(F.col("a.logdet") < F.col("b.logdet") - 1e-9)
        # a step that doesn't lower a group's determinant leaves its estimate as it was
        fit = common.materialise(after.unionByName(fit).groupBy("grp", "start").agg(F.min_by(F.struct("n", "logdet", "centre", "precision", "cov"), "logdet").alias("_f")).select("grp", "start", "_f.*"), "mcd")
        if moved.isEmpty():
            break
    best = fit.groupBy("grp").agg(F.min_by(F.struct("start", "n", "logdet", "centre", "precision", "cov"), F.struct("logdet", "start")).alias("_b"))
    return best.select("grp", "_b.*")


def drawn(own: tuple, above: tuple, k: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(centre, covariance, rows) of a group drawn towards the level above by n / (n + k)."""
    share = own[2] / (own[2] + k)
    return share * own[0] + (1 - share) * above[0], share * own[1] + (1 - share) * above[1], own[2]


MODEL = "lang string, source string, centre array<double>, precision array<double>"


def _drawn(k: float):
    p = len(NAMES)

    def run(batches):
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                whole, language, own = ((np.array(row[f"centre_{x}"]), np.array(row[f"cov_{x}"]).reshape(p, p), row[f"rows_{x}"]) for x in LEVELS)
                centre, cov, _ = drawn(own, drawn(language, whole, k), k)
                out.append((row["lang"], row["source"], centre.tolist(), np.linalg.inv(floored(cov)).ravel().tolist()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in MODEL.split(", ")])

    return run


def models(rows: DataFrame, steps: int = MAX_STEPS, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """(lang, source, centre, precision, scale) of every language and source; ``rows`` have vectors."""
    table = common.materialise(cells(rows), "cells")
    fit = mcd(table, steps).join(table.groupBy("grp").agg(F.sum("n").alias("rows")), "grp")
    fit = common.materialise(fit, "fit")
    groups = rows.select("lang", "source").distinct()
    for level in LEVELS:
        own = fit.select(F.col("grp").alias("_g"), *[F.col(c).alias(f"{c}_{level}") for c in ("centre", "cov", "rows")])
        groups = groups.join(own, group_name(level) == F.col("_g")).drop("_g")
    model = common.materialise(groups.mapInPandas(_drawn(prior_rows), MODEL), "models")
    # distances are scaled so that their median is that of chi-square, but never made larger
    placed = common.attach(table, model.select(group_name("own").alias("_g"), "centre", "precision"), F.col("grp") == F.col("_g"), "inner")
    middle = _middle(placed.withColumn("bin", distance_bin(squared_distance())), "bin", ["grp"])
    scale = F.greatest(F.lit(1.0), F.expm1(F.col("middle") / BINS) / 1000 / CHI2_MEDIAN)
    middle = middle.select(F.col("grp").alias("_g"), scale.alias("scale"))
    return common.materialise(model.join(middle, group_name("own") == F.col("_g")).drop("_g"), "models")


def robust_verdicts(stats: DataFrame, *, tail: float = TAIL, steps: int = MAX_STEPS, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """Add ``base_failed``, ``distance`` (squared, scaled to chi-square; null without a group's estimate) and ``kept``."""
    spark = stats.sparkSession
    with common.only_last(spark), common.batches_of(spark, 8 << 20):
        rows = vectors(common.materialise(stats.withColumn("base_failed", base_failed()), "statistics"))
        fit = models(rows.where(~F.col("base_failed")), steps, prior_rows)
        fit = fit.withColumnsRenamed({"lang": "_l", "source": "_s"})
        judged = common.attach(rows, fit, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")))
        judged = judged.withColumn("distance", squared_distance() / F.col("scale"))
        kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi_square(tail))
        return common.materialise(judged.withColumn("kept", kept).drop("_l", "_s", "centre", "precision", "scale"), "verdicts")


def quality_rules(docs: DataFrame, *, columns: list[str] | None = None, **options) -> DataFrame:
    """Statistics and verdict of every row of ``docs``; ``row_key`` is a hash of ``columns``."""
    return robust_verdicts(text_statistics(docs, columns), **options)
