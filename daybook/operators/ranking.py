"""Ranking pictures from pairwise votes: Bradley-Terry fit with a side bias, boards, tiers and progress."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import work

Z = 1.96
SIGMA, SIDE_SIGMA = 2.0, 1.0
STEPS, TOLERANCE = 500, 1e-11
#: How far conjugate gradients bring the squared rest down in a Newton step, at least; further as the gradient falls.
FORCING, FINEST = 0.01, 1e-7
#: Passes without a lower rest, after which rounding must be what is left.
IDLE = 6
#: Links of a picture that is taken out of the system, at most: n links leave n * (n - 1) entries.
FEW = 6
#: Largest move of the step at which the matrix was made for it to serve the steps that follow.
NEAR = 1e-4
#: Pairs of a part of the matrix: the larger the parts, the more sums meet before they are shuffled.
PART = 2_000_000
#: Pictures that a Python worker solves at a time.
ROWS = 2_000
#: What one even comparison tells about a score.
INFORMATION = 0.25
FUNNEL = (10, 100, 600)


def pair_sums(votes: DataFrame) -> DataFrame:
    """(left, right, weight, won): votes collapse to one row a pair; ties are half a win, self-matches are dropped."""
    won = F.when(F.col("outcome") == "left", 1.0).when(F.col("outcome") == "right", 0.0).otherwise(0.5)
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(1.0)), F.lit(0.0)) if "weight" in votes.columns else F.lit(1.0)
    rows = votes.where("left <> right").select("left", "right", weight.alias("w"), (weight * won).alias("y"))
    return rows.groupBy("left", "right").agg(F.sum("w").alias("weight"), F.sum("y").alias("won"), F.count("*").alias("votes"))


def fit(votes: DataFrame, sigma: float = SIGMA, anchors: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """(picture, score, stderr, comparisons, side_bias): maximum a posteriori scores.

    Every score has a normal prior: mean 0 and standard deviation ``sigma`` (none if it is infinite), or that of its
    row in ``anchors`` (picture, score, ess), whose precision is that of ``ess`` even comparisons and at least the
    common one.  Pictures that only an anchor mentions keep its score.  ``start`` (picture, score), as of an earlier
    fit, saves steps and changes no result.

    Pictures with few links that touch none of their kind ("leaves") are taken out of the system exactly: their scores
    follow from their neighbours', so what is left is a smaller system in the others ("core").  Newton steps on it, each
    solved by conjugate gradients as far as the gradient has come down, preconditioned by the diagonal.  A pass shuffles
    what each core picture gets, summed per part beforehand, and writes the state of the core; it is one job, whose sums
    are observed as it writes.  The driver holds the side bias and a few sums.  Scores that no prior holds are shifted
    to a mean of 0 within their component.
    """
    base, side_prior = 0.0 if not math.isfinite(sigma) else sigma**-2, SIDE_SIGMA**-2
    counted, size = _observed(pair_sums(votes), n=F.count(F.lit(1)))
    pairs = work.kept(counted, "pairs")
    pictures = _Held.of(_pictures(pairs, base, anchors, start))
    if not size.get["n"]:
        alone = work.kept(pictures.rows.withColumn("info", F.col("prec")), "ranking")
        pictures.drop(), _drop(pairs)
        return _told(alone, 0.0)
    cut = _cut(pairs, pictures.rows, max(votes.sparkSession.sparkContext.defaultParallelism, -(-size.get["n"] // PART)))
    pictures.drop()
    at, side = cut.core, 0.0
    side_was, least, made, gradient, entries, state = 0.0, math.inf, math.inf, None, None, None
    for _ in range(STEPS):
        whole, told = _observed(_sums(cut, at.rows, side), y=F.sum("slope"), c=F.sum("curve"), loss=F.sum("loss"), square=F.sum("square"))
        first, sums = _observed(_start(whole, at.rows), rz=F.sum(F.col("r") * F.col("d")), moved=F.max(F.abs("d")), norm=F.sum(F.col("prec") * (F.col("theta") - F.col("mean")) ** 2))
        state = _Held.of(first, state)
        bias, sums = ({k: v or 0.0 for k, v in seen.get.items()} for seen in (told, sums))
        slope, info = bias["y"] - side * side_prior, bias["c"] - bias["square"] + side_prior
        moved = max(sums["moved"], abs(slope / info))
        if moved < TOLERANCE:
            break
        loss = bias["loss"] + (sums["norm"] + side_prior * side * side) / 2
        if loss > least + 1e-9 * abs(least):  # too far: half the way back
            at, side = _Held.of(state.rows.select(*_PICTURE[:-2], ((F.col("theta") + F.col("was")) / 2).alias("theta"), "was"), at), (side + side_was) / 2
            continue
        least = loss
        if made > NEAR:
            entries, made = _Held.of(_entries(cut, at.rows, side), entries, "source", cut.parts), moved
        x, d, r, rz = 0.0, slope / info, slope, sums["rz"] + slope * slope / info
        goal = max(rz * min(FORCING, 1.0 if gradient is None else max(0.8 * (rz / gradient) ** 2, FINEST)), (TOLERANCE / 3) ** 2)
        gradient = rz
        alpha, beta, lowest, idle = 0.0, 0.0, rz, 0
        for _ in range(STEPS):
            turned, told = _observed(
                _turn(entries.rows, state.rows, alpha, beta, d, cut.parts), dhd=F.sum(F.col("d") * F.col("hd")), rhd=F.sum(F.col("r") * F.col("hd") / _info()),
                hdhd=F.sum(F.col("hd") * F.col("hd") / _info()), q=F.sum(F.col("t") * F.col("d")),
            )
            state = _Held.of(turned, state)
            told = {k: v or 0.0 for k, v in told.get.items()}
            hd = told["q"] + info * d
            dhd = told["dhd"] + d * hd
            if dhd <= 0:
                alpha = 0.0
                break
            alpha = rz / dhd
            rest = max(rz - 2 * alpha * (told["rhd"] + r * hd / info) + alpha * alpha * (told["hdhd"] + hd * hd / info), 0.0)
            x, r = x + alpha * d, r - alpha * hd
            d, rz, beta = r / info + rest / rz * d, rest, rest / rz
            idle = 0 if rest < lowest else idle + 1
            lowest = min(lowest, rest)
            if rz <= goal or idle >= IDLE:
                break
        forth = F.col("theta") + F.col("x") + F.lit(alpha) * F.col("d")
        at = _Held.of(state.rows.select(*_PICTURE[:-2], forth.alias("theta"), F.col("theta").alias("was")), at)
        side, side_was = side + x, side
    columns = ("picture", "comparisons", "theta", "mean", "prec", "info")
    scores = work.kept(state.rows.select(*columns).unionByName(_solved(cut, state.rows, side, "scores")), "ranking")
    if base == 0:
        scores = _centred(scores, pairs.select("left", "right"))
        scores = work.kept(scores, "ranking")
    _drop(pairs)
    for table in (at, cut.routes, cut.rest, entries, state):
        if table is not None:
            table.drop()
    return _told(scores, side)


def _told(scores: DataFrame, side: float) -> DataFrame:
    return scores.select("picture", F.col("theta").alias("score"), (1 / F.sqrt(_info())).alias("stderr"), "comparisons", F.lit(side).alias("side_bias"))


_PICTURE = ("picture", "comparisons", "mean", "prec", "theta", "was")


class _Held:
    """Rows written to the shared folder, or to a table of the warehouse whose buckets are dealt by a column.

    Joins on the column of such a table leave its rows where they lie, if the other side is dealt to as many parts.  A
    checkpoint would not do: what it was dealt by is forgotten where queries adapt as they run.
    """

    def __init__(self, rows: DataFrame, table: str | None = None):
        self.rows, self.table = rows, table

    @classmethod
    def of(cls, rows: DataFrame, old: _Held | None = None, key: str | None = None, parts: int = 0) -> _Held:
        """``old`` is dropped afterwards, so rows may come from it."""
        if key is None:
            held = cls(work.kept(rows, "ranking"))
        else:
            name = f"daybook_ranking_{uuid.uuid4().hex}"
            rows.repartition(parts, key).write.bucketBy(parts, key).saveAsTable(name, format="parquet")
            held = cls(rows.sparkSession.table(name), name)
        if old is not None:
            old.drop()
        return held

    def drop(self) -> None:
        if self.table:
            self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")
        else:
            _drop(self.rows)


def _observed(rows: DataFrame, **sums: Column) -> tuple[DataFrame, Observation]:
    """Rows whose sums are told once they have been written."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(k) for k, c in sums.items()]), seen


def _info() -> Column:
    return F.greatest(F.col("info"), F.lit(1e-12))


def _pictures(pairs: DataFrame, base: float, anchors: DataFrame | None, start: DataFrame | None) -> DataFrame:
    """Every picture of a pair or an anchor, with its prior, where the fit begins and the number of its links."""
    seen = pairs.select(F.explode(F.array("left", "right")).alias("picture"), "votes").groupBy("picture").agg(F.sum("votes").alias("comparisons"), F.count("*").alias("links"))
    rows = seen.withColumns({"mean": F.lit(0.0), "prec": F.lit(base)})
    if anchors is not None:
        prior = anchors.select("picture", F.col("score").cast("double").alias("_m"), F.greatest(F.col("ess") * INFORMATION, F.lit(base)).cast("double").alias("_p"))
        both = seen.join(prior, "picture", "full")
        rows = both.select("picture", F.coalesce("comparisons", F.lit(0)).alias("comparisons"), F.coalesce("_m", F.lit(0.0)).alias("mean"), F.coalesce("_p", F.lit(base)).alias("prec"), F.coalesce("links", F.lit(0)).alias("links"))
    theta = F.col("mean")
    if start is not None:
        rows = rows.join(start.select("picture", F.col("score").cast("double").alias("_s")), "picture", "left")
        theta = F.coalesce("_s", "mean")
    return rows.select("picture", "comparisons", "mean", "prec", theta.alias("theta"), theta.alias("was"), "links")


class _Cut(NamedTuple):
    """The core's pictures, the links of leaves dealt by their core end, and the pairs within the core."""

    core: _Held
    routes: _Held
    rest: _Held
    parts: int


def _cut(pairs: DataFrame, pictures: DataFrame, parts: int) -> _Cut:
    """Leaves have a prior, at most ``FEW`` links, and rank below each neighbour by their links; so no two are linked."""
    links = lambda side, name: pictures.select(F.col("picture").alias(side), F.col("links").alias(name))
    met = pairs.join(links("left", "_a"), "left").join(links("right", "_b"), "right")
    rank = lambda n, side: F.struct(F.col(n).alias("n"), F.xxhash64(side).alias("h"), F.col(side).alias("p"))
    below = rank("_a", "left") < rank("_b", "right")
    low, high = (F.when(below, F.col(a)).otherwise(F.col(b)) for a, b in (("left", "right"), ("right", "left")))
    lows = _Held.of(met.select(low.alias("picture"), high.alias("core"), F.when(below, 1.0).otherwise(-1.0).alias("sign"), "weight", "won", "votes"), key="picture", parts=parts)
    known = pictures.select("picture", "links", "mean", "prec").repartition(parts, "picture")
    leaves = _Held.of(lows.rows.groupBy("picture").agg(F.count("*").alias("_n")).join(known, "picture").where((F.col("_n") == F.col("links")) & (F.col("links") <= FEW) & (F.col("prec") > 0)).drop("_n"))
    told = lows.rows.join(leaves.rows.repartition(parts, "picture"), "picture", "left")
    routes = _Held.of(told.where("links is not null"), key="core", parts=parts)
    left, right = (F.when(F.col("sign") > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("picture", "core"), ("core", "picture")))
    rest = _Held.of(told.where("links is null").select(left.alias("left"), right.alias("right"), "weight", "won"), key="left", parts=parts)
    core = _Held.of(pictures.join(leaves.rows.select("picture"), "picture", "left_anti").drop("links"))
    lows.drop(), leaves.drop()
    return _Cut(core, routes, rest, parts)


_TOLD = {
    "sums": "picture long, y double, c double, t double, v double, loss double, slope double, curve double, square double",
    "entries": "source long, target long, v double",
    "scores": "picture long, theta double, info double, comparisons long, mean double, prec double",
}


def _solved(cut: _Cut, at: DataFrame, side: float, kind: str) -> DataFrame:
    """What the leaves tell (``_TOLD``) when each has its best score, given the core's.

    A leaf of one link stays with its neighbour; the links of others meet at the leaf.
    """
    here = at.select(F.col("picture").alias("core"), F.col("theta").alias("at")).repartition(cut.parts, "core")
    met = cut.routes.rows.join(here, "core")
    link = F.struct("core", "sign", "weight", "won", "votes", "at")
    several = met.where("links > 1").repartition(cut.parts, "picture").groupBy("picture").agg(F.max("mean").alias("mean"), F.max("prec").alias("prec"), F.collect_list(link).alias("ends"))
    if kind != "entries":
        several = several.unionAll(met.where("links = 1").select("picture", "mean", "prec", F.array(link).alias("ends")))
    return several.mapInArrow(_solver(side, kind), _TOLD[kind])


def _solver(side: float, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_pydict(_solve(batch.slice(at, ROWS), side, kind))

    return run


def _solve(batch: pa.RecordBatch, side: float, kind: str) -> dict[str, np.ndarray]:
    """Newton steps within a bracket for each leaf; ``k`` is the leaf of a link."""
    n, ends = batch.num_rows, batch.column("ends")
    size, flat = pc.list_value_length(ends).to_numpy(zero_copy_only=False), ends.flatten()
    core, sign, weight, won, votes, at = (pc.struct_field(flat, x).to_numpy(zero_copy_only=False) for x in ("core", "sign", "weight", "won", "votes", "at"))
    mean, prec = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("mean", "prec"))
    k = np.repeat(np.arange(n), size)
    total = lambda x: np.bincount(k, weights=x, minlength=n)
    theta, reach = mean.copy(), total(weight) / prec
    low, high = mean - reach, mean + reach
    for turn in range(100):
        m = sign * (theta[k] - at) + side
        p = 1 / (1 + np.exp(np.minimum(-m, 700.0)))
        y, c = won - weight * p, weight * p * (1 - p)
        r, info = total(sign * y) - prec * (theta - mean), total(c) + prec
        step = r / info
        if turn == 99 or np.all(np.abs(step) < 1e-14 * (1 + np.abs(theta))):
            break
        low, high = np.where(r > 0, theta, low), np.where(r < 0, theta, high)
        there = theta + step
        theta = np.where((np.abs(step) > 1e-6) & ((there < low) | (there > high)), (low + high) / 2, there)
    if kind == "scores":
        return {"picture": batch.column("picture").to_numpy(), "theta": theta, "info": info, "comparisons": total(votes).astype(np.int64), "mean": mean, "prec": prec}
    if kind == "entries":
        begin = np.cumsum(size) - size
        place, out = np.arange(len(k)) - begin[k], []
        for ahead in range(1, int(size.max())):
            one = np.flatnonzero(size[k] > ahead)
            out.append((one, begin[k[one]] + (place[one] + ahead) % size[k[one]]))
        one, other = (np.concatenate(x) for x in zip(*out, strict=True))
        return {"source": core[one], "target": core[other], "v": -c[one] * c[other] / info[k[one]]}
    t = total(sign * c)
    loss = weight * (np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m)))) - won * m + (prec * (theta - mean) ** 2 / 2 / size)[k]
    return {"picture": core, "y": -sign * y, "c": c, "t": c * ((t / info)[k] - sign), "v": c - c * c / info[k], "loss": loss, "slope": y, "curve": c, "square": (t * t / info / size)[k]}


def _slopes(pairs: DataFrame, at: DataFrame, side: float, parts: int) -> DataFrame:
    """(left, right, y, c, loss): residual, curvature and negative log likelihood of each pair."""
    value = lambda side, name: at.select(F.col("picture").alias(side), F.col("theta").alias(name))
    met = pairs.join(value("left", "a").repartition(parts, "left"), "left").join(value("right", "b"), "right")
    met = met.withColumn("m", F.col("a") - F.col("b") + F.lit(side)).withColumn("p", 1 / (1 + F.exp(-F.col("m"))))
    loss = F.col("weight") * (F.greatest("m", F.lit(0.0)) + F.log1p(F.exp(-F.abs("m")))) - F.col("won") * F.col("m")
    curve = F.col("weight") * F.col("p") * (1 - F.col("p"))
    return met.select("left", "right", (F.col("won") - F.col("weight") * F.col("p")).alias("y"), curve.alias("c"), loss.alias("loss"))


def _sums(cut: _Cut, at: DataFrame, side: float) -> DataFrame:
    """(picture, y, c, t, v, and what the side bias gets): each link's share in the gradient, its picture's information,
    the side bias's column and the diagonal."""
    none = F.lit(0.0)
    end = lambda name, y, t, loss, slope, curve: F.struct(F.col(name).alias("picture"), y.alias("y"), F.col("c").alias("c"), t.alias("t"), F.col("c").alias("v"), loss.alias("loss"), slope.alias("slope"), curve.alias("curve"), none.alias("square"))
    left = end("left", F.col("y"), F.col("c"), F.col("loss"), F.col("y"), F.col("c"))
    return _slopes(cut.rest.rows, at, side, cut.parts).select(F.inline(F.array(left, end("right", -F.col("y"), -F.col("c"), none, none, none)))).unionByName(_solved(cut, at, side, "sums"))


def _entries(cut: _Cut, at: DataFrame, side: float) -> DataFrame:
    """(source, target, v): the matrix beside its diagonal, both ways; rows of one place add up."""
    end = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("target"), (-F.col("c")).alias("v"))
    return _slopes(cut.rest.rows, at, side, cut.parts).select(F.inline(F.array(end("left", "right"), end("right", "left")))).unionByName(_solved(cut, at, side, "entries"))


def _start(sums: DataFrame, at: DataFrame) -> DataFrame:
    """The state of conjugate gradients before their first pass: solution x, rest r, direction d; ``t`` is the side bias's
    column, ``v`` the diagonal without the prior."""
    sums = sums.groupBy("picture").agg(*[F.sum(k).alias(k) for k in "yctv"])
    none, c, y = F.lit(0.0), F.coalesce("c", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    rows = at.join(sums, "picture", "left").withColumns({"r": y - F.col("prec") * (F.col("theta") - F.col("mean")), "info": c + F.col("prec")})
    return rows.select(*_PICTURE, none.alias("x"), "r", (F.col("r") / _info()).alias("d"), none.alias("hd"), "info", F.coalesce("t", none).alias("t"), F.coalesce("v", none).alias("v"))


def _turn(entries: DataFrame, state: DataFrame, alpha: float, beta: float, side: float, parts: int) -> DataFrame:
    """Brings the state up to the pass and multiplies the new direction by the matrix."""
    rest = F.col("r") - F.lit(alpha) * F.col("hd")
    direction = F.col("d") if alpha == 0 else rest / _info() + F.lit(beta) * F.col("d")
    state = state.select(*_PICTURE, (F.col("x") + F.lit(alpha) * F.col("d")).alias("x"), rest.alias("r"), direction.alias("d"), "info", "t", "v")
    here = state.select(F.col("picture").alias("source"), "d").repartition(parts, "source")
    handed = entries.join(here, "source").groupBy(F.col("target").alias("picture")).agg(F.sum(F.col("v") * F.col("d")).alias("m"))
    hd = (F.col("v") + F.col("prec")) * F.col("d") + F.coalesce("m", F.lit(0.0)) + F.col("t") * F.lit(side)
    return state.join(handed, "picture", "left").withColumn("hd", hd).drop("m")


def _centred(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components that no prior holds, moved to a mean of 0."""
    member = components(pairs)
    rows = scores.join(member, "picture", "left").withColumn("root", F.coalesce("root", "picture"))
    shift = rows.groupBy("root").agg(F.avg("theta").alias("middle"), F.max("prec").alias("held"))
    return rows.join(shift, "root").withColumn("theta", F.when(F.col("held") > 0, F.col("theta")).otherwise(F.col("theta") - F.col("middle"))).drop("root", "middle", "held")


def components(pairs: DataFrame) -> DataFrame:
    """(picture, root): the least picture of each one's component, by handing on least roots and jumping to theirs."""
    both = work.kept(pairs.select(F.inline(F.array(F.struct(F.col("left").alias("a"), F.col("right").alias("b")), F.struct(F.col("right").alias("a"), F.col("left").alias("b"))))).distinct(), "links")
    roots = work.kept(both.groupBy(F.col("a").alias("picture")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("picture").alias("b"), "root"), "b").groupBy(F.col("a").alias("picture")).agg(F.min("root").alias("near"))
        met = roots.join(near, "picture").withColumn("low", F.least("root", "near"))
        # a root whose own root fell takes it at once, so paths halve; so do those that point to it
        fell = met.groupBy("root").agg(F.min("low").alias("fallen")).withColumnRenamed("root", "old")
        jumped = met.join(fell, met["low"] == fell["old"], "left").select("picture", "root", F.least("low", F.coalesce("fallen", "low")).alias("new"))
        new, seen = _observed(jumped, changed=F.count_if(F.col("new") != F.col("root")))
        before, roots = roots, work.kept(new.select("picture", F.col("new").alias("root")), "roots")
        _drop(before)
        if not seen.get["changed"]:
            _drop(both)
            return roots


def _drop(rows: DataFrame) -> None:
    for name in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        work.remove(rows.sparkSession, name)


def board(scores: DataFrame, least: int = 0) -> DataFrame:
    """Adds lower, upper and place, best first by the lower bound; places are counted in sorted ranges."""
    bound = scores.where(F.col("comparisons") >= least).withColumns({"lower": F.col("score") - Z * F.col("stderr"), "upper": F.col("score") + Z * F.col("stderr")})
    return numbered(bound, [F.desc("lower"), F.col("picture")], "place")


def _ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in ranges of the order, in column ``__range``; written, as ranges are drawn from a sample."""
    return work.kept(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds the place of each row in the order, from 1, counted range by range."""
    ranged = _ranged(rows, order)
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))  # a row per range
    before = F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    placed = ranged.join(F.broadcast(counts.select("__range", before.alias("__before"))), "__range")
    return placed.withColumn(out, (F.col("__before") + inside).cast("int")).drop("__range", "__before")


def _followers(rows: DataFrame) -> DataFrame:
    """(place, next): the first place whose upper bound is below the place's lower bound, if any.

    Bounds of both kinds are sorted together; the answer is the least place among the upper bounds before, range by
    range.  An upper bound equal to the lower bound doesn't count, so it is sorted behind.
    """
    ends = F.array(F.struct(F.col("upper").alias("at"), F.lit(1).alias("kind"), F.col("place").alias("place")), F.struct(F.col("lower").alias("at"), F.lit(0).alias("kind"), F.col("place").alias("place")))
    ranged = _ranged(rows.select(F.inline(ends)), [F.col("at"), F.col("kind"), F.col("place")])
    upper = F.when(F.col("kind") == 1, F.col("place"))
    lows = ranged.groupBy("__range").agg(F.min(upper).alias("low"))  # a row per range
    before = F.min("low").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    inside = F.min(upper).over(W.partitionBy("__range").orderBy("at", "kind", "place").rowsBetween(W.unboundedPreceding, -1))
    met = ranged.join(F.broadcast(lows.select("__range", before.alias("__before"))), "__range")
    return met.withColumn("next", F.least("__before", inside)).where("kind = 0").select("place", "next")


def tiers(ranked: DataFrame) -> DataFrame:
    """(picture, place, tier): a new tier begins where an upper bound is below the lower bound of the tier's leader.

    Each place knows which would lead after it, if it led; the leaders are the chain that begins with the first place.
    It is found by pointer jumping: the leaders known so far reach as many more by pointers of twice the length, so
    n tiers take log n joins.  A place's tier is the number of leaders up to it, counted in sorted ranges.
    """
    rows = work.kept(ranked.select("picture", "place", "lower", "upper"), "tiers")
    jump = work.kept(_followers(rows).where("next is not null"), "jumps")
    leaders = work.kept(rows.where("place = 1").select("place"), "leaders")
    while True:
        found = leaders.join(jump, "place").select(F.col("next").alias("place"))
        grown = work.kept(leaders.union(found).distinct(), "leaders")
        more = grown.count() > leaders.count()
        _drop(leaders)
        leaders = grown
        if not more:
            break
        ahead = jump.select(F.col("place").alias("next"), F.col("next").alias("then"))
        doubled = work.kept(jump.join(ahead, "next").select("place", F.col("then").alias("next")), "jumps")
        _drop(jump)
        jump = doubled
    first = F.when(F.col("lead").isNotNull(), 1).otherwise(0)
    flagged = _ranged(rows.join(leaders.withColumn("lead", F.lit(True)), "place", "left").select("picture", "place", first.alias("first")), [F.col("place")])
    counts = flagged.groupBy("__range").agg(F.sum("first").alias("n"))  # a row per range
    before = F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("first").over(W.partitionBy("__range").orderBy("place"))
    met = flagged.join(F.broadcast(counts.select("__range", before.alias("__before"))), "__range")
    return met.select("picture", "place", (F.col("__before") + inside).cast("int").alias("tier"))


def progress(pool: int, votes: int) -> list[tuple[str, int, int]]:
    """(stage, target, done) of the funnel: everything, then the best 500, then the best 50; a vote serves two pictures."""
    out = []
    for stage, n, each in zip(("screen", "contend", "settle"), (pool, min(pool, 500), min(pool, 50)), FUNNEL, strict=True):
        target = n * each // 2
        done = min(votes, target)
        votes -= done
        out.append((stage, target, done))
    return out


def budgets(votes: DataFrame, seconds: int = 3600) -> DataFrame:
    """(vote_id, voter, used): the voter's votes in the hour up to and with this one, a sliding range window."""
    at = F.col("voted_at").cast("timestamp").cast("double") * 1e6
    window = W.partitionBy("voter").orderBy(F.round(at).cast("long")).rangeBetween(-seconds * 1_000_000, 0)
    return votes.select("vote_id", "voter", F.count("*").over(window).alias("used"))


def capped(votes: DataFrame, least: int) -> DataFrame:
    """(picture, shown) of pictures that were shown at least so often, on either side."""
    both = votes.select(F.col("left").alias("picture")).unionAll(votes.select("right"))
    return both.groupBy("picture").agg(F.count("*").alias("shown")).where(F.col("shown") >= least)
