"""Ranking of many pictures: held to a plain fit, a plain scan of tiers, and to no single task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.operators import ranking
from daybook.plans import registry
from daybook.sources.tables import votes


def plain_fit(rows, prior=0.25, steps=4000):
    ids = sorted({x for r in rows for x in r[:2]})
    at = {x: i for i, x in enumerate(ids)}
    a, b = np.array([at[r[0]] for r in rows]), np.array([at[r[1]] for r in rows])
    y = np.array([{"left": 1.0, "right": 0.0, "tie": 0.5}[r[2]] for r in rows])
    theta, side = np.zeros(len(ids)), 0.0
    total = lambda k, x: np.bincount(k, weights=x, minlength=len(ids))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(theta[a] - theta[b] + side)))
        residual, curve = y - p, p * (1 - p)
        info = total(a, curve) + total(b, curve) + prior
        theta = theta + 0.5 * (total(a, residual) - total(b, residual) - prior * theta) / info
        side += 0.5 * (residual.sum() - side) / (curve.sum() + 1)
        theta -= theta.mean()
    return {x: (theta[at[x]], info[at[x]] ** -0.5) for x in ids}, side


@pytest.fixture(scope="module")
def cast():
    r = random.Random(3)
    out = []
    for _ in range(400):
        a, b = r.randrange(8), r.randrange(120)  # a few hubs, many that are seen a few times
        if a != b:
            out.append((a, b, r.choices(("left", "right", "tie"), (3 + a, 4, 1))[0]))
    return out


def test_fit_equals_a_plain_one(spark, cast):
    want, side = plain_fit(cast)
    got = ranking.fit(spark.createDataFrame(cast, "left long, right long, outcome string")).collect()
    assert {x.picture for x in got} == set(want)
    assert max(abs(x.score - want[x.picture][0]) for x in got) < 1e-8
    assert max(abs(x.stderr - want[x.picture][1]) for x in got) < 1e-8
    assert max(abs(x.side_bias - side) for x in got) < 1e-8


def test_fit_of_no_votes(spark):
    assert ranking.fit(spark.createDataFrame([], "left long, right long, outcome string")).count() == 0


def test_places_and_tiers_equal_a_plain_scan(spark):
    r = random.Random(4)
    rows = [(i, r.choice((r.gauss(0, 3), 1.0)), r.choice((0.05, 0.2, 1.0)), 5) for i in range(500)]
    frame = spark.createDataFrame(rows, "picture long, score double, stderr double, comparisons long")
    order = sorted(rows, key=lambda x: (-(x[1] - ranking.Z * x[2]), x[0]))
    tier, leader, want = 0, None, {}
    for place, (i, score, error, _) in enumerate(order, 1):
        if leader is None or score + ranking.Z * error < leader:
            tier, leader = tier + 1, score - ranking.Z * error
        want[i] = (place, tier)
    assert tier > 5
    board = ranking.board(frame)
    assert board.columns == [*frame.columns, "lower", "upper", "place"]
    out = ranking.tiers(board)
    assert {x.picture: (x.place, x.tier) for x in out.collect()} == want
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "int"]
    assert ranking.tiers(ranking.board(frame.where("picture < 0"))).count() == 0


def test_registered_ranking_takes_whole_ids(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("event_id"), (F.col("id") % 45).alias("user_id"), F.lit("buy").alias("event_type"), (F.col("id") % 20).cast("double").alias("value"), F.current_timestamp().alias("ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    whole = votes(spark, str(tmp_path), groups=None).where("left <> right")
    pictures = {x[0] for x in whole.select("left").union(whole.select("right")).collect()}
    assert len(pictures) > 45
    assert {x.picture for x in registry.R01_fit(spark, str(tmp_path)).collect()} == pictures


def dense(rows, sigma, anchors=None):
    """Newton's method on the whole matrix; components without a prior are centred."""
    anchors = anchors or {}
    ids = sorted({x for r in rows for x in r[:2]} | set(anchors))
    at = {x: i for i, x in enumerate(ids)}
    base = 0.0 if sigma == float("inf") else sigma**-2
    mean = np.array([anchors[x][0] if x in anchors else 0.0 for x in ids])
    prec = np.array([max(anchors[x][1] / 4, base) if x in anchors else base for x in ids])
    root = list(range(len(ids)))
    for _ in ids:
        for a, b, _ in rows:
            root[at[a]] = root[at[b]] = min(root[at[a]], root[at[b]])
    parts = [[i for i in range(len(ids)) if root[i] == k] for k in sorted(set(root))]
    free = [p for p in parts if not prec[p].any()]
    x = np.append(mean, 0.0)
    for _ in range(60):
        g, h = np.append(-prec * (x[:-1] - mean), -x[-1]), np.diag(np.append(prec, 1.0))
        for a, b, how in rows:
            v = np.zeros(len(x))
            v[at[a]], v[at[b]], v[-1] = 1.0, -1.0, 1.0
            p = 1 / (1 + np.exp(-v @ x))
            g += ({"left": 1.0, "right": 0.0, "tie": 0.5}[how] - p) * v
            h += p * (1 - p) * np.outer(v, v)
        for p in free:  # the gauge: no move of a free component as a whole
            v = np.zeros(len(x))
            v[p] = 1.0
            h += np.outer(v, v)
        step = np.linalg.solve(h, g)
        x = x + step
        if np.abs(step).max() < 1e-13:
            break
    for p in free:
        x[p] -= x[p].mean()
    info = np.diag(h)[:-1] - np.array([1.0 if any(i in p for p in free) else 0.0 for i in range(len(ids))])
    return {i: (x[at[i]], info[at[i]] ** -0.5 if info[at[i]] > 0 else None) for i in ids}, x[-1]


def parts_of(seed):
    """Votes in three components, nobody wins or loses always."""
    r, out = random.Random(seed), []
    for base, n in ((0, 12), (100, 5), (200, 2)):
        for a in range(n):
            for b in (a + 1, a + 3):
                for how in ("left", "right", r.choice(("left", "tie"))):
                    pair = (base + a, base + b % n)
                    if pair[0] != pair[1]:
                        out.append((*(pair if r.random() < 0.5 else pair[::-1]), how))
    return out


@pytest.mark.parametrize("sigma", [2.0, float("inf")])
def test_anchored_fit_equals_a_dense_solver(spark, sigma):
    rows, anchors = parts_of(5), {0: (1.5, 40.0), 3: (-0.5, 2.0), 101: (0.7, 10.0), 900: (2.5, 8.0)}
    want, side = dense(rows, sigma, anchors)
    votes_, prior = spark.createDataFrame(rows, "left long, right long, outcome string"), spark.createDataFrame([(i, *a) for i, a in anchors.items()], "picture long, score double, ess double")
    got = {x.picture: x for x in ranking.fit(votes_, sigma, prior).collect()}
    assert set(got) == set(want)
    for i, (score, error) in want.items():
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].stderr == pytest.approx(error, abs=1e-9)
        assert got[i].side_bias == pytest.approx(side, abs=1e-9)
    assert (got[900].score, got[900].comparisons) == (2.5, 0)
    if sigma != 2.0:
        return
    again = {x.picture: x.score for x in ranking.fit(votes_, sigma, prior, start=spark.createDataFrame([(i, float(s)) for i, (s, _) in want.items()], "picture long, score double")).collect()}
    assert all(again[i] == pytest.approx(s, abs=1e-9) for i, (s, _) in want.items())


def test_only_anchors(spark):
    prior = spark.createDataFrame([(1, 0.5, 16.0)], "picture long, score double, ess double")
    none = spark.createDataFrame([], "left long, right long, outcome string")
    assert [tuple(x)[:4] for x in ranking.fit(none, anchors=prior).collect()] == [(1, 0.5, 0.5, 0)]


def test_ten_thousand_tiers(spark):
    """Each place leads a tier of its own, but for every third, which leans on the one before."""
    frame = spark.range(15000).select(F.col("id").alias("picture"), (-F.col("id") * 1.0).alias("score"), F.when(F.col("id") % 3 == 1, 0.55).otherwise(0.1).alias("stderr"), F.lit(9).alias("comparisons"))
    rows = sorted(((r.picture, r.score - ranking.Z * r.stderr, r.score + ranking.Z * r.stderr) for r in frame.collect()), key=lambda x: (-x[1], x[0]))
    tier, leader, want = 0, float("inf"), {}
    for picture, low, high in rows:
        if high < leader:
            tier, leader = tier + 1, low
        want[picture] = tier
    got = {r.picture: r.tier for r in ranking.tiers(ranking.board(frame)).collect()}
    assert got == want and tier >= 10000


def test_components_of_a_long_chain(spark):
    pairs = [(i * 7 % 200, (i + 1) * 7 % 200) for i in range(150)] + [(1000, 1001), (1002, 1001)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.picture: r.root for r in ranking.components(spark.createDataFrame(pairs, "left long, right long")).collect()}
    assert got == root


def _shuffled(spark, since=-1):
    """(rows shuffled by the stages after one, the last stage)."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    told = [(s.stageId(), s.shuffleWriteRecords()) for s in (stages.apply(i) for i in range(stages.size()))]
    return sum(n for i, n in told if i > since), max(i for i, _ in told)


def test_a_fit_shuffles_links_by_step_and_not_by_pass(spark):
    """Leaves of one link to more than are taken out, on either side, some linked twice with the same picture."""
    r = random.Random(6)
    rows = [(a, (a + b) % 12, r.choice(("left", "right"))) for a in range(12) for b in (1, 3)]
    for leaf in range(100, 900):
        for hub in r.choices(range(12), k=r.choice((1, 1, 2, 3, 5, ranking.FEW + 2 if leaf < 120 else 2))):
            rows.append((*((hub, leaf) if r.random() < 0.8 else (leaf, hub)), r.choices(("left", "right", "tie"), (3 + hub, 5, 2))[0]))
    want, side = plain_fit(rows)
    frame = spark.createDataFrame(rows, "left long, right long, outcome string")
    frame.count()
    _, last = _shuffled(spark)
    got = {x.picture: x for x in ranking.fit(frame).collect()}
    shuffled, _ = _shuffled(spark, last)
    assert set(got) == set(want)
    assert max(abs(got[x].score - score) for x, (score, _) in want.items()) < 1e-8
    assert max(abs(got[x].stderr - error) for x, (_, error) in want.items()) < 1e-8
    assert max(abs(x.side_bias - side) for x in got.values()) < 1e-8
    assert shuffled < 40 * len(rows)
