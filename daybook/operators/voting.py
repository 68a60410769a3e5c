"""Votes and voters: the weighted log, cohorts, tallies, stored fits with priors from a baseline, and picks of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking

#: What one comparison of equals tells about a score, and the most that a baseline may claim.
COMPARISON_INFORMATION, MOST_EFFECTIVE = 0.25, 50.0
BAND = 0.25


def to_left(outcome: Column) -> Column:
    """What the left picture won: a tie is half."""
    return F.when(outcome == "left", 1.0).when(outcome == "right", 0.0).when(outcome == "tie", 0.5)


def counted_votes(votes: DataFrame, voters: DataFrame) -> DataFrame:
    """Votes of voters that aren't blocked, with the voter's weight."""
    return votes.join(voters.where("not blocked").select("voter", "weight"), "voter")


def cohort_use(votes: DataFrame, voters: DataFrame, since: Column) -> DataFrame:
    """(cohort, used): votes of each cohort since an instant."""
    recent = votes.where(F.col("voted_at") >= since).join(voters.where("cohort is not null").select("voter", "cohort"), "voter")
    return recent.groupBy("cohort").agg(F.count("*").alias("used"))


def tally(votes: DataFrame, voters: DataFrame, fits: DataFrame) -> DataFrame:
    """(category, votes, voters, fitted_at): voters that aren't blocked are counted over all categories."""
    per = votes.groupBy("category").agg(F.count("*").alias("votes"))
    everyone = voters.agg(F.count_if(~F.col("blocked")).alias("voters"))
    last = fits.groupBy("category").agg(F.max("fitted_at").alias("fitted_at"))
    return per.join(F.broadcast(everyone)).join(last, "category", "left")  # one row of voters


def group_votes(votes: DataFrame, grouping: DataFrame) -> DataFrame:
    """Votes between groups of pictures; a picture without a group is its own."""
    left = grouping.withColumnsRenamed({"date_id": "left", "picture_group": "_l"})
    right = grouping.withColumnsRenamed({"date_id": "right", "picture_group": "_r"})
    both = votes.join(left, "left", "left").join(right, "right", "left")
    return both.withColumns({"left": F.coalesce("_l", "left"), "right": F.coalesce("_r", "right")}).drop("_l", "_r")


def recorded(voters: DataFrame, casts: DataFrame) -> DataFrame:
    """Voters after casts (voter, at, cohort, life in seconds): a cohort is replaced only where there is none or it is over.

    A voter's first cast of the batch decides; the fold over many casts is ``streaming.ledger.sticky_cohorts``.
    """
    first = casts.groupBy("voter").agg(F.min_by(F.struct("at", "cohort", "life"), "at").alias("c"))
    both = voters.join(first, "voter", "full")
    over = F.col("cohort").isNull() | (F.col("expires_at") < F.col("c.at"))
    fresh = F.col("c").isNotNull() & over
    return both.select(
        "voter", F.when(fresh, F.col("c.cohort")).otherwise(F.col("cohort")).alias("cohort"),
        F.when(fresh, F.timestamp_seconds(F.col("c.at").cast("double") + F.col("c.life"))).otherwise(F.col("expires_at")).alias("expires_at"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("weight", F.lit(1.0)).alias("weight"),
    )


def saved(scores: DataFrame, fit: DataFrame) -> DataFrame:
    """Stored scores after a fit: rows with a prior stay even where the fit has none, others are the fit's.

    ``scores`` has picture, score, stderr, comparisons, prior_score, prior_stderr; ``fit`` the first four.
    """
    new = fit.select("picture", *[F.col(c).alias(f"_{c}") for c in ("score", "stderr", "comparisons")])
    both = scores.join(new, "picture", "full").where("_score is not null or prior_score is not null")
    kept = {c: F.coalesce(f"_{c}", c).alias(c) for c in ("score", "stderr", "comparisons")}
    return both.select("picture", *kept.values(), "prior_score", "prior_stderr")


def anchors(dataset: DataFrame) -> DataFrame:
    """(picture, score, ess, stderr): a baseline's scores with their claim cut to what is allowed."""
    ess = F.least(F.greatest(F.col("ess"), F.lit(0.0)), F.lit(MOST_EFFECTIVE))
    return dataset.select("picture", "score", ess.alias("ess"), (1 / F.sqrt(F.nullif(ess * COMPARISON_INFORMATION, F.lit(0.0)))).alias("stderr"))


def imported(scores: DataFrame, dataset: DataFrame) -> DataFrame:
    """Stored scores with the priors of a baseline; live scores stay, pictures without one take the prior's."""
    prior = anchors(dataset).select("picture", F.col("score").alias("_s"), F.col("stderr").alias("_e"))
    both = scores.drop("prior_score", "prior_stderr").join(prior, "picture", "full")
    return both.select(
        "picture", F.coalesce("score", "_s").alias("score"), F.coalesce("stderr", "_e").alias("stderr"), F.coalesce("comparisons", F.lit(0)).alias("comparisons"),
        F.col("_s").alias("prior_score"), F.col("_e").alias("prior_stderr"),
    )


def forgotten(votes: DataFrame, voters: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes and voters without those listed."""
    return votes.join(gone.select("voter"), "voter", "left_anti"), voters.join(gone.select("voter"), "voter", "left_anti")


def flagged(voters: DataFrame, changes: DataFrame) -> DataFrame:
    """Voters with ``blocked`` and ``weight`` replaced where ``changes`` has a value."""
    new = changes.select("voter", F.col("blocked").alias("_b"), F.col("weight").alias("_w"))
    return voters.join(new, "voter", "left").withColumns({"blocked": F.coalesce("_b", "blocked"), "weight": F.coalesce("_w", "weight")}).drop("_b", "_w")


def expired(voters: DataFrame, now: Column) -> DataFrame:
    """Cohorts that are over are emptied."""
    over = F.col("expires_at") < now
    return voters.withColumns({"cohort": F.when(~over, F.col("cohort")), "expires_at": F.when(~over, F.col("expires_at"))})


def still_active(voters: DataFrame, votes: DataFrame, since: Column) -> DataFrame:
    """Voters with a vote since an instant."""
    return voters.join(votes.where(F.col("voted_at") >= since).select("voter").distinct(), "voter", "left_semi")


def avoided(recent: DataFrame, capped: DataFrame) -> DataFrame:
    """(picture): what was shown lately or as often as it may be."""
    return recent.select("picture").union(capped.select("picture")).distinct()


def favourite(board: DataFrame) -> DataFrame:
    """The leader, only if settled and above the second one's reach; ``board`` has score, lower, upper and settled."""
    two = board.orderBy(F.desc("score"), "picture").limit(2)
    pair = two.agg(F.max_by(F.struct("picture", "score", "lower", "settled"), "score").alias("a"), F.min_by(F.struct("upper"), "score").alias("b"), F.count("*").alias("n"))
    return pair.where("n = 2 and a.settled and b.upper < a.lower").select("a.picture", "a.score")


def tiers_on_page(tiers: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of a board whose tiers were numbered over the whole of it."""
    return tiers.orderBy(F.desc("score"), "picture").offset(offset).limit(limit)


def bands(scores: DataFrame) -> DataFrame:
    """(band, pictures, doubt): bands of a quarter of a point with the sum of squared standard errors, which is how
    likely a pair is drawn from each."""
    return scores.groupBy(F.floor(F.col("score") / BAND).alias("band")).agg(F.count("*").alias("pictures"), F.sum(F.col("stderr") * F.col("stderr")).alias("doubt"))


def drawn_pairs(scores: DataFrame, n: int, seed: int, avoid: DataFrame | None = None) -> DataFrame:
    """(draw, left, right): pairs of pictures of one band, bands drawn by doubt, of four candidates the one compared least.

    Bands number a few hundred at most (scores over a quarter); the draws are rows, and each meets its band's pictures
    by their random place, counted in sorted ranges, so no pool and no band is gathered.
    """
    pool = scores if avoid is None else scores.join(avoid, "picture", "left_anti")
    spark = scores.sparkSession
    from pyspark.sql import Window as W

    placed = pool.select("picture", "comparisons", F.floor(F.col("score") / BAND).alias("band"))
    placed = ranking.numbered(placed, [F.col("band"), F.xxhash64("picture", F.lit(seed)), F.col("picture")], "_at")
    line = W.orderBy("band")
    every = bands(pool)
    starts = every.select("band", (F.sum("pictures").over(line) - F.col("pictures")).alias("_start"))
    placed = placed.join(F.broadcast(starts), "band").select("picture", "comparisons", "band", (F.col("_at") - 1 - F.col("_start")).alias("place"))
    known = every.where("pictures > 1").withColumns({"upto": F.sum("doubt").over(line), "whole": F.sum("doubt").over(W.partitionBy())})
    chance = lambda k: F.pmod(F.xxhash64("draw", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("_u", chance(0))
    chosen = draws.join(F.broadcast(known), F.col("_u") * F.col("whole") < F.col("upto"))
    chosen = chosen.groupBy("draw").agg(F.min(F.struct("upto", "band", "pictures")).alias("b")).select("draw", "b.band", "b.pictures")
    tries = F.explode(F.array(*[F.struct(F.lit(k // 4).alias("side"), F.floor(chance(k + 1) * F.col("pictures")).alias("place")) for k in range(8)])).alias("t")
    met = chosen.select("draw", "band", tries).select("draw", "band", "t.side", "t.place").join(placed, ["band", "place"])
    best = met.groupBy("draw", "side").agg(F.min(F.struct("comparisons", F.xxhash64("picture", "draw"), "picture")).alias("m")).select("draw", "side", "m.picture")
    sides = best.groupBy("draw").agg(F.max(F.when(F.col("side") == 0, F.col("picture"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("picture"))).alias("y"))
    flip = chance(99) < 0.5
    return sides.where("x <> y").select("draw", F.when(flip, F.col("x")).otherwise(F.col("y")).alias("left"), F.when(flip, F.col("y")).otherwise(F.col("x")).alias("right"))


def weighted_category(draw: Column, share: float) -> Column:
    """One of two categories by a uniform draw."""
    return F.when(draw < share, "first").otherwise("second")
