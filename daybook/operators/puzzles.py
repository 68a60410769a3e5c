"""Puzzles from the archive: redacted texts, deterministic draws, streaks and scores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.batches import of_pandas
from ..functions.hashing import MASK, hash64, word_hashes
from ..sources import work
from . import ranking

_CLOZE_WORD = re.compile(r"(?:\d+(?:[,.]\d+)*|[^\W\d_])(?:['’-]?(?:\d+(?:[,.]\d+)*|[^\W\d_]))*")
CLOZE = "hidden int, distinct_hidden int, pieces array<struct<shown:string, hash:string, length:int>>"


def text_pool(entries: DataFrame, stats: DataFrame, low: int = 90, high: int = 200) -> DataFrame:
    """Ids of image or video entries with a text of fitting length."""
    return stats.where(F.col("words").between(low, high)).join(entries.where("kind in ('image', 'video')").select("date_id"), "date_id").select("date_id")


def cloze(texts: DataFrame, given: frozenset[str], salt: int) -> DataFrame:
    """(date_id, hidden, distinct_hidden, pieces): words outside ``given`` become a salted hash and a length.

    ``given`` is a bounded list (200 words by default of its query); numbers without a letter are shown.
    """

    def cut(raw: str | None) -> list[tuple[int, int, str]]:
        """(start, end, word) of what is hidden."""
        found = ((m.start(), m.end(), m[0].replace("’", "'").lower()) for m in _CLOZE_WORD.finditer(raw or ""))
        return [x for x in found if x[2] not in given and any(c.isalpha() for c in x[2])]

    def pieces(raw: str, hidden: list[tuple[int, int, str]], hashes: dict[str, str]) -> list[dict]:
        out, at = [], 0
        for start, end, word in hidden:
            if start > at:
                out.append({"shown": raw[at:start], "hash": None, "length": None})
            out.append({"shown": None, "hash": hashes[word], "length": end - start})
            at = end
        return out + ([{"shown": raw[at:], "hash": None, "length": None}] if raw and at < len(raw) else [])

    def run(frames):
        for frame in (f[at:to] for f in frames for at, to in of_pandas((f["text"],))):
            cuts = [cut(t) for t in frame["text"]]
            words = list({w for c in cuts for _, _, w in c})  # hashed once a portion
            hashes = dict(zip(words, word_hashes(salt, words), strict=True))
            yield pd.DataFrame({
                "date_id": frame["date_id"], "hidden": [len(c) for c in cuts], "distinct_hidden": [len({hashes[w] for _, _, w in c}) for c in cuts],
                "pieces": [pieces(t, c, hashes) for t, c in zip(frame["text"], cuts, strict=True)],
            })

    return texts.select(F.col("date_id").cast("long"), "text").mapInPandas(run, f"date_id long, {CLOZE}")


def draw(pool: DataFrame, seed: str, n: int) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed and pool."""
    return pool.withColumn("_draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("date_id").cast("string")), 256)).orderBy("_draw", "date_id").limit(n).drop("_draw")


def streaks(results: DataFrame) -> DataFrame:
    """(game, first, last, days): runs of consecutive days on which a game was played."""
    days = results.select("game", "day").distinct()
    island = F.date_sub("day", F.row_number().over(W.partitionBy("game").orderBy("day")))
    return days.withColumn("_island", island).groupBy("game", "_island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).drop("_island")


def date_score(days_off: Column, span_days: Column, worth: float = 1.0) -> Column:
    """Halves at 8 percent of the span."""
    return F.round(1000 * worth / (1 + days_off / (0.08 * span_days)))


#: Words that a puzzle may give away; more are an error, none is dropped.
MOST_GIVEN = 10_000


def given_set(rows: DataFrame) -> frozenset[str]:
    """The words of a bounded list, for ``cloze``."""
    words = [r["word"] for r in rows.select("word").limit(MOST_GIVEN + 1).collect()]
    if len(words) > MOST_GIVEN:
        raise ValueError(f"more than {MOST_GIVEN} words are given away")
    return frozenset(words)


# -- seeded deals -------------------------------------------------------------------------------------------------

#: The step of the generator, its two multipliers, and what a game's seed is mixed with.
STEP, MIX_1, MIX_2, GAME = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x5EEDA90D19950616
#: Days between a picture of a chain and the next, and rounds of a chain.
APART, ROUNDS = 180, 10


def _mixed(z: int) -> int:
    z = ((z ^ (z >> 30)) * MIX_1) & MASK
    z = ((z ^ (z >> 27)) * MIX_2) & MASK
    return z ^ (z >> 31)


class Deal:
    """Draws from a seed: the same game on the same day deals the same everywhere."""

    def __init__(self, state: int):
        self.state = state

    @classmethod
    def daily(cls, game: str, day: int) -> Deal:
        seed = _mixed(hash64(game.encode()) ^ hash64(day.to_bytes(4, "big", signed=True)))
        return cls(_mixed(seed ^ GAME))

    @classmethod
    def seeded(cls, seed: int) -> Deal:
        return cls(_mixed(seed & MASK))

    def next(self) -> int:
        self.state = (self.state + STEP) & MASK
        return _mixed(self.state)

    def ranks(self, size: int, count: int) -> list[int]:
        """``count`` different ranks below ``size``, by drawing again what was drawn before."""
        out: dict[int, None] = {}
        while len(out) < min(count, size):
            out.setdefault(self.next() % size)
        return list(out)

    def shuffled(self, items: list) -> list:
        """A short list in another order."""
        out = list(items)
        for last in range(len(out) - 1, 0, -1):
            other = self.next() % (last + 1)
            out[last], out[other] = out[other], out[last]
        return out


class Ranked:
    """A pool of dates by rank: written with places counted in sorted ranges, never gathered.

    A look-up reads the row groups of a place or of a date, as both grow along the files.
    """

    def __init__(self, pool: DataFrame):
        placed = ranking.numbered(pool.select(F.col("date_id").cast("long").alias("date_id")).distinct(), [F.col("date_id")], "place")
        self.rows = work.kept(placed.select("date_id", (F.col("place") - 1).alias("rank")), "pool")
        self.size = self.rows.count()

    def dates(self, ranks: list[int]) -> list[int]:
        """The dates of a few ranks, in their order."""
        found = {r["rank"]: r["date_id"] for r in self.rows.where(F.col("rank").isin(ranks)).collect()}
        return [found[k] for k in ranks]

    def below(self, date_id: int) -> int:
        """How many dates of the pool are before this one."""
        last = self.rows.where(F.col("date_id") < date_id).agg(F.max("rank")).first()[0]
        return 0 if last is None else last + 1

    def rank(self, date_id: int) -> int | None:
        return (self.rows.where(F.col("date_id") == date_id).agg(F.max("rank")).first() or [None])[0]


def take(pool: DataFrame, deal: Deal, count: int) -> list[int]:
    """``count`` dates of the pool, drawn by rank."""
    ranked = Ranked(pool)
    return ranked.dates(deal.ranks(ranked.size, count))


def _nth_outside(n: int, low: int, high: int, used: list[int]) -> int:
    """The n-th rank that is not from ``low`` to ``high`` (without) and not used."""
    at = n
    for start, size in sorted([(low, high - low)] * (high > low) + [(u, 1) for u in used if not low <= u < high]):
        if at >= start:
            at += size
    return at


def chain(pool: DataFrame, deal: Deal, rounds: int = ROUNDS, first: int | None = None, apart: int = APART) -> list[int]:
    """Dates for so many rounds of two neighbours: each next one is ``apart`` days away at least, none comes twice.

    Where no such date is left, any unused one is taken.  How many dates qualify, and which the drawn one is, follows
    from ranks: those of the days around the last date, and those used.
    """
    ranked = Ranked(pool)
    start = None if first is None else ranked.rank(first)
    ranks = [start] if start is not None else deal.ranks(ranked.size, 1)
    dates = ranked.dates(ranks)
    while dates and len(dates) <= rounds:
        low, high = ranked.below(dates[-1] - apart + 1), ranked.below(dates[-1] + apart)
        fitting = ranked.size - (high - low) - sum(not low <= u < high for u in ranks)
        if not fitting:
            low = high = 0
            fitting = ranked.size - len(ranks)
        drawn = deal.ranks(fitting, 1)
        if not drawn:
            break
        ranks.append(_nth_outside(drawn[0], low, high, ranks))
        dates += ranked.dates(ranks[-1:])
    return dates
