"""Vote budgets: who may still vote in the hour, on a table and on a stream, by the same fold.

A vote is refused when its voter (or its cohort) has used up the budget of the window before it; refused votes are not
recorded, so they use nothing up.  ``asked`` counts all votes of the window with this one, ``used`` the accepted ones.

On a stream, votes wait until the watermark passes them and are then walked in order of time, so the result doesn't
depend on the order in which they come, and equals the table's.  State is a key's waiting votes and the times of one
window; a timer empties it once the watermark is past the window of the last vote.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Votes that a voter and a cohort may cast in a window of so many seconds.
VOTER_LIMIT, COHORT_LIMIT, WINDOW = 300, 1000, 3600

OUT = "vote_id long, `key` string, voted_at timestamp, asked long, used long, refused boolean"
_ROW = "vote_id long, at long"


class Budget:
    """The fold over the votes of one key in order of (time, id); times in microseconds."""

    def __init__(self, limit: int, window: int, asked: list[int] = (), used: list[int] = ()):
        self.limit, self.window = limit, window * 1_000_000
        self.asked, self.used = deque(asked), deque(used)

    def cast(self, at: int) -> tuple[int, int, bool]:
        for times in (self.asked, self.used):
            while times and times[0] < at - self.window:
                times.popleft()
        self.asked.append(at)
        refused = len(self.used) >= self.limit
        if not refused:
            self.used.append(at)
        return len(self.asked), len(self.used), refused


def _walked(limit: int, window: int):
    """Votes sorted by key and time, walked batch by batch: no key is held whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, budget = None, None
        for rows in frames:
            told = []
            for k, at in zip(rows["key"], rows["at"], strict=True):
                if budget is None or k != key:
                    key, budget = k, Budget(limit, window)
                told.append(budget.cast(at))
            asked, used, refused = zip(*told, strict=True) if told else ((), (), ())
            yield rows.assign(asked=asked, used=used, refused=refused)[["vote_id", "key", "voted_at", "asked", "used", "refused"]]

    return run


class _Waiting(StatefulProcessor):
    """Votes of a key: kept until the watermark is past them, then walked in order."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.asked = handle.getListState("asked", "at long")
        self.used = handle.getListState("used", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = [(int(i), int(at)) for i, at in zip(frame["vote_id"], frame["at"], strict=True)]
            if new:
                self.waiting.appendList(new)
                first = min([first] * (first is not None) + [at for _, at in new])
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        votes = sorted(self.waiting.get(), key=lambda v: (v[1], v[0])) if self.waiting.exists() else []
        due, later = [v for v in votes if v[1] <= passed], [v for v in votes if v[1] > passed]
        held = [[x[0] for x in state.get()] if state.exists() else [] for state in (self.asked, self.used)]
        budget = Budget(self.limit, self.window, *held)
        told = [(i, key[0], pd.Timestamp(at, unit="us"), *budget.cast(at)) for i, at in due]
        for state, rows in ((self.waiting, later), (self.asked, [(t,) for t in budget.asked if t >= passed - budget.window]), (self.used, [(t,) for t in budget.used if t >= passed - budget.window])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        ends = [at // 1000 + 1 for _, at in later[:1]] + [(t + budget.window) // 1000 + 1 for t in list(budget.asked)[-1:] if t >= passed - budget.window]
        if ends:
            self.handle.registerTimer(min(ends))
        if told:
            yield pd.DataFrame(told, columns=["vote_id", "key", "voted_at", "asked", "used", "refused"])

    def close(self) -> None:
        pass


def budgets(votes: DataFrame, key: str, limit: int = VOTER_LIMIT, window: int = WINDOW, lateness: str = "10 minutes") -> DataFrame:
    """(vote_id, key, voted_at, asked, used, refused) of votes (vote_id, voted_at and the column ``key``).

    A stream needs the RocksDB state store; votes later than ``lateness`` behind the newest are dropped there.
    """
    rows = votes.select("vote_id", F.col(key).cast("string").alias("key"), F.col("voted_at").cast("timestamp").alias("voted_at"))
    if not votes.isStreaming:
        timed = rows.withColumn("at", F.unix_micros("voted_at")).repartition("key").sortWithinPartitions("key", "at", "vote_id")
        return timed.mapInPandas(_walked(limit, window), OUT)
    timed = rows.withWatermark("voted_at", lateness).withColumn("at", F.unix_micros("voted_at"))
    return timed.groupBy("key").transformWithStateInPandas(_Waiting(limit, window), OUT, "Append", "EventTime")


def within_budgets(votes: DataFrame, voter_limit: int = VOTER_LIMIT, cohort_limit: int = COHORT_LIMIT, window: int = WINDOW) -> DataFrame:
    """(vote_id, voter, cohort, voted_at, refused_by) of a table of votes: 'voter', 'cohort' or null; a cohort is only asked for votes that the voter's budget lets through."""
    by_voter = budgets(votes, "voter", voter_limit, window).select("vote_id", "refused")
    rows = votes.join(by_voter, "vote_id")
    by_cohort = budgets(rows.where("not refused and cohort is not null"), "cohort", cohort_limit, window).select("vote_id", F.col("refused").alias("full"))
    told = F.when(F.col("refused"), "voter").when(F.col("full"), "cohort")
    return rows.join(by_cohort, "vote_id", "left").select("vote_id", "voter", "cohort", "voted_at", told.alias("refused_by"))
