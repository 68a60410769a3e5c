"""Statistics over the archive: totals, timeline, coverage, gaps, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import ratio


def filtered(entries: DataFrame, *, first=None, last=None, kinds=None, copyright: bool | None = None) -> DataFrame:
    """Inclusive dates, kinds and the copyright flag; all optional."""
    for wanted, rule in ((first, F.col("date") >= F.lit(first)), (last, F.col("date") <= F.lit(last)), (copyright, F.col("copyright") == F.lit(copyright))):
        if wanted is not None:
            entries = entries.where(rule)
    return entries if kinds is None else entries.where(F.col("kind").isin(list(kinds)))


def totals(entries: DataFrame) -> DataFrame:
    """One row: entries, first and last date, how many carry a copyright, days without an entry in between."""
    span = F.datediff(F.max("date"), F.min("date")) + 1
    return entries.agg(
        F.count("*").alias("entries"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.coalesce(F.sum(F.col("copyright").cast("long")), F.lit(0)).alias("copyrighted"), (span - F.count_distinct("date")).cast("long").alias("gaps"),
    )


def text_summary(entries: DataFrame) -> DataFrame:
    """One row over all entries and words; zeros for an empty archive.

    Every text is split once: its words and one row without a word, which carries its size, are summed by word.
    """
    cut = entries.select(T.words(F.col("text")).alias("w"), F.char_length("text").alias("chars"))
    rows = cut.select(F.size("w").cast("long").alias("size"), "chars", F.explode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("word"))
    own = lambda c: F.when(F.col("word").isNull(), F.col(c))
    per = rows.groupBy("word").agg(
        F.count("*").alias("total"), F.sum(own("size")).alias("words"), F.min(own("size")).alias("shortest"), F.max(own("size")).alias("longest"), F.sum(own("chars")).alias("chars"),
    )
    none = F.col("word").isNull()
    both = per.agg(
        F.coalesce(F.max(F.when(none, F.col("total"))), F.lit(0)).alias("entries"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("words", "shortest", "longest", "chars")],
        F.count("word").alias("vocabulary"), F.count_if(~none & (F.col("total") == 1)).alias("used_once"),
    )
    return both.withColumn("mean_words", F.round(ratio(F.col("words"), F.col("entries")), 6))


def timeline(entries: DataFrame) -> DataFrame:
    """(year, entries, images, videos, words, distinct_words, new_words)

    Texts are split once, into (year, word) counts; kinds are counted from a scan without texts.
    """
    year = F.year("date").alias("year")
    base = entries.groupBy(year).agg(F.count("*").alias("entries"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"))
    per = entries.select(year, F.explode(T.words(F.col("text"))).alias("word")).groupBy("year", "word").agg(F.count("*").alias("n"))
    first = per.withColumn("_first", F.min("year").over(W.partitionBy("word")))  # a row a year at most
    words = first.groupBy("year").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"), F.count_if(F.col("year") == F.col("_first")).alias("new_words"))
    return base.join(words, "year", "left").fillna(0, ["words", "distinct_words", "new_words"])


def coverage(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.count("*").alias("entries"))


def coverage_totals(entries: DataFrame) -> DataFrame:
    """Months, years and everything in one pass; nulls mark the sums."""
    return entries.select(F.year("date").alias("year"), F.month("date").alias("month")).rollup("year", "month").agg(F.count("*").alias("entries"))


def missing_days(dates: DataFrame) -> DataFrame:
    """(day) of the span that has no row."""
    span = dates.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).join(dates.select(F.col("date").alias("day")).distinct(), "day", "left_anti")


def gap_runs(days: DataFrame) -> DataFrame:
    """(first, last, days) of consecutive missing days."""
    island = F.date_sub("day", F.row_number().over(W.orderBy("day")))
    return days.withColumn("_island", island).groupBy("_island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).drop("_island")


def keyset_page(entries: DataFrame, *, cursor=None, limit: int = 30, newest_first: bool = True) -> DataFrame:
    """``limit`` rows from the inclusive cursor on, and the row after them, whose date is the next cursor."""
    if cursor is not None:
        entries = entries.where(F.col("date") <= F.lit(cursor) if newest_first else F.col("date") >= F.lit(cursor))
    return entries.orderBy(F.desc("date") if newest_first else F.asc("date")).limit(limit + 1)


def on_this_day(entries: DataFrame, month: int, day: int) -> DataFrame:
    return entries.where(F.date_format("date", "MM-dd") == f"{month:02d}-{day:02d}").orderBy(F.desc("date"))


def in_order(entries: DataFrame, dates: list[int]) -> DataFrame:
    """The listed entries in the order of the list; unknown ones are dropped."""
    wanted = entries.sparkSession.createDataFrame(list(enumerate(dates)), "pos int, date_id long")
    return entries.join(F.broadcast(wanted), "date_id").orderBy("pos")
