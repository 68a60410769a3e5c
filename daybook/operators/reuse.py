"""Pictures that ran on several days: groups by address and by print, their listing, summary and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import like
from .pictures import groups, near_pairs


def same_address(entries: DataFrame) -> DataFrame:
    """(a, b): the first entry of each address that isn't empty, with every other one of it."""
    held = entries.where("media_url <> ''").select("date_id", "media_url")
    first = held.groupBy("media_url").agg(F.min("date_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return held.join(first, "media_url").where("date_id <> a").select("a", F.col("date_id").alias("b"))


def same_print(entries: DataFrame, radius: int = 8) -> DataFrame:
    """(a, b): entries of near prints, by the first entry of each print; entries of one print hang on their first."""
    held = entries.where("print is not null").select("date_id", "print")
    first = held.groupBy("print").agg(F.min("date_id").alias("first"), F.count("*").alias("n"))
    copies = held.join(first.where("n > 1"), "print").where("date_id <> first").select(F.col("first").alias("a"), F.col("date_id").alias("b"))
    near = near_pairs(held, radius)
    ends = first.select("print", "first")
    across = near.join(ends.withColumnsRenamed({"print": "a", "first": "fa"}), "a").join(ends.withColumnsRenamed({"print": "b", "first": "fb"}), "b")
    detailed = F.bit_count("print").between(4, 60)
    flat = held.where(~detailed).select("date_id")  # flat prints say nothing about a picture
    return copies.join(flat.withColumnRenamed("date_id", "b"), "b", "left_anti").select("a", "b").unionByName(across.select(F.col("fa").alias("a"), F.col("fb").alias("b")))


def picture_groups(entries: DataFrame, radius: int = 8, checkpoint=None) -> DataFrame:
    """(date_id, picture_group) of entries that share a picture with another; the group is its first entry."""
    edges = same_address(entries).unionByName(same_print(entries, radius))
    return groups(edges, checkpoint).select(F.col("member").alias("date_id"), F.col("root").alias("picture_group"))


def regrouped(entries: DataFrame, found: DataFrame) -> DataFrame:
    """``entries`` with ``picture_group`` as found, null for the others."""
    return entries.drop("picture_group").join(found, "date_id", "left")


def pictures(entries: DataFrame) -> DataFrame:
    """(picture_group, shown, first_id, last_id, titles, span_days, title, media_url): a row a group, named by its first entry."""
    held = entries.where("picture_group is not null")
    rolled = held.groupBy("picture_group").agg(
        F.count("*").alias("shown"), F.min("date_id").alias("first_id"), F.max("date_id").alias("last_id"), F.count_distinct("title").alias("titles"),
    )
    first = entries.select(F.col("date_id").alias("picture_group"), "title", "media_url")
    return rolled.withColumn("span_days", F.col("last_id") - F.col("first_id")).join(first, "picture_group")


def filtered(listing: DataFrame, entries: DataFrame, *, query: str | None = None, min_shown: int | None = None, retitled: bool | None = None) -> DataFrame:
    """Groups with a text in the title of any of their runs, shown often enough, under several titles or one."""
    if query and query.strip():
        named = entries.where(F.col("picture_group").isNotNull() & like(F.col("title"), query.strip())).select("picture_group").distinct()
        listing = listing.join(named, "picture_group", "left_semi")
    if min_shown is not None:
        listing = listing.where(F.col("shown") >= min_shown)
    if retitled is not None:
        listing = listing.where(F.col("titles") > 1 if retitled else F.col("titles") == 1)
    return listing


ORDERS = {"appearances": "shown", "first": "first_id", "last": "last_id", "span": "span_days", "title": "title"}


def ordered(listing: DataFrame, order: str = "appearances", ascending: bool = False) -> DataFrame:
    column = F.lower("title") if order == "title" else F.col(ORDERS[order])
    return listing.orderBy(column.asc() if ascending else column.desc(), F.asc("picture_group"))


def group_dates(entries: DataFrame, dates: DataFrame) -> DataFrame:
    """(date_id, runs): all runs of the picture of each listed entry, in order; an entry without a group is alone."""
    held = entries.where("picture_group is not null").select("date_id", "picture_group")
    wanted = dates.select("date_id").distinct().join(held, "date_id", "left")
    runs = held.join(wanted.where("picture_group is not null").select("picture_group").distinct(), "picture_group", "left_semi")
    runs = runs.groupBy("picture_group").agg(F.array_sort(F.collect_list("date_id")).alias("runs"))
    return wanted.join(runs, "picture_group", "left").select("date_id", F.coalesce("runs", F.array("date_id")).alias("runs"))


def summary(entries: DataFrame) -> DataFrame:
    """One row: pictures, entries in groups, entries with a print, the group shown most often and how often."""
    totals = entries.agg(F.count_distinct("picture_group").alias("pictures"), F.count("picture_group").alias("entries"), F.count("print").alias("hashed"))
    shown = entries.where("picture_group is not null").groupBy("picture_group").agg(F.count("*").alias("n"))
    most = shown.agg(F.max(F.struct("n", -F.col("picture_group"))).alias("m"))
    most = most.select((-F.col("m.col2")).alias("most_shown"), F.coalesce("m.n", F.lit(0)).alias("most_shown_times"))
    return totals.join(most)  # two single rows


def pool(entries: DataFrame, kinds: tuple[str, ...], before: int | None = None) -> DataFrame:
    """(date_id): the first eligible entry of every picture; eligibility is decided before grouping."""
    held = entries.where(F.col("thumb_path").isNotNull() & F.col("kind").isin(*kinds))
    held = held if before is None else held.where(F.col("date_id") < before)
    return held.groupBy(F.coalesce("picture_group", "date_id").alias("_g")).agg(F.min("date_id").alias("date_id")).select("date_id")


def largest(entries: DataFrame, show: int = 20) -> DataFrame:
    """(picture_group, shown): the groups with the most entries."""
    shown = entries.where("picture_group is not null").groupBy("picture_group").agg(F.count("*").alias("shown"))
    return shown.orderBy(F.desc("shown"), "picture_group").limit(show)


def same_picture(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers`` (round, right_id, picked_id) with ``correct``: both entries have the same first run."""
    held = entries.select("date_id", F.coalesce("picture_group", "date_id").alias("_g"))
    left = answers.join(held.withColumnsRenamed({"date_id": "right_id", "_g": "_r"}), "right_id", "left")
    both = left.join(held.withColumnsRenamed({"date_id": "picked_id", "_g": "_p"}), "picked_id", "left")
    return both.withColumn("correct", F.coalesce(F.col("_r") == F.col("_p"), F.lit(False))).drop("_r", "_p")
