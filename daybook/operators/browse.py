"""Pages of one word or one link, filtered and ordered listings, work lists and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalogue import like

# Kinds of media, and the two names that stand for three kinds each.
KINDS = ("image_jpg", "image_png", "image_gif", "video_mp4", "youtube", "vimeo", "iframe", "other", "none")
EXPANDED = {"image": ("image_jpg", "image_png", "image_gif"), "images": ("image_jpg", "image_png", "image_gif"), "video": ("video_mp4", "youtube", "vimeo"), "videos": ("video_mp4", "youtube", "vimeo")}
THUMBNAILED = ("image_jpg", "image_png", "image_gif", "video_mp4", "youtube", "vimeo")


def kind_filter(listed: str) -> list[str]:
    """Kinds of a list between commas, each once; a single unknown name fails the whole list."""
    found: list[str] = []
    for part in filter(None, map(str.strip, listed.split(","))):
        if part not in EXPANDED and part not in KINDS:
            raise ValueError(f"{part} is no kind")
        found += EXPANDED.get(part, (part,))
    if not found:
        raise ValueError("no kind is given")
    return list(dict.fromkeys(found))


def word_totals(bag: DataFrame, word: str) -> DataFrame:
    """One row (word, total, entries, first_id, last_id), none for an unknown word."""
    found = bag.where(F.col("word") == word.strip().lower())
    sums = found.groupBy("word").agg(F.sum("n").alias("total"), F.count("*").alias("entries"), F.min("date_id").alias("first_id"), F.max("date_id").alias("last_id"))
    return sums


def word_years(bag: DataFrame, entries: DataFrame, word: str) -> DataFrame:
    """(year, total, entries) of a word."""
    found = bag.where(F.col("word") == word.strip().lower()).join(entries.select("date_id", F.year("date").alias("year")), "date_id")
    return found.groupBy("year").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))


def word_top(bag: DataFrame, entries: DataFrame, word: str, top: int = 10) -> DataFrame:
    """(date_id, title, n): the entries that use a word most, newer ones first where equal."""
    best = bag.where(F.col("word") == word.strip().lower()).orderBy(F.desc("n"), F.desc("date_id")).limit(top)
    return best.join(entries.select("date_id", "title"), "date_id").select("date_id", "title", "n")


WORD_ORDERS = {"total": ("total", "entries"), "entries": ("entries", "total"), "word": ("word",)}


def ordered_words(catalogue: DataFrame, order: str = "total", ascending: bool = False, *, pattern: str | None = None, min_total: int | None = None, max_total: int | None = None) -> DataFrame:
    """Words that pass the filters with their place in the order; ties by word."""
    kept = catalogue if pattern is None else catalogue.where(like(F.col("word"), pattern))
    kept = kept if min_total is None else kept.where(F.col("total") >= min_total)
    kept = kept if max_total is None else kept.where(F.col("total") <= max_total)
    way = F.asc if ascending else F.desc
    return kept.orderBy(*[way(c) for c in WORD_ORDERS[order]], *([] if order == "word" else [F.asc("word")]))


def link_filter(catalogue: DataFrame, links: DataFrame, *, host: str | None = None, min_refs: int | None = None, credited: bool | None = None, query: str | None = None) -> DataFrame:
    """Links by host, number of references, whether a credit holds them, and a text in key, label or any anchor."""
    if host is not None:
        catalogue = catalogue.where(F.col("host") == host.lower())
    if min_refs is not None:
        catalogue = catalogue.where(F.col("refs") >= min_refs)
    if credited is not None:
        catalogue = catalogue.where(F.col("credited") > 0 if credited else F.col("credited") == 0)
    if query is None or not query.strip():
        return catalogue
    holds = lambda c: F.contains(F.lower(c), F.lit(query.strip().lower()))
    anchored = links.where(holds(F.col("anchor"))).select("key", F.lit(True).alias("_anchored")).distinct()
    marked = catalogue.join(anchored, "key", "left")
    return marked.where(holds(F.col("key")) | F.coalesce(holds(F.col("label")), F.lit(False)) | F.coalesce("_anchored", F.lit(False))).drop("_anchored")


#: Order, then what decides ties; labels compare without case and stand last when missing.
LINK_ORDERS = {"refs": ("refs", "entries"), "entries": ("entries", "refs"), "first": ("first_id",), "last": ("last_id",), "address": ("key",), "label": ("label",)}


def ordered_links(catalogue: DataFrame, order: str = "refs", ascending: bool = False) -> DataFrame:
    way = F.asc if ascending else F.desc
    if order == "label":
        return catalogue.orderBy(F.col("label").isNull(), way(F.lower("label")), F.asc("key"))
    return catalogue.orderBy(*[way(c) for c in LINK_ORDERS[order]], F.asc("key"))


def link_summary(catalogue: DataFrame) -> DataFrame:
    """One row: links, hosts, references, links of a single entry."""
    return catalogue.agg(F.count("*").alias("links"), F.count_distinct("host").alias("hosts"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"), F.count_if(F.col("entries") == 1).alias("used_once"))


def link_references(links: DataFrame, key: str, offset: int = 0, limit: int = 30) -> DataFrame:
    """A page of the entries that refer to a link, newest first."""
    return links.where(F.col("key") == key).orderBy(F.desc("page_id")).offset(offset).limit(limit)


def link_anchors(links: DataFrame, key: str, limit: int = 12) -> DataFrame:
    """(anchor, entries): the texts of a link, most frequent first, then shortest."""
    found = links.where((F.col("key") == key) & (F.col("anchor") != "")).groupBy("anchor").agg(F.count("*").alias("entries"))
    return found.orderBy(F.desc("entries"), F.char_length("anchor"), "anchor").limit(limit)


def latest(entries: DataFrame) -> DataFrame:
    """The newest entry."""
    return entries.orderBy(F.desc("date_id")).limit(1)


def with_media(entries: DataFrame, media: DataFrame) -> DataFrame:
    """Adds ``media``: the array of (idx, kind, url) of each entry in order, empty where there is none."""
    held = media.groupBy("date_id").agg(F.array_sort(F.collect_list(F.struct("idx", "kind", "url"))).alias("media"))
    joined = entries.join(held, "date_id", "left")
    return joined.withColumn("media", F.coalesce("media", F.array().cast(held.schema["media"].dataType)))


def work_list(entries: DataFrame, which: str) -> DataFrame:
    """Entries that still need something, newest first.

    ``pending``: a thumbnail to make; ``unmeasured``: its size; ``unhashed``: its print; ``stored``: nothing;
    ``missing``: a thumbnail of a kind that can have one.
    """
    has = F.col("thumb_path").isNotNull()
    rules = {
        "pending": ~has,
        "unmeasured": has & F.col("thumb_width").isNull(),
        "unhashed": has & F.col("print").isNull(),
        "stored": has,
        "missing": ~has & F.col("kind").isin(*THUMBNAILED),
    }
    return entries.where(rules[which]).orderBy(F.desc("date_id"))


def stale(entries: DataFrame, version: int) -> DataFrame:
    """Entries that an older parser wrote."""
    return entries.where(F.col("parser_version") < version)


def publishable_days(spark, first: str, last: str, gaps: tuple[str, ...] = ()) -> DataFrame:
    """(day): every day of the span but the known gaps."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return days.where(~F.col("day").isin([F.to_date(F.lit(g)) for g in gaps])) if gaps else days


def next_target(days: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row (day): the newest day never tried, else that whose failure was tried longest ago.

    ``attempts`` has day, at, ok and final; a final failure isn't tried again.
    """
    fresh = days.join(attempts, "day", "left_anti").select("day", F.lit(0).alias("_rank"), F.lit(None).cast("timestamp").alias("_at"))
    again = attempts.where("not ok and not final").select("day", F.lit(1).alias("_rank"), F.col("at").alias("_at"))
    return fresh.unionByName(again).orderBy("_rank", F.asc_nulls_first("_at"), F.desc("day")).limit(1).select("day")


def recheck(attempts: DataFrame, limit: int) -> DataFrame:
    """The successes that were checked longest ago."""
    return attempts.where("ok").orderBy("at", "day").limit(limit)


def pick(entries: DataFrame, seed: int, n: int = 1) -> DataFrame:
    """``n`` entries at random, the same for one seed; a sampling operator."""
    return entries.orderBy(F.xxhash64("date_id", F.lit(seed)), "date_id").limit(n)


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of an order, with ``total`` of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def trimmed_timeline(events: DataFrame, now: Column, past: int = 3, ahead: int = 10) -> DataFrame:
    """The last ``past`` events before ``now`` and the next ``ahead`` from it on; a timeline is a short list."""
    marked = events.withColumn("_ahead", F.col("at") >= now)
    near = W.partitionBy("_ahead").orderBy(F.when(F.col("_ahead"), F.unix_micros("at")).otherwise(-F.unix_micros("at")))
    return marked.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= F.when(F.col("_ahead"), ahead).otherwise(past)).drop("_ahead", "_n")
