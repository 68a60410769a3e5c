"""Space weather and launches: alerts from free text, readings, what is in force, reports and what to notify of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First words of a message and the notice they mean; letters of the scales.
NOTICES = {"ALERT": "alert", "WARNING": "warning", "EXTENDED WARNING": "warning", "CANCEL WARNING": "warning", "WATCH": "watch", "SUMMARY": "summary"}
BANDS = {"G": "Geomagnetic storms", "S": "Solar radiation", "R": "Radio blackouts"}
PRESSING = ("alert", "warning")
LIFE_HOURS, MOST_ALERTS, DST_DAYS = 3, 40, 7
FIRM = ("SEC", "MIN", "HR", "Second", "Minute", "Hour")
STORMS = ((8.0, "Severe geomagnetic storm"), (7.0, "Strong geomagnetic storm"), (6.0, "Moderate geomagnetic storm"), (5.0, "Minor geomagnetic storm"), (4.0, "Unsettled"))


def readings(raw: DataFrame, value: str) -> DataFrame:
    """(at, value) of rows with a readable time and a value, in order."""
    return raw.select(F.try_to_timestamp("time_tag").alias("at"), F.col(value)).where(F.col("at").isNotNull() & F.col(value).isNotNull()).orderBy("at")


def recent_dst(raw: DataFrame, now: Column) -> DataFrame:
    return readings(raw, "dst").where(F.col("at") >= now - F.expr(f"interval {DST_DAYS} days"))


def _field(lines: Column, name: str) -> Column:
    """What follows a name at the start of the first line that has it; null if that is nothing."""
    line = F.get(F.filter(lines, lambda x: x.startswith(name)), F.lit(0))
    return F.nullif(F.trim(F.substr(line, F.lit(len(name) + 1))), F.lit(""))


def _issued(text: Column) -> Column:
    """The times inside messages: year, month name, day, four digits and UTC."""
    return F.try_to_timestamp(F.regexp_replace(text, r"\s+UTC$", ""), F.lit("yyyy MMM dd HHmm"))


def alerts(raw: DataFrame, most: int | None = MOST_ALERTS) -> DataFrame:
    """(id, notice, headline, scale, issued_at, valid_until, message): messages with a known first word, newest first.

    ``raw`` has product_id, issue_datetime and message.  The feed keeps the newest ``most``.
    """
    text = F.replace("message", F.lit("\r"), F.lit(""))
    rows = raw.select("product_id", F.try_to_timestamp("issue_datetime").alias("issued_at"), text.alias("text")).where("issued_at is not null")
    rows = rows.withColumn("lines", F.transform(F.split("text", "\n"), lambda x: F.trim(x)))
    kind, rest = (lambda x: F.trim(F.substring_index(x, ":", 1))), (lambda x: F.trim(F.substr(x, F.position(F.lit(":"), x) + 1)))
    known = F.filter("lines", lambda x: F.contains(x, F.lit(":")) & kind(x).isin(*NOTICES) & (rest(x) != ""))
    rows = rows.withColumn("head", F.get(known, F.lit(0))).where("head is not null")
    names = F.create_map(*[F.lit(x) for pair in NOTICES.items() for x in pair])
    out = rows.select(
        F.concat_ws("-", "product_id", F.unix_seconds("issued_at").cast("string")).alias("id"), names[kind(F.col("head"))].alias("notice"), rest(F.col("head")).alias("headline"),
        _field(F.col("lines"), "NOAA Scale:").alias("scale"), "issued_at",
        F.coalesce(_issued(_field(F.col("lines"), "Now Valid Until:")), _issued(_field(F.col("lines"), "Valid To:"))).alias("valid_until"), F.trim("text").alias("message"),
    ).orderBy(F.desc("issued_at"), "id")
    return out if most is None else out.limit(most)


def in_force(now: Column) -> Column:
    life = F.col("issued_at") + F.expr(f"interval {LIFE_HOURS} hours")
    return F.coalesce(F.col("valid_until"), life) >= now


def current(now: Column) -> Column:
    return F.col("notice").isin(*PRESSING) & in_force(now)


def band() -> Column:
    """The letter of the scale, else G for a geomagnetic headline."""
    letter = F.substring(F.trim("scale"), 1, 1)
    return F.when(letter.isin(*BANDS), letter).when(F.contains("headline", F.lit("Geomagnetic")), "G")


def storm_label(kp: Column) -> Column:
    out = F.when(kp >= STORMS[0][0], STORMS[0][1])
    for least, name in STORMS[1:]:
        out = out.when(kp >= least, name)
    return out.otherwise("Quiet")


def is_storm(kp: Column) -> Column:
    return kp >= 5


def quiet(levels: Column) -> Column:
    """All scales are 0 or unknown."""
    return F.forall(levels, lambda x: F.coalesce(x["scale"], F.lit(0)) == 0)


def worst(levels: Column) -> Column:
    """The level with the largest scale; of equal ones the last."""
    ranked = F.transform(levels, lambda x, i: F.struct(F.coalesce(x["scale"], F.lit(0)).alias("s"), i.alias("i"), x.alias("level")))
    best = F.aggregate(ranked, F.get(ranked, F.lit(0)), lambda a, b: F.when(b["s"] >= a["s"], b).otherwise(a))
    return best["level"]


def summary(found: DataFrame, now: Column) -> DataFrame:
    """One row: how many alerts are current and the newest of them."""
    held = found.where(current(now))
    return held.agg(F.count("*").alias("active"), F.max_by("headline", F.struct("issued_at", "id")).alias("headline"))


def upcoming_launches(launches: DataFrame, since: Column, limit: int) -> DataFrame:
    return launches.where(F.col("net") >= since).orderBy("net", "id").limit(limit)


def recent_launches(launches: DataFrame, since: Column, until: Column, limit: int) -> DataFrame:
    """The latest of the half-open span, oldest first."""
    return launches.where((F.col("net") >= since) & (F.col("net") < until)).orderBy(F.desc("net"), "id").limit(limit).orderBy("net", "id")


def time_is_firm(precision: Column) -> Column:
    return F.coalesce(precision.isin(*FIRM), F.lit(False))


def weather_notices(found: DataFrame, now: Column, aurora: str | None, weather: str | None) -> DataFrame:
    """(topic, key, title, body): geomagnetic alerts in force but for summaries, and other current ones."""
    geomagnetic = F.coalesce(band() == "G", F.lit(False))
    told = found.select(
        F.when(geomagnetic & in_force(now) & (F.col("notice") != "summary"), F.lit(aurora).cast("string")).when(~geomagnetic & current(now), F.lit(weather).cast("string")).alias("topic"),
        F.concat(F.lit("alert:"), "id").alias("key"), F.concat(F.initcap("notice"), F.lit(": "), "headline").alias("title"), F.col("message").alias("body"),
    )
    return told.where("topic is not null")


def kp_notice(kp: DataFrame, topic: str, least: float = 5.0) -> DataFrame:
    """(topic, key, title, body) of the latest reading where it is high enough; one key a day and whole number."""
    last = kp.orderBy(F.desc("at")).limit(1).where(F.col("kp") >= least)
    level = F.floor("kp").cast("string")
    return last.select(
        F.lit(topic).alias("topic"), F.concat_ws(":", F.lit("kp"), F.date_format("at", "yyyy-MM-dd"), level).alias("key"), F.concat(F.lit("Kp "), level, F.lit(", aurora possible")).alias("title"),
        F.concat(F.lit("The planetary K index reached "), F.format_number("kp", 2), F.lit(", observed "), F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit(" UTC.")).alias("body"),
    )


def sky_notices(events: DataFrame, now: Column, topic: str, leads: dict[str, int]) -> DataFrame:
    """(topic, key, title) of timeline events that come within the lead of their kind, in hours; other kinds are silent."""
    hours = F.create_map(*[x for k, h in leads.items() for x in (F.lit(k), F.lit(h))])
    ahead = (F.unix_seconds("at") - F.unix_seconds(now)) / 3600
    near = events.where((ahead >= 0) & (ahead <= hours[F.col("kind")]))
    day = F.when(F.col("kind") == "shower", F.date_format("at", "yyyy")).otherwise(F.date_format("at", "yyyy-MM-dd"))
    return near.select(F.lit(topic).alias("topic"), F.concat_ws(":", "kind", "name", day).alias("key"), F.col("name").alias("title"))


def entry_notice(entries: DataFrame, published: Column, now: Column, topic: str, max_age_hours: int = 36) -> DataFrame:
    """(topic, key, title) of the newest entry, unless it is too old."""
    last = entries.orderBy(F.desc("date_id")).limit(1)
    fresh = last.where(F.unix_seconds(now) - F.unix_seconds(published) <= max_age_hours * 3600)
    return fresh.select(F.lit(topic).alias("topic"), F.concat(F.lit("entry:"), F.col("date").cast("string")).alias("key"), "title")
