"""Polled feeds: launches, readings and scales as JSON documents; ratings as strict CSV; archived pages as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAUNCHES = "struct<results: array<struct<id:string, name:string, net:string, status:struct<abbrev:string>, launch_service_provider:struct<name:string>, pad:struct<name:string, location:struct<name:string>>>>>"
SCALES = "map<string, struct<DateStamp:string, R:struct<Scale:string, Text:string>, S:struct<Scale:string, Text:string>, G:struct<Scale:string, Text:string>>>"
BASELINE = "date date, category string, score double, ess double, comparisons long"


def launches(bodies: DataFrame) -> DataFrame:
    """(id, name, provider, pad, status, net) from documents with a ``body`` column; malformed ones give no row."""
    rows = bodies.select(F.explode(F.from_json("body", LAUNCHES)["results"]).alias("x")).select("x.*")
    pad = F.concat_ws(", ", "pad.name", "pad.location.name")
    out = rows.select("id", "name", F.col("launch_service_provider.name").alias("provider"), F.nullif(pad, F.lit("")).alias("pad"), F.col("status.abbrev").alias("status"), F.try_to_timestamp("net").alias("net"))
    return out.where("id is not null and name is not null and net is not null")


def scales(bodies: DataFrame) -> DataFrame:
    """(day, kind, level, text): the days of a scales document, levels in the order G, S, R; days without any are left out."""
    days = bodies.select(F.explode(F.from_json("body", SCALES)).alias("day", "x"))
    levels = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("place"), F.expr(f"try_cast(x.{k}.Scale as int)").alias("level"), F.nullif(F.trim(f"x.{k}.Text"), F.lit("")).alias("text")) for i, k in enumerate("GSR")])
    return days.select("day", F.inline(levels)).where("level is not null").select("day", "kind", "level", "text")


def readings(rows: DataFrame, now: str, days: int = 3) -> DataFrame:
    """(at, kp) of readings with a value that aren't too old; two time formats are understood."""
    at = F.coalesce(F.try_to_timestamp("time_tag", F.lit("yyyy-MM-dd HH:mm:ss[.SSS]")), F.try_to_timestamp("time_tag", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    found = rows.select(at.alias("at"), "kp").where("at is not null and kp is not null")
    return found.where(F.col("at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Ratings from CSV with exactly this header; a bad row, a negative weight or a picture twice is an error."""
    df = spark.read.schema(BASELINE).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    bad = df.where("ess < 0 or isnan(score) or isnan(ess) or score is null or ess is null").limit(1).count()
    if bad or df.groupBy("date", "category").count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: ratings must be finite, weights positive, pictures listed once")
    return df


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(date, content) of the pages stored as ``YYYY-MM-DD.html`` anywhere below a folder, each date once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)
    date = F.to_date(F.nullif(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.html$", 1), F.lit("")))
    return files.select(date.alias("date"), "content").where("date is not null").dropDuplicates(["date"])
