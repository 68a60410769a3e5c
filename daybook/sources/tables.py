"""The supplied tables as the day-keyed archive that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_of


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores, dealt over the cores; any larger scan stays as it is, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date_id, date, title, text, host, kind, copyright): a document per day, its first sentence as the title."""
    kind = F.when(F.col("lang") == "en", "image").when(F.col("lang") == "de", "video").otherwise("other")
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        F.col("doc_id").alias("date_id"), date_of(F.col("doc_id")).alias("date"), F.substring_index("text", ".", 1).alias("title"),
        "text", F.col("source").alias("host"), kind.alias("kind"), (F.col("lang") == "en").alias("copyright"),
    )


#: The same view for the SQL twin of a query.
ENTRIES_SQL = """entries as (select doc_id as date_id, date '1995-06-16' + doc_id::int as date, split_part(text, '.', 1) as title, text,
    source as host, case lang when 'en' then 'image' when 'de' then 'video' else 'other' end as kind, lang = 'en' as copyright from documents)"""


def votes(spark: SparkSession, sf_dir: str, groups: int | None = 40) -> DataFrame:
    """(vote_id, voter, voted_at, left, right, outcome): events as comparisons of two pictures.

    ``groups`` folds the pictures into so many, as the SQL twin does; None takes whole ids.
    """
    e = read(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "view", "tie").when(F.col("value") >= 10, "left").otherwise("right")
    left, right = F.col("user_id"), F.expr("user_id * 7 + event_id")
    if groups is not None:
        left, right = F.pmod(left, F.lit(groups)), F.pmod(right, F.lit(groups))
    return e.select(F.col("event_id").alias("vote_id"), F.col("user_id").alias("voter"), F.col("ts").alias("voted_at"), left.alias("left"), right.alias("right"), outcome.alias("outcome"))


VOTES_SQL = """votes as (select event_id as vote_id, user_id as voter, ts as voted_at, user_id % 40 as "left", (user_id * 7 + event_id) % 40 as "right",
    case when event_type = 'view' then 'tie' when value >= 10 then 'left' else 'right' end as outcome from events)"""
