"""Five stages from raw documents to batches: quality rules, near-duplicates, repeated passages, mixing, packing.

Every stage takes and returns whole tables; all but the last keep the columns of the input.  A row is known by its id
and a hash of all its values, so a verdict never falls on another row with the same or a null id; rows that are equal
in every column share one verdict, and where one copy of a group stays, one of them stays.

Defined results: ids may be null or repeat, rows with one id and different texts are different documents; documents
without words are no one's duplicate (the quality rules reject them before); an empty table gives an empty result;
columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, length_packing, mixing, near_dedup, quality_rules, suffix_dedup


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": common.row_key(docs.columns)})


def _same(marked: DataFrame) -> Column:
    """Condition that joins ``_keyed`` rows with (_i, _k) of ``marked``."""
    return F.col("__id").eqNullSafe(marked["_i"]) & (F.col("__key") == marked["_k"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.quality_rules(docs, columns=docs.columns)
    rejected = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_i"), F.col("row_key").alias("_k")).distinct()
    return _keyed(docs).join(rejected.hint("merge"), _same(rejected), "left_anti").drop("__id", "__key")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; null ids come last."""
    rows = _keyed(docs)
    # every different row is a vertex of its own
    found = near_dedup.near_duplicates(rows.select(F.col("__key").alias("doc_id"), "text")).where("n_shingles > 0")
    group = found.groupBy(F.col("doc_id").alias("_k")).agg(F.first("component_id").alias("_c"), F.count("*").alias("_n"))
    ids = rows.select(F.col("__id").alias("_i"), F.col("__key").alias("_k")).distinct()
    placed = common.materialise(ids.join(group, "_k"), "placed")
    first = placed.groupBy("_c").agg(F.min(F.struct(F.col("_i").isNull().alias("_last"), "_i", "_k")).alias("_f"), F.count("*").alias("_m"))
    # only groups of more than one row reject any
    groups = common.materialise(first.where("_m > 1").select("_c", "_m", F.col("_f._i").alias("_fi"), F.col("_f._k").alias("_fk")), "groups")
    rejected = common.join_split(placed, groups, "_c", "_m").where(~(F.col("_i").eqNullSafe(F.col("_fi")) & (F.col("_k") == F.col("_fk"))))
    rejected = common.materialise(rejected.select("_i", "_k"), "rejected")
    repeated = common.materialise(placed.where("_n > 1").select("_i", "_k"), "repeated")
    stay = rows.join(rejected.hint("merge"), _same(rejected), "left_anti")
    once = stay.join(repeated, _same(repeated), "left_anti")
    several = stay.join(repeated, _same(repeated), "left_semi").dropDuplicates(["__id", "__key"])
    return once.unionByName(several).drop("__id", "__key")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents hold; a character cut in two goes as a whole."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = suffix_dedup.remove_repeats(docs, texts=True, carry=others)
    text = F.col("kept").cast("string")
    fields = {c: F.col("carry")[c] for c in others} | {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text}
    if "n_chars" in fields:
        fields["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[fields[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights; documents repeat where a source runs over its size."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches in optimal length buckets."""
    return length_packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", mix_sources),
    ("length buckets", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; a stage's work tables and its input go once its result is written."""
    docs = common.table(spark, sf_dir, "documents")
    with common.only_last(spark):
        for name, stage in STAGES:
            with common.only_last(spark):
                docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
