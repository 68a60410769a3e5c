"""A corpus pipeline of five stages, each one of the training-data operators."""

from __future__ import annotations

from daybook.llm import pipeline

STAGES = pipeline.STAGES
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    return pipeline.run(spark, sf_dir)
