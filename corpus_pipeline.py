"""The corpus pipeline: documents to packed token sequences, stage by stage (see ``quillgraph.llm.pipeline``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import pipeline

#: (name, function of spark, docs and sf_dir)
STAGES = pipeline.STAGES

#: Fitted scores, components and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    return pipeline.run(spark, sf_dir)
