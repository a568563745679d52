"""The stages of the corpus pipeline: documents to packed token sequences.

Each stage gets what its predecessor kept, written as Parquet and read again. The first four return the columns of
their input, whatever those are called; the last returns the packed pieces. Every stage gives no rows for an empty
table, counts a null text as empty, and treats null ids and rows that repeat one another as its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, exact, packing, passages, quality, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: list[str] = []


def stage(f: Stage) -> Stage:
    """``f``, which gets its predecessor's result reread: the predecessor's intermediate tables are deleted before, unless
    ``docs`` reads them. So one pipeline at a time may run in a process."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.sweep(_before, but=docs)
        held = set(common.made_so_far())
        out = f(spark, docs, sf_dir)
        _before[:] = [path for path in common.made_so_far() if path not in held]
        return out

    return run


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones, does not reject: a score of at least ``quality.THRESHOLD``.

    Equal texts have equal scores, so repeated rows stay or go together; an id plays no part. Without labels of these
    documents all stay.
    """
    common.workers_find_library(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.remainder() != 0)
    named = docs.select(F.struct(*(common.column(c) for c in docs.columns)).alias("row"), F.col("text"))
    found = quality.scored(named, quality.fit_quality(docs, labels))
    return found.where(F.col("score") >= quality.THRESHOLD).select(*(F.col(f"row.{common.quoted(c)}").alias(c) for c in docs.columns))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the one with the most code points, then
    the least id (null last), then, of rows that repeat one another, one. Empty and null texts are one group."""
    common.workers_find_library(spark)
    return exact.without_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id (null last) of each component of near copies; of equal ids and repeated rows one."""
    common.workers_find_library(spark)
    return simhash.without_near_copies(docs)


@stage
def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document of a lesser id (null last) holds; n_chars, where there is such a
    column, follows the text. A null text stays null; a text may become empty; rows that repeat one another stay alike."""
    common.workers_find_library(spark)
    found = passages.passages_removed(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return found.select(*(common.column(c) for c in docs.columns))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048. Every row is packed, null texts and ids and repeated rows too."""
    common.workers_find_library(spark)
    return packing.packed_documents(docs, bpe.vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's intermediate tables are deleted when the next one begins, and its input when its result is written."""
    docs = common.documents(spark, sf_dir)
    for number, (_, step) in enumerate(STAGES):
        held = [path for path in common.made_so_far() if "quillgraph-stage-" in path]
        docs = common.materialise(step(spark, docs, sf_dir), f"stage-{number}")
        common.sweep([*held, *_before], but=docs)
    return docs
