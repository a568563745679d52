"""Incremental refresh: what changed by content hash, and the next snapshot."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DEFAULTS, Settings
from ..sources.embedder import Embedder, embedded
from ..sources.snapshot import Meta, Store
from ..workers import checkpointed, released


def refresh_plan(records: DataFrame, stored: DataFrame) -> DataFrame:
    """(uid, action): embed (new or changed), keep, delete; one full outer join of (uid, content_hash)."""
    now = records.select("uid", F.col("content_hash").alias("now"), F.lit(True).alias("here"))
    was = stored.select("uid", F.col("content_hash").alias("was"), F.lit(True).alias("there"))
    action = F.when(F.col("here").isNull(), "delete").when(F.col("there").isNotNull() & F.col("now").eqNullSafe(F.col("was")), "keep").otherwise("embed")
    return now.join(was, "uid", "full_outer").select("uid", action.alias("action"))


def refresh_counts(plan: DataFrame) -> DataFrame:
    """One row: embedded, deleted, unchanged, record_count."""
    count = {a: F.count_if(F.col("action") == a) for a in ("embed", "delete", "keep")}
    return plan.agg(count["embed"].alias("embedded"), count["delete"].alias("deleted"), count["keep"].alias("unchanged"), (count["embed"] + count["keep"]).alias("record_count"))


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with the rows of ``new`` put in place of those with the same uid."""
    return stored.join(new.select("uid"), "uid", "left_anti").unionByName(new)


def deleted(stored: DataFrame, uids: DataFrame) -> DataFrame:
    """``stored`` without ``uids``; unknown ones are ignored."""
    return stored.join(uids.select("uid"), "uid", "left_anti")


def check_schema_version(meta: Meta, s: Settings = DEFAULTS) -> None:
    if meta.schema_version != s.schema_version:
        raise ValueError(f"the store has schema version {meta.schema_version}, not {s.schema_version}: rebuild it")


def deleted_uids(plan: DataFrame) -> DataFrame:
    """(uid) that a plan deletes, ascending by code point."""
    return plan.where("action = 'delete'").select("uid").orderBy("uid")


def refuse_repeats(records: DataFrame) -> None:
    twice = records.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"uid {twice[0]['uid']!r} occurs more than once")


def build(spark: SparkSession, store: Store, records: DataFrame, embedder: Embedder, graph_name: str, include_daily_notes: bool = True, s: Settings = DEFAULTS) -> Meta:
    """Embed all records and write a snapshot of them alone; an empty graph gives an empty store."""
    meta = Meta(graph_name, embedder.model, embedder.dimension, _moment(), 0, None, s.schema_version, include_daily_notes)
    return store.write(spark, embedded(records, embedder, s), meta, refuse_repeats)  # no copy of the records besides the store's own


def refresh(spark: SparkSession, store: Store, records: DataFrame, embedder: Embedder, s: Settings = DEFAULTS) -> dict[str, int]:
    """Embed changed records only and write what has changed as one segment; returns the counts.

    Without a change only the snapshot file is written anew, with the moment; no record, vector or posting is.
    """
    of = store.snapshot(spark)
    check_schema_version(of.meta, s)
    kept, lost = _parted(records, store.hashes(spark, of))
    plan = kept.select("uid", "_action").union(lost.select("uid", F.lit("delete"))).withColumnRenamed("_action", "action")
    counts = refresh_counts(plan).first().asDict()
    meta = replace(of.meta, refreshed_at=_moment())
    if not counts["embedded"] and not counts["deleted"]:
        store.touch(spark, of, meta)
        released(kept, lost)
        return counts
    changed = kept.where("_action = 'embed'").drop("_action")
    if counts["embedded"] and embedder.dimension != of.meta.dimension:
        raise ValueError(f"the embedder gives {embedder.dimension} numbers, the store holds {of.meta.dimension}")
    store.change(spark, of, embedded(changed, embedder, s), lost, meta)
    released(kept, lost)
    return counts


def _parted(records: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``records`` with _action, embed or keep as in ``refresh_plan``; uids that are to be deleted). Records are computed once, and of those
    that are kept only uids are written."""
    was = stored.select("uid", F.col("content_hash").alias("_was"), F.lit(True).alias("_there"))
    action = F.when(F.col("_there") & F.col("content_hash").eqNullSafe(F.col("_was")), "keep").otherwise("embed")
    met = records.join(was, "uid", "left").withColumn("_action", action)
    kept = checkpointed(met.select("_action", *(F.col(c) if c == "uid" else F.when(F.col("_action") == "embed", F.col(c)).alias(c) for c in records.columns)))
    return kept, checkpointed(stored.select("uid").join(kept.select("uid"), "uid", "left_anti"))


def _moment() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")
