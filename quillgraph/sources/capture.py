"""A graph's entities as they were last captured, and the next capture of only what has changed."""

from __future__ import annotations

import json
import re
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import checkpointed, file_system, workers_find_library
from .embedder import stays_here
from .entities import from_json
from .pull import TIMEOUT_SECONDS

#: The queries for all uids, for uids edited after a moment, and for the entities of some uids.
EVERY_UID = "[:find ?uid :where [?e :block/uid ?uid]]"
EDITED_AFTER = "[:find ?uid :in $ ?since :where [?e :block/uid ?uid] [?e :edit/time ?time] [(> ?time ?since)]]"
SOME_ENTITIES = '[:find (pull ?e [* [:block/view-type :as "block-view-type"] [:children/view-type :as "children-view-type"]]) :in $ [?uid ...] :where [?e :block/uid ?uid]]'
#: Entities that one request asks for, and captures that are kept for readers that began before.
ASKED, KEPT = 500, 2


def answer(url: str, token: str, *args: object) -> list:
    """The rows of one query's answer."""
    asked = urllib.request.Request(url, json.dumps({"action": "data.q", "args": list(args)}).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {token}"})
    with urllib.request.urlopen(asked, timeout=TIMEOUT_SECONDS) as said:
        rows = json.load(said)
    rows = rows.get("result") if isinstance(rows, dict) else rows
    if not isinstance(rows, list) or not all(isinstance(r, list) and r for r in rows):
        raise TypeError("the answer is no list of rows")
    return rows


def _asked_uids(spark: SparkSession, url: str, token: str, *args: object) -> DataFrame:
    """(uid, ordinal) of a query for uids, asked in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            rows = answer(url, token, *args)
            for at in range(0, len(rows), 65536):
                part = [str(r[0]) for r in rows[at : at + 65536]]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(range(at, at + len(part)), pa.int64())], names=["uid", "ordinal"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "uid string, ordinal long")


def entities_of(wanted: DataFrame, url: str, token: str) -> DataFrame:
    """(uid, value) of ``wanted`` (uid): ranges of uids, one in a task, each asked for ASKED at a time, so no task and no
    request holds the graph. Unknown uids have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_pylist()
            for at in range(0, len(uids), ASKED):
                found = [r[0] for r in answer(url, token, SOME_ENTITIES, uids[at : at + ASKED])]
                if not all(isinstance(e, dict) for e in found):
                    raise TypeError("a row of the answer does not begin with an entity")
                yield pa.RecordBatch.from_arrays([pa.array([e.get("uid") for e in found], pa.string()), pa.array([json.dumps(e) for e in found], pa.string())], names=["uid", "value"])

    # ranges are sampled: the uids are written first, so that they are not asked for again
    return checkpointed(wanted.select("uid")).repartitionByRange("uid").mapInArrow(run, "uid string, value string")


def capture_plan(swept: DataFrame, before: DataFrame, edited: DataFrame) -> DataFrame:
    """(uid, ordinal, action) of all uids: ``pull`` what is new or edited, ``keep``, or ``drop`` what the sweep has not."""
    now = swept.groupBy("uid").agg(F.max("ordinal").alias("ordinal"), F.lit(True).alias("_now"))
    was = before.select("uid", F.lit(True).alias("_was"))
    touched = edited.select("uid", F.lit(True).alias("_edited")).distinct()
    action = F.when(F.col("_now").isNull(), "drop").when(F.col("_was").isNull() | F.col("_edited"), "pull").otherwise("keep")
    return now.join(was, "uid", "full_outer").join(touched, "uid", "left").select("uid", "ordinal", action.alias("action"))


class Captures:
    """A folder of captures: (uid, value, ordinal) of every entity, in numbered folders; the newest that was written to its end
    is the current one."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _numbers(self, spark: SparkSession) -> list[int]:
        folder, fs = file_system(spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [n for n in names if re.fullmatch(r"\d{10}", n) and fs.exists(file_system(spark, f"{self.path}/{n}/_SUCCESS")[0])]
        return sorted(map(int, whole))

    def lines(self, spark: SparkSession) -> DataFrame | None:
        """(uid, value, ordinal) of the current capture; None without one."""
        numbers = self._numbers(spark)
        return spark.read.parquet(f"{self.path}/{numbers[-1]:010d}") if numbers else None

    def capture(self, spark: SparkSession, url: str, token: str) -> dict[str, int]:
        """The next capture; how many entities were pulled, kept and dropped.

        The sweep of all uids is joined with the capture before and with what was edited since the newest moment in that.
        New and edited entities are pulled, and what stands above these, whose lists of children may have
        changed with them. The rest is kept as it was, so an entity that changes without an edit time, and not together with one
        below it, is seen only by a whole capture (of an empty folder).
        """
        if not stays_here(url):
            raise ValueError(f"{url!r} is not on this machine")
        workers_find_library(spark)
        swept, before = checkpointed(_asked_uids(spark, url, token, EVERY_UID)), self.lines(spark)
        if before is None:
            plan = swept.groupBy("uid").agg(F.max("ordinal").alias("ordinal")).withColumn("action", F.lit("pull"))
            before = swept.limit(0).withColumn("value", F.lit("")).select("uid", "value", "ordinal")
            first = True
        else:
            known = from_json(before, lenient=True)
            since = known.agg(F.max(F.greatest(F.coalesce("time", F.lit(0)), F.coalesce("edit_time", F.lit(0))))).first()[0] or 0
            plan = capture_plan(swept, before, _asked_uids(spark, url, token, EDITED_AFTER, since - 1))  # edits of that very moment too
            first = False
        plan = checkpointed(plan)
        pulled = checkpointed(entities_of(plan.where("action = 'pull'"), url, token))
        if not first:
            above = from_json(pulled.withColumn("ordinal", F.lit(0).cast("long")), lenient=True).select(F.explode("parents").alias("id")).distinct()
            more = known.join(above, "id", "left_semi").select("uid").join(pulled.select("uid"), "uid", "left_anti")
            more = more.join(plan.where("action = 'keep'").select("uid"), "uid", "left_semi").distinct()
            pulled = checkpointed(pulled.unionByName(entities_of(more, url, token)))
        places = plan.where("action != 'drop'").select("uid", "ordinal")
        kept = before.select("uid", "value").join(plan.where("action = 'keep'").select("uid"), "uid", "left_semi").join(pulled.select("uid"), "uid", "left_anti")
        self._write(spark, kept.unionByName(pulled).join(places, "uid"))
        n = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        read = pulled.count()
        return {"pulled": read, "kept": n.get("pull", 0) + n.get("keep", 0) - read, "dropped": n.get("drop", 0)}

    def _write(self, spark: SparkSession, lines: DataFrame) -> None:
        """Written aside, then named by the next number."""
        numbers = self._numbers(spark)
        aside = f"{self.path}/_{uuid.uuid4().hex}"
        lines.select("uid", "value", "ordinal").write.parquet(aside)
        source, fs = file_system(spark, aside)
        target, _ = file_system(spark, f"{self.path}/{(numbers[-1] + 1 if numbers else 0):010d}")
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"{target} is there already: another capture has ended meanwhile")
        for old in numbers[: -KEPT + 1]:
            fs.delete(file_system(spark, f"{self.path}/{old:010d}")[0], True)

    def entities(self, spark: SparkSession) -> DataFrame:
        """The entities of the current capture."""
        found = self.lines(spark)
        if found is None:
            raise FileNotFoundError(f"no capture at {self.path}")
        return from_json(found.select("value", "ordinal"), lenient=True)
