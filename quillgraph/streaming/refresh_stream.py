"""An extension: entity files that arrive in a folder refresh the store, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.records import index_records
from ..plans.refresh import build, refresh
from ..schema import DEFAULTS, Settings
from ..sources.embedder import Embedder
from ..sources.entities import from_json
from ..sources.snapshot import Store


def refresh_on_arrival(spark: SparkSession, folder: str, store: Store, embedder: Embedder, checkpoint: str, graph_name: str, s: Settings = DEFAULTS) -> StreamingQuery:
    """Each batch of ``folder`` (JSON lines: value, ordinal) is a whole capture of the graph; the last one wins.

    A batch that is run again after a failure finds nothing changed, so the snapshot flip makes it effectively once.
    """

    def batch(lines: DataFrame, _: int) -> None:
        if lines.isEmpty():
            return
        notes = store.meta(spark).include_daily_notes if store.exists(spark) else True
        records = index_records(from_json(lines), notes, s)
        if store.exists(spark):
            refresh(spark, store, records, embedder, s)
        else:
            build(spark, store, records, embedder, graph_name, notes, s)

    lines = spark.readStream.schema("value string, ordinal long").json(folder)
    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
