"""Entities pulled from a graph's local API, as a data source: ``spark.read.format("quillgraph_pull")``.

The API answers one query with the whole graph, so there is one partition; what it reads is one row for each entity, and
everything after that is DataFrame code.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..workers import workers_find_library
from .embedder import stays_here
from .entities import from_json

#: Fixed value: the query for every entity with a uid; both view types get names of their own.
EVERY_ENTITY = '[:find (pull ?e [* [:block/view-type :as "block-view-type"] [:children/view-type :as "children-view-type"]]) :where [?e :block/uid]]'
TIMEOUT_SECONDS = 300
ROWS = 4096


class PullSource(DataSource):
    """Options: url, token, query."""

    @classmethod
    def name(cls) -> str:
        return "quillgraph_pull"

    def schema(self) -> str:
        return "value string, ordinal long"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PullReader(self.options["url"], self.options["token"], self.options.get("query", EVERY_ENTITY))


class PullReader(DataSourceReader):
    def __init__(self, url: str, token: str, query: str):
        self.url, self.token, self.query = url, token, query

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        asked = urllib.request.Request(
            self.url, json.dumps({"action": "data.q", "args": [self.query]}).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.token}"}
        )
        with urllib.request.urlopen(asked, timeout=TIMEOUT_SECONDS) as answer:
            rows = json.load(answer)
        rows = rows.get("result") if isinstance(rows, dict) else rows
        if not isinstance(rows, list):
            raise TypeError("the answer is no list of rows")
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            if not all(isinstance(r, list) and r and isinstance(r[0], dict) for r in some):
                raise TypeError("a row of the answer does not begin with an entity")
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r[0]) for r in some], pa.string()), pa.array(range(at, at + len(some)), pa.int64())], names=["value", "ordinal"])


def pulled_entities(spark: SparkSession, url: str, token: str, query: str = EVERY_ENTITY) -> DataFrame:
    """Every entity of the graph at ``url``, which must be on this machine."""
    if not stays_here(url):
        raise ValueError(f"{url!r} is not on this machine")
    workers_find_library(spark)
    spark.dataSource.register(PullSource)
    return from_json(spark.read.format(PullSource.name()).option("url", url).option("token", token).option("query", query).load(), lenient=True)
