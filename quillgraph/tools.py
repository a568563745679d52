"""What may be asked of this machine's graphs: the functions behind the command line and the tool server."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .plans import records, refresh, search
from .schema import DEFAULTS, META
from .sources import entities
from .sources.capture import Captures
from .sources.embedder import SERVER, Embedder, HashEmbedder, LoopbackEmbedder, embedded_query
from .sources.pull import pulled_entities
from .sources.snapshot import Meta, Store

log = logging.getLogger(__name__)


@dataclass
class Tools:
    """``registry``: the file of known graphs; ``stores``: the folder of their stores; ``port_file``: the API's port settings.
    ``entities``: JSON lines to capture a graph from, instead of its API. ``url``: the embedding server, else from the
    environment. Without a ``model`` words are hashed. ``captures``: a folder that keeps each graph's entities, so that a refresh pulls
    only what has changed; without it the whole graph is pulled."""

    spark: SparkSession
    registry: str = ""
    stores: str = "stores"
    port_file: str = ""
    entities: str = ""
    captures: str = ""
    lenient: bool = False
    model: str = ""
    dimension: int = 64
    url: str = field(default_factory=lambda: os.environ.get("QUILLGRAPH_EMBED_URL") or SERVER)
    token: str | None = None
    port: int | None = None

    def catalog(self) -> DataFrame:
        return catalog.read_catalog(self.spark, self.registry)

    def embedder(self, meta: Meta | None = None) -> Embedder:
        """That of a store, or of the settings for a new one."""
        model, dimension = (meta.embed_model, meta.dimension) if meta else (self.model, self.dimension)
        return HashEmbedder(dimension) if not model or model == HashEmbedder(dimension).model else LoopbackEmbedder(model, dimension, self.url)

    def captured(self, graph: Row | None, name: str, daily_notes: bool) -> DataFrame:
        """Index records of the graph as it is now."""
        if self.entities:
            found = entities.read_entities(self.spark, self.entities, self.lenient)
        else:
            at = catalog.access(self.spark, graph, name, self.token, self.port, self.port_file)
            if self.captures:
                held = Captures(catalog.store_path(self.captures, name))
                log.info("%s: %s", name, held.capture(self.spark, at.url, at.token))
                found = held.entities(self.spark)
            else:
                found = pulled_entities(self.spark, at.url, at.token)
        return records.index_records(found, daily_notes)

    def build(self, graph: str, daily_notes: bool = True) -> Meta:
        """A new index of a graph of the catalog, or, with entities given, of any name."""
        known = catalog.resolved(self.catalog(), F.lit(graph)).first()
        name = known["name"] if known else graph
        return refresh.build(self.spark, Store(catalog.store_path(self.stores, name)), self.captured(known, name, daily_notes), self.embedder(), name, daily_notes)

    def _indexed(self, graph: str) -> tuple[Row | None, Store]:
        """Entities that are given need no catalog entry, only a store of that name."""
        loose = Store(catalog.store_path(self.stores, graph))
        if self.entities and loose.exists(self.spark):
            return catalog.resolved(self.catalog(), F.lit(graph)).first(), loose
        return catalog.indexed_store(self.spark, self.catalog(), graph, self.stores)

    def list_indexes(self) -> list[dict]:
        """The graphs that are known here, and which of them can be searched."""
        return [r.asDict() for r in catalog.summaries(self.catalog(), self.stores).orderBy("ordinal").drop("ordinal").collect()]

    def index_stats(self, graph: str) -> dict:
        """What an index was made from and when."""
        return asdict(self._indexed(graph)[1].meta(self.spark))

    def refresh_index(self, graph: str) -> dict[str, int]:
        """Capture a graph and embed what has changed: how many were embedded, deleted, unchanged."""
        entry, store = self._indexed(graph)
        return self._refreshed(entry, store, store.meta(self.spark))

    def _refreshed(self, entry: Row | None, store: Store, meta: Meta) -> dict[str, int]:
        return refresh.refresh(self.spark, store, self.captured(entry, meta.graph_name, meta.include_daily_notes), self.embedder(meta))

    def semantic_search(self, graph: str, query: str, k: int = DEFAULTS.default_k) -> dict:
        """The best ``k`` hits of a graph's index, its meta, and whether it was brought up to date before. An index that is
        too old is refreshed; if that fails, the hits are those of the old one and the failure is told. Of many searches one
        refreshes, and the others have the hits of the old index meanwhile."""
        entry, store = self._indexed(graph)
        state = freshness(self.spark, store.meta(self.spark), lambda meta: self._refreshed(entry, store, meta), store)
        meta = store.meta(self.spark)
        hits = searched(self.spark, store, query, k, self.embedder(meta))
        return {"hits": [h.asDict() for h in hits], "index": asdict(meta), "refresh": state}


def freshness(spark: SparkSession, meta: Meta, bring_up: Callable[[Meta], object], store: Store | None = None) -> dict:
    """state, age_seconds before, threshold_seconds and error of a store about to be searched.

    The state is unchecked, fresh, refreshed or failed; refreshing where another search holds the ``store``'s lease and brings
    it up to date.
    """
    most = catalog.max_staleness(spark)
    judged = lambda m: catalog.with_freshness(spark.createDataFrame([tuple(asdict(m).values())], META), F.lit(most)).first()
    row = judged(meta)
    told = {"state": row["state"], "age_seconds": row["age"], "threshold_seconds": most, "error": None}
    if row["state"] != "stale":
        return told
    with store.leased(spark) if store else nullcontext(True) as mine:
        if not mine:
            return told | {"state": "refreshing"}
        if store and (meta := store.meta(spark)) and judged(meta)["state"] == "fresh":
            return told | {"state": "refreshed"}  # by the holder before
        try:
            bring_up(meta)
        except Exception as e:  # noqa: BLE001  what can be searched is searched, whatever the cause
            log.warning("%s could not be refreshed: %s", meta.graph_name, e)
            return told | {"state": "failed", "error": str(e)}
    return told | {"state": "refreshed"}


def searched(spark: SparkSession, store: Store, words: str, k: int, embedder: Embedder) -> list[Row]:
    """Hits of one query, best first."""
    hits = search.hybrid_search(store.vector_index(spark), store.index(spark), [(0, words, embedded_query(words, embedder))], k)
    return search.stored_hits(spark, store, hits).orderBy("rank").collect()
