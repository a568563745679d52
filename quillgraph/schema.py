"""Schemas and settings of the outline engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_ids = T.ArrayType(T.LongType())

#: Entities as the operators read them; ``sources.entities`` makes them from JSON.
ENTITY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("uid", T.StringType()),
        T.StructField("string", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("parents", _ids),
        T.StructField("children", _ids),
        T.StructField("order", T.LongType()),
        T.StructField("time", T.LongType()),
        T.StructField("edit_time", T.LongType()),
        T.StructField("ordinal", T.LongType()),
    ]
)

RECORD = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("page_title", T.StringType()),
        T.StructField("breadcrumb", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("concepts", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("descendant_text", T.StringType()),
        T.StructField("embed_input", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("edited_at", T.LongType()),
        T.StructField("is_page", T.BooleanType()),
        T.StructField("ordinal", T.LongType()),
    ]
)

META = T.StructType(
    [
        T.StructField("graph_name", T.StringType()),
        T.StructField("embed_model", T.StringType()),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("built_at", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("refreshed_at", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("include_daily_notes", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Settings:
    """Fixed values that results depend on, all of them parameters."""

    uid_pattern: str = "[A-Za-z0-9_-]{9}"
    daily_note_pattern: str = r"\d{2}-\d{2}-\d{4}"
    skipped_page_prefixes: tuple[str, ...] = ("roam/",)
    reference_chars: int = 300
    ancestor_chars: int = 60
    embed_chars: int = 8000
    schema_version: int = 2
    rrf_k: int = 60
    default_k: int = 10
    least_pool: int = 50
    pool_factor: int = 4
    cosine_epsilon: float = 1e-12
    embed_batch: int = 32
    document_prefix: str = "search_document: "
    query_prefix: str = "search_query: "
    max_staleness_seconds: int = 3600

    def pool(self, k: int) -> int:
        """Candidates that each ranking gives to a fusion of k hits."""
        if k < 0:
            raise ValueError("k must not be negative")
        return max(self.pool_factor * k, self.least_pool)


#: Weights of the indexed columns in BM25.
COLUMN_WEIGHTS = {"text": 1.0, "breadcrumb": 1.0, "concepts": 4.0, "tags": 2.0, "descendant_text": 1.0}
DEFAULTS = Settings()
