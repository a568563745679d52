"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, counts, exact, lines, manifest, media, mixing, packing, passages, quality, sharding, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_kd_shards": sharding.op2_kd_shards,
    "op3_media": media.op3_media,
    "op4_passages": passages.op4_passages,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_token_counts": counts.op7_token_counts,
    "op8_bpe": bpe.op8_bpe,
    "op9_packing": packing.op9_packing,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_mixing": mixing.op11_mixing,
    "op12_merkle": manifest.op12_merkle,
    "op13_centroids": centroids.op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": lines.ORACLE_SQL,
    "op10_exact_dedup": exact.ORACLE_SQL,
    "op11_mixing": mixing.ORACLE_SQL,
    "op12_merkle": manifest.ORACLE_SQL,
    "op13_centroids": centroids.ORACLE_SQL,
}
