"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

#: document_index builds the index; the searches after it read it, as a store's searches do. refresh_rounds builds a store,
#: refreshes it with changes, and refreshes it without any.
HEADLINE = ["document_index", "hybrid_search", "keyword_bm25", "phrase_search", "vector_topk", "batch_search", "rrf_fusion", "markup_clean", "breadcrumb", "descendant_fold", "index_records", "refresh_diff", "refresh_counts", "upsert_snapshot", "refresh_rounds"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillgraph import registry

    registry.QUERIES["refresh_counts"](spark, sf_dir).collect()  # the session is warm
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
