"""Python workers, this library, and the folder that all of a cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def workers_find_library(spark: SparkSession) -> None:
    """Put this library's folder on the path of Python workers that were not started with it (a local session)."""
    known = spark.sparkContext.environment
    home = str(Path(__file__).resolve().parents[1])
    if home not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(x for x in (home, known.get("PYTHONPATH")) if x)


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the process ends in order, with all that is in it."""
    _made.append((spark, path))
    return path


@atexit.register
def _delete_scratch() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            at, fs = file_system(spark, path)
            fs.delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


@lru_cache(maxsize=1)
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quillgraph-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local session without one gets a temporary folder; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if (spark, _temporary()) not in _made:
        scratch(spark, _temporary())
    return _temporary()


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside are deleted with it, not when the driver collects garbage, and batches that go to
    Python workers are bounded by bytes, not only by rows. Neither changes any row."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": f"{8 << 20}b"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, compressed: a short plan that survives lost executors. The files are deleted when
    the process ends in order, or by ``released``."""
    spark = df.sparkSession
    path = scratch(spark, f"{shared_folder(spark)}/quillgraph-kept-{uuid.uuid4().hex}")
    with writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*dfs: DataFrame) -> None:
    """Delete the files of ``checkpointed`` frames that nothing reads any more."""
    names = {f.rsplit("/", 2)[-2] for df in dfs for f in df.inputFiles()}
    for made in [x for x in _made if x[1].rsplit("/", 1)[-1] in names]:
        _made.remove(made)
        at, fs = file_system(*made)
        fs.delete(at, True)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(the path, its Hadoop file system)"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)
