"""What the operators of this subpackage share: shared storage, hashing and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that the contracts call white space.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_local_root: str | None = None
_made: list[tuple[SparkSession, str, str | None]] = []


def workers_find_library(spark: SparkSession) -> None:
    """Put this library's folder on the path of Python workers that were not started with it (a local session)."""
    known = spark.sparkContext.environment
    home = str(Path(__file__).resolve().parents[2])
    if home not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(x for x in (home, known.get("PYTHONPATH")) if x)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_find_library(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset a local session gets a
    temporary one; a cluster is refused, as its executors do not see each other's folders."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} shares")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        _made.append((spark, _local_root, None))
    return _local_root


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors.

    The folder is deleted when the Python process ends in order.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/quillgraph-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path, None))
    with _writing(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings while a query is planned and run inside; none of them changes any query's rows."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _writing(spark: SparkSession):  # noqa: ANN202
    """Shuffle files of a query that is written whole are deleted with it, not when the driver collects garbage; the
    order of bucketed tables is used; and batches that go to Python workers are bounded by bytes, not only by rows."""
    return _set(
        spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__legacy__bucketedTableScan__outputOrdering="true",
        spark__sql__execution__arrow__maxBytesPerBatch=f"{4 << 20}b",
    )


def made_so_far() -> list[str]:
    """The paths of the tables that are kept now."""
    return [path for _, path, _ in _made]


def sweep(paths: list[str] | None = None, but: DataFrame | None = None) -> None:
    """Delete what ``materialise`` and ``bucketed`` have written in this process, all or ``paths``, but for what ``but`` reads."""
    kept = but.inputFiles() if but is not None else []
    stay = []
    while _made:
        spark, path, table = _made.pop()
        if paths is not None and (path not in paths or path == _local_root) or any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in kept):
            stay.append((spark, path, table))
            continue
        try:
            dropped(spark, table, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
    _made.extend(reversed(stay))


atexit.register(sweep)


def utf8(name: str) -> Column:
    """The UTF-8 bytes of the text in the column ``name``; null counts as empty."""
    return F.coalesce(column(name).cast("binary"), F.lit(b""))


def quoted(name: str) -> str:
    """``name`` as one identifier, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


_kept: dict[tuple, object] = {}
_kept_stage: int | None = None


def _stage() -> int | None:
    context = TaskContext.get()
    return context.stageId() if context else None


def kept_for_stage(make: Callable, *args):  # noqa: ANN201
    """``make(*args)``, made once for all tasks of a stage in a worker; the first task of another stage drops it."""
    key = (make.__qualname__, *args)
    if key not in _kept:
        _kept[key] = make(*args)
    return _kept[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``. Spark uses a worker again for other stages: what was kept for another stage is dropped
    before, and free memory goes back to the system when the task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _kept_stage
        if _kept_stage != _stage():
            _kept.clear()
            _kept_stage = _stage()
            pa.set_memory_pool(pa.system_memory_pool())  # what it frees can be given back
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return whole


def raw_texts(array: pa.Array) -> pa.Array:
    """The bytes of an array of strings or binaries, null as empty; nothing is copied where no value is null."""
    array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "") if array.null_count else array
    return array.cast(pa.large_binary()) if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else array.cast(pa.binary())


def added(df: DataFrame, text: str, outputs: dict[str, str], values: Callable[[pa.Array], list[pa.Array]], most_bytes: int = 2_000_000) -> DataFrame:
    """``df`` with the columns ``outputs`` (name -> type), which ``values`` makes of an array of the text's bytes.

    Input columns of an output's name are replaced; all others are kept whatever they are called. The text goes to
    the worker once, within its row.
    """
    df = df.drop(*(c for c in outputs if c != text))
    names = df.columns
    schema = T.StructType([T.StructField("row", df.schema), *(T.StructField(c, _parse(kind)) for c, kind in outputs.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw = raw_texts(whole.column("row").field(text))
            _, offsets = binaries(raw)
            for at, to in spans(offsets, most_bytes):
                yield pa.RecordBatch.from_arrays([whole.column("row").slice(at, to - at), *values(raw.slice(at, to - at))], names=["row", *outputs])

    found = df.select(F.struct(*(column(c) for c in names)).alias("row")).mapInArrow(tidy(run), schema)
    return found.select(*(F.col(f"row.{quoted(c)}") for c in names), *(column(c) for c in outputs))


def bundled(df: DataFrame, text: str) -> DataFrame:
    """doc_id, the text, and rest: a struct of all other columns, whose names then clash with nothing."""
    rest = [column(c) for c in df.columns if c not in ("doc_id", text)]
    return df.select("doc_id", column(text), F.struct(*(rest or [F.lit(None).cast("int").alias("none")])).alias("rest"))


def unbundled(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` of a ``bundled`` DataFrame."""
    return df.select(*(column(c) if c in ("doc_id", text) else F.col(f"rest.{quoted(c)}").alias(c) for c in columns))


def _parse(kind: str) -> T.DataType:
    return {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "binary": T.BinaryType()}[kind]


def binaries(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values one after another, n+1 offsets) of a string or binary array; nulls have no bytes."""
    kind = array.type
    if not (pa.types.is_large_binary(kind) or pa.types.is_large_string(kind)):
        array = array.cast(pa.large_binary())
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column``, one row at least, so that work arrays stay small."""
    for batch in batches:
        for at, to in spans(binaries(batch.column(column))[1], most_bytes):
            yield batch.slice(at, to - at)


def spans(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(first row, end) of runs of rows that hold about ``most_bytes``, one row at least."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, to
        at = to


#: How a row takes part in a block of a group: it is compared with the others of its own kind too, only as the right side, or only as the left.
BOTH, RIGHT, LEFT = 0, 1, 2


def paired_blocks(item: Column, blocks: Column) -> Column:
    """An array of (block, side) for a row of a group whose every two rows must meet: the rows fall into ``blocks`` parts,
    and each two parts meet in one block, so a block holds two parts at most and no task the whole group."""
    own = F.pmod(F.xxhash64(item), blocks).cast("int")
    side = lambda x: F.when(x == own, BOTH).when(x > own, LEFT).otherwise(RIGHT)
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct((F.least(x, own).cast("long") * blocks + F.greatest(x, own)).alias("block"), side(x).alias("side")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (src long, dst long); component: the least node reachable.

    Alternating large-star and small-star rounds. Each round's rows are written to the shared folder, so joins
    read plain scans (adaptive execution can split a hub's rows) and lineage stays short. Rounds grow with
    the logarithm of a component's width, and nothing but one count and one sum reaches the driver.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = materialise(e, f"{name}-0")
    before = None
    for k in range(1, 200):
        for large in (True, False):
            e = materialise(_star(e, large, name), f"{name}-{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    hubs = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)


def _star(e: DataFrame, large: bool, name: str) -> DataFrame:
    """One star round over edges u > v. The least neighbours are written first, so that a hub's rows can be split in the join."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    if large:
        moved = both.where("v > u").join(least, "u")
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """Write ``df`` to the shared folder bucketed by ``keys``; grouping, cogrouping and joining by them then need no exchange."""
    return bucketed_table(df, name, buckets, *keys)[0]


def bucketed_table(df: DataFrame, name: str, buckets: int, *keys: str, ordered: bool = False, root: str | None = None) -> tuple[DataFrame, str, str]:
    """(the rows, table, path) of ``df`` written in buckets, each sorted by ``keys`` if ``ordered``. A table in a ``root``
    of the caller's is left to the caller."""
    spark = df.sparkSession
    table = f"quillgraph_{name}_{uuid.uuid4().hex}"
    path = f"{(root or shared_root(spark)).rstrip('/')}/{table}"
    if root is None:
        _made.append((spark, path, table))
    writer = df.write.bucketBy(buckets, *keys)
    # a task whose rows fall into few buckets has a writer for each, and does not sort its rows (texts) by bucket
    with _writing(spark), _set(spark, spark__sql__maxConcurrentOutputFileWriters="4"):
        (writer.sortBy(*keys) if ordered else writer).option("path", path).saveAsTable(table)
    return spark.table(table), table, path


def dropped(spark: SparkSession, table: str | None, path: str) -> None:
    """Delete a folder and the table in it, if any."""
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, within: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` (written before, as it is sampled for ranges) with index: a row's place, from 0, by ``order`` among the rows of
    its values of ``within`` (nulls are a value).

    A sort by ranges. A row's place in its range is fixed by the write, and only counts by ``within`` and range are summed,
    so no task gets a whole group.
    """
    keys = [*(column(c).asc_nulls_first() for c in within), *order]
    placed = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    runs = placed.groupBy(*(column(c).alias(f"_in{k}") for k, c in enumerate(within)), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    groups = [f"_in{k}" for k in range(len(within))]
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_of")) - F.col("_n") - F.col("_first")
    same = reduce(Column.__and__, [column(c).eqNullSafe(F.col(g)) for c, g in zip(within, groups, strict=True)], F.col("_part") == F.col("_of"))
    joined = placed.join(runs.withColumn("_before", before), same)
    return joined.select(*(column(c) for c in df.columns), (F.col("_place") + F.col("_before")).alias("index"))
