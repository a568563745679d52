"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, bucketed_table, documents, dropped, materialise, slices, tidy, utf8

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
MIN_DOCUMENTS = 10
MIN_CODE_POINTS = 1
#: Lines that one batch adds to the runs, about; a small table comes in LEAST_BATCHES.
BATCH_LINES, LEAST_BATCHES = 1_000_000_000, 4
#: Runs of a level that are compacted into one of the next.
FANOUT = 2
HASH = ["h1", "h2"]


def keys(text: bytes) -> list[bytes]:
    """The key of each line: stripped of white space, A-Z lower-cased."""
    return [x.strip(SPACE_BYTES) for x in text.translate(_LOWER).split(b"\n")]


def _document_key(doc_id: int | None, text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b"%d\0" % doc_id + text if doc_id is not None else b"\0" + text)


def _longs(digests: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]


def line_hashes(df: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """A row for each line with a long enough key: the row's key (k1, k2), line_no, the line's hash (h1, h2: 128 bits), and
    whether it is the first with this hash in its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 4_000_000):
            rows, numbers, digests, first = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                seen: set[bytes] = set()
                of = _document_key(doc_id, text)
                for no, key in enumerate(keys(text)):
                    if len(key) < min_code_points or len(key) < 4 * min_code_points and len(key.decode("utf-8", "replace")) < min_code_points:
                        continue
                    h = xxhash.xxh3_128_digest(key)
                    rows.append(of)
                    numbers.append(no)
                    digests.append(h)
                    first.append(h not in seen)
                    seen.add(h)
            yield pa.RecordBatch.from_arrays([*_longs(rows), pa.array(numbers, pa.int32()), *_longs(digests), pa.array(first, pa.bool_())], names=["k1", "k2", "line_no", *HASH, "first"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t")).mapInArrow(tidy(run), "k1 long, k2 long, line_no int, h1 long, h2 long, first boolean")


@dataclass
class Run:
    """A sorted run: a table of hashes (with counts ``n``, or settled ones without) in buckets that are sorted by hash."""

    table: str
    path: str
    rows: DataFrame


class LineRuns:
    """Counts of documents by line hash, as a log-structured merge of sorted runs.

    Level 0 takes a run from each batch. Two runs of a level are merge-joined into one of the next, adding their counts;
    hashes that have reached ``min_documents`` move to settled runs. A batch is merge-anti-joined with the settled
    runs before it is added, so frequent lines are not carried on. All runs have the same buckets, each sorted by hash,
    so these joins neither exchange nor sort a run. The runs lie in ``root``; with a root of your own they stay there and
    ``LineRuns.opened`` goes on from them.
    """

    def __init__(self, spark: SparkSession, min_documents: int, buckets: int | None = None, root: str | None = None):
        self.spark, self.min_documents = spark, min_documents
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = root
        self.levels: list[list[Run]] = [[]]
        self.settled: list[Run] = []

    @classmethod
    def opened(cls, spark: SparkSession, root: str) -> LineRuns:
        """The runs that ``saved`` has listed in ``root``."""
        listed = spark.read.parquet(f"{root}/runs").orderBy("place").collect()
        runs = cls(spark, listed[0]["min_documents"], listed[0]["buckets"], root)
        for r in listed:
            if not r["path"]:
                continue
            table = f"quillgraph_run_{uuid.uuid4().hex}"
            columns = ", ".join(["h1 BIGINT", "h2 BIGINT", *(["n BIGINT"] if r["level"] >= 0 else [])])
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {runs.buckets} BUCKETS LOCATION '{r['path']}'")
            run = Run(table, r["path"], spark.table(table))
            if r["level"] < 0:
                runs.settled.append(run)
                continue
            while len(runs.levels) <= r["level"]:
                runs.levels.append([])
            runs.levels[r["level"]].append(run)
        return runs

    def saved(self) -> None:
        """List the runs in ``root``, so that later batches can be added in another session."""
        every = [(level, run) for level, of in enumerate(self.levels) for run in of] + [(-1, run) for run in self.settled]
        rows = [(n, level, run.path, self.buckets, self.min_documents) for n, (level, run) in enumerate(every)] or [(0, 0, "", self.buckets, self.min_documents)]
        self.spark.createDataFrame(rows, "place int, level int, path string, buckets int, min_documents int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/runs")

    def _written(self, df: DataFrame, name: str) -> Run:
        rows, table, path = bucketed_table(df, name, self.buckets, *HASH, ordered=True, root=self.root)
        return Run(table, path, rows)

    def add(self, lines: DataFrame) -> None:
        """Count ``lines`` (h1, h2, first), one batch."""
        new = self._written(lines.where("first").groupBy(*HASH).agg(F.count("*").alias("n")), "run_0")
        if self.settled:
            batch = new
            new = self._written(reduce(unsettled, [run.rows for run in self.settled], batch.rows), "run_0")
            dropped(self.spark, batch.table, batch.path)
        self.levels[0].append(new)
        level = 0
        while len(self.levels[level]) >= FANOUT:
            runs, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            level += 1
            self.levels[level].append(self._compacted(runs, f"run_{level}"))

    def _compacted(self, runs: list[Run], name: str) -> Run:
        whole = self._written(merged([r.rows for r in runs]), f"{name}_whole")
        few, many = whole.rows.where(F.col("n") < self.min_documents), whole.rows.where(F.col("n") >= self.min_documents)
        self.settled.append(self._written(many.select(*HASH), "settled"))
        run = self._written(few, name)
        for old in (*runs, whole):
            dropped(self.spark, old.table, old.path)
        return run

    def finish(self) -> DataFrame:
        """The hashes that are found in at least ``min_documents`` documents."""
        runs = [run for level in self.levels for run in level]
        self.levels = [[]]
        if runs:
            self.levels[0].append(self._compacted(runs, "run_last"))
        return reduce(DataFrame.unionByName, [run.rows for run in self.settled])


def unsettled(new: DataFrame, settled: DataFrame) -> DataFrame:
    """The rows of ``new`` whose hash no row of the sorted run ``settled`` has: a merge-anti-join."""
    return new.join(settled.hint("merge"), HASH, "left_anti")


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run of several sorted ones, counts added: merge joins."""
    whole = runs[0]
    for run in runs[1:]:
        both = whole.join(run.withColumnRenamed("n", "_n").hint("merge"), HASH, "full_outer")
        whole = both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"))
    return whole


def frequent_lines_dropped(df: DataFrame, min_documents: int = MIN_DOCUMENTS, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, kept (the text that is left) of each row.

    Each row is a document, also one that repeats another. A null or empty text is one empty line. Equal keys at
    any place of a text are one line of its document. Null ids are like any other; other columns are not read; an
    empty table gives no rows. A text is one value of its batch, whatever its length.
    """
    lines = materialise(line_hashes(df, min_code_points), "lines")
    batches = max(LEAST_BATCHES, -(-lines.count() // BATCH_LINES))
    runs = LineRuns(df.sparkSession, min_documents)
    for batch in range(batches):
        runs.add(lines.where(F.pmod("k1", F.lit(batches)) == batch))
    frequent = materialise(runs.finish(), "frequent")
    hit = lines.select("k1", "k2", "line_no", *HASH).join(frequent, HASH).groupBy("k1", "k2").agg(F.collect_set("line_no").alias("dropped"))
    hit = materialise(hit, "dropped")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 4_000_000):
            of = [_document_key(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *_longs(of)], names=["doc_id", "t", "k1", "k2"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 4_000_000):
            total, gone, digest, kept = [], [], [], []
            for text, dropped in zip(batch.column("t").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
                of = text.split(b"\n")
                out = set(dropped or ())
                left = b"\n".join([x for no, x in enumerate(of) if no not in out]) if out else text
                total.append(len(of))
                gone.append(len(out))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t")).mapInArrow(tidy(keyed), "doc_id long, t binary, k1 long, k2 long")
    joined = texts.join(hit, ["k1", "k2"], "left").select("doc_id", "t", "dropped")
    return joined.mapInArrow(tidy(cleaned), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_lines_dropped(documents(spark, sf_dir)).drop("kept")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM d),
k AS (SELECT r, doc_id, line, no, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""
