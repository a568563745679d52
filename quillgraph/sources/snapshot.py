"""A store of records, vectors and their keyword index, in Parquet segments under numbered snapshots."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import keyword, vector
from ..schema import COLUMN_WEIGHTS
from ..workers import file_system, writing

#: Segments of one tier that are merged; a tier's segments have up to so many times the records of the tier below.
FAN = 4
#: Bytes of unsorted postings that are put in order at a time, and passes at most: what is shuffled at once is its share only.
PASS_BYTES, MOST_PASSES, SAMPLED_TERMS = 64 << 20, 8, 10_000


class ConflictError(RuntimeError):
    """Another writer has made the next snapshot meanwhile; nothing of this write is visible."""


@dataclass(frozen=True)
class Meta:
    graph_name: str
    embed_model: str
    dimension: int
    built_at: str
    record_count: int
    refreshed_at: str | None = None
    schema_version: int | None = None
    include_daily_notes: bool = True


@dataclass(frozen=True)
class Snapshot:
    """What a snapshot file holds: segments, oldest first, and how many records each was written with, the tokens of all live
    records, and the meta row."""

    number: int
    segments: tuple[str, ...]
    sizes: tuple[int, ...]
    total_len: int
    meta: Meta


class Store:
    """A folder of segments and snapshots.

    A segment has the records that one write put in, sorted by uid with Bloom filters; their vectors, grouped around pivots; their
    postings in blocks, ranged by (term, block), so that a term in every record is spread over all files; a dictionary
    (term, df); and the uids that it takes out of the segments before it (gone). The dictionary of a segment counts its
    own records up and those it takes out down, so that the sum over segments is right.

    A refresh writes one segment of what has changed. Segments fall into tiers by their size; FAN of the newest that are of
    one tier, or below, are merged into one: postings are joined with the records that live on, and nothing is tokenised. So
    a record is rewritten once a tier.

    A snapshot file, named by its number, lists the segments. It is written aside and then put in place only if no file of that
    name is there, so of two writers from the same snapshot one fails with ``ConflictError``; readers take the newest
    file that is whole. That step is a link on a local file system and a rename elsewhere, which must not replace (HDFS does not); a
    store without such a step, as many object stores, needs a file system layer that has it. Snapshots, but for the newest, and their
    segments are kept for ``retention`` seconds, for readers that began before; segments that no snapshot lists, of
    writers that failed, for ``orphans`` seconds.
    """

    def __init__(self, path: str, columns: tuple[str, ...] = tuple(COLUMN_WEIGHTS), retention: float = 3600, orphans: float = 86400):
        self.path, self.columns, self.retention, self.orphans = path.rstrip("/"), list(columns), retention, orphans
        self._schemas: dict[str, StructType] = {}  # all segments have the same

    # -- reading

    def _listed(self, spark: SparkSession) -> dict[int, float]:
        """Numbers of snapshot files, whole or not, and when they were made."""
        folder, fs = file_system(spark, f"{self.path}/_snapshots")
        found = fs.listStatus(folder) if fs.exists(folder) else []
        return {int(x.getPath().getName()): x.getModificationTime() / 1000 for x in found if re.fullmatch(r"\d{10}", x.getPath().getName())}

    def _opened(self, spark: SparkSession, number: int) -> Snapshot | None:
        """A snapshot; None if its file is not whole, or gone."""
        path, fs = file_system(spark, f"{self.path}/_snapshots/{number:010d}")
        try:
            stream = fs.open(path)
        except Exception:
            if fs.exists(path):
                raise
            return None
        try:
            held = json.loads(bytes(stream.readAllBytes()).decode())
            return Snapshot(number, tuple(held["segments"]), tuple(held["sizes"]), held["total_len"], Meta(**held["meta"]))
        except (ValueError, KeyError, TypeError):
            return None
        finally:
            stream.close()

    def current(self, spark: SparkSession) -> Snapshot | None:
        """The newest whole snapshot; None without one."""
        return next((s for n in sorted(self._listed(spark), reverse=True) if (s := self._opened(spark, n)) is not None), None)

    def exists(self, spark: SparkSession) -> bool:
        return self.current(spark) is not None

    def snapshot(self, spark: SparkSession) -> Snapshot:
        found = self.current(spark)
        if found is None:
            raise FileNotFoundError(f"no index at {self.path}: build it")
        return found

    def _read(self, spark: SparkSession, segment: str, part: str) -> DataFrame:
        """A segment's part; its schema is looked up once."""
        reader = spark.read.schema(self._schemas[part]) if part in self._schemas else spark.read
        found = reader.parquet(f"{self.path}/{segment}/{part}")
        self._schemas[part] = found.schema
        return found

    def _all(self, spark: SparkSession, part: str, segments: tuple[str, ...]) -> DataFrame:
        """Rows of ``part`` with the number of their segment."""
        return reduce(DataFrame.unionByName, [self._read(spark, s, part).withColumn("segment", F.lit(n)) for n, s in enumerate(segments)])

    def _gone(self, spark: SparkSession, segments: tuple[str, ...]) -> DataFrame | None:
        """(uid, _at): the last segment that takes a record out of those before."""
        if len(segments) == 1:
            return None
        rows = reduce(DataFrame.unionByName, [self._read(spark, s, "gone").withColumn("_at", F.lit(n)) for n, s in enumerate(segments) if n])
        return rows.groupBy("uid").agg(F.max("_at").alias("_at"))

    def _live(self, spark: SparkSession, segments: tuple[str, ...], uids: list | None = None) -> DataFrame:
        """Records of ``segments`` that none of the later ones takes out, with _no; of ``uids`` alone if given."""
        rows, gone = self._all(spark, "records", segments), self._gone(spark, segments)
        if uids is not None:
            rows, gone = rows.where(F.col("uid").isin(uids)), None if gone is None else gone.where(F.col("uid").isin(uids))
        return keyword.without_gone(rows, gone)

    def records(self, spark: SparkSession, of: Snapshot | None = None) -> DataFrame:
        return self._live(spark, (of or self.snapshot(spark)).segments).drop("segment", "_no")

    def records_of(self, spark: SparkSession, uids: list, of: Snapshot | None = None) -> DataFrame:
        """The records of a few ``uids``: literals of the scans, whose statistics and Bloom filters leave most row groups out."""
        return self._live(spark, (of or self.snapshot(spark)).segments, uids).drop("segment", "_no")

    def hashes(self, spark: SparkSession, of: Snapshot | None = None) -> DataFrame:
        return self.records(spark, of).select("uid", "content_hash")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return self.records(spark).select("uid", "ordinal", "embedding")

    def vector_index(self, spark: SparkSession) -> vector.VectorIndex:
        of = self.snapshot(spark)
        return vector.VectorIndex(self._all(spark, "vectors", of.segments), self._all(spark, "pivots", of.segments), self._gone(spark, of.segments))

    def index(self, spark: SparkSession, of: Snapshot | None = None) -> keyword.KeywordIndex:
        of = of or self.snapshot(spark)
        terms = reduce(DataFrame.unionByName, [self._read(spark, s, "terms") for s in of.segments])
        return keyword.KeywordIndex(self._all(spark, "postings", of.segments), terms, self.columns, of.meta.record_count, of.total_len, self._gone(spark, of.segments))

    def meta(self, spark: SparkSession) -> Meta:
        return self.snapshot(spark).meta

    # -- writing

    def _put(self, spark: SparkSession, base: str, records: DataFrame) -> DataFrame:
        """``records`` written in order of uid, with their number _no, and read again. They are dealt by hash: a sample for
        ranges would compute them twice."""
        placed = records.repartition("uid").sortWithinPartitions("uid").withColumn("_no", F.monotonically_increasing_id())
        with writing(spark):
            placed.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#uid", "true").option("parquet.block.size", 16 << 20).parquet(f"{base}/records")
        written = spark.read.parquet(f"{base}/records")
        if "embedding" in written.columns:
            self._put_vectors(spark, base, written)
        return written

    def _put_vectors(self, spark: SparkSession, base: str, written: DataFrame) -> None:
        centers = vector.pivots_of(written)
        grouped = vector.grouped_around(written, centers)
        with writing(spark):
            grouped.repartitionByRange("pivot", "away", "uid").sortWithinPartitions("pivot", "away").write.option("parquet.block.size", 4 << 20).parquet(f"{base}/vectors")
        known = spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(centers)], "_p int, center array<double>")
        held = spark.read.parquet(f"{base}/vectors").groupBy("pivot").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
        held.join(F.broadcast(known), F.col("pivot") == F.col("_p"), "left").drop("_p").coalesce(1).write.parquet(f"{base}/pivots")  # MOST_PIVOTS rows

    def _put_postings(self, spark: SparkSession, base: str, blocks: DataFrame) -> DataFrame:
        """Written as they come, so that they are not computed once more for the sample of ranges, and then in order: pass by
        pass, each a range of terms, so that the shuffle of one pass alone is on disk at a time."""
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        unsorted, fs = file_system(spark, f"{base}/_unsorted")
        with writing(spark):
            blocks.write.option("compression", "zstd").parquet(f"{base}/_unsorted")
            rows = spark.read.parquet(f"{base}/_unsorted")
            tests = self._passes(rows, fs.getContentSummary(unsorted).getLength())
            for test in tests:
                part = rows.where(test).repartitionByRange(max(1, -(-least // len(tests))), "term", "block").sortWithinPartitions("term", "block")
                part.write.mode("append").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{base}/postings")
        fs.delete(unsorted, True)
        return spark.read.parquet(f"{base}/postings")

    @staticmethod
    def _passes(rows: DataFrame, size: int) -> list[Column]:
        """Conditions that each row of postings meets one of: ranges of terms, bounded by some of a bounded sample; nulls first."""
        n = min(MOST_PASSES, -(-size // PASS_BYTES))
        if n <= 1:
            return [F.lit(True)]
        some = sorted(r["term"] for r in rows.where("term is not null").sample(min(1.0, SAMPLED_TERMS / max(1, rows.count())), 0).select("term").limit(2 * SAMPLED_TERMS).collect())
        bounds = sorted({some[len(some) * k // n] for k in range(1, n)}) if some else []
        term = F.col("term")
        ends = [None, *bounds, None]
        return [(F.lit(True) if low is None else term >= low) & (F.lit(True) if high is None else (term < high) | term.isNull() if low is None else term < high) for low, high in zip(ends, ends[1:], strict=False)]

    def _segment(self, spark: SparkSession, records: DataFrame, of: Snapshot | None = None, gone: DataFrame | None = None, check: Callable[[DataFrame], None] | None = None) -> tuple[str, int, int]:
        """(name, records, tokens) of a new segment; after ``of`` it takes ``gone`` and what has the uid of one of its records out.
        If ``check`` raises on the written records, they are deleted."""
        name = uuid.uuid4().hex
        base = f"{self.path}/{name}"
        written = self._put(spark, base, records)
        if check is not None:
            try:
                check(written)
            except Exception:
                path, fs = file_system(spark, base)
                fs.delete(path, True)
                raise
        postings = self._put_postings(spark, base, keyword.posting_blocks(keyword.tokenised(written, self.columns), len(self.columns)))
        uids = written.where("false").select("uid") if of is None else written.select("uid").unionByName(gone.select("uid")).distinct()
        uids.write.parquet(f"{base}/gone")
        terms = postings.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
        if of is not None:
            out = self._live(spark, of.segments).join(spark.read.parquet(f"{base}/gone"), "uid", "left_semi")
            less = keyword.record_terms(keyword.tokenised(out, self.columns))
            terms = terms.unionByName(less.select("term", (-F.col("n")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        with writing(spark):
            terms.where("df != 0").repartitionByRange("term").sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{base}/terms")
        lengths = postings.where("term is null").select(F.explode("dl").alias("dl"))
        n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return name, n, total

    def _publish(self, spark: SparkSession, of: Snapshot, after: int | None) -> None:
        """Put the snapshot in place as the next one, if the newest whole one is still ``after`` (any, if None)."""
        listed = self._listed(spark)
        whole = self.current(spark)
        number = max(listed, default=-1) + 1
        if after is not None and (whole is None or whole.number != after):
            raise ConflictError(f"snapshot {after} of {self.path} is not the newest any more")
        folder = f"{self.path}/_snapshots"
        aside, fs = file_system(spark, f"{folder}/_{uuid.uuid4().hex}")
        path, _ = file_system(spark, f"{folder}/{number:010d}")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps({"segments": of.segments, "sizes": of.sizes, "total_len": of.total_len, "meta": asdict(of.meta)}).encode()))
        stream.close()
        if not self._placed(fs, aside, path):
            fs.delete(aside, False)
            raise ConflictError(f"snapshot {number} of {self.path} is there already")
        self._clean(spark)

    @staticmethod
    def _placed(fs, aside, path) -> bool:  # noqa: ANN001
        """Give the file ``aside`` the name ``path``; False if there is such a file. Any other failure is raised."""
        if fs.getUri().getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), path.toUri().getPath())
            except FileExistsError:
                return False
            fs.delete(aside, False)
            return True
        if fs.exists(path):
            return False
        if fs.rename(aside, path):
            return True
        if fs.exists(path):
            return False
        raise OSError(f"{path} could not be made")

    @contextmanager
    def leased(self, spark: SparkSession, seconds: float = 3600) -> Iterator[bool]:
        """Whether the caller alone may refresh meanwhile: it holds the file ``_lease``, which is put in place as a snapshot is.

        One older than ``seconds`` is of a holder that crashed, and is taken over. Who works on regardless
        fails at the snapshot, so a lease spares work and guards nothing.
        """
        folder = f"{self.path}/_snapshots"
        lease, fs = file_system(spark, f"{folder}/_lease")
        own = uuid.uuid4().hex
        aside, _ = file_system(spark, f"{folder}/_{own}")
        stream = fs.create(aside, True)
        stream.write(bytearray(own.encode()))
        stream.close()
        held = self._placed(fs, aside, lease)
        if not held and fs.exists(lease) and time.time() - fs.getFileStatus(lease).getModificationTime() / 1000 > seconds:
            fs.delete(lease, False)
            held = self._placed(fs, aside, lease)
        try:
            if not held:
                fs.delete(aside, False)
            yield held
        finally:
            if held and self._holder(fs, lease) == own:
                fs.delete(lease, False)

    @staticmethod
    def _holder(fs, lease) -> str | None:  # noqa: ANN001
        if not fs.exists(lease):
            return None
        stream = fs.open(lease)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _clean(self, spark: SparkSession) -> None:
        """Delete snapshots older than ``retention``, but for the newest whole one, the segments that only they list, and
        segments and files aside that no snapshot lists for longer than ``orphans``."""
        now, listed, newest = time.time(), self._listed(spark), self.current(spark)
        held = {n: self._opened(spark, n) for n in listed}
        old = [n for n, made in listed.items() if newest is not None and n < newest.number and now - made > self.retention]
        kept = {s for n, of in held.items() if n not in old and of is not None for s in of.segments}
        dropped = {s for n in old if held[n] is not None for s in held[n].segments} - kept
        root, fs = file_system(spark, self.path)
        for x in fs.listStatus(root):
            name = x.getPath().getName()
            lost = name != "_snapshots" and name not in kept and now - x.getModificationTime() / 1000 > self.orphans
            if lost or name in dropped:
                fs.delete(x.getPath(), True)
        for n in old:
            fs.delete(file_system(spark, f"{self.path}/_snapshots/{n:010d}")[0], False)
        folder, _ = file_system(spark, f"{self.path}/_snapshots")
        for x in fs.listStatus(folder):
            if x.getPath().getName().startswith("_") and now - x.getModificationTime() / 1000 > self.orphans:
                fs.delete(x.getPath(), False)

    def write(self, spark: SparkSession, records: DataFrame, meta: Meta, check: Callable[[DataFrame], None] | None = None) -> Meta:
        """A snapshot of ``records`` alone; ``check`` may refuse them, once written, by an error."""
        name, n, total = self._segment(spark, records, check=check)
        meta = replace(meta, record_count=n)
        self._publish(spark, Snapshot(0, (name,), (n,), total, meta), None)
        return meta

    def touch(self, spark: SparkSession, of: Snapshot, meta: Meta) -> None:
        """The snapshot after ``of``, with the same segments and another meta row."""
        self._publish(spark, replace(of, meta=meta), of.number)

    def change(self, spark: SparkSession, of: Snapshot, put: DataFrame, gone: DataFrame, meta: Meta) -> Meta:
        """The snapshot after ``of``: ``put`` (records with vectors) in place of the rows with their uids, without ``gone`` (uid).

        Writes what has changed, then merges segments if there are enough of a tier; fails if ``of`` is not the newest any more.
        """
        name, n, total = self._segment(spark, put, of, gone)
        out = spark.read.parquet(f"{self.path}/{name}/gone")
        lost = self.index(spark, of).lengths.join(out, "uid", "left_semi").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        meta = replace(meta, record_count=of.meta.record_count + n - lost[0])
        self._publish(spark, Snapshot(of.number + 1, (*of.segments, name), (*of.sizes, n), of.total_len + total - lost[1], meta), of.number)
        try:
            self.compact(spark)
        except ConflictError:
            pass  # another writer goes on from here, and merges
        return meta

    def compact(self, spark: SparkSession) -> bool:
        """Merge the newest segments if there are FAN of a tier; whether there were."""
        of = self.snapshot(spark)
        at = merged_from(of.sizes)
        if at is None:
            return False
        some, name = of.segments[at:], uuid.uuid4().hex
        base = f"{self.path}/{name}"
        written = self._put(spark, base, self._live(spark, some).drop("segment", "_no"))
        index = keyword.KeywordIndex(self._all(spark, "postings", some), written.limit(0), self.columns, 0, 0, self._gone(spark, some))
        bits = keyword.BLOCK.bit_length() - 1
        placed = written.select("uid", F.shiftright("_no", bits).alias("block"), F.col("_no").bitwiseAND(keyword.BLOCK - 1).cast("int").alias("slot"))
        names = [c for c in index.blocks.columns if c != "segment"]
        self._put_postings(spark, base, keyword.reblocked(index.postings, index.lengths.join(placed, "uid"), len(self.columns), names))
        gone = reduce(DataFrame.unionByName, [self._read(spark, s, "gone") for s in some]).distinct()
        (gone if at else gone.where("false")).write.parquet(f"{base}/gone")
        terms = reduce(DataFrame.unionByName, [self._read(spark, s, "terms") for s in some]).groupBy("term").agg(F.sum("df").alias("df"))
        with writing(spark):
            terms.where("df != 0").repartitionByRange("term").sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{base}/terms")
        n = written.count()
        self._publish(spark, replace(of, segments=(*of.segments[:at], name), sizes=(*of.sizes[:at], n)), of.number)
        return True


def tier(records: int) -> int:
    """The tier of a segment by its size: the logarithm to the base FAN."""
    level = 0
    while records >= FAN:
        records //= FAN
        level += 1
    return level


def merged_from(sizes: tuple[int, ...]) -> int | None:
    """The first of the newest segments that are to be merged into one; None if there are not FAN of a tier (or below).

    The merged segment may be the last that its own tier needed, so the question is asked again with it in place.
    """
    at, sizes = None, list(sizes)
    while True:
        level = tier(sizes[-1])
        n = next((k for k, size in enumerate(reversed(sizes)) if tier(size) > level), len(sizes))
        if n < FAN:
            return at
        at = len(sizes) - n
        sizes[at:] = [sum(sizes[at:])]
