"""Exact deduplication by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BYTES, bucketed, column, documents, materialise, quoted, slices, tidy, utf8

#: Rows that one part, a message's sender, holds at most; a part is one writing task's rows unless those are more.
PART_BITS = 20
#: Fingerprints that one owner gets on average, at most.
OWNER_ROWS = 2_000_000
#: Codes that are packed or read at a time.
_SOME = 1 << 15


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct 64-bit values as Golomb-Rice codes of their gaps: all quotients in unary, then all k-bit remainders."""
    gaps = np.diff(values, prepend=values[:1] * 0)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = [((gaps[at : at + _SOME, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel() for at in range(0, len(gaps), _SOME)]
    return np.packbits(np.concatenate((unary, *rest))).tobytes()


def golomb_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ones = np.flatnonzero(bits)[:n]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    at = int(ones[-1]) + 1 if n else 0
    rest = bits[at : at + n * k].reshape(n, k)
    for i in range(k):
        gaps |= rest[:, i].astype(np.uint64) << np.uint64(i)
    return np.cumsum(gaps, dtype=np.uint64)


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE_BYTES)


def _fingerprinted(df: DataFrame, text: str) -> DataFrame:
    """``df`` as row (a struct), with _part and _seq (the row's place in it), _h, _sha and _n (code points of the text)."""
    schema = T.StructType([T.StructField("row", df.schema), *(T.StructField(c, kind) for c, kind in (("_part", T.LongType()), ("_seq", T.IntegerType()), ("_h", T.LongType()), ("_sha", T.BinaryType()), ("_n", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "raw", 1_000_000):
            raws = batch.column("raw").to_pylist()
            keys = [normalised(x) for x in raws]
            places = np.arange(at, at + len(raws))
            at += len(raws)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(places >> PART_BITS), pa.array((places & ((1 << PART_BITS) - 1)).astype(np.int32)),
                 pa.array(np.array([xxhash.xxh64_intdigest(x) for x in keys], np.uint64).view(np.int64)),
                 pa.array([hashlib.sha256(x).digest() for x in keys], pa.binary()),
                 pa.array([len(x.decode("utf-8", "replace")) for x in raws], pa.int64())],
                names=schema.fieldNames(),
            )

    return df.select(F.struct(*(column(c) for c in df.columns)).alias("row"), utf8(text).alias("raw")).mapInArrow(tidy(run), schema)


def _messages(owners: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        h = np.sort(table.column("_h").to_numpy().view(np.uint64))
        first = np.concatenate(([True], h[1:] != h[:-1]))
        twice = np.diff(np.concatenate((np.flatnonzero(first), [len(h)]))) > 1
        h = h[first]
        owner = ((h >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(owner, np.arange(owners + 1))
        there = np.flatnonzero(np.diff(cuts))
        part = table.column("_part")[0].as_py()
        spans = [(int(cuts[o]), int(cuts[o + 1])) for o in there]
        return pa.table({
            "_part": pa.array([part] * len(there), pa.int64()), "_owner": pa.array(there, pa.int64()), "_count": pa.array([b - a for a, b in spans], pa.int64()),
            "_codes": pa.array([golomb_encode(h[a:b] - _base(o, owners), _rice(owners, b - a)) for o, (a, b) in zip(there, spans, strict=True)], pa.binary()),
            "_twice": pa.array([np.packbits(twice[a:b]).tobytes() for a, b in spans], pa.binary()),
        })

    return run


def _rice(owners: int, count: int) -> int:
    """Bits of the remainder: about the logarithm of the mean gap of so many fingerprints in an owner's range."""
    return max(1, 64 - (owners * count).bit_length())


def _base(owner: int, owners: int) -> np.uint64:
    return np.uint64(-(-(int(owner) << 32) // owners) << 32)


def _replies(owners: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        counts = table.column("_count").to_pylist()
        h = np.concatenate([golomb_decode(c, n, _rice(owners, n)) for c, n in zip(table.column("_codes").to_pylist(), counts, strict=True)])
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8))[:n] for t, n in zip(table.column("_twice").to_pylist(), counts, strict=True)]).astype(bool)
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        group = np.cumsum(new) - 1
        many = (np.bincount(group) > 1) | (np.bincount(group, twice[order]) > 0)
        hit = np.empty(len(h), bool)
        hit[order] = many[group]
        ends = np.cumsum(counts)
        return pa.table({"_part": table.column("_part"), "_owner": table.column("_owner"), "_bits": pa.array([np.packbits(hit[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())})

    return run


def _suspects(owners: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, found = [], []
            for x in batch.to_pylist():
                hit = np.unpackbits(np.frombuffer(x["_bits"], np.uint8))[: x["_count"]].astype(bool)
                if hit.any():
                    h = golomb_decode(x["_codes"], x["_count"], _rice(owners, x["_count"]))[hit] + _base(x["_owner"], owners)
                    found.append(h.view(np.int64))
                    part += [x["_part"]] * len(h)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.concatenate(found))], names=["_part", "_h"])

    return run


def _flagged(pairs: pa.Table, part: int) -> pa.Table:
    """One row: the part, and for each of its places up to the last one of ``pairs`` whether it is there."""
    places = pairs.column("_seq").to_numpy()
    flags = np.zeros(int(places.max()) + 1 if len(places) else 0, bool)
    flags[places] = True
    return pa.table({"_part": pa.array([part]), "_flags": pa.ListArray.from_arrays(pa.array([0, len(flags)], pa.int32()), pa.array(flags))})


def _flag() -> Column:
    """Whether the row's place is flagged in its part's array."""
    return F.coalesce(F.get("_flags", F.col("_seq")), F.lit(False))


_FLAGS = "_part long, _flags array<boolean>"


def marked(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, suspects, buckets' flags of suspects). stored: ``df`` as row, with _part, _seq, _sha, _n, bucketed by _part.
    suspects: doc_id, _part, _seq, _sha, keep_id, group_size, kept of each row whose fingerprint occurs more than once.

    1. Parts (a writing task's rows) send each owner of a hash range their sorted distinct fingerprints, Golomb-coded
       in one message, with a bitmap of those they hold twice.
    2. Owners answer each message with a bitmap of the fingerprints that occur more than once.
    3. Parts look up their suspects and flag them. Rows are stored bucketed by part, so this moves only bitmaps; only
       suspects' texts are shuffled, grouped by their bytes after map-side aggregation, so a group of copies that holds
       a third of all rows reaches its reducer as one row a task.

    A part holds 2**PART_BITS rows at most and an owner OWNER_ROWS fingerprints on average, at any size of the table.
    """
    buckets = max(1, df.rdd.getNumPartitions())
    stored = bucketed(_fingerprinted(df, text), "parts", buckets, "_part")
    owners = max(8, -(-stored.count() // OWNER_ROWS))
    messages = materialise(stored.select("_part", "_h").groupBy("_part").applyInArrow(_messages(owners), "_part long, _owner long, _count long, _codes binary, _twice binary"), "messages")
    replies = messages.groupBy("_owner").applyInArrow(_replies(owners), "_part long, _owner long, _bits binary")
    answered = messages.select("_part", "_owner", "_count", "_codes").join(replies, ["_part", "_owner"])
    twice = bucketed(answered.mapInArrow(tidy(_suspects(owners)), "_part long, _h long").repartition(buckets, "_part"), "twice", buckets, "_part")

    def look_up(rows: pa.Table, hit: pa.Table) -> pa.Table:
        part = (rows if rows.num_rows else hit).column("_part")[0].as_py()
        found = np.isin(rows.column("_h").to_numpy(), hit.column("_h").to_numpy())
        return _flagged(rows.filter(pa.array(found)), part)

    flags = bucketed(stored.select("_part", "_seq", "_h").groupBy("_part").cogroup(twice.groupBy("_part")).applyInArrow(look_up, _FLAGS), "flags", buckets, "_part")
    held = F.col(f"row.{quoted(text)}")
    key = F.translate(F.coalesce(held.cast("string"), F.lit("")), SPACE_BYTES.decode(), "")
    hit = stored.join(flags.hint("shuffle_hash"), "_part").where(_flag())
    hit = hit.select(F.col("row.doc_id").alias("doc_id"), "_part", "_seq", "_sha", "_n", key.alias("_key"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "_part", "_seq"))
    groups = materialise(hit.groupBy("_sha", "_key").agg(best.alias("b"), F.count("*").alias("group_size")).drop("_key"), "groups")
    members = materialise(hit.select("doc_id", "_part", "_seq", "_sha"), "members").join(groups, "_sha")
    kept = (F.col("_part") == F.col("b._part")) & (F.col("_seq") == F.col("b._seq"))
    suspects = materialise(members.select("doc_id", "_part", "_seq", "_sha", F.col("b.doc_id").alias("keep_id"), "group_size", kept.alias("kept")), "suspects")
    return stored, suspects, flags


def exact_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row, by ``marked``.

    Texts are equal when identical without white space; null counts as empty. Of a group the row with the most code
    points stays, then the least doc_id (null last), then, of rows that repeat one another, the first stored. A text of
    any length is one row of its batch. An empty table gives no rows; other columns are not read.
    """
    stored, suspects, flags = marked(df.select("doc_id", column(text)), text)
    digest = F.lower(F.hex("_sha")).alias("text_sha256")
    single = stored.select(F.col("row.doc_id").alias("doc_id"), "_part", "_seq", "_sha").join(flags.hint("shuffle_hash"), "_part", "left").where(~_flag())
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    return single.unionByName(suspects.select("doc_id", "keep_id", "group_size", "kept", digest))


def without_copies(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one row of each group of ``exact_groups``; rows of other texts stay as they are. Columns may have any
    names; an empty table gives no rows."""
    stored, suspects, _ = marked(df, text)
    gone = suspects.where("not kept").select("_part", "_seq").groupBy("_part").applyInArrow(lambda t: _flagged(t, t.column("_part")[0].as_py()), _FLAGS)
    stay = stored.join(gone.hint("shuffle_hash"), "_part", "left").where(~_flag())
    return stay.select(*(F.col(f"row.{quoted(c)}").alias(c) for c in df.columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM g
"""
