"""Best-fit packing of token sequences with exact complements."""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import piece_coder, vocabulary
from .common import documents, materialise, slices, tidy, utf8

CAPACITY = 2048
END_ID = 0
#: How long the longest member of an exact filling is at least, of the longest length that fits: one plan for each.
REACHES = (0.0, 0.7, 1.0)


class SumIndex:
    """Which available lengths have a given sum: one, two or three of them.

    ``left`` has how often each length is available: the index of single sums. Pairs are hashed by their sum, and triples
    by their sum too, as a length beside an entry of the index of pairs. Entries of a sum are made when it is first asked
    for, the longest length last. Counts only fall, so an entry that they no longer allow is dropped for good when it is
    met.
    """

    def __init__(self, left: list[int]):
        self.left = left
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def _free(self, *parts: int) -> bool:
        return all(self.left[x] >= parts.count(x) for x in parts)

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.left[total] else None

    def pair(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Two available lengths, besides those of ``beside``, with the longest length that any such pair has."""
        if total not in self.pairs:
            self.pairs[total] = [x for x in range((total + 1) // 2, total) if self._free(x, total - x)]
        found = self.pairs[total]
        while found and not self._free(found[-1], total - found[-1]):
            found.pop()
        return next(((x, total - x) for x in reversed(found) if not beside or self._free(x, total - x, *beside)), None)

    def triple(self, total: int, above: int = 0) -> tuple[int, ...] | None:
        """Three available lengths with the longest length that any such triple has, if that is more than ``above``."""
        if total not in self.triples:
            self.triples[total] = [x for x in range(-(-total // 3), total - 1) if self.left[x]]
        found = self.triples[total]
        at = len(found) - 1
        while at >= 0 and found[at] > above:
            x = found[at]
            two = self.pair(total - x, (x,)) if self.left[x] else None
            if two:
                return (x, *two)
            del found[at]  # has no pair any more, nor will it
            at -= 1
        return None

    def exact(self, total: int, least: int = 1) -> tuple[int, ...] | None:
        """One length, a pair or a triple with this sum, whichever has the longest length: long ones fit in fewest gaps. Of a
        pair and a triple with the same longest one the pair. None only if no such filling has a length of ``least``."""
        if found := self.single(total):
            return found
        two = self.pair(total)
        two = two if two and two[0] >= least else None
        return self.triple(total, two[0] if two else least - 1) or two


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan of exact fillings and best-fit residuals; of its REACHES the one with the fewest sequences. With 0 any exact
    filling is taken; with more those of short lengths, which would use up what fills other gaps, are left."""
    return min((_plan(counts, capacity, reach) for reach in REACHES), key=lambda found: sum(times for times, _ in found))


def _plan(counts: dict[int, int], capacity: int, reach: float) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns [(times, [(length, how many), ...]), ...] that together use each length as often as ``counts`` has it.

    Works on the counts of lengths alone. The longest length left opens a pattern. One, two or three available lengths
    that fill its gap exactly are looked up by their sum and consumed. Where there are none the gap is a residual: it
    takes the longest length that fits best, and what is left of the gap is looked up again. The pattern is then used
    as often as availability allows.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        left[length] += n
    index = SumIndex(left)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    for length in range(capacity, 0, -1):
        while left[length]:
            parts, gap = [length], capacity - length
            left[length] -= 1
            while gap:
                longest = next((x for x in range(gap, 0, -1) if left[x]), None)
                if longest is None:
                    break
                filled = index.exact(gap, max(1, math.ceil(reach * longest))) or (longest,)
                for x in filled:
                    left[x] -= 1
                parts += filled
                gap -= sum(filled)
            used = Counter(parts)
            more = min(left[x] // n for x, n in used.items())
            for x, n in used.items():
                left[x] -= more * n
            out.append((1 + more, sorted(used.items(), reverse=True)))
    return out


def token_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row_no, and with ``with_ids`` ids (the piece's): each document's ids and END_ID,
    cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_no = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "t", 4_000_000):
            source, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, (of, _) in enumerate(piece_coder(path, False).coded(batch.column("t"), tokens=False)):
                of = bytes(of) + struct.pack("<I", END_ID)
                for n, at in enumerate(range(0, len(of), 4 * capacity)):
                    part = of[at : at + 4 * capacity]
                    source.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            numbers = np.arange(row_no, row_no + len(source))
            row_no += len(source)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(numbers, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else [])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "row_no", *(["ids"] if with_ids else [])],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row_no long" + (", ids binary" if with_ids else "")
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("t")).mapInArrow(tidy(run), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (written before; with length and a distinct row_no) with sequence_id and offset.

    Pieces of a length are numbered apart in buckets, so that no task gets all pieces of a frequent length; only
    the counts of lengths reach the driver. A pattern of ``plan`` holds fewer than sqrt(2 * capacity) distinct
    lengths, and there are at most a few patterns for each length, so the broadcast plan has at most about
    4 * capacity * sqrt(2 * capacity) rows (0.5 million at 2048), whatever the input's size.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, base = [], 0
    used: Counter[int] = Counter()
    for times, parts in plan(counts, capacity):
        at = 0
        for length, n in parts:
            rows.append((length, used[length], used[length] + times * n, base, at, n))
            used[length] += times * n
            at += length * n
        base += times
    table = spark.createDataFrame(rows, "length long, _from long, _to long, _base long, _at long, _n long")
    buckets = max(64, sum(counts.values()) // 1_000_000)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("row_no"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_size"))
    before = sizes.select("length", "_bucket", (F.sum("_size").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_size")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("row_no"))
    numbered = dealt.withColumn("_number", number).join(before, ["length", "_bucket"]).withColumn("_no", F.col("_before") + F.col("_number") - 1)
    placed = numbered.join(F.broadcast(table), (numbered["length"] == table["length"]) & (F.col("_no") >= F.col("_from")) & (F.col("_no") < F.col("_to"))).drop(table["length"])
    step = F.col("_no") - F.col("_from")
    return placed.select(
        *pieces.columns,
        (F.col("_base") + F.floor(step / F.col("_n"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(step, F.col("_n")) * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(df: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document.

    A null or empty text is END_ID alone; repeated rows and null ids are documents like any other; other columns
    are not read; an empty table gives no rows. A text of any length is cut into pieces as it is coded. Pieces of equal
    length are interchangeable, so ties need no rule.
    """
    pieces = materialise(token_pieces(df, path, capacity, with_ids=False), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), vocabulary())
