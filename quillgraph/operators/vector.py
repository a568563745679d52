"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULTS
from .keyword import without_gone

#: Pivots of a segment at most, and the group of vectors without a direction.
MOST_PIVOTS, NO_PIVOT = 256, -1
#: What a distance of unit vectors, computed in floating point, may be off by.
OFF = 1e-6


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors score 0."""
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)) + F.lit(DEFAULTS.cosine_epsilon))


def neighbours(vectors: DataFrame, query: list[float], limit: int, uid: str = "uid", ordinal: str = "ordinal", vector: str = "embedding") -> DataFrame:
    """(uid, ordinal, score) of the ``limit`` nearest: a projection and one top-k, all in the JVM. The query's length is a constant."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    length = float(np.sqrt(np.square(np.asarray(query, np.float64)).sum()))
    score = _dot(F.col(vector), asked) / (F.sqrt(_dot(F.col(vector), F.col(vector))) * F.lit(length) + F.lit(DEFAULTS.cosine_epsilon))
    scored = vectors.where(F.col(vector).isNotNull()).select(F.col(uid).alias("uid"), F.col(ordinal).alias("ordinal"), score.alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "ordinal").limit(limit)


def batch_neighbours(vectors: DataFrame, queries: list[tuple[int, list[float]]], limit: int, uid: str = "uid", ordinal: str = "ordinal", vector: str = "embedding") -> DataFrame:
    """(qid, uid, ordinal, score): each Arrow batch of vectors is multiplied with a block of queries, which travels with the
    function, and gives its own ``limit`` best for each, so what goes on to the global ranking is bounded by batches x
    queries x limit."""
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"qid long, uid {kind[uid]}, ordinal {kind[ordinal]}, score double"
    if not queries:
        return vectors.sparkSession.createDataFrame([], schema)
    ids = np.array([q for q, _ in queries], np.int64)
    asked = np.array([v for _, v in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _best(batch, ids, asked, limit)

    return _prepared(vectors, uid, ordinal, vector).mapInArrow(run, schema)


#: Vectors and queries that one group of a join holds, and vectors and queries of it that are multiplied at a time.
PART, QUERY_BLOCK, SLICE, QUERY_SLICE = 65_536, 16_384, 1024, 1024


def joined_neighbours(vectors: DataFrame, queries: DataFrame, limit: int, uid: str = "uid", ordinal: str = "ordinal", vector: str = "embedding") -> DataFrame:
    """(qid, uid, ordinal, score) for a table of ``queries`` (qid, embedding) of any size: a stated query set against all rows.

    Vectors fall into parts and queries into blocks, of PART and QUERY_BLOCK rows on average however large the tables are; each part
    meets each block in one group. So a vector is sent once for each block of queries, and a query once for each
    part of vectors. A group multiplies SLICE vectors with QUERY_SLICE queries at a time and keeps each query's ``limit`` best so far.
    """
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"qid long, uid {kind[uid]}, ordinal {kind[ordinal]}, score double"
    asked = queries.where("embedding is not null").select(F.col("qid").cast("long").alias("qid"), "embedding")
    rows = _prepared(vectors, uid, ordinal, vector)
    blocks, parts = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-rows.count() // PART))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = rows.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts))).withColumn("block", each(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("part", each(parts))

    def run(some: pa.Table, of: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "uid": some.column("uid").slice(0, 0), "ordinal": some.column("ordinal").slice(0, 0), "score": pa.array([], pa.float64())})
        if not some.num_rows or not of.num_rows:
            return empty
        found = []
        for first in range(0, of.num_rows, QUERY_SLICE):
            asked = of.slice(first, QUERY_SLICE)
            best = RunningBest(np.asarray(asked.column("embedding").combine_chunks().flatten(), np.float64).reshape(asked.num_rows, -1), limit)
            for at in range(0, some.num_rows, SLICE):
                part = some.slice(at, SLICE).combine_chunks()
                best.add(np.asarray(part.column("v").combine_chunks().flatten(), np.float64).reshape(part.num_rows, -1), np.asarray(part.column("ordinal")), at)
            query, row, score = best.rows()
            at = pa.array(row)
            found.append(pa.table({"qid": asked.column("qid").take(pa.array(query)), "uid": some.column("uid").take(at), "ordinal": some.column("ordinal").take(at), "score": pa.array(score)}))
        return pa.concat_tables(found)

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)


class RunningBest:
    """Each query's ``limit`` best so far: by score to nine places, then ordinal. Holds queries x limit of them, whatever has
    been added."""

    def __init__(self, asked: np.ndarray, limit: int):
        self.asked, self.limit = asked, limit
        self.lengths = np.sqrt((asked**2).sum(axis=1))
        self.score = np.empty((len(asked), 0))
        self.place = self.row = np.empty((len(asked), 0), np.int64)

    def add(self, vectors: np.ndarray, ordinals: np.ndarray, first: int) -> None:
        """``vectors``, numbered from ``first``."""
        scores = (self.asked @ vectors.T) / (self.lengths[:, None] * np.sqrt((vectors**2).sum(axis=1))[None, :] + DEFAULTS.cosine_epsilon)
        wide = lambda a: np.broadcast_to(a, scores.shape)
        score, place, row = (np.concatenate(x, axis=1) for x in ((self.score, scores), (self.place, wide(ordinals)), (self.row, wide(np.arange(first, first + len(vectors))))))
        if score.shape[1] > self.limit:
            kept = np.lexsort((place, -np.round(score, 9)), axis=1)[:, : self.limit]
            score, place, row = (np.take_along_axis(a, kept, axis=1) for a in (score, place, row))
        self.score, self.place, self.row = score, place, row

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, number of the vector, score) of all that are held."""
        return np.repeat(np.arange(len(self.asked)), self.score.shape[1]), self.row.ravel(), self.score.ravel()


def _prepared(vectors: DataFrame, uid: str, ordinal: str, vector: str) -> DataFrame:
    return vectors.where(F.col(vector).isNotNull()).select(F.col(uid).alias("uid"), F.col(ordinal).alias("ordinal"), F.col(vector).alias("v"))


def _best(batch: pa.RecordBatch, ids: np.ndarray, asked: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Each query's ``limit`` best of a batch (uid, ordinal, v): by score to nine places, then ordinal."""
    if not batch.num_rows:
        return
    m = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1)
    lengths = np.sqrt((m**2).sum(axis=1))[:, None] * np.sqrt((asked**2).sum(axis=1))[None, :]
    scores = m @ asked.T / (lengths + DEFAULTS.cosine_epsilon)
    place = np.asarray(batch.column("ordinal"))
    for k in range(len(ids)):
        rounded = np.round(scores[:, k], 9)
        some = np.arange(len(rounded))
        if limit < len(rounded):
            least = np.partition(rounded, len(rounded) - limit)[len(rounded) - limit]
            some = np.flatnonzero(rounded >= least)
        best = some[np.lexsort((place[some], -rounded[some]))[:limit]]
        at = pa.array(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), ids[k])), batch.column("uid").take(at), batch.column("ordinal").take(at), pa.array(scores[best, k])], names=["qid", "uid", "ordinal", "score"])


def pivots_of(vectors: DataFrame) -> np.ndarray:
    """Unit vectors, at most MOST_PIVOTS: as many as the root of the number of vectors, those with the least hashes of their uid."""
    given = vectors.where("embedding is not null")
    most = min(MOST_PIVOTS, max(1, int(given.count() ** 0.5)))
    some = given.where(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("uid"), "uid").limit(most).select("embedding").collect()
    return _unit(np.array([r["embedding"] for r in some], np.float64)) if some else np.empty((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((m**2).sum(axis=1))[:, None]
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


def grouped_around(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(pivot, away, uid, ordinal, embedding): each vector with the pivot nearest to its direction, and how far it is; vectors of
    zeros are in a group of their own."""
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                m = _unit(np.asarray(batch.column("embedding").flatten(), np.float64).reshape(batch.num_rows, -1))
                some = (m != 0).any(axis=1)
                near = m @ pivots.T if len(pivots) else np.zeros((len(m), 1))
                of = np.where(some, near.argmax(axis=1), NO_PIVOT)
                away = np.where(some, np.sqrt(np.maximum(0, 2 - 2 * near.max(axis=1))), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(away), batch.column("uid"), batch.column("ordinal"), batch.column("embedding")], names=["pivot", "away", "uid", "ordinal", "embedding"])

    given = vectors.where("embedding is not null").select("uid", "ordinal", "embedding")
    return given.mapInArrow(run, f"pivot int, away double, uid {kind['uid']}, ordinal {kind['ordinal']}, embedding {kind['embedding']}")


@dataclass(frozen=True)
class VectorIndex:
    """groups (segment, pivot, away, uid, ordinal, embedding), and pivots (segment, pivot, center, n, least, most): how many vectors a
    group has and how far its nearest and farthest are. ``gone`` as in the keyword index."""

    groups: DataFrame
    pivots: DataFrame
    gone: DataFrame | None = None

    def candidates(self, query: list[float], limit: int) -> DataFrame:
        """Vectors (uid, ordinal, embedding) that the ``limit`` nearest are among.

        The groups around the pivots nearest to the query are scored first, as many as hold ``limit`` vectors. What is farther than the last of
        these cannot be among the nearest, and by the triangle inequality a vector is at least as far as the distances of
        query and vector to a pivot differ: whole groups, and in the others all but a ring, are left to the filter
        of the scan. At most MOST_PIVOTS rows a segment reach the driver.
        """
        known = self.pivots.collect()
        asked = _unit(np.array([query], np.float64))[0]
        dead = self.gone is not None
        if not asked.any() or not known:
            return self._live(self.groups)
        some = [r for r in known if r["pivot"] != NO_PIVOT]
        far = {(r["segment"], r["pivot"]): float(np.linalg.norm(asked - np.array(r["center"], np.float64))) for r in some}
        first, held = [], 0
        for r in sorted(some, key=lambda r: far[r["segment"], r["pivot"]]):
            first.append(r)
            held += r["n"]
            if held >= limit and not dead or held >= 4 * limit:
                break
        near = neighbours(self._live(self._rings([(r, 0.0, 3.0) for r in first])), query, limit).select("score").collect()
        if len(near) < limit:
            return self._live(self.groups)
        reach = float(np.sqrt(max(0.0, 2 - 2 * near[-1]["score"]))) + OFF
        rings = [(r, d - reach, d + reach) for r in some if (d := far[r["segment"], r["pivot"]]) - reach <= r["most"] and d + reach >= r["least"]]
        zeros = [(r, -1.0, 1.0) for r in known if r["pivot"] == NO_PIVOT] if near[-1]["score"] <= OFF else []
        return self._live(self._rings(rings + zeros))

    def _rings(self, rings: list) -> DataFrame:
        """Vectors of the groups whose distance to their pivot is within bounds."""
        segments: dict[int, list] = {}
        for r, low, high in rings:
            segments.setdefault(r["segment"], []).append((r["pivot"], low, high))
        test = F.lit(False)
        for segment, of in segments.items():
            bounds = F.create_map(*(x for pivot, low, high in of for x in (F.lit(pivot), F.array(F.lit(low), F.lit(high)))))[F.col("pivot")]
            test = test | ((F.col("segment") == segment) & F.col("pivot").isin([p for p, _, _ in of]) & (F.col("away") >= min(x for _, x, _ in of)) & (F.col("away") <= max(x for _, _, x in of)) & (F.col("away") >= bounds[0]) & (F.col("away") <= bounds[1]))
        return self.groups.where(test)

    def _live(self, rows: DataFrame) -> DataFrame:
        return without_gone(rows, self.gone).select("uid", "ordinal", "embedding")

    def nearest(self, query: list[float], limit: int) -> DataFrame:
        """``neighbours`` of the query."""
        return neighbours(self.candidates(query, limit), query, limit)
