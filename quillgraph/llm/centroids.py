"""Centroids of vectors in exact integers; Hamerly's bounds say which vectors need no scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed_table, column, dropped, materialise, tidy, workers_find_library

SCALE, CLUSTERS, ROUNDS, DIMS = 1024, 8, 10, 64
#: Vectors of a block, and blocks of a bucket: a task holds one block and reads one bucket.
BLOCK, BUCKET = 4096, 64
#: Components are held within this bound.
MOST = 2**62
#: What a bound, a rounded number, may be off by, relatively. It is widened by so much.
SLACK = 1e-12


@dataclass
class Clusters:
    """rows (vec_id, cluster, distance), the centroids, and how many vectors each assignment scanned whole."""

    rows: DataFrame
    centroids: list[list[int]]
    scanned: list[int] = field(default_factory=list)


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and ints, floor(scale * x), of the vectors with ``dims`` components, none of them null or not finite."""
    v = column(vector)
    fine = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    ints = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * float(scale)), F.lit(MOST)), F.lit(-MOST)))
    return df.where(fine).select(column(vec_id).cast("long").alias("vec_id"), ints.alias("ints"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the least digests of ``seed``:id, ties by components, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["ints"]) for r in vectors.orderBy(digest.asc_nulls_last(), "ints").limit(k).collect()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` and rows of ``c``: in doubles where all sums are integers that these hold,
    else in 64 bits, else in Python's integers."""
    bound = max((int(np.abs(a).max()) for a in (x, c) if a.size), default=0)
    if 4 * bound * bound * x.shape[1] < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    kind = np.int64 if 4 * bound * bound * x.shape[1] < 2**63 else object
    a, b = x.astype(kind), c.astype(kind)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def _own(x: np.ndarray, c: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to the centroids ``of`` them."""
    out = np.zeros(len(x), object)
    for j in np.unique(of):
        at = np.flatnonzero(of == j)
        out[at] = squared(x[at], c[j : j + 1])[:, 0]
    return out


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def assigned(x: np.ndarray, c: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, drift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest centroid, upper bound of its distance, lower bound of the second nearest's, vectors scanned whole).

    ``state`` is what the assignment before gave; its bounds are loosened by how far the centroids went (``drift``). Where
    the upper bound is below the lower one, or below half of the way to the next centroid, the nearest is still
    the nearest, and no other is as near. The others get an exact upper bound, and if that does not settle it a whole scan, in
    which ties go to the smaller number.
    """
    n, k = len(x), len(c)
    if state is None:
        of, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
        open_rows = np.arange(n)
    else:
        of, upper, lower = (a.copy() for a in state)
        far = np.sort(drift)[::-1]
        beside = np.where(drift == far[0], far[1] if k > 1 else 0.0, far[0])  # the farthest that any other one went
        upper = upper * (1 + SLACK) + drift[of] * (1 + SLACK)
        lower = lower * (1 - SLACK) - beside[of] * (1 + SLACK)
        between = _root(squared(c, c)) * (1 - SLACK)
        between[np.arange(k), np.arange(k)] = np.inf
        hold = np.maximum(lower, between.min(axis=1)[of] / 2)
        near = np.flatnonzero(~(upper < hold))
        upper[near] = _root(_own(x[near], c, of[near])) * (1 + SLACK)
        open_rows = near[~(upper[near] < hold[near])]
    if len(open_rows):
        d = squared(x[open_rows], c)
        best = d.argmin(axis=1)
        least = d[np.arange(len(d)), best]
        if k > 1:
            rest = d.astype(object) if d.dtype == object else d.copy()
            rest[np.arange(len(d)), best] = d.max() + 1
            second = _root(rest.min(axis=1)) * (1 - SLACK)
        else:
            second = np.full(len(d), np.inf)
        of[open_rows], upper[open_rows], lower[open_rows] = best, _root(least) * (1 + SLACK), second
    return of, upper, lower, len(open_rows)


def _packed(vectors: DataFrame) -> DataFrame:
    """block, ids, width and ints: BLOCK vectors of a partition in a row, their components in as few bytes as hold all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ints = part.column("ints").flatten().to_numpy().astype(np.int64)
                bound = int(np.abs(ints).max()) if len(ints) else 0
                width = next(w for w in (2, 4, 8) if bound < 2 ** (8 * w - 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([ints.astype(f"<i{width}").tobytes()], pa.binary())],
                    names=["block", "ids", "width", "ints"],
                )
                number += 1

    return vectors.mapInArrow(tidy(run), "block long, ids array<long>, width int, ints binary")


def _matrix(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["ints"], f"<i{row['width']}").astype(np.int64).reshape(-1, dims)


def _state(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    return None if row.get("of") is None else (np.frombuffer(row["of"], "<i4"), np.frombuffer(row["upper"], "<f8"), np.frombuffer(row["lower"], "<f8"))


def _step(blocks: DataFrame, centroids: list[list[int]], drift: list[float] | None) -> DataFrame:
    """block, of, upper, lower (the state after this assignment) and moved: for each centroid the sums of the components of vectors that
    came to it, less those that left it, their number, and at the end the vectors scanned whole; null without any."""
    dims, k = len(centroids[0]), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                x, state = _matrix(row, dims), _state(row)
                of, upper, lower, scanned = assigned(x, c, state, None if drift is None else np.array(drift))
                sums = np.zeros((k, dims + 1), object)
                went = np.ones(len(x), bool) if state is None else of != state[0]
                for sign, where in ((1, of), (-1, state[0] if state else None)):
                    for j in np.unique(where[went]) if where is not None else ():
                        some = x[went & (where == j)]
                        sums[j, :dims] += sign * (some.astype(object) if np.abs(some).max() > 2**40 else some).sum(axis=0).astype(object)
                        sums[j, dims] += sign * len(some)
                moved = [Decimal(int(v)) for v in [*sums.ravel(), scanned]] if scanned or went.any() else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([of.astype("<i4").tobytes()], pa.binary()), pa.array([upper.tobytes()], pa.binary()), pa.array([lower.tobytes()], pa.binary()), pa.array([moved], pa.list_(pa.decimal128(38, 0)))],
                    names=["block", "of", "upper", "lower", "moved"],
                )

    return blocks.mapInArrow(tidy(run), "block long, of binary, upper binary, lower binary, moved array<decimal(38,0)>")


def _ended(blocks: DataFrame, centroids: list[list[int]], drift: list[float] | None) -> DataFrame:
    """vec_id, cluster, distance, and in a block's first row how many of it were scanned."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                x = _matrix(row, dims)
                of, _, _, scanned = assigned(x, c, _state(row), None if drift is None else np.array(drift))
                distance = [min(int(d), 2**63 - 1) for d in _own(x, c, of)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(of, pa.int32()), pa.array(distance, pa.int64()), pa.array([scanned] + [0] * (len(x) - 1), pa.int64())], names=["vec_id", "cluster", "distance", "scanned"])

    return blocks.mapInArrow(tidy(run), "vec_id long, cluster int, distance long, scanned long")


def clustered(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3", dims: int = DIMS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> Clusters:
    """``rounds`` of assignment and exact floor means, then one more assignment.

    Vectors are packed in blocks once and written in buckets. A round reads them beside the state that the round before wrote, in the same
    buckets, so neither is shuffled, and writes a new state of 20 bytes a vector: its centroid, an upper bound and a
    second-nearest lower bound. Sums follow from the vectors that went from one centroid to another. Only the sums of ``k`` centroids
    reach the driver.

    Vectors of another length, null or with components that are null or not finite take no part. There are as
    many centroids as vectors if these are fewer; equal ids (and null ids, which come last) are ties of the start and go by
    components; repeated rows are vectors of their own. Components beyond 2**62 count as that, distances beyond a
    long as the largest. Other columns are not read; an empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, vec_id, vector, dims, scale)
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [])
    buckets = max(8, vectors.count() // (BLOCK * BUCKET))
    blocks, table, path = bucketed_table(_packed(vectors).repartition(buckets, "block"), "vectors", buckets, "block", ordered=True)
    sums, drift, states, scanned = np.zeros((len(centroids), dims + 1), object), None, None, []
    met = blocks
    for n in range(rounds):
        before = states
        states = bucketed_table(_step(met, centroids, drift), f"bounds_{n}", buckets, "block", ordered=True)
        if before:
            dropped(spark, *before[1:])
        met = blocks.join(states[0].drop("moved"), "block")
        told = {r["pos"]: int(r["v"]) for r in states[0].select(F.posexplode("moved").alias("pos", "v")).groupBy("pos").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
        for at in range(sums.size):
            sums.flat[at] += told.get(at, 0)
        scanned.append(told.get(sums.size, 0))
        new = [[int(s) // int(of[dims]) for s in of[:dims]] if of[dims] else old for of, old in zip(sums, centroids, strict=True)]
        drift = [float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) ** 0.5 * (1 + SLACK) for x, y in zip(new, centroids, strict=True)]
        centroids = new
    found = materialise(_ended(met, centroids, drift), "clustered")
    scanned.append(found.agg(F.sum("scanned")).first()[0])
    for held in ([states] if states else []) + [(None, table, path)]:
        dropped(spark, *held[1:])
    return Clusters(found.drop("scanned"), centroids, scanned)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_find_library(spark)
    found = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = {r["cluster"]: r["total"] for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of = [F.lit(min(int(inertia.get(j, 0)), 2**63 - 1)).cast("long") for j in range(len(digests))]
    pick = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    if not digests:
        return found.rows.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    total = F.lit(min(int(sum(inertia.values())), 2**63 - 1)).cast("long")
    return found.rows.select("vec_id", "cluster", "distance", pick(of).alias("cluster_inertia"), total.alias("inertia"), pick([F.lit(d) for d in digests]).alias("centroid_sha256"))


def _sql() -> str:
    """Every round spelled out: all distances, least first, then number; sums and floor quotients in integers."""
    rounds = []
    for n in range(ROUNDS + 1):
        rounds.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, row_no, ints, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.row_no, v.ints, k.c, list_sum(list_transform(list_zip(v.ints, k.ints), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v, k{n} k) GROUP BY vec_id, row_no, ints)""")
        if n < ROUNDS:
            rounds.append(f"""s{n} AS (SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(ints) AS x, unnest(range({DIMS})) AS pos FROM a{n}) GROUP BY c, pos),
k{n + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.ints, k.ints) AS ints FROM k{n} k LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS ints FROM s{n} GROUP BY c) m USING (c))""")
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, ints) - 1 AS c, ints FROM (SELECT sha256('3:' || vec_id) AS h, ints FROM v ORDER BY h, ints LIMIT {CLUSTERS})),
{", ".join(rounds)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.ints, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN k{ROUNDS} k ON a.c = k.c"""


ORACLE_SQL = _sql()
