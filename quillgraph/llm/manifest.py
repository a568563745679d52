"""A Merkle manifest of a dataset: blocks of leaves as contiguous matrices of hex digests, hashed level by level."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, materialise, numbered, tidy

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Nodes of a block at most: a task holds the digests of one block and the paths above it.
BLOCK = 4096
HEX = 64


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(f) for f in fields)), 256)


def matrix(digests: list[str]) -> np.ndarray:
    """(n, 64) bytes, a hex digest in a row."""
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, HEX)


def level_above(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The parents of a level: its rows reshaped by ``fanout`` and hashed; the last run may be shorter, one node even."""
    whole = len(nodes) // fanout * fanout
    rows = [row for row in nodes[:whole].reshape(-1, fanout * HEX)]
    if whole < len(nodes):
        rows.append(np.ascontiguousarray(nodes[whole:]).reshape(-1))
    return matrix([sha256(row).hexdigest() for row in rows])


def levels(nodes: np.ndarray, fanout: int, most: int | None) -> list[np.ndarray]:
    """The levels of a block, from ``nodes`` up: ``most`` of them above, or until one node is left."""
    found = [nodes]
    while len(found[-1]) > 1 if most is None else len(found) <= most:
        found.append(level_above(found[-1], fanout))
    return found


def siblings(found: list[np.ndarray], fanout: int) -> tuple[np.ndarray, list[list[bytes]]]:
    """(place in its run of each node's ancestor, for each level but the last; the others of that run, left to right)."""
    n, depth = len(found[0]), len(found) - 1
    places = np.empty((n, depth), np.int64)
    others: list[list[bytes]] = [[] for _ in range(n)]
    node = np.arange(n)
    for k in range(depth):
        level = found[k]
        places[:, k] = node % fanout
        first = node - places[:, k]
        run = np.stack([first + j + (j >= places[:, k]) for j in range(fanout - 1)], axis=1)
        there = run < len(level)
        held = level[np.where(there, run, 0)]
        for i in range(n):
            others[i].append(held[i, there[i]].tobytes())
        node = node // fanout
    return places, others


def folded(leaf: bytes, places: list[int], others: list[bytes]) -> bytes:
    """The root that a leaf, its places and the others of its runs lead to."""
    for place, rest in zip(places, others, strict=True):
        at = HEX * place
        leaf = sha256(rest[:at] + leaf + rest[at:]).hexdigest().encode()
    return leaf


def _depth(fanout: int) -> int:
    """Levels of a whole block."""
    depth = 1
    while fanout ** (depth + 1) <= BLOCK:
        depth += 1
    return depth


_BLOCK = "seq long, block long, total long, nodes array<struct<index: long, digest: string, payload: struct<doc_id: long, claimed: string>>>"
_PATHS = "seq long, index long, places array<int>, others array<binary>"


def _blocks(nodes: DataFrame, fanout: int, name: str) -> DataFrame:
    """One row for each aligned block of a sequence: nodes in order. A block has BLOCK nodes at most, whatever its sequence."""
    size = fanout ** _depth(fanout)
    of = nodes.withColumn("block", F.floor(F.col("index") / size)).groupBy("seq", "block", "total")
    return materialise(of.agg(F.array_sort(F.collect_list(F.struct("index", "digest", "payload"))).alias("nodes")), name)


def _roots(blocks: DataFrame, fanout: int) -> DataFrame:
    """The root of each block, as a node of the sequence above; the only block of a sequence ends at one node."""
    depth = _depth(fanout)
    size = fanout**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for total, nodes in zip(batch.column("total").to_pylist(), batch.column("nodes"), strict=True):
                found = levels(matrix(nodes.values.field("digest").to_pylist()), fanout, depth if total > size else None)
                tops.append(found[-1].tobytes().decode())
            totals = [-(-t // size) for t in batch.column("total").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("block"), pa.array(totals, pa.int64()), pa.array(tops, pa.string())], names=["seq", "index", "total", "digest"])

    found = blocks.select("seq", "block", "total", F.transform("nodes", lambda x: F.struct(x["digest"].alias("digest"))).alias("nodes")).mapInArrow(tidy(run), "seq long, index long, total long, digest string")
    return found.withColumn("payload", F.lit(None).cast("struct<doc_id: bigint, claimed: string>"))


def _climbed(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(the blocks of each pass, from the leaves up; the root of each sequence). A pass has a row for BLOCK rows of the one before."""
    passes = []
    while True:
        passes.append(_blocks(nodes, fanout, f"{name}-blocks-{len(passes)}"))
        nodes = materialise(_roots(passes[-1], fanout), f"{name}-roots-{len(passes)}")
        if not (nodes.agg(F.max("total")).first()[0] or 0) > 1:
            return passes, nodes


def _met(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """Blocks with the path of their root to the very top: places and others."""
    if above is None:
        none = {"places": F.array().cast("array<int>"), "others": F.array().cast("array<binary>")}
        return blocks.withColumns(none)
    return blocks.join(above.withColumnRenamed("index", "block"), ["seq", "block"])


def _descended(blocks: DataFrame, above: DataFrame | None, fanout: int) -> DataFrame:
    """seq, index, places, others of each node of the blocks: its path through its block and then on to the very top."""
    depth = _depth(fanout)
    size = fanout**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places, others = siblings(levels(matrix([x["digest"] for x in row["nodes"]]), fanout, depth if row["total"] > size else None), fanout)
                n = len(row["nodes"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["seq"]] * n, pa.int64()), pa.array([x["index"] for x in row["nodes"]], pa.int64()), pa.array([[*p, *row["places"]] for p in places.tolist()], pa.list_(pa.int32())), pa.array([[*o, *row["others"]] for o in others], pa.list_(pa.binary()))],
                    names=["seq", "index", "places", "others"],
                )

    return _met(blocks, above).mapInArrow(tidy(run), _PATHS)


def _proved(blocks: DataFrame, above: DataFrame, subroots: DataFrame, root: str, fanout: int, paths: bool) -> DataFrame:
    depth = _depth(fanout)
    size = fanout**depth
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", places array<int>, others array<binary>" if paths else "")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["places", "others"] if paths else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = row["nodes"]
                places, others = siblings(levels(matrix([x["digest"] for x in nodes]), fanout, depth if row["total"] > size else None), fanout)
                upper = b"".join(row["others"])
                proofs = [sha256(b"".join(o) + upper).hexdigest() for o in others]
                ways = [([*p, *row["places"]], [*o, *row["others"]]) for p, o in zip(places.tolist(), others, strict=True)]
                roots = [folded((x["payload"]["claimed"] or x["digest"]).encode(), *w).decode() for x, w in zip(nodes, ways, strict=True)]
                n = len(nodes)
                columns = [
                    pa.array([x["payload"]["doc_id"] for x in nodes], pa.int64()), pa.array([x["digest"] for x in nodes]), pa.array([row["subroot"]] * n), pa.array([root] * n),
                    pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots]),
                ]
                if paths:
                    columns += [pa.array([p for p, _ in ways], pa.list_(pa.int32())), pa.array([o for _, o in ways], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _met(blocks, above).join(subroots, "seq").mapInArrow(tidy(run), schema)


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, claimed: dict[str, Column] | None = None, tampered: Column | None = None, group: str = "lang", fanout: int = FANOUT, paths: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; with ``paths`` also its proof: the place
    in its run at each level (places), and the other digests of that run (others, hex, joined).

    A leaf is the digest of its ``fields``. Leaves of a ``group`` are in order of doc_id, null first, ties in order of the
    leaf; groups are in order of UTF-8 bytes, null first. A row is proved with what it claims to be now: ``claimed`` replaces
    fields of rows that are ``tampered``, and folded_root is what that leaf and the original siblings lead to.

    Leaves get their place by a sort in ranges and are put in aligned blocks of at most BLOCK; a block's levels are matrices, and a
    block's root is a node of the pass above, which has as many rows fewer. Down again each block gets the path of its
    root. So a group of any size is spread over blocks, a text is read once by one digest (twice if it is tampered with), and only the
    root and one count a pass reach the driver.

    Nulls are leaves' values; an empty text and a null one differ. Repeated rows are leaves of their own, with equal digests.
    Other columns are not read; an empty table gives no rows.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    claims = [(claimed or {}).get(c, column(c)) for c in fields]
    other = F.when(tampered, leaf_digest(claims)) if tampered is not None else F.lit(None).cast("string")
    leaves = df.select(column("doc_id").cast("long").alias("doc_id"), column(group).cast("string").alias("_group"), leaf_digest([column(c) for c in fields]).alias("digest"), other.alias("claimed"))
    placed = numbered(materialise(leaves, "manifest-leaves"), ["_group"], [F.col("doc_id").asc_nulls_first(), F.col("digest")], "manifest-order")
    groups = materialise(placed.groupBy("_group").agg(F.count("*").alias("total")), "manifest-groups")
    ranks = numbered(groups, [], [F.col("_group").asc_nulls_first()], "manifest-ranks").select(F.col("_group").alias("_of"), "total", F.col("index").alias("seq"))
    nodes = placed.join(ranks, F.col("_group").eqNullSafe(F.col("_of"))).select("seq", "index", "total", "digest", F.struct("doc_id", "claimed").alias("payload"))
    passes, subroots = _climbed(nodes, fanout, "manifest")
    count = groups.count()
    tops = subroots.select(F.lit(0).cast("long").alias("seq"), F.col("seq").alias("index"), F.lit(count).cast("long").alias("total"), "digest", "payload")
    upper, roots = _climbed(tops, fanout, "manifest-top")
    root = (roots.first() or {"digest": ""})["digest"]
    above = None
    for blocks in reversed(upper):
        above = materialise(_descended(blocks, above, fanout), "manifest-paths")
    above = above.select(F.col("index").alias("seq"), F.lit(0).cast("long").alias("index"), "places", "others")
    for blocks in reversed(passes[1:]):
        above = materialise(_descended(blocks, above, fanout), "manifest-paths")
    return _proved(passes[0], above, subroots.select("seq", F.col("digest").alias("subroot")), root, fanout, paths)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(documents(spark, sf_dir), claimed={"n_chars": F.col("n_chars") + 1}, tampered=tampered)


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _bit(x: str) -> str:
    return f"(CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END)"


#: A level's nodes are hashed in pairs of neighbours until one is left; crc32 by its definition, a bit at a time.
ORACLE_SQL = f"""WITH RECURSIVE bits AS (SELECT b AS byte, b AS crc, 0 AS step FROM range(256) t(b) UNION ALL SELECT byte, {_bit("crc")}, step + 1 FROM bits WHERE step < 8),
crcs AS MATERIALIZED (SELECT byte, crc AS entry FROM bits WHERE step = 8),
digits AS (SELECT doc_id, doc_id::VARCHAR AS shown, 0 AS pos, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) UNION ALL
  SELECT doc_id, shown, pos + 1, xor(entry, crc >> 8) FROM digits JOIN crcs ON byte = xor(crc & 255, ascii(shown[pos + 1])) WHERE pos < length(shown)),
odd AS MATERIALIZED (SELECT doc_id FROM digits WHERE pos = length(shown) AND xor(crc, 4294967295) % 7 = 0),
leaf AS MATERIALIZED (SELECT doc_id, lang, sha256(concat({", ".join(_field(c) for c in FIELDS)})) AS leaf,
  sha256(concat({", ".join(_field(c) for c in FIELDS).replace("n_chars", "(n_chars + CASE WHEN doc_id IN (SELECT doc_id FROM odd) THEN 1 ELSE 0 END)")})) AS claimed FROM documents),
node AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
tree AS (SELECT lang, 0 AS lvl, idx, n, leaf AS digest FROM node UNION ALL
  SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(digest || coalesce(beside, '')) FROM (SELECT *, lead(digest) OVER (PARTITION BY lang ORDER BY idx) AS beside FROM tree WHERE n > 1) WHERE idx % 2 = 0),
held AS MATERIALIZED (SELECT * FROM tree),
top AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n, lvl, digest FROM held WHERE n = 1),
crown AS (SELECT 0 AS lvl, place AS idx, n, digest FROM top UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(digest || coalesce(beside, '')) FROM (SELECT *, lead(digest) OVER (ORDER BY idx) AS beside FROM crown WHERE n > 1) WHERE idx % 2 = 0),
crowns AS MATERIALIZED (SELECT * FROM crown),
way AS (SELECT node.lang, node.idx AS leaf_no, 0 AS lvl, node.idx AS pos, node.n, false AS up, '' AS proof, claimed AS digest, place, top.n AS groups, top.digest AS subroot FROM node JOIN top ON node.lang IS NOT DISTINCT FROM top.lang UNION ALL
  SELECT way.lang, leaf_no, CASE WHEN way.n > 1 OR up THEN way.lvl + 1 ELSE 0 END, CASE WHEN way.n > 1 OR up THEN pos // 2 ELSE place END, CASE WHEN way.n > 1 OR up THEN (way.n + 1) // 2 ELSE groups END, up OR way.n = 1,
    proof || coalesce(h.digest, c.digest, ''), CASE WHEN way.n = 1 THEN way.digest WHEN pos % 2 = 0 THEN sha256(way.digest || coalesce(h.digest, c.digest, '')) ELSE sha256(coalesce(h.digest, c.digest) || way.digest) END, place, groups, subroot
  FROM way LEFT JOIN held h ON NOT up AND way.n > 1 AND h.lang IS NOT DISTINCT FROM way.lang AND h.lvl = way.lvl AND h.idx = xor(pos, 1) LEFT JOIN crowns c ON up AND c.lvl = way.lvl AND c.idx = xor(pos, 1) WHERE way.n > 1 OR NOT up),
root AS (SELECT digest AS root FROM crowns WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified FROM way JOIN node ON way.lang IS NOT DISTINCT FROM node.lang AND leaf_no = idx, root WHERE up AND way.n = 1"""
