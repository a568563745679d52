"""Mixing, the manifest and centroids on small tables with nulls, ties, repeated rows and hot keys, against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ROWS, SCHEMA, found

from quillgraph.llm import centroids, common, manifest, mixing


@pytest.fixture(scope="module")
def docs(spark):
    common.workers_find_library(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [x[:5] for x in ROWS])
    return c


def sql(duck, text, *columns):
    got = duck.execute(text)
    names = [x[0] for x in got.description]
    return Counter(tuple(r[names.index(c)] for c in columns) for r in got.fetchall())


# -- mixing


def _targets(sizes, weights, epochs):
    """Clamp all that are above their cap at once, again and again, in fractions of the rest."""
    clamped: set = set()
    while True:
        free = [s for s in sizes if s not in clamped]
        rest = sum(sizes.values()) - sum(epochs * sizes[s] for s in clamped)
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return {s: share.get(s, epochs * sizes[s]) for s in sizes}
        clamped |= over


def _mix_checks(rows, got):
    """rows: (doc_id, text, source); got: (doc_id, size, source_size, target, times, source)"""
    size = lambda t: len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("")
    assert Counter((r[0], size(r[1]), r[2]) for r in rows) == Counter((r[0], r[1], r[5]) for r in got)
    sizes: Counter = Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    want = _targets(sizes, {s: 1 + k % 3 for k, s in enumerate(names)}, 3)
    taken: Counter = Counter()
    for _, z, source_size, target, times, source in got:
        assert source_size == sizes[source] and math.isclose(target, want[source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= times <= 3
        taken[source] += z * times
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(10, 0.002 * want[s]), (s, taken[s], want[s])


def test_mixing(spark, docs, duck):
    columns = ("doc_id", "size", "source_size", "target", "times")
    got = mixing.mixed(docs).cache()
    assert {"row", "h", "_fp", "score", "rest", "shard"} < set(got.columns)
    _mix_checks([(x[0], x[1], x[3]) for x in ROWS], [tuple(r) for r in got.select(*columns, "source").collect()])
    taken = got.withColumn("taken", (F.col("times") * F.col("size")).cast("long"))
    assert found(taken, "doc_id", "size", "source_size", "target", "taken") == sql(duck, mixing.ORACLE_SQL, "doc_id", "size", "source_size", "target", "taken")
    again = mixing.mixed(docs.repartition(7))
    assert found(again, "doc_id", "text", "source", "times") == found(got, "doc_id", "text", "source", "times")
    assert mixing.repeated(got).count() == sum(r["times"] for r in got.collect())
    assert mixing.mixed(docs.where("false")).count() == 0
    got.unpersist()


def test_mixing_of_hot_and_repeated_rows(spark):
    """A third of all rows repeat one row with a null id, another third has one source; ties at an edge are split."""
    r = random.Random(3)
    rows = [(None, "one two three", "hot")] * 400 + [(i, "w " * r.randint(0, 60), "big") for i in range(400)] + [(i, "x " * r.randint(1, 9), f"s{i % 7}" if i % 9 else None) for i in range(300)] + [(7, None, "none"), (8, "", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    columns = ("doc_id", "size", "source_size", "target", "times", "source")
    got = [tuple(x) for x in mixing.mixed(df).select(*columns).collect()]
    _mix_checks(rows, got)
    hot = Counter(x[4] for x in got if x[5] == "hot")
    assert abs(sum(3 * t * n for t, n in hot.items()) - next(x[3] for x in got if x[5] == "hot")) <= 3
    assert Counter(got) == Counter(tuple(x) for x in mixing.mixed(df.repartition(9, "text")).select(*columns).collect())


def test_water_filling(spark):
    r = random.Random(1)
    for sizes in ({"a": 1, "b": 1000, "c": 1}, {f"s{i:02}": 3**i for i in range(12)}, {f"s{i:02}": r.randint(0, 500) for i in range(30)}, {"a": 0, "b": 0}):
        weights = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))}
        df = spark.createDataFrame([(s, n, float(weights[s])) for s, n in sizes.items()], "s string, size long, weight double")
        got = {x["s"]: x["target"] for x in mixing.water_filled(df, 3).collect()}
        want = _targets(sizes, weights, 3)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)
        assert math.isclose(sum(got.values()), sum(sizes.values()), rel_tol=1e-9, abs_tol=1e-9)


def test_mixing_runs_no_python(spark, docs):
    plan = mixing.mixed(docs).select("doc_id", "times")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- the manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _tree(nodes, fanout):
    """(root, [(place, others) of each level] of each node), by the definition."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, node in enumerate(at):
            first = node // fanout * fanout
            run = nodes[first : first + fanout]
            ways[i].append((node - first, run[: node - first] + run[node - first + 1 :]))
            at[i] = node // fanout
        nodes = [H(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], ways


def _manifest(rows, fanout=2):
    null_first = lambda v: (v is not None, v if v is not None else 0)
    groups: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = _leaf(doc_id, source, lang, n_chars, text)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        groups.setdefault(lang, []).append((null_first(doc_id), leaf, _leaf(doc_id, source, lang, n_chars + 1, text) if bad else leaf, doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort()
        trees[g] = _tree([x[1] for x in groups[g]], fanout)
    root, tops = _tree([trees[g][0] for g in names], fanout)
    out = Counter()
    for k, g in enumerate(names):
        for (_, leaf, claimed, doc_id), way in zip(groups[g], trees[g][1], strict=True):
            at = claimed
            for place, others in way + tops[k]:
                at = H(*others[:place], at, *others[place:])
            out[doc_id, leaf, trees[g][0], root, H(*(o for _, others in way + tops[k] for o in others)), at, at == root] += 1
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _tampered():
    return {"claimed": {"n_chars": F.col("n_chars") + 1}, "tampered": F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0}


def test_manifest(spark, docs, duck):
    got = found(manifest.manifest(docs, **_tampered()), *COLUMNS)
    assert got == _manifest([x[:5] for x in ROWS]) == sql(duck, manifest.ORACLE_SQL, *COLUMNS)
    assert manifest.manifest(docs.where("false"), **_tampered()).count() == 0
    assert found(manifest.manifest(docs.where("doc_id = 3"), **_tampered()), *COLUMNS) == _manifest([x[:5] for x in ROWS if x[0] == 3])


@pytest.mark.parametrize(("fanout", "block"), [(2, 4), (3, 9), (5, 8), (2, 2)])
def test_manifest_over_many_blocks_and_passes(spark, monkeypatch, fanout, block):
    """Blocks of a few leaves make several passes, with groups that fill blocks, exceed them by one, or are one leaf alone."""
    monkeypatch.setattr(manifest, "BLOCK", block)
    sizes = {"aa": 1, "b": 2, "é": 3, "日": 4, "c": 5, None: 8, "d": 9, "e": 16, "f": 17, "g": 33, "h": 81}
    rows = [(100 * k + i, f"t{i}" if i % 4 else None, g, f"s{i % 3}", i if i % 5 else None) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(manifest.manifest(df, fanout=fanout, **_tampered()), *COLUMNS) == _manifest(rows, fanout)


def test_manifest_paths_lead_to_the_root(spark, docs):
    rows = manifest.manifest(docs, paths=True).collect()
    for r in rows:
        assert manifest.folded(r.leaf.encode(), r.places, [bytes(o) for o in r.others]).decode() == r.root and r.verified


# -- centroids


def _brute(rows, k, rounds, dims, seed="3"):
    keep = [(i, [max(-(2**62), min(2**62, math.floor(1024 * float(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(keep, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in keep]
        for j in range(len(c)):
            some = [v for (_, v), o in zip(keep, of, strict=True) if o == j]
            if some:
                c[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    return c, Counter((i, near(v)[1], min(near(v)[0], 2**63 - 1)) for i, v in keep)


def _vectors(dims, n, scale=1.0):
    r = np.random.default_rng(4)
    spots = r.normal(size=(5, dims))
    return [(i, [float(np.float32(x)) for x in scale * (spots[i % 5] + r.normal(scale=0.6, size=dims))]) for i in range(n)]


def _odd(dims):
    same = [0.25] * dims
    return [(None, same), (None, same), (900, same), (901, same), (901, same), (902, None), (903, []), (904, [1.0] * (dims - 1)), (905, [float("nan")] + same[1:]), (906, [float("inf")] + same[1:]), (907, [None] + same[1:]), (908, [-1e-9] * dims), (909, [0.0] * dims)]


@pytest.mark.parametrize(("scale", "block"), [(1.0, 50), (1e4, 4096), (1e8, 64), (1e18, 64)])
def test_centroids(spark, monkeypatch, scale, block):
    """Doubles, 64-bit integers and Python's integers give the same; blocks and buckets are many."""
    monkeypatch.setattr(centroids, "BLOCK", block)
    common.workers_find_library(spark)
    rows = _vectors(6, 240, scale) + _odd(6)
    df = spark.createDataFrame([(*x, "y") for x in rows], "vec_id long, embedding array<double>, block string").repartition(3)
    got = centroids.clustered(df, k=8, rounds=4, dims=6)
    c, want = _brute(rows, 8, 4, 6)
    assert got.centroids == c
    assert found(got.rows, "vec_id", "cluster", "distance") == want


def test_centroids_of_few_and_equal_vectors(spark):
    common.workers_find_library(spark)
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(20)], [(1, [0.0, 0.0]), (2, [4.0, 0.0]), (3, [2.0, 0.0])]):
        got = centroids.clustered(spark.createDataFrame(rows, kind), k=2, rounds=3, dims=2)
        c, want = _brute(rows, 2, 3, 2)
        assert got.centroids == c and found(got.rows, "vec_id", "cluster", "distance") == want


def test_bounds_spare_scans_and_keep_the_nearest():
    """Over rounds of drifting centroids the state's bounds hold, every nearest is exact, and most vectors are not scanned."""
    r = np.random.default_rng(0)
    c = r.integers(-4000, 4000, (8, 64))
    x = c[r.integers(0, 8, 3000)] + r.integers(-300, 300, (3000, 64))
    state, drift, scans = None, None, []
    for _ in range(6):
        *state, n = centroids.assigned(x, c, tuple(state) if state else None, drift)
        d = centroids.squared(x, c)
        assert (state[0] == d.argmin(axis=1)).all()
        near = np.sort(d, axis=1)
        assert (state[1] >= np.sqrt(near[:, 0])).all() and (state[2] <= np.sqrt(near[:, 1])).all()
        scans.append(n)
        new = c + r.integers(-20, 20, c.shape)
        drift, c = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + centroids.SLACK), new
    assert scans[0] == 3000 and max(scans[1:]) < 300


def test_rounds_shuffle_no_vectors(spark):
    """A round's join of blocks and states has no exchange."""
    common.workers_find_library(spark)
    df = spark.createDataFrame(_vectors(6, 300), "vec_id long, embedding array<double>")
    blocks, table, path = common.bucketed_table(centroids._packed(centroids.whole_vectors(df, dims=6)).repartition(8, "block"), "t_vectors", 8, "block", ordered=True)
    state = common.bucketed_table(centroids._step(blocks, [[0] * 6, [9] * 6], None), "t_bounds", 8, "block", ordered=True)
    plan = blocks.join(state[0].drop("moved").hint("merge"), "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
