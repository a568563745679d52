"""The store: skipped blocks and groups, split terms, tiers of segments, the commit protocol and look-ups."""

from __future__ import annotations

import math
import os
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import fusion, keyword, vector
from quillgraph.sources import snapshot
from quillgraph.sources.snapshot import ConflictError, Meta, Store, merged_from, tier
from quillgraph.workers import workers_find_library

META = Meta("g", "m", 4, "", 0)
KIND = "uid string, ordinal long, text string, title string, embedding array<float>"


def _frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def _words(n, seed=1):
    """Records of which all have ``the``, many a common word, and few a rare one; lengths and repeats differ much."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = "the " * r.randint(1, 5) + "common " * (r.random() < 0.5) + f"w{r.randint(0, 40)} " * r.randint(1, 3) + "filler " * r.randint(0, 60)
        if i % 97 == 0:
            text += " rare" * r.randint(1, 6)
        rows.append((f"u{i:05}", i, text, "rare title" if i % 331 == 0 else "title", [float(x) for x in np.random.default_rng(i).normal(size=4)]))
    return rows


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """3,000 records in blocks of 32, eight files of postings."""
    workers_find_library(spark)
    patch = pytest.MonkeyPatch()
    patch.setattr(keyword, "BLOCK", 32)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    store = Store(str(tmp_path_factory.mktemp("big")), ("text", "title"))
    store.write(spark, _frame(spark, _words(3000)), META)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    yield store
    patch.undo()


WEIGHTS = {"text": 1.0, "title": 4.0}


def _top(scored, n):
    return [(r.uid, round(r.score, 9)) for r in fusion.ranked(scored, n).orderBy("rank").collect()]


@pytest.mark.parametrize("words", ["rare", "the rare", "rare common w7 the the", "the", "nothing", "rare nothing the"])
def test_pruned_search_has_the_same_best(spark, big, words):
    index = big.index(spark)
    whole, best = keyword.bm25_of(index, [(0, words)], WEIGHTS), keyword.bm25_of(index, [(0, words)], WEIGHTS, 20)
    assert _top(best, 20) == _top(whole, 20)


def test_blocks_are_skipped(spark, big):
    """Of two words, one in every record and one in few, some blocks are read; of none more than its scalar columns."""
    index = big.index(spark)
    blocks = index.blocks.where(F.col("term").isin(["the", "rare"]))
    kept, asked = keyword.surviving(index, blocks, {(0, "the"): 1, (0, "rare"): 1}, WEIGHTS, 10)
    size = lambda b: b.agg(F.sum(F.size("slot"))).first()[0]
    assert size(kept) < 0.5 * size(blocks)
    bounds = keyword.block_bounds(index, blocks, asked, WEIGHTS)
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan and "slot" not in plan and "uid" not in plan and "PushedFilters: [In(term" in plan.replace("[IsNotNull(term), ", "[")
    least = {(r.segment, r.block): r.bound for r in bounds.collect()}
    exact = keyword._exact(index, blocks, asked, WEIGHTS).join(index.blocks.where("term is null").select("segment", "block", F.explode("uid").alias("uid")), "uid").collect()
    assert len(exact) == 3000 and all(r.score <= least[r.segment, r.block] + 1e-9 for r in exact)


def test_search_reads_no_positions_and_shuffles_no_records(spark, big):
    """A block's records meet its surviving rows of terms by a broadcast of these, and entries are made after that."""
    plan = keyword.bm25_of(big.index(spark), [(0, "rare common")], WEIGHTS, 10)._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan and "/records" not in plan


def test_a_term_in_every_record_is_in_all_files(spark, big):
    """Its blocks are ranged by (term, block), and no file has much more than its share."""
    index = big.index(spark)
    the = index.blocks.where("term = 'the'").withColumn("file", F.input_file_name()).groupBy("file").agg(F.sum("n").alias("n")).collect()
    every = index.blocks.withColumn("file", F.input_file_name()).select("file").distinct().count()
    assert every == 8 and sum(r.n for r in the) == 3000
    many = Store(big.path + "-hot", ("text",))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    many.write(spark, _frame(spark, [(f"u{i:05}", i, "the", "", None) for i in range(3000)]), META)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    files = many.index(spark).blocks.where("term = 'the'").withColumn("file", F.input_file_name()).groupBy("file").agg(F.sum("n").alias("n")).collect()
    assert len(files) >= 4 and max(r.n for r in files) <= 1500
    assert many.index(spark).terms.collect()[0].df == 3000


def test_lookup_is_pushed_down(spark, big):
    found = big.records_of(spark, ["u00007", "u02999", "none"])
    assert sorted(r.uid for r in found.collect()) == ["u00007", "u02999"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(uid" in plan.replace("[IsNotNull(uid), ", "[") and "Exchange" not in plan


def test_nearest_reads_a_part(spark, tmp_path):
    """Vectors around some directions: the nearest are those of brute force, ties and zeros too, and most groups are not read."""
    workers_find_library(spark)
    r = np.random.default_rng(2)
    spots = r.normal(size=(12, 16))
    m = spots[r.integers(0, 12, 1500)] + r.normal(scale=0.1, size=(1500, 16))
    rows = [(f"v{i:04}", i, "", "", x.tolist()) for i, x in enumerate(m.astype(np.float32))] + [(f"z{i}", 5000 + i, "", "", [0.0] * 16) for i in range(3)] + [("none", 9000, "", "", None), ("same", 9001, "", "", m.astype(np.float32)[7].tolist())]
    store = Store(str(tmp_path / "s"), ("text",))
    store.write(spark, _frame(spark, rows), META)
    index, whole = store.vector_index(spark), store.vectors(spark)
    for asked in (m[7].tolist(), (-spots[0]).tolist(), [0.0] * 16, spots[3].tolist()):
        for n in (1, 40):
            got = [(x.uid, round(x.score, 9)) for x in index.nearest(asked, n).collect()]
            assert got == [(x.uid, round(x.score, 9)) for x in vector.neighbours(whole, asked, n).collect()]
    share = index.candidates(spots[3].tolist(), 20).count() / 1504
    assert share < 0.4
    assert len(index.nearest(spots[3].tolist(), 2000).collect()) == 1504  # more than there are


def test_running_best_is_bounded():
    r = np.random.default_rng(1)
    asked, m = r.normal(size=(7, 5)), r.normal(size=(3000, 5))
    m[100:200] = m[5]  # ties go by ordinal
    order = r.permutation(3000)
    best = vector.RunningBest(asked, 10)
    for at in range(0, 3000, 128):
        best.add(m[at : at + 128], order[at : at + 128], at)
        assert best.score.shape[1] <= 10
    scores = (asked @ m.T) / (np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :] + 1e-12)
    query, row, _ = best.rows()
    for q in range(7):
        assert row[query == q].tolist() == np.lexsort((order, -np.round(scores[q], 9)))[:10].tolist()


def test_joined_neighbours_in_many_groups(spark, monkeypatch):
    workers_find_library(spark)
    monkeypatch.setattr(vector, "PART", 60)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector, "SLICE", 16)
    m = np.random.default_rng(3).normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(m)], "uid long, ordinal long, embedding array<float>")
    asked = df.where("uid % 20 = 0").select(F.col("uid").alias("qid"), "embedding")
    got = {(r.qid, r["rank"]): r.uid for r in fusion.ranked(vector.joined_neighbours(df, asked, 3), 3).collect()}
    want = {(q, k + 1): r.uid for q in range(0, 300, 20) for k, r in enumerate(vector.neighbours(df, m[q].tolist(), 3).collect())}
    assert got == want


# -- tiers


def test_tiers_rewrite_a_record_a_few_times():
    """Over n small refreshes, records written grow as n log n, and segments as log n."""
    for n in (64, 1000, 4096):
        sizes, written = (100 * n,), 0
        for _ in range(n):
            sizes += (1,)
            written += 1
            at = merged_from(sizes)
            if at is not None:
                written += sum(sizes[at:])
                sizes = (*sizes[:at], sum(sizes[at:]))
        assert written <= n * (2 + math.log(n, 4))
        assert len(sizes) <= 2 + 3 * (1 + math.log(n, 4))
    assert merged_from((1000, 5)) is None and merged_from((1000, 1, 1, 1, 1)) == 1 and merged_from((0, 0, 0, 0)) == 0
    assert [tier(x) for x in (0, 1, 3, 4, 15, 16)] == [0, 0, 0, 1, 1, 2]


def _record(i, text):
    return (f"u{i:03}", i, text, "", [float(i), 1.0])


def test_merging_tokenises_nothing(spark, tmp_path, monkeypatch):
    """Four small changes are merged; the first segment is not rewritten, and what is merged is not tokenised again."""
    workers_find_library(spark)
    store = Store(str(tmp_path / "s"), ("text",))
    store.write(spark, _frame(spark, [_record(i, f"base word{i % 5}") for i in range(40)]), META)
    first = store.snapshot(spark).segments[0]
    calls, real = [], keyword.tokenised
    monkeypatch.setattr(keyword, "tokenised", lambda *a, **k: calls.append(1) or real(*a, **k))
    gone = spark.createDataFrame([], "uid string")
    for n in range(4):
        store.change(spark, store.snapshot(spark), _frame(spark, [_record(n, f"changed word{n} again")]), gone, META)
        assert len(calls) == 2 * (n + 1)  # what is put and what it takes out; nothing in the merge
    of = store.snapshot(spark)
    assert of.segments[0] == first and of.sizes == (40, 4)
    fresh = Store(str(tmp_path / "f"), ("text",))
    fresh.write(spark, store.records(spark), META)
    for words in ("changed word1", "changed again base"):
        assert _top(keyword.bm25_of(store.index(spark), [(0, words)], {"text": 1.0}, 5), 5) == _top(keyword.bm25_of(fresh.index(spark), [(0, words)], {"text": 1.0}, 5), 5)


# -- snapshots


def _small(spark, path, **kw):
    store = Store(str(path), ("text",), **kw)
    store.write(spark, _frame(spark, [_record(i, f"text {i}") for i in range(5)]), META)
    return store


def _texts(frame):
    return sorted(r.text for r in frame.collect())


def test_an_empty_newest_file_is_passed_over(spark, tmp_path):
    workers_find_library(spark)
    store = _small(spark, tmp_path / "s")
    folder = tmp_path / "s" / "_snapshots"
    (folder / "0000000001").write_text("")
    (folder / "0000000002").write_text('{"segments": ["x"')
    assert store.snapshot(spark).number == 0 and len(_texts(store.records(spark))) == 5
    store.touch(spark, store.snapshot(spark), META)  # and it is not in the way for ever
    assert store.snapshot(spark).number == 3 and len(_texts(store.records(spark))) == 5


def test_what_a_crashed_writer_left_goes_in_time(spark, tmp_path):
    workers_find_library(spark)
    store = _small(spark, tmp_path / "s")
    left, aside = tmp_path / "s" / "deadbeef", tmp_path / "s" / "_snapshots" / "_cafe"
    left.mkdir()
    (left / "part").write_text("x")
    aside.write_text("{")
    store.touch(spark, store.snapshot(spark), META)
    assert left.exists() and aside.exists() and store.snapshot(spark).number == 1
    old = time.time() - 90000
    for p in (left, aside):
        os.utime(p, (old, old))
    store.touch(spark, store.snapshot(spark), META)
    assert not left.exists() and not aside.exists() and len(_texts(store.records(spark))) == 5


def test_of_two_writers_one_fails(spark, tmp_path):
    workers_find_library(spark)
    store = _small(spark, tmp_path / "s")
    of, outcome = store.snapshot(spark), []
    gate = threading.Barrier(6)

    def write(n):
        gate.wait()
        try:
            store.touch(spark, of, Meta(f"writer{n}", "m", 4, "", 5))
            outcome.append(n)
        except ConflictError:
            outcome.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [n for n in outcome if n is not None]
    assert len(outcome) == 6 and len(winners) == 1
    assert store.snapshot(spark).meta.graph_name == f"writer{winners[0]}" and store.snapshot(spark).number == 1
    with pytest.raises(ConflictError):
        store.touch(spark, of, META)


def test_a_failure_that_is_no_conflict_is_told(spark, tmp_path, monkeypatch):
    workers_find_library(spark)
    store = _small(spark, tmp_path / "s")

    def refused(*_):
        raise PermissionError("no right")

    monkeypatch.setattr(snapshot.os, "link", refused)
    with pytest.raises(PermissionError):
        store.touch(spark, store.snapshot(spark), META)


def test_a_slow_reader_keeps_its_snapshot(spark, tmp_path):
    """Frames opened before changes, a merge and a rebuild read what they read; without retention old segments go."""
    workers_find_library(spark)
    store = _small(spark, tmp_path / "s")
    slow, want = store.records(spark), [f"text {i}" for i in range(5)]
    gone = spark.createDataFrame([("u000",)], "uid string")
    for n in range(4):
        store.change(spark, store.snapshot(spark), _frame(spark, [_record(10 + n, "new")]), gone, META)
    store.write(spark, _frame(spark, [_record(1, "whole")]), META)
    assert _texts(slow) == want and _texts(store.records(spark)) == ["whole"]
    hasty = Store(store.path, ("text",), retention=-1)
    hasty.touch(spark, hasty.snapshot(spark), META)
    assert len([p for p in (tmp_path / "s").iterdir() if p.name != "_snapshots"]) == 1
    assert len([p for p in (tmp_path / "s" / "_snapshots").iterdir() if not p.name.startswith(".")]) == 1
    assert _texts(hasty.records(spark)) == ["whole"]
