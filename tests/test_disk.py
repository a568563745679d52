"""What a store and a batch of searches write and shuffle: bounded, with the same rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import fusion, keyword
from quillgraph.plans import refresh
from quillgraph.sources import embedder, snapshot
from quillgraph.sources.snapshot import Meta, Store
from quillgraph.workers import workers_find_library

WORDS = ["alpha", "beta", "gamma", "delta", "foo", "bar", "rare", "of_the"]


def _docs(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(f"u{i:03d}", i, t := " ".join(r.choice(WORDS) for _ in range(r.randrange(9))), t, str(hash(t))) for i in range(n)]
    return spark.createDataFrame(rows, "uid string, ordinal long, text string, embed_input string, content_hash string")


def test_postings_are_ordered_in_passes(spark, tmp_path, monkeypatch):
    """Several passes, each a range of terms: the same postings as one, no term in two passes' ranges."""
    workers_find_library(spark)
    docs = _docs(spark, 60)
    for name, size in (("one", 1 << 30), ("many", 1)):
        monkeypatch.setattr(snapshot, "PASS_BYTES", size)
        Store(str(tmp_path / name), ("text",)).write(spark, docs, Meta("g", "none", 0, "", 0))
    of = lambda name: Store(str(tmp_path / name), ("text",)).index(spark)
    rows = lambda name: sorted(map(tuple, of(name).postings.select("term", "uid", "col", "tf").collect()))
    assert rows("one") == rows("many") == sorted(map(tuple, of("many").counts.select("term", "uid", "col", "tf").collect())) and rows("one")
    ends = of("many").blocks.withColumn("file", F.input_file_name()).where("term is not null").groupBy("file").agg(F.min("term").alias("a"), F.max("term").alias("b")).orderBy("a", "b").collect()
    assert len(ends) > 4 and all(x.b <= y.a for x, y in zip(ends, ends[1:], strict=False))


def test_best_of_a_batch_are_those_of_all_scores(spark, monkeypatch):
    """In groups of a few rows, with ties, phrases, repeated words and words that nothing has."""
    workers_find_library(spark)
    monkeypatch.setattr(keyword, "FOUND", 40)
    monkeypatch.setattr(keyword, "ASKED", 4)
    index = keyword.keyword_index(_docs(spark, 50), ["text"])
    asked = spark.createDataFrame(list(enumerate(["alpha", "alpha beta rare", "foo foo bar", "of_the", "none", "delta none"])), "qid long, query string")
    want = fusion.ranked(keyword.bm25(index, asked, {"text": 1.0}), 5).collect()
    best = keyword.bm25_best(index, asked, {"text": 1.0}, 5)
    got = fusion.ranked(best, 5).collect()
    shown = lambda rows: sorted((x.qid, x["rank"], x.uid, round(x.score, 9)) for x in rows)
    assert shown(got) == shown(want) and len(want) == 25


def test_a_batch_passes_on_its_best_alone(spark, monkeypatch):
    """However many parts the records fall into, no more than ``limit`` rows of a query leave the tasks that add up its scores."""
    workers_find_library(spark)
    monkeypatch.setattr(keyword, "FOUND", 40)
    index = keyword.keyword_index(_docs(spark, 200), ["text"])
    asked = spark.createDataFrame(list(enumerate(["alpha", "alpha beta rare", "foo foo bar", "of_the"])), "qid long, query string")
    best = keyword.bm25_best(index, asked, {"text": 1.0}, 5).groupBy("qid").count().collect()
    assert {x["count"] for x in best} == {5} and len(best) == 4


@pytest.mark.parametrize("docs", ["alpha beta of the", "Älpha BETA été of_the, naïve x", ""])
def test_an_index_of_asked_terms_scores_as_a_whole_one(spark, docs):
    """Accents, phrases, repeated words, records without a token; terms that nothing asks for are not kept."""
    workers_find_library(spark)
    rows = _docs(spark, 50).unionByName(_docs(spark, 1).withColumn("uid", F.lit("x")).withColumn("ordinal", F.lit(99).cast("long")).withColumn("text", F.lit(docs)))
    asked = spark.createDataFrame(list(enumerate(["alpha", "alpha été rare", "foo foo naïve", "of_the", "none", ""])), "qid long, query string")
    whole, index = keyword.keyword_index(rows, ["text"]), keyword.asked_index(rows, ["text"], asked)
    assert (index.n_docs, index.total_len) == (whole.n_docs, whole.total_len)
    assert index.blocks.where("term in ('beta', 'delta', 'gamma')").count() < whole.counts.where("term in ('beta', 'delta', 'gamma')").count()
    shown = lambda of: sorted((x.qid, x.uid, x.ordinal, round(x.score, 9)) for x in keyword.bm25_best(of, asked, {"text": 1.0}, 7).collect())
    assert shown(index) == shown(whole) and len(shown(index)) > 20


def test_a_batch_builds_no_store(spark, monkeypatch):
    """Without a stored index the batch search reads the terms it asks for; with one, it reads that. The same rows."""
    from quillgraph import registry
    from quillgraph.sources import corpora

    rows = lambda: sorted(map(tuple, registry.QUERIES["batch_search"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(corpora, "_stores", {})
    direct = rows()
    assert not corpora._stores and direct
    corpora.document_store(spark, "/root/testdata/sf0.001")
    assert rows() == direct


def test_a_refresh_writes_changed_records_alone(spark, tmp_path, monkeypatch):
    """A build makes no copy of its records; a refresh keeps texts of changed ones only, and deletes what it kept."""
    workers_find_library(spark)
    kept, real, gone = [], refresh.checkpointed, []
    monkeypatch.setattr(refresh, "checkpointed", lambda df: kept.append(real(df)) or kept[-1])
    monkeypatch.setattr(refresh, "released", lambda *dfs: gone.append([df.count() for df in dfs] + [dfs[0].where("text is not null").count()]))
    store, hashing, docs = Store(str(tmp_path / "s"), ("text",)), embedder.HashEmbedder(4), _docs(spark, 40)
    with pytest.raises(ValueError, match="more than once"):
        refresh.build(spark, store, docs.unionByName(docs), hashing, "g")
    assert not kept and not [x for x in (tmp_path / "s").iterdir() if x.name != "_snapshots"]
    refresh.build(spark, store, docs, hashing, "g")
    later = docs.where("ordinal >= 5").withColumn("content_hash", F.when(F.col("ordinal") < 8, F.lit("new")).otherwise(F.col("content_hash")))
    counts = refresh.refresh(spark, store, later, hashing)
    assert counts == {"embedded": 3, "deleted": 5, "unchanged": 32, "record_count": 35} and gone == [[35, 5, 3]]
    assert store.index(spark).counts.select("uid").distinct().count() == store.index(spark).lengths.where("dl > 0").count()
