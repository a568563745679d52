"""The outline engine on hand-made graphs, a naive walk, and SQLite's own BM25."""

from __future__ import annotations

import json
import random
import re
import sqlite3
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quillgraph import catalog, cli, server, tools
from quillgraph.functions import markup, tokens
from quillgraph.operators import fusion, keyword, outline, vector
from quillgraph.plans import records, refresh, search
from quillgraph.schema import COLUMN_WEIGHTS, ENTITY
from quillgraph.sources import embedder, entities
from quillgraph.sources.pull import pulled_entities
from quillgraph.sources.snapshot import ConflictError, Meta, Store
from quillgraph.streaming.refresh_stream import refresh_on_arrival
from quillgraph.workers import workers_find_library

CLEAN = [
    ("notes on [[Rivers of [[Peru]] basin]] today", "notes on Rivers of Peru basin today"), ("C#sharp and #[[two words]] #a-b", "Csharp and two words a-b"), ("#c:blue-2 urgent {{[[DONE]]}} ship it", "urgent ship it"), ("{{[[kanban]]}}", ""),
    ("![map](http://h/a(1).png) [spec](http://h/b)", "map spec"), ("owner:: [[Ana]]", "owner: Ana"), ("```sql\nselect 1\n```", "select 1"), ("go to http://h/p#frag", "go to http://h/pfrag"), ("__init__ **x** `y`", "init x y"),
    ("{{widget ((abcdefghi))}} left", "left"), ("#été", "été"), ("see ((abcdefghi)) and ((zzzzzzzzz)).", "see REF and ."), ("{{[[embed]]: ((abcdefghi))}}", "REF"), ("a\x1c  b", "a b"), ("", ""),
]
NAMES = [("see [[[[A]] B]] [[C]]", ["A", "A B", "C"]), ("#x then [[Y]]", ["Y", "x"]), ("k:: [[Z]] #Z", ["Z"]), ("none", []), ("#c:red [[]] [[A]] #A", ["A"])]


def test_plain_text_and_names(spark):
    df = spark.createDataFrame(CLEAN, "raw string, want string").withColumn("m", F.create_map(F.lit("abcdefghi"), F.lit("REF")))
    assert [r for r in df.select("raw", "want", markup.plain_text(F.col("raw"), F.col("m")).alias("got")).collect() if r.got != r.want] == []
    df = spark.createDataFrame(NAMES, "raw string, want array<string>")
    assert [r for r in df.select("raw", "want", markup.page_names(F.col("raw")).alias("got")).collect() if r.got != r.want] == []


def _unwrap(text):
    """(text, names): one innermost reference at a time, from the left, until none is left."""
    names = []
    while m := re.search(r"\[\[([^\[\]]*)\]\]", text):
        names.append(m[1])
        text = text[: m.start()] + m[1] + text[m.end() :]
    return text, names


def test_brackets_of_any_shape(spark):
    """Random runs of brackets and letters: what one reference at a time gives, and names in the order in which they close."""
    r = random.Random(8)
    odd = ["[[[]][a]]", "[[a][[]]]", "[[[a]]]", "[[[[a]] b]] [[c]]", "[[a [b] c]]", "]][[x]][["] + ["".join(r.choice(["[[", "]]", "[", "]", "a", "b ", "c"]) for _ in range(r.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in odd], "t string").select("t", markup.unwrapped(F.col("t")).alias("u"), markup.page_names(F.col("t")).alias("n"), markup.plain_text(F.col("t")).alias("p"))
    for x in df.collect():
        text, names = _unwrap(x.t)
        assert x.u == text, x.t
        assert x.n == list(dict.fromkeys(n for n in (" ".join(n.split()) for n in names) if n)), x.t


def test_many_references_take_time_in_proportion(spark):
    took = []
    for n in (10_000, 80_000):
        df = spark.createDataFrame([("[[ab]] c " * n,)], "t string")
        began = time.time()
        row = df.select(F.length(markup.unwrapped(F.col("t"))).alias("u"), F.size(markup.page_names(F.col("t"))).alias("n"), F.length(markup.plain_text(F.col("t"))).alias("p")).first()
        took.append(time.time() - began)
        assert (row.u, row.n, row.p) == (5 * n, 1, 5 * n - 1)
    assert took[1] < 20 * max(took[0], 0.2)  # eight times the text


def _graph(spark, rows):
    full = []
    for n, r in enumerate(rows):
        r = {"parents": [], "children": [], "order": 0, "time": None, "edit_time": None, "string": None, "title": None, "page_id": None} | r
        full.append(tuple(r.get(c) for c in ENTITY.fieldNames()[:-1]) + (n,))
    return spark.createDataFrame(full, ENTITY)


GRAPH = [
    {"id": 1, "uid": "page00001", "title": "The [[Big]] Page", "children": [3, 2, 99], "time": 1000},
    {"id": 2, "uid": "block0002", "string": "first #tag", "page_id": 1, "parents": [1], "children": [4], "order": 0, "time": 2000, "edit_time": 3000},
    {"id": 3, "uid": "block0003", "string": "tags:: [[T1]] #T2", "page_id": 1, "parents": [1], "order": 1},
    {"id": 4, "uid": "block0004", "string": "nested ((block0003)) **deep**", "page_id": 1, "parents": [2, 1, 77], "children": [5], "order": 0},
    {"id": 5, "uid": "block0005", "string": "{{[[TODO]]}}", "page_id": 1, "parents": [4, 1, 2], "order": 0},
    {"id": 6, "uid": "page00006", "title": "roam/css", "children": [7]},
    {"id": 7, "uid": "block0007", "string": "hidden", "page_id": 6, "parents": [6]},
    {"id": 8, "uid": "01-02-2024", "title": "January 2nd, 2024", "children": [9]},
    {"id": 9, "uid": "block0009", "string": "a day", "page_id": 8, "parents": [8]},
    {"id": 10, "uid": "block0010", "string": "no page"},
]


def test_index_records(spark):
    got = {r.uid: r for r in records.index_records(_graph(spark, GRAPH)).collect()}
    assert set(got) == {"page00001", "block0002", "block0003", "block0004", "01-02-2024", "block0009"}
    page, deep = got["page00001"], got["block0004"]
    assert (page.page_title, page.text, page.concepts, page.tags, page.edited_at) == ("The [[Big]] Page", "The Big Page", ["Big"], ["T1", "T2"], 1000)
    assert page.descendant_text == "first tag · nested tags: T1 T2 deep · tags: T1 T2"
    assert (deep.breadcrumb, deep.text) == ("The Big Page › first tag", "nested tags: T1 T2 deep")
    assert got["block0002"].embed_input == "The Big Page › first tag | concepts: tag | nested tags: T1 T2 deep" and got["block0002"].edited_at == 3000
    days = {r.uid for r in records.index_records(_graph(spark, GRAPH), include_daily_notes=False).collect()}
    assert "01-02-2024" not in days and "block0009" not in days


def test_cap_cuts_descendants_first(spark):
    rows = [{"id": 1, "uid": "page00001", "title": "P", "children": [2]}, {"id": 2, "uid": "block0002", "string": "x" * 9000, "page_id": 1, "parents": [1]}]
    page = next(r for r in records.index_records(_graph(spark, rows)).collect() if r.is_page)
    assert len(page.embed_input) == 8000 and page.embed_input.startswith("P | xxx") and len(page.descendant_text) == 9000


def test_random_trees_against_a_walk(spark):
    r = random.Random(3)
    rows, parent, kids = [{"id": 0, "uid": "page00000", "title": "root"}], {0: None}, {0: []}
    for i in range(1, 24):
        p = r.randrange(max(0, i - 6), i)
        parent[i], kids[i] = p, []
        kids[p].append(i)
    order = {i: r.randrange(4) for i in range(24)}
    above = lambda i: [] if parent[i] is None else [parent[i], *above(parent[i])]
    stubs = {}
    for i in range(24):
        stubs[i] = r.sample(kids[i], len(kids[i]))
        if i:
            rows.append({"id": i, "uid": f"block{i:04d}", "string": f"text {i}", "page_id": 0, "parents": r.sample(above(i), len(above(i))), "order": order[i]})
    for row in rows:
        row["children"] = stubs[row["id"]]

    def walk(i):
        return [x for k in sorted(stubs[i], key=lambda k: order[k]) for x in (f"text {k}", *walk(k))]

    got = {x.ordinal: x for x in records.index_records(_graph(spark, rows)).collect()}
    for i in range(24):
        assert got[i].descendant_text == " · ".join(walk(i))
        if i:
            path = [f"text {k}" for k in reversed(above(i)) if k]
            assert got[i].breadcrumb == ("root › " + " · ".join(path) if path else "root")


def test_cycles_end_and_last_duplicate_wins(spark):
    rows = [{"id": 1, "uid": "page00001", "title": "P", "children": [2]}, {"id": 2, "uid": "block0002", "string": "a", "page_id": 1, "parents": [1], "children": [3]}, {"id": 3, "uid": "block0003", "string": "b", "page_id": 1, "parents": [1, 2], "children": [2]}, {"id": 3, "uid": "block0003", "string": "c", "page_id": 1, "parents": [1, 2], "children": [2]}]
    nodes = outline.by_id(outline.cleaned(outline.with_references(_graph(spark, rows), outline.reference_texts(_graph(spark, rows)))))
    got = {x.id: x.descendant_text for x in outline.descendants(nodes).collect()}
    assert got[1] == "a · c"


def test_bm25_equals_sqlite(spark):
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "été", "foo", "bar", "snake", "zeta", "x1"]
    rows = []
    for i in range(40):
        say = lambda: " ".join(r.choice(words) for _ in range(r.randrange(6)))
        rows.append((f"u{i:02d}", i, say(), say(), [say()], [say(), say()], say() + (" foo bar" if i % 5 == 0 else "")))
    df = spark.createDataFrame(rows, "uid string, ordinal long, text string, breadcrumb string, concepts array<string>, tags array<string>, descendant_text string")
    index = keyword.keyword_index(df, list(COLUMN_WEIGHTS))
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(uid UNINDEXED, text, breadcrumb, concepts, tags, descendant_text)")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?, ?, ?)", [(x[0], x[2], x[3], " · ".join(x[4]), " · ".join(x[5]), x[6]) for x in rows])
    queries = ["alpha", "alpha zeta", "alpha alpha ete", 'foo_bar AND "x1', "_", "NEAR(", "Été gamma nothing"]
    asked = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    got = {(x.qid, x.uid): x.score for x in keyword.bm25(index, asked, COLUMN_WEIGHTS).collect()}
    for q, text in enumerate(queries):
        match = " OR ".join(f'"{w}"' for w in re.findall(r"\w+", text))
        want = dict(db.execute("SELECT uid, -bm25(f, 0, 1, 1, 4, 2, 1) FROM f WHERE f MATCH ?", (match,)).fetchall())
        own = {u: s for (k, u), s in got.items() if k == q}
        assert own.keys() == want.keys() and all(abs(own[u] - want[u]) < 1e-9 for u in own), text


def test_vectors_and_fusion(spark):
    workers_find_library(spark)
    rows = [("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("c", 2, [1.0, 1.0]), ("z", 3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "uid string, ordinal long, embedding array<float>")
    assert [x.uid for x in vector.neighbours(df, [1.0, 0.0], 3).collect()] == ["a", "c", "b"]
    both = vector.batch_neighbours(df, [(5, [1.0, 0.0]), (6, [0.0, 1.0])], 2)
    ranks = {(x.qid, x.uid): x["rank"] for x in fusion.ranked(both, 2).collect()}
    assert ranks == {(5, "a"): 1, (5, "c"): 2, (6, "b"): 1, (6, "c"): 2}
    asked = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0]), (7, None)], "qid long, embedding array<float>")
    joined = fusion.ranked(vector.joined_neighbours(df, asked, 2), 2)
    assert {(x.qid, x.uid): x["rank"] for x in joined.collect()} == ranks
    assert vector.batch_neighbours(df, [], 2).count() == 0 == vector.batch_neighbours(df.limit(0), [(1, [1.0, 0.0])], 2).count()
    one = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "qid long, uid string, rank int")
    two = spark.createDataFrame([(0, "y", 1), (0, "w", 2)], "qid long, uid string, rank int")
    assert {x.uid: x.score for x in fusion.rrf([one, one]).collect()}["x"] == pytest.approx(2 / 61)
    fused = fusion.fused(one, two, 10).orderBy("rank").collect()
    assert [x.uid for x in fused] == ["y", "x", "w"] and fused[2].vector_rank is None
    assert fusion.fused(one, two, 0).count() == 0


def _nodes(spark, children, texts=None):
    """Outline rows of {id: [children]}, all of order 0, with text t<id>."""
    ids = sorted(set(children) | {k for of in children.values() for k in of})
    rows = [(i, children.get(i, []), 0, f"t{i}" if texts is None else texts.get(i, "")) for i in ids]
    return spark.createDataFrame(rows, "id long, children array<long>, `order` long, clean string")


def _walked(children, i, met=()):
    return [x for k in children.get(i, []) if k not in (*met, i) for x in (f"t{k}", *_walked(children, k, (*met, i)))]


def test_descendants_of_trees_knots_and_cycles(spark):
    """Trees beside nodes of two parents, a child named twice, cycles with a tail, and a way from a tree into a knot."""
    workers_find_library(spark)
    r = random.Random(5)
    children = {1: [2, 3], 2: [4], 10: [11, 12], 11: [13], 12: [13], 13: [14], 14: [15], 20: [21], 21: [22], 22: [20, 23], 23: [24], 30: [31, 31], 40: [40, 41], 50: [51], 51: [13]}
    for i in range(100, 160):
        children.setdefault(r.randrange(99, i), []).append(i)
    got = {x.id: x.descendant_text for x in outline.descendants(_nodes(spark, children)).collect()}
    assert got == {i: " · ".join(w) for i in children if (w := _walked(children, i))}


def test_descendants_of_a_chain_write_a_row_a_node(spark, monkeypatch):
    """A chain of 2000 nodes: each round writes as many rows as there are nodes, and rounds grow with the logarithm."""
    workers_find_library(spark)
    written, real = [], outline.checkpointed
    monkeypatch.setattr(outline, "checkpointed", lambda df: written.append(real(df)) or written[-1])
    n = 2000
    got = {x.id: x.descendant_text for x in outline.descendants(_nodes(spark, {i: [i + 1] for i in range(n)})).collect()}
    assert len(got) == n and got[n - 2] == f"t{n - 1} · t{n}" and got[0].count("·") == n - 1
    assert len(written) <= 4 + 12 and all(df.count() <= n + 1 for df in written)


def test_tokens(spark):
    df = spark.createDataFrame([("Été_été Straße, x1!",)], "t string")
    row = df.select(tokens.index_tokens(F.col("t")).alias("i"), tokens.query_words(F.col("t")).alias("q")).first()
    assert row.i == ["ete", "ete", "straße", "x1"] and row.q == ["Été_été", "Straße", "x1"]


def test_lenient_and_strict_reading(spark, tmp_path):
    good = {"id": 1, "uid": "u1", "string": "s", "page": {"id": 9}, "parents": [{"id": 9}], "children": [{"id": 3}], "order": 2, "time": 5, "edit-time": 6}
    odd = {"id": 2, "uid": "u2", "string": 5, "title": ["q"], "parents": [{"id": 1}, {"no": 1}, 7], "children": "x", "order": 3.5}
    (tmp_path / "g.json").write_text("\n".join(map(json.dumps, [good, odd, {"id": 3}])))
    strict = {r.uid: r for r in entities.read_entities(spark, str(tmp_path / "g.json")).collect()}
    lenient = {r.uid: r for r in entities.read_entities(spark, str(tmp_path / "g.json"), lenient=True).collect()}
    assert strict["u1"] == lenient["u1"] and set(lenient) == {"u1", "u2"}
    assert (lenient["u2"].string, lenient["u2"].title, lenient["u2"].parents, lenient["u2"].children, lenient["u2"].order) == (None, None, [1], [], None)
    answer = lambda x: entities.unwrapped(spark.createDataFrame([(json.dumps(x),)], "value string"))
    for wrong in ([{"id": 1}], {"a": 1}, [[]]):
        with pytest.raises(Exception, match="the answer"):
            answer(wrong).collect()
    assert answer([[good]]).first().uid == "u1"


def test_refresh_plan(spark):
    of = lambda rows: spark.createDataFrame(rows, "uid string, content_hash string")
    plan = refresh.refresh_plan(of([("same", "1"), ("changed", "2"), ("new", "3")]), of([("same", "1"), ("changed", "9"), ("gone", "4")]))
    assert {r.uid: r.action for r in plan.collect()} == {"same": "keep", "changed": "embed", "new": "embed", "gone": "delete"}
    assert refresh.refresh_counts(plan).first().asDict() == {"embedded": 2, "deleted": 1, "unchanged": 1, "record_count": 3}


def test_build_search_refresh(spark, tmp_path):
    workers_find_library(spark)
    store, hashing = Store(str(tmp_path / "store")), embedder.HashEmbedder(16)
    graph = _graph(spark, GRAPH)
    meta = refresh.build(spark, store, records.index_records(graph), hashing, "g")
    assert meta.record_count == 6 and store.exists(spark)
    hits = tools.searched(spark, store, "nested deep", 3, hashing)
    assert [h["rank"] for h in hits] == [1, 2, 3] and next(h for h in hits if h.uid == "block0004").keyword_rank is not None
    assert cli.shown(hits[0]).startswith("1. ")
    edited = _graph(spark, [x | {"string": "first changed"} if x["id"] == 2 else x for x in GRAPH if x["id"] != 9])
    counts = refresh.refresh(spark, store, records.index_records(edited), hashing)
    assert counts["deleted"] == 1 and counts["record_count"] == 5 and store.meta(spark).refreshed_at
    again = refresh.refresh(spark, store, records.index_records(edited), hashing)
    assert again["embedded"] == 0 and again["unchanged"] == 5
    assert len(store.snapshot(spark).segments) == 2  # nothing was written for the refresh without a change
    assert search.records_by_uid(store.records(spark), spark.createDataFrame([("block0002",), ("nope",)], "uid string")).first().text == "first changed"
    with pytest.raises(ValueError):
        refresh.check_schema_version(Meta("g", "m", 1, "x", 0, None, 1))
    with pytest.raises(ValueError):
        refresh.build(spark, Store(str(tmp_path / "twice")), records.index_records(graph).unionByName(records.index_records(graph)), hashing, "g")
    empty = refresh.build(spark, Store(str(tmp_path / "empty")), records.index_records(graph.limit(0)), hashing, "g")
    assert empty.record_count == 0


def test_refresh_stream(spark, tmp_path):
    workers_find_library(spark)
    (tmp_path / "in").mkdir()
    line = json.dumps({"id": 1, "uid": "page00001", "title": "Streamed"})
    (tmp_path / "in" / "a.json").write_text(json.dumps({"value": line, "ordinal": 0}))
    store = Store(str(tmp_path / "store"))
    refresh_on_arrival(spark, str(tmp_path / "in"), store, embedder.HashEmbedder(8), str(tmp_path / "cp"), "g").awaitTermination(120)
    assert [r.text for r in store.records(spark).collect()] == ["Streamed"]


def test_store_of_segments_equals_a_new_one(spark, tmp_path, monkeypatch):
    """Many small changes, and the merge of segments, leave the records, lengths, dictionary and scores of a store built at once."""
    monkeypatch.setattr("quillgraph.sources.snapshot.FAN", 2)
    workers_find_library(spark)
    hashing, r = embedder.HashEmbedder(4), random.Random(1)
    rows = {f"u{i}": f"word{i % 3} text {i}" for i in range(12)}

    def frame():
        df = spark.createDataFrame([(u, int(u[1:]), t, t) for u, t in sorted(rows.items())], "uid string, ordinal long, text string, embed_input string")
        return df.withColumn("content_hash", F.sha2("text", 256))

    store = Store(str(tmp_path / "store"), ("text",))
    refresh.build(spark, store, frame(), hashing, "g")
    for n in range(3):
        rows.pop(r.choice(sorted(rows)))
        rows[r.choice(sorted(rows))] += f" changed word{n}"
        rows[f"u{20 + n}"] = "word1 new"
        old = store.snapshot(spark)
        counts = refresh.refresh(spark, store, frame(), hashing)
        assert counts["record_count"] == len(rows) == store.meta(spark).record_count
        with pytest.raises(ConflictError):
            store.change(spark, old, store.records(spark, old).limit(0), spark.createDataFrame([("u1",)], "uid string"), old.meta)
        fresh = Store(str(tmp_path / f"fresh{n}"), ("text",))
        refresh.build(spark, fresh, frame(), hashing, "g")
        terms = lambda s: s.index(spark).terms.groupBy("term").agg(F.sum("df").alias("df")).where("df != 0")
        for part in (lambda s: s.records(spark).select("uid", "text", "embedding"), lambda s: s.index(spark).lengths.select("uid", "dl"), lambda s: s.index(spark).postings.select("term", "uid", "tf", "positions"), terms):
            assert sorted(map(str, part(store).collect())) == sorted(map(str, part(fresh).collect()))
        scores = [sorted((x.uid, round(x.score, 9)) for x in keyword.bm25_of(s.index(spark), [(0, "word1 changed")], {"text": 1.0}).collect()) for s in (store, fresh)]
        assert scores[0] == scores[1]
        near = [sorted((x.uid, round(x.score, 9)) for x in s.vector_index(spark).nearest([1.0, 0.5, 0.0, 2.0], 5).collect()) for s in (store, fresh)]
        assert near[0] == near[1]
        assert sorted(x.uid for x in store.records_of(spark, ["u0", "u1", "u20", "nope"]).collect()) == sorted({"u0", "u1", "u20"} & set(rows))


def test_catalog_and_access(spark, tmp_path, monkeypatch):
    path = lambda text: (tmp_path / "r.json").write_text(text) and str(tmp_path / "r.json")
    assert catalog.read_catalog(spark, str(tmp_path / "none.json")).count() == 0
    for broken in ("no json", '{"graphs": 5}', '{"graphs": [{"nickname": "x"}]}', '{"graphs": [{"name": "x", "type": "other"}]}'):
        assert catalog.read_catalog(spark, path(broken)).count() == 0
    graphs = catalog.read_catalog(spark, path(json.dumps({"graphs": [{"name": "one", "nickname": "Uno", "token": "t", "x": 1}, {"name": "two", "type": "offline"}, {"name": "uno"}]})))
    assert catalog.resolve(graphs, " UNO ").name == "one" and catalog.resolve(graphs, "Two").type == "offline"
    with pytest.raises(catalog.UnknownGraphError, match="Uno, two, uno"):
        catalog.resolve(graphs, "x")
    one, two = catalog.resolve(graphs, "one"), catalog.resolve(graphs, "two")
    with pytest.raises(catalog.UnknownGraphError, match="offline"):
        catalog.access(spark, two, "two", port=1)
    (tmp_path / "port.json").write_text('{"port": 3333}')
    assert catalog.access(spark, one, "one", port_file=str(tmp_path / "port.json")) == catalog.Access("http://127.0.0.1:3333/api/one", "t")
    assert catalog.access(spark, one, "one", token="flag", port=5).token == "flag"
    monkeypatch.setenv("QUILLGRAPH_TOKEN", "environment")
    assert catalog.access(spark, one, "one", port=5).token == "t" and catalog.access(spark, None, "other", port=5).token == "environment"
    with pytest.raises(catalog.UnknownGraphError, match="port"):
        catalog.access(spark, one, "one")
    monkeypatch.setenv("QUILLGRAPH_PORT", "77")
    assert catalog.access(spark, one, "one").url.startswith("http://127.0.0.1:77/")
    (tmp_path / "port.json").write_text('{"port": "none"}')
    with pytest.raises(catalog.UnknownGraphError):
        catalog.read_port(spark, str(tmp_path / "port.json"))


def test_freshness(spark):
    meta = lambda built: Meta("g", "m", 1, built, 0, None, 2)
    now = datetime.now(UTC).isoformat(timespec="seconds")
    assert tools.freshness(spark, meta(now), lambda m: 1 / 0)["state"] == "fresh"
    assert tools.freshness(spark, meta("2020-01-01T00:00:00"), lambda m: None)["state"] == "refreshed"
    failed = tools.freshness(spark, meta("soon"), lambda m: 1 / 0)
    assert failed["state"] == "failed" and failed["age_seconds"] is None and "zero" in failed["error"]
    try:
        spark.conf.set("spark.quillgraph.maxStaleness", "-1")
        assert tools.freshness(spark, meta("soon"), lambda m: 1 / 0)["state"] == "unchecked"
        spark.conf.set("spark.quillgraph.maxStaleness", "often")
        assert catalog.max_staleness(spark) == 3600
    finally:
        spark.conf.unset("spark.quillgraph.maxStaleness")


def test_embedders_stay_here_and_are_checked():
    with pytest.raises(ValueError, match="this machine"):
        embedder.LoopbackEmbedder("m", 2, "http://192.0.2.1:1")
    assert embedder.stays_here("http://localhost:1") and embedder.stays_here("http://[::1]:1") and not embedder.stays_here("nothing")
    assert embedder.as_matrix([[1, 2], [3, 4]], 2, 2).tolist() == [[1, 2], [3, 4]] and embedder.as_matrix([], 0, 2).shape == (0, 2)
    for vectors, error in (([[1, 2]], ValueError), ([[1, 2], [3]], TypeError), ([[1], [2]], ValueError), (None, TypeError), ([["a", "b"], ["c", "d"]], TypeError)):
        with pytest.raises(error):
            embedder.as_matrix(vectors, 2, 2)


@pytest.fixture
def api():
    """A graph's API and an embedding server in one, on this machine."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    rows = [{"id": 1, "uid": "page00001", "title": "Rivers", "children": [{"id": 2}], "time": 1}, {"id": 2, "uid": "block0002", "string": "the [[Nile]]", "page": {"id": 1}, "parents": [{"id": 1}], "order": 0}]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == embedder.EMBED_PATH:
                said = {"embeddings": [[float(len(x)), 1.0] for x in asked["input"]]}
            elif self.headers["Authorization"] == "Bearer t" and asked["action"] == "data.q" and ":block/uid" in asked["args"][0]:
                said = {"result": [[x] for x in rows] if self.path.endswith("/one") else [{"id": 1}]}
            else:
                self.send_error(401)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield http.server_port, rows
    http.shutdown()


def test_graph_is_pulled_indexed_and_searched_over_the_tool_server(spark, tmp_path, api):
    import io

    port, rows = api
    workers_find_library(spark)
    assert sorted(x.uid for x in pulled_entities(spark, f"http://127.0.0.1:{port}/api/one", "t").collect()) == ["block0002", "page00001"]
    for url, token, error in ((f"http://127.0.0.1:{port}/api/two", "t", "entity"), (f"http://127.0.0.1:{port}/api/one", "wrong", "401")):
        with pytest.raises(Exception, match=error):
            pulled_entities(spark, url, token).collect()
    with pytest.raises(ValueError, match="this machine"):
        pulled_entities(spark, "http://192.0.2.1/api/one", "t")
    (tmp_path / "r.json").write_text(json.dumps({"graphs": [{"name": "one", "nickname": "Uno", "token": "t"}, {"name": "two"}]}))
    own = tools.Tools(spark, str(tmp_path / "r.json"), str(tmp_path / "stores"), model="m", dimension=2, url=f"http://127.0.0.1:{port}", port=port)
    assert own.build("uno").record_count == 2
    rows[1]["string"] = "the [[Nile]] floods"
    ask = lambda n, name, **a: {"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": name, "arguments": a}}
    asked = [{"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"},
             ask(2, "list_indexes"), ask(3, "semantic_search", graph="UNO", query="Nile", k=1), ask(4, "refresh_index", graph="one"), ask(5, "index_stats", graph="one"), ask(6, "index_stats", graph="two"), ask(7, "nothing")]
    said = io.StringIO()
    server.serve(own, io.StringIO("\n".join([*map(json.dumps, asked), "no json"])), said)
    answers = {x["id"]: x for x in map(json.loads, said.getvalue().splitlines())}
    assert set(answers) == {0, 1, 2, 3, 4, 5, 6, 7, None} and len(answers[1]["result"]["tools"]) == 4
    told = {k: json.loads(x["result"]["content"][0]["text"]) for k, x in answers.items() if k in (2, 3, 4, 5)}
    assert [(g["label"], g["indexed"], g["record_count"]) for g in told[2]] == [("Uno", True, 2), ("two", False, None)]
    assert len(told[3]["hits"]) == 1 and told[3]["refresh"]["state"] == "fresh"
    assert told[4] == {"embedded": 2, "deleted": 0, "unchanged": 0, "record_count": 2} and told[5]["embed_model"] == "m"
    assert answers[6]["result"]["isError"] and "build -g two" in answers[6]["result"]["content"][0]["text"] and "error" in answers[7]


def test_command_line(spark, tmp_path, capsys):
    workers_find_library(spark)
    (tmp_path / "g.json").write_text(json.dumps({"id": 1, "uid": "page00001", "title": "Streams"}))
    of = ["-g", "g", "--stores", str(tmp_path / "stores"), "--entities", str(tmp_path / "g.json")]
    assert cli.main(["search", "streams", *of], spark) == 1 and "names no graph" in capsys.readouterr().err
    for command, shown in (("build", "1 records"), ("refresh", "'unchanged': 1"), ("stats", "hash-64"), ("graphs", "")):
        assert cli.main([command, *of], spark) == 0 and shown in capsys.readouterr().out
    assert cli.main(["search", "streams", *of], spark) == 0 and "page00001 Streams" in capsys.readouterr().out


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from quillgraph.workers import shared_folder

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:1"))
    with pytest.raises(RuntimeError, match="shares"):
        shared_folder(bare)
