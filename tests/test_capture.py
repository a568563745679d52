"""Captures against a local server that counts what it sends, and searches of which one refreshes."""

from __future__ import annotations

import json
import threading
import time
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quillgraph import tools
from quillgraph.plans import records, refresh
from quillgraph.sources import capture, embedder
from quillgraph.sources.capture import Captures
from quillgraph.sources.snapshot import Store
from quillgraph.workers import workers_find_library


@pytest.fixture
def graph():
    """(url, entities by uid, entities sent in each request)"""
    entities, sent = {}, []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            query, *more = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["args"]
            if query == capture.EVERY_UID:
                said = [[u] for u in entities]
            elif query == capture.EDITED_AFTER:
                said = [[u] for u, e in entities.items() if e.get("edit-time", 0) > more[0]]
            else:
                said = [[entities[u]] for u in more[0] if u in entities]
                sent.append(len(said))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"result": said}).encode())

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/api/g", entities, sent
    http.shutdown()


def _entity(i, **more):
    return {"id": i, "uid": f"uid{i:06d}", "time": 10, **more}


def test_a_capture_reads_what_has_changed(spark, tmp_path, graph, monkeypatch):
    url, entities, sent = graph
    monkeypatch.setattr(capture, "ASKED", 40)
    for i in range(300):
        page = i // 30 * 30
        e = _entity(i, title=f"page {i}", children=[{"id": k} for k in range(i + 1, i + 30)]) if i == page else _entity(i, string=f"block {i}", page={"id": page}, parents=[{"id": page}], order=i - page)
        entities[e["uid"]] = e
    held = Captures(str(tmp_path / "g"))
    assert held.capture(spark, url, "t") == {"pulled": 300, "kept": 0, "dropped": 0}
    assert sum(sent) == 300 and max(sent) <= 40 and held.entities(spark).count() == 300
    before = {r.uid: r for r in records.index_records(held.entities(spark)).collect()}

    sent.clear()
    entities["uid000007"] |= {"string": "edited", "edit-time": 50}
    del entities["uid000040"]
    entities["uid000900"] = _entity(900, string="new", page={"id": 60}, parents=[{"id": 60}], order=99, **{"edit-time": 60})
    entities["uid000060"]["children"].append({"id": 900})  # its own edit time stays as it was
    # the edited, the new, and the pages above them
    assert held.capture(spark, url, "t") == {"pulled": 4, "kept": 296, "dropped": 1}
    assert sum(sent) == 4
    whole = Captures(str(tmp_path / "whole"))
    whole.capture(spark, url, "t")
    plain = lambda c: {(r.uid, r.text, r.descendant_text, r.content_hash) for r in records.index_records(c.entities(spark)).collect()}
    assert plain(held) == plain(whole)
    plan = refresh.refresh_plan(records.index_records(held.entities(spark)), spark.createDataFrame([(u, r.content_hash) for u, r in before.items()], "uid string, content_hash string"))
    assert refresh.refresh_counts(plan).first().asDict()["deleted"] == 1

    sent.clear()
    assert held.capture(spark, url, "t")["dropped"] == 0
    assert sum(sent) <= 2  # edits of the newest moment are asked for again, with what is above
    assert len([p for p in (tmp_path / "g").iterdir() if p.name.isdigit()]) == capture.KEPT


def test_captures_of_empty_and_foreign_graphs(spark, tmp_path, graph):
    url, entities, _ = graph
    held = Captures(str(tmp_path / "g"))
    with pytest.raises(FileNotFoundError):
        held.entities(spark)
    assert held.capture(spark, url, "t") == {"pulled": 0, "kept": 0, "dropped": 0} and held.entities(spark).count() == 0
    entities["uid000001"] = _entity(1, title="first")
    assert held.capture(spark, url, "t") == {"pulled": 1, "kept": 0, "dropped": 0}
    entities.clear()
    assert held.capture(spark, url, "t") == {"pulled": 0, "kept": 0, "dropped": 1}
    with pytest.raises(ValueError, match="not on this machine"):
        held.capture(spark, "http://example.org/api/g", "t")


def test_of_many_stale_searches_one_refreshes(spark, tmp_path, graph):
    """Four searches at once: one captures the graph, the others answer from the index as it is."""
    workers_find_library(spark)
    url, entities, _ = graph
    entities["uid000001"] = _entity(1, title="first")
    held, store, hashing = Captures(str(tmp_path / "g")), Store(str(tmp_path / "s")), embedder.HashEmbedder(8)
    held.capture(spark, url, "t")
    refresh.build(spark, store, records.index_records(held.entities(spark)), hashing, "g")
    old = replace(store.meta(spark), built_at="2001-01-01T00:00:00+00:00")
    store.touch(spark, store.snapshot(spark), old)
    gate, states, pulls = threading.Barrier(4), [], []

    def bring_up(meta):
        pulls.append(1)
        time.sleep(2)
        held.capture(spark, url, "t")
        refresh.refresh(spark, store, records.index_records(held.entities(spark)), hashing)

    def search():
        gate.wait()
        states.append(tools.freshness(spark, old, bring_up, store)["state"])

    threads = [threading.Thread(target=search) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(pulls) == 1 and set(states) <= {"refreshed", "refreshing"} and "refreshed" in states
    assert not [p for p in (tmp_path / "s" / "_snapshots").iterdir() if p.name.startswith("_")]
    with store.leased(spark) as mine, store.leased(spark) as other:
        assert mine and not other
        with store.leased(spark, seconds=-5) as taken:  # of a holder that crashed
            assert taken
    with store.leased(spark) as mine:
        assert mine
