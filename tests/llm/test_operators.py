"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing names, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import bpe, common, counts, exact, lines, media, packing, passages, quality, registry, sharding, simhash
from quillgraph.llm.words import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, _fp string, score string, rest int, shard int"


def _rows() -> list[tuple]:
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    passage = prose(70)
    texts: list[str | None] = [None, "", " \n\t ", "a", prose(40), prose(40), "common line\n" + prose(30), prose(3000)]
    texts += ["Common LINE \t\n" + prose(20 + i) + "\n\ncommon line" for i in range(12)]
    near = prose(160).split()
    for i in range(6):
        copy = list(near)
        copy[20 * i + 3] = "changedword"
        texts.append(" ".join(copy))
    texts += [prose(40 + i) + " then " + passage + " and " + prose(30) for i in range(4)]
    texts += [texts[4], texts[4].replace(" ", "  "), texts[4], "é中文 😀\n" + prose(9), "la " * 200]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", None, None, 5), (None, "no id", None, None, 5), (None, None, None, None, None)]
    return [(*x, "x", 1, "y", "z", 2, 9) for x in rows]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    common.workers_find_library(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    common.workers_find_library(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [x[:5] for x in ROWS])
    return c


def found(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def raw(x):
    return (x or "").encode()


def test_op3(docs, none):
    got = found(media.media_digests(media.with_media(docs).select("doc_id", "n_bytes", "media")), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = Counter()
    for x in ROWS:
        p = media.padded(raw(x[1]))
        want[x[0], len(raw(x[1])), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want
    assert set(docs.columns) < set(media.rgb_tensors(media.with_media(docs)).columns)
    assert media.media_digests(media.with_media(none).select("doc_id", "n_bytes", "media")).count() == 0


def test_op3_tensors_are_stored_whole(spark, docs, tmp_path):
    """Tensors written to Parquet and read again are those of the stored JPEG, and the digests are those of the stored bytes."""
    made = media.rgb_tensors(media.with_media(docs.where("length(text) < 3000")).select("doc_id", "n_bytes", "media"))
    made.write.parquet(f"{tmp_path}/tensors")
    rows = spark.read.parquet(f"{tmp_path}/tensors").collect()
    told = Counter((r.doc_id, r.media_bytes, r.media_sha256, r.feature) for r in media.media_digests(made.select("doc_id", "n_bytes", "media")).collect())
    want = Counter()
    for r in rows:
        tensor = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert (tensor == media.jpeg.rgb(media.jpeg.decode(r.media))).all()
        mean = tensor.reshape(-1, 3).astype(float).mean(axis=0)
        want[r.doc_id, len(r.media), hashlib.sha256(r.media).hexdigest(), f"{r.height}x{r.width}x3 rgb {mean[0]:.2f} {mean[1]:.2f} {mean[2]:.2f}"] += 1
    assert told == want


def _walk(pieces, text):
    """(count, score) of the best path, a place at a time over all pieces that end there, ties to the longest last piece."""
    unknown = min(pieces.values()) - 10
    best = [(0.0, 0, False)]
    longest = max(map(len, pieces))
    for end in range(1, len(text) + 1):
        options = []
        for n in range(min(longest, end), 0, -1):
            if (piece := text[end - n : end]) in pieces:
                score, count, _ = best[end - n]
                options.append((score + pieces[piece], -len(options), count + 1, False))
        if text[end - 1] not in pieces:
            score, count, _ = best[end - 1]
            options.append((score + unknown, -len(options), count + len(text[end - 1].encode()), True))
        score, _, count, lost = max(options, key=lambda o: o[:2])
        best.append((score, count, lost))
    return best[-1][1]


def test_op7_query_by_brute_force(spark, none, tmp_path):
    import sentencepiece

    r = random.Random(4)
    texts = [None, "", " ", "a", "  two  blanks ", "é中文😀 日本", "tab\tand\nline", "".join(r.choice("abc ") for _ in range(300)), "the same", "the same"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary("piece_bpe_32k.model"))
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = {model.id_to_piece(i): model.get_score(i) for i in ids}
    got = {x.doc_id: x.n_tokens for x in registry.QUERIES["op7_token_counts"](spark, str(tmp_path)).collect()}
    assert got == {i: _walk(pieces, "▁" + t.replace(" ", "▁")) if t else 0 for i, t in enumerate(texts)}
    assert counts.token_counts(none, bpe.vocabulary("piece_bpe_32k.model")).count() == 0


def test_op7_and_op8(docs, none):
    t, c = tokenizer(bpe.vocabulary()), counts.counter(bpe.vocabulary("piece_bpe_32k.model"))
    want8, want7 = Counter(), Counter()
    for x in ROWS:
        ids = t.encode(x[1] or "", add_special_tokens=False).ids
        said = t.decode(ids, skip_special_tokens=False).encode()
        want8[x[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(said).hexdigest()] += 1
        want7[x[0], c.viterbi("▁" + x[1].replace(" ", "▁"))[0] if x[1] else 0] += 1
    assert found(bpe.bpe_digests(docs, bpe.vocabulary()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want8
    assert found(counts.token_counts(docs, bpe.vocabulary("piece_bpe_32k.model")), "doc_id", "n_tokens") == want7
    assert bpe.encode_decode(docs, bpe.vocabulary()).columns == [*docs.columns, "ids", "decoded"]
    assert bpe.bpe_digests(none, bpe.vocabulary()).count() == 0


def test_op9(docs, none):
    rows = packing.packed_documents(docs, bpe.vocabulary(), 256).collect()
    t, want = tokenizer(bpe.vocabulary()), Counter()
    for x in ROWS:
        ids = [*t.encode(x[1] or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[x[0], n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for of in bins.values():
        assert [a for a, _ in sorted(of)] == [sum(n for _, n in sorted(of)[:k]) for k in range(len(of))] and sum(n for _, n in of) <= 256
    assert len(bins) <= -(-sum(r.length for r in rows) // 256) + 2
    assert packing.packed_documents(none, bpe.vocabulary()).count() == 0


def test_op10(docs, none, duck):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(exact.exact_groups(docs), *columns) == Counter(duck.execute(f"SELECT {', '.join(columns)} FROM ({exact.ORACLE_SQL})").fetchall())
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert Counter(norm(r.text) for r in left.collect()) == Counter({norm(x[1]) for x in ROWS})
    assert exact.exact_groups(none).count() == 0 == exact.without_copies(none).count()


def test_op5(docs, none, duck):
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    got = found(lines.frequent_lines_dropped(docs), *columns)
    assert got == Counter(duck.execute(f"SELECT {', '.join(columns)} FROM ({lines.ORACLE_SQL})").fetchall())
    assert any(k[2] for k in got)
    assert lines.frequent_lines_dropped(none).count() == 0


def test_op5_batches_meet_sorted_runs_without_exchange_or_sort(spark, docs):
    hashes = lines.line_hashes(docs)
    runs = lines.LineRuns(spark, 2)
    for _ in range(2):
        runs.add(hashes)
    batch = runs._written(hashes.where("first").groupBy(*lines.HASH).agg(F.count("*").alias("n")), "batch").rows
    with common._writing(spark):
        for df in (lines.unsettled(batch, runs.settled[0].rows), lines.merged([batch, batch])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    left = {tuple(x) for x in lines.unsettled(batch, runs.settled[0].rows).select(*lines.HASH).collect()}
    assert left == {tuple(x) for x in batch.select(*lines.HASH).collect()} - {tuple(x) for x in runs.settled[0].rows.collect()}


def test_op5_runs_can_be_saved_and_added_to(spark, docs, tmp_path):
    hashes = common.materialise(lines.line_hashes(docs), "hashes")
    once = lines.LineRuns(spark, 3)
    for _ in range(3):
        once.add(hashes)
    runs = lines.LineRuns(spark, 3, root=f"file://{tmp_path}/runs")
    runs.add(hashes)
    runs.saved()
    again = lines.LineRuns.opened(spark, f"file://{tmp_path}/runs")
    again.add(hashes)
    again.saved()
    last = lines.LineRuns.opened(spark, f"file://{tmp_path}/runs")
    last.add(hashes)
    assert sorted(once.finish().collect()) == sorted(last.finish().collect()) != []


def _components(n, close):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if close(i, j):
                label[root(i)] = root(j)
    return [root(i) for i in range(n)]


def test_op6(docs, none):
    fps = [simhash.fingerprint(raw(x[1]), 4) for x in ROWS]
    of = _components(len(ROWS), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least: dict = {}
    for x, c in zip(ROWS, of, strict=True):
        if x[0] is not None:
            least[c] = min(x[0], least.get(c, x[0]))
    want = Counter((x[0], f"{fp:016x}", least.get(c)) for x, fp, c in zip(ROWS, fps, of, strict=True))
    assert found(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0


def test_op6_stage_tells_texts_with_one_short_hash_apart(spark, monkeypatch):
    """Texts are equal by 128 bits: with the first 64 of all alike, what differs stays."""
    own = simhash._marks
    monkeypatch.setattr(simhash, "_marks", lambda raw: [x if k != 1 else pa.array([7] * len(raw), pa.int64()) for k, x in enumerate(own(raw))])
    assert _kept_ids(spark, ["one text", "another text", "one text", "", "a third, with other words"]) == [0, 1, 3, 4]


def test_op6_stage(docs, none):
    left = simhash.without_near_copies(docs)
    assert left.columns == docs.columns
    fps = [simhash.word_fingerprint(raw(x[1])) for x in ROWS]
    assert left.count() == len(set(_components(len(ROWS), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 6)))
    ids = {r.doc_id for r in left.collect()}
    assert {20} == ids & set(range(20, 26)) and {4, 6, 7} <= ids
    assert simhash.without_near_copies(none).count() == 0


def _near_components(texts):
    """By brute force over shingles of five words, and of two where fingerprints are close."""
    words = [t.lower().split() for t in texts]
    five, two = [[{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in words] for n in (5, 2)]
    fps = [simhash.word_fingerprint(t.encode()) for t in texts]
    share = lambda s, i, j: len(s[i] & s[j]) / len(s[i] | s[j])
    return _components(len(texts), lambda i, j: share(five, i, j) >= 0.8 or (fps[i] ^ fps[j]).bit_count() <= 6 and share(two, i, j) >= 0.5)


def _kept_ids(spark, texts):
    common.workers_find_library(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in simhash.without_near_copies(df).collect())


def _first_of_each(components):
    return sorted({c: i for i, c in reversed(list(enumerate(components)))}.values())


def test_op6_stage_finds_appended_cut_and_edited_copies(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    texts = []
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 500))]
        n = round(len(words) * r.choice([0.05, 0.1, 0.18, 0.23, 0.3]))
        texts += [" ".join(words), " ".join([words + [r.choice(vocabulary) for _ in range(n)], words[n:], words[:9] + words[9 + n :]][k % 3])]
        words[len(words) // 2] = "edited"
        texts.append(" ".join(words))
    want = _first_of_each(_near_components(texts))
    assert 60 <= len(want) < 120
    assert _kept_ids(spark, texts) == want


def test_op6_stage_finds_short_copies_and_such_without_blanks(spark):
    r = random.Random(12)
    note = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(40))
    few = " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(12))
    han, thai = ["".join(chr(r.randrange(*of)) for _ in range(300)) for of in ((0x4E00, 0x9FA0), (0x0E01, 0x0E2F))]
    texts = [note, note + " end", few, "start " + few, "one two three", "one two three four", "one two three", han, han[:150] + "\u4e01" + han[150:], thai, thai[9:]]
    texts += ["".join(reversed(han)), note[::-1], ""]
    assert _kept_ids(spark, texts) == [0, 2, 4, 5, 7, 9, 11, 12, 13]


def test_op6_stage_keeps_texts_of_one_template(spark):
    """Equal longer words, so equal fingerprints, but other values between them, or another order; an edited form is a copy."""
    r = random.Random(13)
    labels = ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(30)]
    filled = lambda: " ".join(f"{x} {r.randrange(9999)} {r.randrange(9999)}" for x in labels)
    texts = [filled() for _ in range(12)]
    shuffled = list(labels)
    r.shuffle(shuffled)
    texts += [" ".join(labels), " ".join(shuffled), texts[3].replace(labels[7], labels[7] + " x")]
    assert len({simhash.word_fingerprint(t.encode()) for t in texts[:13]}) == 1
    assert _kept_ids(spark, texts) == list(range(14))


def _shuffled(plan):
    """What the plan scans below an exchange."""
    lines, depth, under = plan.splitlines(), [], []
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-"))
        depth = [d for d in depth if d < at]
        if "FileScan" in line and depth:
            under.append(line)
        if re.search(r"\bExchange ", line):
            depth.append(at)
    return under


def test_op6_stage_shuffles_no_texts(spark, monkeypatch):
    """Neither for the words of candidates nor for the rows that stay, though no table is small enough to be broadcast."""
    common.workers_find_library(spark)
    r = random.Random(14)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[3] + " end", texts[5]])), "doc_id long, text string").repartition(3)
    plans, write = {}, simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = simhash.without_near_copies(df)
        plans["kept"] = left._jdf.queryExecution().executedPlan().toString()
        assert sorted(x.doc_id for x in left.collect()) == list(range(30))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in ("near-words", "kept"):
        scans = _shuffled(plans[name])
        assert scans and not [x for x in scans if re.search(r"\btext#", x)], name


def test_op6_links_of_a_dense_group_are_few_and_connect(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 3).astype(np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)) for b in base]))
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "_fp long")).collect()
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    joined = {frozenset((at[a.src], at[a.dst])) for a in links}
    got = _components(len(fp), lambda i, j: frozenset((i, j)) in joined)
    want = _components(len(fp), lambda i, j: int(fp[i] ^ fp[j]).bit_count() <= 4)
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want, strict=True))) == len(set(want))


def test_op6_many_probes_on_few_index_rows(spark):
    """60,000 fingerprints one bit away from a key with 5: what a block holds stays bounded, and every link is found."""
    r = np.random.default_rng(3)
    first, second = simhash._segment_mask(0, 5), simhash._segment_mask(1, 5)
    free = ~(first | second)
    key = r.integers(0, 2**63, 1).astype(np.uint64)[0] & (first | second)
    flip = np.uint64(1 << simhash._second(0, 5, 4)[0])
    index = key | (r.integers(0, 2**63, 5).astype(np.uint64) & free)
    probes = np.unique((key ^ flip) | (r.integers(0, 2**63, 60_000).astype(np.uint64) & free))
    near = (index ^ flip) ^ np.uint64(1 << 63)
    fp = np.unique(np.concatenate((index, probes, near)))
    df = common.materialise(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "_fp long"), "probes")
    heavy = {x._key: x for x in simhash._heavy_keys(df, 5, 4, 2048).collect()}
    of = heavy[int(simhash._named(key[None] if np.ndim(key) else np.array([key]), 0).view(np.int64)[0])]
    assert of._lefts == 1 and of._rights >= 29
    sizes = []
    dealt = simhash._dealt(df, 4, 5, 2048)
    for x in dealt.groupBy("_key", "_block").count().collect():
        sizes.append(x["count"])
    assert max(sizes) <= 2 * 2048 + 600
    linked = {frozenset((x.src, x.dst)) for x in simhash.near_links(df).collect()}
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    label = np.arange(len(fp))
    for pair in linked:
        a, b = (label[at[x]] for x in pair) if len(pair) == 2 else (0, 0)
        label[label == max(a, b)] = min(a, b)
    for x, y in zip(index.view(np.int64).tolist(), near.view(np.int64).tolist(), strict=True):
        assert label[at[x]] == label[at[y]]


def test_op2(docs, none):
    rows = sharding.kd_shards(docs, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((x[0], len(raw(x[1])) + 1, zlib.crc32(raw(x[1]))) for x in ROWS)
    slots: dict = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.kd_shards(none, 8).count() == 0


def test_op2_is_even_with_a_hot_group(spark):
    r = random.Random(2)
    rows = [(i, "copy " * 40 if i % 3 == 0 else "x" * r.randint(1, 400), "en", "s", 1) for i in range(6000)]
    found = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(found) == 8 and max(x.b for x in found) < 1.1 * min(x.b for x in found)


def test_op2_is_even_with_rows_that_repeat_one_another(spark):
    r = random.Random(3)
    for doc_id in (None, 7):
        rows = [(doc_id, "copy " * 40, "en", "s", 1) if i % 3 == 0 else (i, "x" * r.randint(1, 400), "en", "s", 1) for i in range(6000)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        found = sharding.kd_shards(df, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
        assert len(found) == 8 and max(x.b for x in found) - min(x.b for x in found) <= 3 * 401
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text in all rows").alias("text"))
    for shards in (8, 5):
        rows = sharding.kd_shards(same, shards).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
        assert len(rows) == shards and all(x.last == x.n - 1 for x in rows)
        assert max(x.n for x in rows) - min(x.n for x in rows) <= 6


def test_op2_cuts_at_most_one_group_at_a_boundary(spark):
    r = random.Random(4)
    rows = [(i, f"text {i // 5 % 300} " * (1 + i // 5 % 300 % 7), r.choice(["en", "de"]), "s") for i in range(3000)]
    found = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8)
    cut = found.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert cut <= 7


def test_op2_cuts_at_most_one_of_many_groups_at_one_place(spark):
    """Without ids, and with texts of one size, all groups lie at one place; their first hash bits are often alike."""
    df = spark.range(120_000).select(F.lit(None).cast("long").alias("doc_id"), F.lpad((F.col("id") % 40_000).cast("string"), 6, "0").alias("text"))
    found = sharding.kd_shards(df, 8)
    sizes = [x["count"] for x in found.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 7
    assert found.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() <= 7


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_op2_equals_a_tree_in_memory(spark, shards):
    """Distinct sizes and ids far apart: every point has a place of its own in both dimensions."""
    r = random.Random(shards)
    ids = r.sample(range(10_000), 200)
    rows = [(i, "x" * n) for i, n in zip(ids, r.sample(range(1, 900), 200), strict=True)]
    points = [{"doc_id": i, "d_size": len(t) + 1, "d_doc": i} for i, t in rows]
    dims = ["d_size", "d_doc"]
    ends = {d: (min(p[d] for p in points), max(p[d] for p in points)) for d in dims}
    place = lambda p, d: int((p[d] - ends[d][0]) / (ends[d][1] - ends[d][0]) * (2**24 - 1))
    want = {}

    def split(of, first, count):
        if count == 1:
            want.update({p["doc_id"]: first for p in of})
            return
        widest = max(dims, key=lambda d: max(place(p, d) for p in of) - min(place(p, d) for p in of))
        of = sorted(of, key=lambda p: place(p, widest))
        goal = count // 2 / count * sum(p["d_size"] for p in of)
        sums = np.cumsum([p["d_size"] for p in of])
        at = int(np.searchsorted(sums, goal))
        at += int(sums[at] - goal <= goal - (sums[at - 1] if at else 0))
        split(of[:at], first, count // 2)
        split(of[at:], first + count // 2, count - count // 2)

    split(points, 0, shards)
    found = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
    assert {x.doc_id: x.shard for x in found} == want


def test_op4(docs, none):
    rows = {(r.doc_id, r.kept_sha256): r for r in passages.without_repeats(docs).collect()}
    planted = [i for i in range(26, 30)]
    by_id = {k[0]: r for k, r in rows.items() if k[0] is not None}
    assert by_id[26].n_removed == 0
    for i in planted[1:]:
        assert by_id[i].words_removed >= 45 and by_id[i].repeats == [26]
    for i in (4, 5, 6, 7):
        assert by_id[i].n_removed == 0
    for i in (30, 31, 32):
        assert by_id[i].repeats == [4]
    left = passages.passages_removed(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[0] is None and texts[1] == "" and texts[7] == ROWS[7][1] and len(texts[27]) < len(ROWS[27][1])
    assert passages.without_repeats(none).count() == 0 == passages.passages_removed(none).count()


def test_op4_links_near_copies_of_paragraphs(spark):
    """Paragraphs that differ in their last word have Jaccard of at least 0.8 if long; brute force agrees on the components."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    base = [[r.choice(vocabulary) for _ in range(300)] for _ in range(4)]
    rows = []
    for i in range(24):
        words = list(base[i % 4])
        words[r.randrange(300)] = "edited"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    common.workers_find_library(spark)
    of = passages.Cut(*common.binaries(pa.array([t.encode() for _, t in rows]))).paragraphs
    value, first = of.shingles(np.arange(len(of.first)))
    sets = {int(h): set(value[first[k] : first[k + 1]].tolist()) for k, h in enumerate(of.h.view(np.int64))}
    hashes = sorted(sets)
    close = lambda i, j: len(sets[hashes[i]] & sets[hashes[j]]) >= 0.8 * len(sets[hashes[i]] | sets[hashes[j]])
    want = Counter(_components(len(hashes), close))
    got = passages.similar_paragraphs(df, common.materialise(passages.units(df), "t"), "text").groupBy("component").count().collect()
    assert sorted(x["count"] for x in got) == sorted(n for n in want.values() if n > 1)


def test_op4_recall_of_near_copies_inside_lines(spark):
    """Passages of 50 to 200 words, each set into two texts of one line with up to four words changed, left out or put in
    between: of those that share 0.8 of their five-word shingles at least 0.9 go, and of their words 0.85; little else goes."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    set_of = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, sizes = [], {}
    while len(sizes) < 250:
        passage = some(r.randint(50, 200))
        words = list(passage)
        for at in sorted(r.sample(range(1, len(words) - 1), r.randint(1, 4)), reverse=True):
            words[at : at + r.randint(0, 1)] = some(r.randint(0, 1))
        a, b = set_of(passage), set_of(words)
        if a != b and len(a & b) >= 0.8 * len(a | b):
            sizes[len(rows) + 1] = len(words)
            rows += [(len(rows) + k, " ".join(some(150) + w + some(150))) for k, w in enumerate((passage, words))]
    common.workers_find_library(spark)
    got = {x.doc_id: x for x in passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(got[i - 1].words_removed == 0 and got[i].repeats in ([], [i - 1]) for i in sizes)
    assert sum(got[i].words_removed >= 0.5 * n for i, n in sizes.items()) >= 0.9 * len(sizes)
    assert sum(got[i].words_removed for i in sizes) >= 0.85 * sum(sizes.values())
    assert all(got[i].words_removed <= n + 1 for i, n in sizes.items())


def test_op4_recall_of_near_copies(spark):
    """Paragraphs of 60 to 200 words with a few edited words, among others: of the pairs that brute force finds at five-word
    Jaccard of 0.8 or more at least 0.95 are in one class, and every class is connected by such pairs."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    texts = []
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 200))]
        for edits in (0, 1, 2, 3):
            words = list(base)
            for at in r.sample(range(len(words)), edits):
                words[at] = "edited"
            texts.append(" ".join(words))
    df = spark.createDataFrame([(i, f"{t}\nown line {i}") for i, t in enumerate(texts)], "doc_id long, text string")
    common.workers_find_library(spark)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    cut = passages.Cut(*common.binaries(pa.array([t.encode() for t in texts]))).paragraphs
    named = {x.h: x.component for x in passages.similar_paragraphs(df, common.materialise(passages.units(df), "t"), "text").collect()}
    of = [named.get(h) for h in cut.h.view(np.int64).tolist()]
    assert len(pairs) > 100
    assert sum(of[i] is not None and of[i] == of[j] for i, j in pairs) >= 0.95 * len(pairs)
    want = _components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    for c in {x for x in of if x is not None}:
        assert len({want[i] for i, x in enumerate(of) if x == c}) == 1


ODD = ["my col", "a.b", "a:b", "row", "d", "_part", "h", "t", "_key", "back`tick", "marks", "size", "none"]


def test_columns_of_any_name_are_kept(spark, none):
    """Every operator and stage that returns its input's columns, with names that need quoting or that it uses itself."""
    common.workers_find_library(spark)
    texts = [None, "", "a text of some words that is long enough to be cut", "a text of some words that is long enough to be cut", "another"]
    rows = [(i, t, *range(len(ODD))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{common.quoted(c)} int" for c in ODD))
    labels = spark.createDataFrame([(2, 1), (4, 0)], "doc_id long, quality int")
    model = quality.fit_quality(df, labels)
    kept = {
        "quality": quality.scored(df, model).drop("score"), "media": media.rgb_tensors(media.with_media(df)).drop("n_bytes", "media", "height", "width", "rgb"),
        "bpe": bpe.encode_decode(df, bpe.vocabulary()).drop("ids", "decoded"), "exact": exact.without_copies(df), "near": simhash.without_near_copies(df), "passages": passages.passages_removed(df),
    }
    for name, got in kept.items():
        assert got.columns == df.columns, name
        assert all(list(r)[2:] == list(range(len(ODD))) for r in got.collect()), name
    others = (sharding.kd_shards(df, 3), lines.frequent_lines_dropped(df), simhash.near_duplicates(df), passages.without_repeats(df), exact.exact_groups(df), packing.packed_documents(df, bpe.vocabulary()), bpe.bpe_digests(df, bpe.vocabulary()), counts.token_counts(df, bpe.vocabulary("piece_bpe_32k.model")))
    assert all(got.select("doc_id").distinct().count() == 5 for got in others)


def test_texts_longer_than_a_slice(spark):
    """One row above every operator's slice: it is a batch of its own, and whole."""
    common.workers_find_library(spark)
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    long = " ".join(r.choice(vocabulary) for _ in range(950_000))
    df = spark.createDataFrame([(0, "short"), (1, long), (2, "short too")], "doc_id long, text string").repartition(1)
    assert len(long) > 6_000_000
    t = tokenizer(bpe.vocabulary())
    n = len(t.encode(long, add_special_tokens=False).ids)
    assert {x.doc_id: x.n_tokens for x in bpe.bpe_digests(df, bpe.vocabulary()).collect()}[1] == n
    assert packing.packed_documents(df, bpe.vocabulary()).where("doc_id = 1").count() == -(-(n + 1) // 2048)
    assert {x.doc_id: x.payload_sha256 for x in media.media_digests(media.with_media(df).select("doc_id", "n_bytes", "media")).collect()}[1] == hashlib.sha256(media.padded(long.encode())).hexdigest()
    assert {x.doc_id: x.kept_sha256 for x in lines.frequent_lines_dropped(df).collect()}[1] == hashlib.sha256(long.encode()).hexdigest()
    assert {x.doc_id: x.fingerprint for x in simhash.near_duplicates(df).collect()}[1] == f"{simhash.fingerprint(long.encode(), 4):016x}"
    assert exact.exact_groups(df).where("kept").count() == 3
    assert {x.doc_id: x.size for x in sharding.kd_shards(df, 2).collect()}[1] == len(long) + 1
    assert {x.doc_id: x.kept_sha256 for x in passages.without_repeats(df).collect()}[1] == hashlib.sha256(long.encode()).hexdigest()
    model = quality.fit_quality(df, spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int"))
    assert quality.scored(df, model).count() == 3


def test_op1(spark, docs, none):
    r = random.Random(1)
    rows, known = [], []
    for i in range(300):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 200))]
        good = i % 4 != 0
        rows.append((i, " ".join(words) if good else "!! ".join(words).upper()))
        known.append((i, int(good), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(known + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(df, labels.where(quality.remainder() != 0))
    held = quality.scored(df, model).join(labels, "doc_id").where((quality.remainder() == 0) & F.col("quality").isNotNull()).collect()
    assert np.mean([(x.score >= 0.3) == (x.quality == 1) for x in held]) > 0.95
    out = quality.scored(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert all(0 <= x.score <= 1 for x in out.select("score").collect())
    assert quality.scored(none, model).count() == 0
    assert quality.fit_quality(df, labels.limit(0)) is None and {x.score for x in quality.scored(df, None).collect()} == {0.5}


def test_op1_scores_equal_the_definition(spark, docs):
    """Attention and score of each text by plain loops over its passages."""
    df = spark.createDataFrame([(i, ("good words here " if i % 2 else "BAD !! ") * (30 + 9 * i)) for i in range(20)], "doc_id long, text string")
    model = quality.fit_quality(df, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))

    def slow(text):
        x, _ = quality.encode(*common.binaries(pa.array([raw(text)], pa.binary())))
        weights, hidden = [], []
        for row in x.astype(float):
            h = [min(max((v - m) / s, -8), 8) for v, m, s in zip(row, model.mean, model.scale, strict=True)]
            e = 0.0
            for j, w in enumerate(model.w):
                gate = 1 / (1 + np.exp(-sum(a * b for a, b in zip(h, model.u[:, j], strict=True))))
                e += w * np.tanh(sum(a * b for a, b in zip(h, model.v[:, j], strict=True))) * gate
            weights.append(np.exp(e))
            hidden.append(h)
        z = [sum(a * h[j] for a, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(len(hidden[0]))]
        return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(z, model.c, strict=True)) + model.b)))

    for r in quality.scored(docs.select("text"), model).collect():
        assert r.score == pytest.approx(slow(r.text), abs=1e-4)


def test_op1_sample_is_bounded_in_passages(spark, monkeypatch):
    """Long texts are left out of fitting beyond the bound of one document, and others once the bound of all is reached."""
    df = spark.createDataFrame([(i, "word " * (64 * 50 if i == 3 else 64 * 2)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fitted = []
    monkeypatch.setattr(quality.GatedAttention, "fit", classmethod(lambda cls, x, first, y: fitted.append((len(x), np.diff(first).tolist(), len(y)))))
    quality.fit_quality(df, labels, passages=21, longest=10)
    quality.fit_quality(df, labels)
    quality.fit_quality(df, labels, rows=7, longest=10)
    assert fitted[0] == (20, [2] * 10, 10) and fitted[1][2] == 40 and 50 in fitted[1][1] and fitted[2][2] in (6, 7)


def test_pipeline_stages_follow_their_brute_force(spark, tmp_path):
    """Each stage on its own input: the documents that it keeps, their columns, and the packing of what is left."""
    base = [x[:5] for x in ROWS]
    spark.createDataFrame(base, ", ".join(SCHEMA.split(", ")[:5])).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 34), 0) for i in range(35)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.documents(spark, str(tmp_path))
    model = quality.fit_quality(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").where(quality.remainder() != 0))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rank = lambda r: (r.doc_id is None, r.doc_id or 0)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.materialise(stage(spark, docs, str(tmp_path)), "test-stage")
        was, now = before.collect(), docs.collect()
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality classifier":
            x, first = quality.encode(*common.binaries(pa.array([raw(r.text) for r in was], pa.binary())))
            assert Counter(now) == Counter(r for r, s in zip(was, model.score(x, first), strict=True) if s >= 0.3)
        elif name == "exact dedup":
            best: dict = {}
            for r in was:
                best.setdefault(norm(r.text), []).append(r)
            want = [min(of, key=lambda r: (-len(r.text or ""), *rank(r))) for of in best.values()]
            assert Counter((r.doc_id, r.text or "") for r in now) == Counter((r.doc_id, r.text or "") for r in want)
        elif name == "SimHash near-dedup":
            of = _near_components([r.text or "" for r in was])
            kept = {c: min((r for r, k in zip(was, of, strict=True) if k == c), key=rank).doc_id for c in of}
            assert Counter(r.doc_id for r in now) == Counter(kept.values())
        elif name == "substring dedup":
            assert Counter(r.doc_id for r in now) == Counter(r.doc_id for r in was)
            assert all(r.n_chars == len(r.text) for r in now if r.text is not None)
            told = {r.doc_id: r.kept for r in passages.without_repeats(before).collect()}
            assert all(told[r.doc_id] == (r.text or "") for r in now)
        else:
            t = tokenizer(bpe.vocabulary())
            tokens = [len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in was]
            assert len(now) == sum(-(-n // 2048) for n in tokens) and sum(r.length for r in now) == sum(tokens)
            assert len({r.sequence_id for r in now}) <= -(-sum(tokens) // 2048) + 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(7, 60)) and 3 not in got


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and all(isinstance(x, str) for x in registry.ORACLE_SQL.values())
