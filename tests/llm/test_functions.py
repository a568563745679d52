"""The parts that need no Spark, against brute force, libraries and round trips."""

from __future__ import annotations

import itertools
import random
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import bpe, counts, exact, jpeg, lines, media, packing, passages, quality, simhash
from quillgraph.llm.common import binaries
from quillgraph.llm.words import tokenizer

ODD = ["", " ", "a", "<|startoftext|>hi<|endoftext|>", "é́ Å ﬁ Σας İstanbul 中文 😀😀 1²Ⅷ", "it's WE'LL don’t", "a\x1cb\x85c d e", "x" * 3000, "<|start", "'''s's", "Ⱥ ß ẞ", "12 345", "a b", "\n\t y\n", "|" * 200]


def test_bpe_equals_library():
    t, coder = tokenizer(bpe.vocabulary()), bpe.piece_coder(bpe.vocabulary(), True)
    for text, (ids, said) in zip(ODD, coder.coded(pa.array([x.encode() for x in ODD], pa.binary()), True), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert bytes(said[:-1]).decode() == t.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_library_on_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    (ids, _), = bpe.piece_coder(bpe.vocabulary(), True).coded(pa.array([text.encode()], pa.binary()), True)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tokenizer(bpe.vocabulary()).encode(text, add_special_tokens=False).ids


def test_segment_trees_in_step_equal_single_ones():
    b = bpe.SegmentTreeBpe(bpe.vocabulary())
    r = random.Random(1)
    pieces = ["".join(r.choice("abñé1'x") for _ in range(r.randint(1, 90))) for _ in range(300)]
    assert b.encode_many(pieces) == [bpe.packed(b.encode(x)) for x in pieces]


def test_viterbi_counts_equal_library_with_ties():
    from tokenizers import Tokenizer, models

    for trial in range(80):
        r = random.Random(trial)
        vocab = {"<unk>": -1.0}
        for _ in range(r.randint(2, 12)):
            vocab["".join(r.choice("ab▁c") for _ in range(r.randint(1, 4)))] = float(-r.randint(0, 3))
        library = Tokenizer(models.Unigram(list(vocab.items()), 0, False))
        own = counts.UnigramCounter(list(vocab.items())[1:], False)
        own.unknown = min(vocab.values()) - 10
        for _ in range(15):
            text = "".join(r.choice("ab▁cd") for _ in range(r.randint(1, 14)))
            assert own.viterbi(text)[0] == len(library.encode(text).ids)


def test_counts_of_odd_texts():
    c = counts.counter(counts.vocabulary("piece_bpe_32k.model"))
    n, score = c.counts(["", "a", "a a", "   "])
    assert n[0] == 0 and score[0] == 0 and n[1] >= 1
    for text, k in zip(["  a  b ", "é中文😀 日本", "a\nb"], c.counts(["  a  b ", "é中文😀 日本", "a\nb"])[0], strict=True):
        assert c.viterbi("▁" + text.replace(" ", "▁"))[0] == k


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 30000])
def test_jpeg_round_trip(n):
    for raw in (random.Random(n).randbytes(n), b"a" * n):
        payload = media.padded(raw)
        frame = jpeg.decode(jpeg.encode_payload(payload))
        assert jpeg.payload_of(frame) == payload
        assert jpeg.rgb(frame).shape == (frame.height, frame.width, 3)


def test_jpeg_refinement_of_any_coefficients():
    """A gray image with zero runs, end-of-band runs, ZRL and new coefficients in refinement, written bit by bit."""
    r = random.Random(4)
    blocks = 12
    want = np.zeros((blocks, 64), np.int32)
    for b in range(blocks):
        for k in range(1, 64):
            if r.random() < (0.15 if b % 3 else 0.0):
                want[b, k] = r.choice([-3, -2, -1, 1, 2, 3])
    want[0, 20] = 1
    first = [0] * 16
    first[7] = 160
    symbols = [16 * run + size for run in range(16) for size in range(10)]
    code = {s: f"{i:08b}" for i, s in enumerate(symbols)}

    def stuffed(bits: str) -> bytes:
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    def eob(run: int) -> str:
        n = run.bit_length() - 1
        return code[16 * n] + (f"{run - (1 << n):0{n}b}" if n else "")

    high = np.sign(want) * (np.abs(want) >> 1)
    out = ""
    for b in range(blocks):
        zeros, cells = 0, [k for k in range(1, 64) if high[b, k]]
        for k in range(1, (cells[-1] if cells else 0) + 1):
            v = int(high[b, k])
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                out += code[0xF0]
                zeros -= 16
            size = abs(v).bit_length()
            out += code[16 * zeros + size] + f"{v if v > 0 else v + (1 << size) - 1:0{size}b}"
            zeros = 0
        if not cells or cells[-1] < 63:
            out += eob(1)
    scan_first = stuffed(out)
    out = ""
    for b in range(blocks):
        new = [k for k in range(1, 64) if want[b, k] and not high[b, k]]
        zeros, pending = 0, ""
        for k in range(1, (new[-1] if new else 0) + 1):
            if high[b, k]:
                pending += str(abs(int(want[b, k])) & 1)
            elif want[b, k]:
                out += code[16 * zeros + 1] + ("1" if want[b, k] > 0 else "0") + pending
                zeros, pending = 0, ""
            else:
                zeros += 1
                if zeros == 16:
                    out += code[0xF0] + pending
                    zeros, pending = 0, ""
        last = new[-1] if new else 0
        if last < 63:
            out += eob(1) + pending + "".join(str(abs(int(want[b, k])) & 1) for k in range(last + 1, 64) if high[b, k])
    scan_second = stuffed(out)
    dht = bytes([0x10]) + bytes(first) + bytes(symbols)
    raw = b"".join([
        b"\xff\xd8", jpeg._segment(0xDB, bytes([0] + [1] * 64)), jpeg._segment(0xC2, struct.pack(">BHHB", 8, 24, 32, 1) + bytes([1, 0x11, 0])), jpeg._segment(0xC4, dht),
        jpeg._scan([(1, 0)], 1, 63, 0, 1, scan_first), jpeg._scan([(1, 0)], 1, 63, 1, 0, scan_second), b"\xff\xd9",
    ])
    assert (jpeg.decode(raw).components[0].coefficients == want).all()


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_once_and_fills(seed):
    r = random.Random(seed)
    lengths = {r.randint(1, 128): r.randint(1, 40) for _ in range(60)}
    found = packing.plan(lengths, 128)
    used: dict[int, int] = {}
    for times, parts in found:
        assert sum(x * n for x, n in parts) <= 128
        for x, n in parts:
            used[x] = used.get(x, 0) + times * n
    assert used == lengths
    bins: list[int] = []
    for x in sorted((x for x, n in lengths.items() for _ in range(n)), reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= x]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= x
        else:
            bins.append(128 - x)
    assert sum(t for t, _ in found) <= len(bins)  # best-fit decreasing without the index of sums


def test_plan_fills_exactly_where_sums_allow():
    """Gaps that only a single, a pair, or a triple of the available lengths fills, under their counts."""
    for lengths, sequences in (({90: 2, 10: 2}, 2), ({90: 1, 7: 1, 3: 1}, 1), ({90: 1, 5: 1, 3: 1, 2: 1}, 1), ({60: 3, 20: 6}, 3), ({70: 2, 30: 1, 20: 1, 10: 1}, 2), ({50: 4}, 2)):
        found = packing.plan(lengths, 100)
        assert sum(t for t, _ in found) == sequences and all(sum(x * n for x, n in parts) == 100 for _, parts in found)


def test_sums_follow_the_counts():
    left = [0] * 101
    for x, n in ((40, 1), (30, 2), (20, 2), (10, 1)):
        left[x] = n
    index = packing.SumIndex(left)
    assert index.exact(30) == (30,) and index.exact(80) == (40, 30, 10) and index.exact(60) == (40, 20) and index.exact(95) is None and index.pair(60) == (40, 20) and index.triple(80) == (40, 30, 10)
    left[40] = 0
    assert index.pair(60) == (30, 30) and index.triple(80) == (30, 30, 20) and index.triple(80, 30) is None
    left[30] = 1
    assert index.pair(60) is None and index.triple(80) is None and index.triple(60) == (30, 20, 10)


@pytest.mark.parametrize("seed", range(4))
def test_an_exact_filling_is_found_whenever_there_is_one(seed):
    """Random multisets, some of them used up on the way: one to three lengths with the sum, and the longest member of all such."""
    r = random.Random(seed)
    for _ in range(400):
        left = [0] * 31
        for _ in range(r.randint(1, 9)):
            left[r.randint(1, 14)] += 1
        index = packing.SumIndex(left)
        for _ in range(4):
            total, there = r.randint(1, 28), [x for x in range(31) for _ in range(left[x])]
            fillings = [c for k in (1, 2, 3) for c in itertools.combinations(there, k) if sum(c) == total]
            got = index.exact(total)
            assert (got is None) == (not fillings)
            if got:
                assert sum(got) == total and not Counter(got) - Counter(there) and max(got) == max(map(max, fillings))
                for x in got:
                    left[x] -= 1


def test_triples_without_the_longest_fitting_length():
    """Two sequences are filled exactly only if 2038 takes 5, 4 and 1, though 7 fits."""
    found = packing.plan(Counter([2038, 2037, 7, 5, 4, 4, 1]), 2048)
    assert sum(t for t, _ in found) == 2 and all(sum(x * n for x, n in parts) == 2048 for _, parts in found)


def test_plan_edges():
    assert packing.plan({}, 8) == []
    assert packing.plan({8: 3}, 8) == [(3, [(8, 1)])]
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


@pytest.mark.parametrize("k", [1, 13, 40, 60])
def test_golomb_round_trip(k):
    values = np.unique(np.random.default_rng(k).integers(0, 1 << min(62, k + 8), 500).astype(np.uint64))
    assert (exact.golomb_decode(exact.golomb_encode(values, k), len(values), k) == values).all()


def test_fingerprint_by_definition():
    import xxhash

    assert simhash.fingerprint(b" \n ", 4) == 0
    text = b"One two THREE four five one two three four"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    assert simhash.fingerprint(text, 4) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_chain_keys_meet_for_every_close_pair():
    r = np.random.default_rng(2)
    for segments, distance in ((5, 4), (7, 6)):
        a = r.integers(0, 2**63, 300).astype(np.uint64)
        b = a.copy()
        for i in range(len(b)):
            for bit in r.choice(64, r.integers(0, distance + 1), replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        if not (np.bitwise_count(a ^ b) <= distance).all():
            raise AssertionError
        ka, _, pa_ = simhash._chain_keys(a, segments, distance)
        kb, _, pb = simhash._chain_keys(b, segments, distance)
        n = len(a)
        for i in range(n):
            met = set(ka[~pa_][i::n].tolist()) & set(kb[i::n].tolist())
            # at one of the positions where they meet, every chain keeps its share
            assert any(simhash._forest(a[i : i + 1], b[i : i + 1], key & 7, segments, distance) for key in met) or a[i] == b[i]


def test_chains_prune_before_the_whole_count():
    """A pair whose third segment alone exceeds its share is dropped though the key is met; no far pair is linked."""
    one = np.zeros(1, np.uint64)
    third = simhash._segment_mask(2, 5)
    far = np.array([int(third) & -int(third) | 1 << 63], np.uint64)
    spread = np.array([sum(1 << b for b in range(64) if int(third) >> b & 1)], np.uint64)
    assert simhash._forest(one, spread, 0, 5, 4) == []
    assert simhash._forest(one, far, 0, 5, 4) != []


def test_large_groups_pass_on_as_they_come(monkeypatch):
    r = np.random.default_rng(0)
    rows = np.array(sorted(zip(r.integers(0, 40, 5000).tolist(), r.integers(0, 300, 5000).tolist(), strict=True)))

    def run(size):
        out: dict = {}
        batches = (pa.RecordBatch.from_arrays([pa.array(rows[a : a + size, k]) for k in (0, 1)], names=["key", "h"]) for a in range(0, len(rows), size))
        for b in passages.grouped(batches):
            for key, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.setdefault(key, []).append(h)
        return sorted(map(sorted, out.values()))

    whole = run(5000)
    assert whole == sorted(sorted(set(rows[rows[:, 0] == k, 1].tolist())) for k in range(40))
    monkeypatch.setattr(passages, "CARRIED", 20)
    assert run(7) == run(100) == whole


def test_paragraphs_do_not_depend_on_neighbours():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    inner = " ".join(words[100:180])
    texts = ["", "a", " ".join(words[:100]) + " " + inner, "Other start, " + inner.upper() + "! and an end.", "la " * 50]
    whole = passages.Cut(*binaries(pa.array([x.encode() for x in texts], pa.binary())))
    for k, text in enumerate(texts):
        alone = passages.Cut(*binaries(pa.array([text.encode()], pa.binary())))
        for own, every in ((alone.cuts, whole.cuts), (alone.paragraphs, whole.paragraphs)):
            assert (own.h == every.h[every.by_text[k] : every.by_text[k + 1]]).all() and (own.g == every.g[every.by_text[k] : every.by_text[k + 1]]).all()
    shared = set(whole.cuts.h[whole.cuts.text == 2].tolist()) & set(whole.cuts.h[whole.cuts.text == 3].tolist())
    assert len(shared) >= 3


def test_passages_grow_over_edits():
    words = np.arange(100, 260, dtype=np.uint32)
    edited = np.concatenate((words[:20], words[21:40], [7], words[41:60], [8, 9], words[60:]))
    assert passages.grown(words.tobytes(), edited.astype(np.uint32).tobytes()) == [(20, 20), (40, 39), (60, 59), (160, 161)]
    assert passages.grown(b"", words.tobytes()) == [(0, 0)] == passages.grown(words.tobytes(), words[::-1].tobytes())
    seed, none = words[:11], np.empty(0, np.uint32)
    assert passages.grown_passage(seed, (none, None), (none, None)) is None
    assert passages.grown_passage(seed, (none, None), (words[11:20], words[11:20])) == (0, 9)
    one = np.concatenate((words[11:30], [5], words[31:60])).astype(np.uint32)
    assert passages.grown_passage(seed, (none, None), (one, words[11:60])) == (0, 49)
    assert passages.grown_passage(seed, (none, None), (one[:30], words[11:41])) == (0, 19)  # beyond the edit it would be below 0.8
    many = words[11:75].copy()
    many[::8] = 5
    assert passages.grown_passage(seed, (none, None), (many, words[11:75])) is None


def test_paragraphs_are_lines():
    texts = ["one two\nthree\n\n four five six \n", "x", "\n\n"]
    cut = passages.Cut(*binaries(pa.array([x.encode() for x in texts], pa.binary())))
    assert cut.paragraphs.size.tolist() == [2, 1, 3, 1] and cut.paragraphs.text.tolist() == [0, 0, 0, 1]


def test_bands_reach_recall():
    bands, rows = passages.tuned_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99


def test_line_keys():
    assert lines.keys(b"  A b\t\n\xc3\x89 \x0b\n") == [b"a b", b"\xc3\x89", b""]


def test_quality_encoding_of_a_text_stands_alone():
    texts = ["", "a b c " * 50, "HELLO!! WORLD!!", "  ", "x"]
    x, first = quality.encode(*binaries(pa.array([t.encode() for t in texts], pa.binary())))
    for k, t in enumerate(texts):
        alone, _ = quality.encode(*binaries(pa.array([t.encode()], pa.binary())))
        assert np.allclose(alone, x[first[k] : first[k + 1]], atol=1e-6)


def test_quality_encoding_in_pieces_is_the_same(monkeypatch):
    """Texts longer than a piece, one without blanks too."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdeé|.A1") for _ in range(r.randint(1, 12))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)).replace(" a", "\n a").encode()
    given = binaries(pa.array([prose(5), b"", prose(4000), b"x" * 30000 + b" " + prose(400), prose(70), b"   ", prose(9000)], pa.binary()))
    whole = quality.encode(*given)
    monkeypatch.setattr(quality, "PIECE_BYTES", 5000)
    pieces = quality.encode(*given)
    assert (whole[1] == pieces[1]).all() and np.allclose(whole[0], pieces[0])


def test_caches_are_bounded_by_bytes():
    c = bpe.piece_coder(bpe.vocabulary(), True)
    c.kept.most_bytes = 50_000
    for n in range(60):
        list(c.coded(pa.array([" ".join(f"{n}w{k}" for k in range(40)).encode()], pa.binary()), True))
        assert c.kept.size <= 50_000
    list(c.coded(pa.array([b"y" * 100_000], pa.binary()), True))
    assert "y" * 100_000 not in c.kept.newer and "y" * 100_000 not in c.kept.older


def _slow_rgb(frame):
    """The tensor by the definition of the inverse transform, a sample at a time, in plain Python."""
    from math import cos, pi, sqrt

    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    scale = lambda k: sqrt(1 / 8) if k == 0 else sqrt(2 / 8)
    planes = []
    for c in frame.components:
        step = frame.quantization[c.table]
        plane = {}
        for b, block in enumerate(c.coefficients.tolist()):
            cells = [(v, u, value * int(step[k])) for k, ((v, u), value) in enumerate(zip(order, block, strict=True)) if value]
            for y in range(8):
                for x in range(8):
                    total = sum(scale(u) * scale(v) * value * cos((2 * x + 1) * u * pi / 16) * cos((2 * y + 1) * v * pi / 16) for v, u, value in cells)
                    plane[b // c.stride * 8 + y, b % c.stride * 8 + x] = min(255.0, max(0.0, total + 128))
        planes.append(plane)
    out = np.zeros((frame.height, frame.width, 3))
    for y in range(frame.height):
        for x in range(frame.width):
            lum, cb, cr = planes[0][y, x], planes[1][y // 2, x // 2] - 128, planes[2][y // 2, x // 2] - 128
            out[y, x] = [lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb]
    return np.clip(out, 0, 255)


def test_rgb_tensors_equal_the_definition():
    r = random.Random(8)
    frame = jpeg.decode(jpeg.encode_payload(media.padded(r.randbytes(700))))
    for c in frame.components:  # tamer coefficients, so that few samples are cut off at 0 and 255
        c.coefficients[:] = [[r.randrange(-30, 30) if r.random() < 0.2 else 0 for _ in range(64)] for _ in c.coefficients]
    assert np.abs(jpeg.rgb(frame).astype(float) - _slow_rgb(frame)).max() <= 0.51 + 1e-3


def test_attention_learns_which_passage_counts():
    r = np.random.default_rng(0)
    bags, labels = [], []
    for _ in range(200):
        bag = r.normal(size=(r.integers(1, 6), 4))
        y = r.random() < 0.5
        bag[r.integers(len(bag)), 0] = 4.0 if y else -4.0
        bags.append(bag)
        labels.append(y)
    first = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    m = quality.GatedAttention.fit(np.concatenate(bags), first, np.array(labels, float))
    assert ((m.score(np.concatenate(bags), first) > 0.5) == np.array(labels)).mean() > 0.95
