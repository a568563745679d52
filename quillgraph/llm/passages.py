"""Substring deduplication by MinHash banding of paragraphs.

Two kinds of units are compared. Paragraphs are a text's lines: banded MinHash finds those that are alike, exact Jaccard
verifies them. Cuts are stretches of words between content-defined breaks, so a passage that is set into different
texts at any place is cut alike but for its ends; they are compared for equality. A component of alike paragraphs, and
each set of equal cuts, is a class; the first document that holds one keeps it. Near copies that stand inside other text
have equal cuts beside their edited words: equal cuts are grown over edits, and what they grow to is verified by exact
Jaccard against the first document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LEFT, RIGHT, binaries, column, components, documents, materialise, paired_blocks, quoted, slices, tidy, utf8

#: A break is a place whose word pair has the least hash within so many words on either side.
REACH = 5
#: Shorter cuts (at the ends of texts, and very short texts) are not compared.
LEAST_WORDS = 6
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
#: A run of repeated cuts of one text is removed if it has so many words; shorter paragraphs are not compared.
LEAST_RUN = 20
#: Words on either side of repeated cuts that are looked at for the passage's ends; the next repeated cuts look on from there.
GROWTH = 64
#: Words that an edit inside a near copy takes out here and there, likeliest first, and equal words that must follow it.
EDITS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3))
AGAIN = 4
#: Paragraphs of one band key that one part of a block holds.
BLOCK = 1024
#: Rows of one band key that are held at once.
CARRIED = 50_000
#: Bytes of texts that are cut at a time; a longer text is cut whole.
SLICE_BYTES = 400_000
CUT, PARAGRAPH = 0, 1

#: Words are runs of letters and digits; A-Z lower-cased.
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_OTHER = np.uint64(0xA0761D6478BD642F)


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 4) -> tuple[int, int]:
    """(bands, rows) with the fewest bands whose chance 1 - (1 - s**rows)**bands of meeting at ``similarity`` reaches ``recall``."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands, rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _ODD) -> np.ndarray:
    """64-bit hash of each span of ``values``: sums of value * odd**i, moved to a common start."""
    n = len(values) + 1
    powers = np.cumprod(np.full(n, base, np.uint64))
    inverses = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((values + np.uint64(1)) * powers[:-1], dtype=np.uint64)))
    return _mixed((sums[ends] - sums[starts]) * inverses[starts])


def halves(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(32)).astype(np.uint32)


class Spans:
    """Stretches of words, by their first words: text, number within it, size, and 128 bits (h, g) that tell their words apart."""

    def __init__(self, cut: Cut, first: np.ndarray):
        n = len(cut.words)
        self.words, self.first = cut.words, first
        self.last = np.append(first[1:], n) if len(first) else first
        self.text = cut.word_text[first]
        self.by_text = np.searchsorted(self.text, np.arange(cut.texts + 1))
        self.number = np.arange(len(first)) - self.by_text[self.text]
        self.size = self.last - first
        self.h = _spans_hash(cut.words, first, self.last) if n else np.empty(0, np.uint64)
        self.g = _spans_hash(_mixed(cut.words ^ _OTHER), first, self.last, _ODD ^ 0x5A5A5A5A5A5A5A5A) if n else np.empty(0, np.uint64)

    def shingles(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all word shingles of the stretches ``of``, index of each one's first and the end); a short one is one shingle."""
        count = np.maximum(self.size[of] - SHINGLE + 1, 1)
        index = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(self.first[of] - index[:-1], count) + np.arange(index[-1])
        value = _spans_hash(self.words, at, np.minimum(at + SHINGLE, np.repeat(self.last[of], count))) if len(at) else np.empty(0, np.uint64)
        return value, index

    def band_keys(self, of: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """[stretch, band]"""
        value, index = self.shingles(of)
        out = np.empty((len(of), bands), np.uint64)
        if not len(of):
            return out
        for b in range(bands):
            key = np.full(len(of), np.uint64((b + 1) * _ODD & (2**64 - 1)))
            for r in range(rows):
                seed = np.uint64(((b * rows + r) * 2 + 1) * 0xC2B2AE3D27D4EB4F & (2**64 - 1))
                key = _mixed(key * np.uint64(3) + np.minimum.reduceat(_mixed(value ^ seed), index[:-1]))
            out[:, b] = key
        return out


class Cut:
    """The cuts and paragraphs of texts given as bytes one after another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.texts = len(offsets) - 1
        lines = np.flatnonzero(data == 0x0A)
        data = np.frombuffer(data.tobytes().translate(_WORD), np.uint8)
        solid = np.concatenate(([False], data != 0x20, [False]))
        begin = solid[1:-1] & ~solid[:-2]
        inner = offsets[1:-1][offsets[1:-1] < len(data)]
        begin[inner] = solid[1:-1][inner]  # a text's first byte begins a word
        stop = solid[1:-1] & ~solid[2:]
        last = offsets[1:][offsets[1:] > 0] - 1
        stop[last] |= solid[1:-1][last]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        n = len(self.starts)
        self.words = _spans_hash(data.astype(np.uint64), self.starts, self.ends) if n else np.empty(0, np.uint64)
        self.word_text = np.searchsorted(offsets, self.starts, "right") - 1
        self.before = before = np.searchsorted(self.starts, offsets)
        pair = _mixed(self.words * np.uint64(3) + np.append(self.words[1:], np.uint64(0))) if n else self.words
        most = np.uint64(2**64 - 1)
        breaks = np.ones(n, bool)
        for k in range(1, REACH + 1):
            same = np.zeros(n, bool)
            same[k:] = self.word_text[k:] == self.word_text[:-k] if n > k else same[k:]
            left = np.full(n, most)
            left[k:] = pair[:-k]
            breaks &= ~same | (pair < left)
            same = np.zeros(n, bool)
            same[: max(0, n - k)] = self.word_text[: max(0, n - k)] == self.word_text[k:]
            right = np.full(n, most)
            right[: max(0, n - k)] = pair[k:]
            breaks &= ~same | (pair <= right)
            at = np.arange(n) - before[self.word_text]
            breaks &= at >= REACH  # no break that the text's beginning alone makes
        first_words = before[:-1][before[:-1] < before[1:]]
        breaks[first_words] = True
        self.cuts = Spans(self, np.flatnonzero(breaks))
        line = np.searchsorted(lines, self.starts)
        new = np.zeros(n, bool)
        new[1:] = line[1:] != line[:-1]
        new[first_words] = True
        self.paragraphs = Spans(self, np.flatnonzero(new))

    def beyond(self, k: int, no: int, after: bool) -> np.ndarray:
        """GROWTH words next to cut ``no`` of the k-th text, outwards; fewer at the text's ends. 32 bits tell a word apart."""
        at = int(self.cuts.by_text[k]) + no
        if after:
            words = self.words[self.cuts.last[at] : min(int(self.cuts.last[at]) + GROWTH, int(self.before[k + 1]))]
        else:
            words = self.words[max(int(self.cuts.first[at]) - GROWTH, int(self.before[k])) : self.cuts.first[at]][::-1]
        return halves(words)

    def kinds(self) -> tuple[tuple[int, Spans, np.ndarray], ...]:
        """(kind, stretches, which of them are compared)"""
        return (CUT, self.cuts, np.flatnonzero(self.cuts.size >= LEAST_WORDS)), (PARAGRAPH, self.paragraphs, np.flatnonzero(self.paragraphs.size >= LEAST_RUN))


def text_key(doc_id: int | None, text: bytes) -> bytes:
    """128 bits that stand for a row's doc_id and text."""
    return xxhash.xxh3_128_digest(b"%d\0" % doc_id + text if doc_id is not None else b"\0" + text)


def _keyed(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([text_key(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), strict=True)], pa.binary())


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("t"))


def units(df: DataFrame, text: str = "text") -> DataFrame:
    """d (key of a row's doc_id and text), doc_id, kind, no, size (in words), h, g, and bands (of paragraphs) of each unit that is compared."""
    bands, rows = tuned_bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE_BYTES):
            cut = Cut(*binaries(batch.column("t")))
            keys = _keyed(batch)
            for kind, spans, of in cut.kinds():
                texts = pa.array(spans.text[of])
                made = spans.band_keys(of, bands, rows).astype("<u8").tobytes() if kind == PARAGRAPH else b""
                held = pa.array([made[at : at + 8 * bands] for at in range(0, len(made), 8 * bands)], pa.binary()) if kind == PARAGRAPH else pa.nulls(len(of), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(texts), batch.column("doc_id").take(texts), pa.array(np.full(len(of), kind, np.int32)), pa.array(spans.number[of].astype(np.int32)), pa.array(spans.size[of].astype(np.int32)), pa.array(spans.h[of].view(np.int64)), pa.array(spans.g[of].view(np.int64)), held],
                    names=["d", "doc_id", "kind", "no", "size", "h", "g", "bands"],
                )

    return _texts(df, text).mapInArrow(tidy(run), "d binary, doc_id long, kind int, no int, size int, h long, g long, bands binary")


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h) of each band of rows of h and bands (64-bit keys one after another)."""
    for batch in batches:
        data, offsets = binaries(batch.column("bands"))
        of = np.repeat(batch.column("h").to_numpy(), np.diff(offsets) // 8)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(of)], names=["key", "h"])


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, h) the groups of several h under one key. The new key is made of the group's h, so that
    equal groups are one; a group of more than CARRIED, which is passed on as it comes, is named by its key."""
    key = h = np.empty(0, np.int64)
    batches = iter(batches)
    done = False
    passing: tuple[int, int] | None = None  # key and last h of a large group

    def rows(name: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(of)], names=["key", "h"])

    def own(k: int, n: int) -> np.ndarray:
        return np.repeat(_mixed(np.array([k], np.int64).view(np.uint64) ^ _OTHER), n)

    while not done:
        batch = next(batches, None)
        done = batch is None
        if not done:
            key, h = np.concatenate((key, batch.column("key").to_numpy())), np.concatenate((h, batch.column("h").to_numpy()))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        if passing:
            new[0] = (key[0], h[0]) != passing
        key, h = key[new], h[new]
        if passing and len(key):
            n = int(np.searchsorted(key, passing[0], "right"))
            if n:
                yield rows(own(passing[0], n), h[:n])
                passing = (passing[0], int(h[n - 1]))
            key, h = key[n:], h[n:]
            passing = None if len(key) else passing
        if not len(key):
            continue
        cut = len(key) if done else int(np.searchsorted(key, key[-1]))
        if cut:
            starts = np.flatnonzero(np.concatenate(([True], key[1:cut] != key[: cut - 1])))
            sizes = np.diff(np.append(starts, cut))
            name = _mixed(np.add.reduceat(_mixed(h[:cut].view(np.uint64)), starts) + sizes.astype(np.uint64))
            several = np.repeat(sizes > 1, sizes)
            if several.any():
                yield rows(np.repeat(name, sizes)[several], h[:cut][several])
        key, h = key[cut:], h[cut:]
        if len(key) > CARRIED:
            yield rows(own(int(key[0]), len(key)), h)
            passing = int(key[0]), int(h[-1])
            key = h = np.empty(0, np.int64)


def candidate_groups(rows: DataFrame) -> DataFrame:
    """(key, h) of groups that share a band, of ``rows`` (h, bands); each set of h is one group."""
    pairs = rows.select("h", "bands").mapInArrow(tidy(banded), "key long, h long")
    return pairs.repartition("key").sortWithinPartitions("key", "h").mapInArrow(tidy(grouped), "key long, h long").distinct()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, block) a spanning forest of each block's links: pairs whose shingles have Jaccard SIMILARITY."""

    def links(rows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        rows.sort(key=lambda x: len(x[2]))
        sizes = np.array([len(x[2]) for x in rows])
        side = np.array([x[1] for x in rows])
        label = np.arange(len(rows))
        found = []
        for i in np.flatnonzero(side != RIGHT).tolist():
            lo, hi = np.searchsorted(sizes, SIMILARITY * sizes[i]), np.searchsorted(sizes, sizes[i] / SIMILARITY, "right")
            for j in (lo + np.flatnonzero((side[lo:hi] != LEFT) & (label[lo:hi] != label[i]))).tolist():
                if label[i] != label[j]:
                    common = len(np.intersect1d(rows[i][2], rows[j][2], assume_unique=True))
                    if common >= SIMILARITY * (sizes[i] + sizes[j] - common):
                        label[label == label[j]] = label[i]
                        found.append((rows[i][0], rows[j][0]))
        return found

    def closed(rows: list) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1 and (found := links(rows)):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    at, rows = None, []
    for batch in batches:
        data, offsets = binaries(batch.column("shingles"))
        for k, (key, block, h, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "block", "h", "side")), strict=True)):
            if (key, block) != at:
                yield from closed(rows)
                at, rows = (key, block), []
            rows.append((h, side, np.frombuffer(data[offsets[k] : offsets[k + 1]].tobytes(), np.int64)))
    yield from closed(rows)


def _with_texts(df: DataFrame, text: str, marked: DataFrame) -> DataFrame:
    """doc_id, t, and ``marked``'s columns by d (left join; d of each row is made from its text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([_keyed(batch), batch.column("doc_id"), batch.column("t")], names=["d", "doc_id", "t"])

    return _texts(df, text).mapInArrow(tidy(run), "d binary, doc_id long, t binary").join(marked.hint("merge"), "d", "left")


def similar_paragraphs(df: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """h, g, component of paragraphs of ``found`` (see ``units``) that links of exact Jaccard at least SIMILARITY connect.

    Paragraphs are one if their h and g are. Each gets a number p, fixed by a write, by which groups and links name it.
    """
    distinct = found.where(F.col("kind") == PARAGRAPH).groupBy("h", "g").agg(F.min(F.struct("d", "no")).alias("at"), F.min("bands").alias("bands"))
    distinct = materialise(distinct.withColumn("p", F.monotonically_increasing_id()), "distinct-paragraphs")
    groups = materialise(candidate_groups(distinct.select(F.col("p").alias("h"), "bands")).withColumnRenamed("h", "p"), "band-groups")
    one = distinct.join(groups.select("p").distinct(), "p", "left_semi")
    wanted = materialise(one.groupBy(F.col("at.d").alias("d")).agg(F.collect_list(F.struct("at.no", "p")).alias("of")), "wanted")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE_BYTES):
            held = Cut(*binaries(batch.column("t"))).paragraphs
            asked = [(int(held.by_text[k]) + x["no"], x["p"]) for k, of in enumerate(batch.column("of").to_pylist()) for x in of]
            value, index = held.shingles(np.array([at for at, _ in asked], np.int64))
            sets = [np.unique(value[a:b]).tobytes() for a, b in zip(index, index[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([p for _, p in asked], pa.int64()), pa.array(sets, pa.binary())], names=["p", "shingles"])

    held = _with_texts(df, text, wanted).where("of is not null").select("t", "of").mapInArrow(tidy(shingles), "p long, shingles binary")
    held = materialise(held.groupBy("p").agg(F.min("shingles").alias("shingles")), "shingles")
    sizes = materialise(groups.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "band-sizes")
    dealt = groups.join(sizes, "key").select("key", "p", F.explode(paired_blocks(F.col("p"), F.col("blocks"))).alias("at")).select("key", "p", "at.block", "at.side")
    checked = dealt.join(held, "p").select("key", "block", "side", F.col("p").alias("h"), "shingles").repartition("key", "block").sortWithinPartitions("key", "block")
    linked = materialise(components(checked.mapInArrow(tidy(_verified), "src long, dst long"), "passages"), "passage-classes")
    return linked.withColumnRenamed("node", "p").join(distinct.select("h", "g", "p"), "p").drop("p")


def repeated(df: DataFrame, text: str = "text") -> DataFrame:
    """d, marks and ends of each row that holds a unit whose class another document holds before it (by doc_id, null last).

    marks: kind, no and size of the unit, and first_id, first_d and first_no of the document that holds it first. ends: see ``run_ends``.
    """
    found = materialise(units(df, text), "units")
    classes = materialise(similar_paragraphs(df, found, text), "named-classes")
    narrow = found.select("d", "doc_id", "kind", "no", "size", "h", "g")
    paragraphs = narrow.where(F.col("kind") == PARAGRAPH).join(classes, ["h", "g"], "left")
    own = F.coalesce("component", "h").alias("h"), F.when(F.col("component").isNull(), F.col("g")).otherwise(0).alias("g")
    named = materialise(paragraphs.select("d", "doc_id", "kind", "no", "size", *own), "named-paragraphs").unionByName(narrow.where(F.col("kind") == CUT))
    # most units occur once: they are left out by a count of the first half of their hashes. These joins and those with
    # texts merge at every size, so that a small table's plan tells what a large one costs
    again = materialise(named.groupBy("kind", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "met-again")
    named = materialise(named.join(again.hint("merge"), ["kind", "h"], "left_semi"), "named-units")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d")
    of = ["kind", "h", "g"]
    several = named.groupBy(*of).agg(F.min(F.struct(order.alias("o"), "no")).alias("first"), F.max(order).alias("last")).where("first.o != last")
    several = materialise(several.select(*of, F.col("first.o.d").alias("first_d"), F.col("first.o.doc_id").alias("first_id"), F.col("first.no").alias("first_no")), "repeated-classes")
    later = named.join(several.hint("merge"), of).where("d != first_d")
    marked = materialise(later.groupBy("d").agg(F.collect_set(F.struct("kind", "no", "size", "first_id", "first_d", "first_no")).alias("marks")), "marked")
    return materialise(marked.join(run_ends(df, text, marked), "d", "left"), "repeated")


def _runs(marks: list[dict]) -> list[list[dict]]:
    """The runs of consecutive repeated cuts. One of less than LEAST_RUN words is parted where its cuts do not follow one
    another in one document, so that each part can be grown there."""
    cuts = sorted((m for m in marks if m["kind"] == CUT), key=lambda m: m["no"])
    runs: list[list[dict]] = []
    for m in cuts:
        if runs and m["no"] == runs[-1][-1]["no"] + 1:
            runs[-1].append(m)
        else:
            runs.append([m])
    parts: list[list[dict]] = []
    for run in runs:
        if _words_of(run) >= LEAST_RUN:
            parts.append(run)
            continue
        for k, m in enumerate(run):
            if k and (m["first_d"], m["first_no"]) == (run[k - 1]["first_d"], run[k - 1]["first_no"] + 1):
                parts[-1].append(m)
            else:
                parts.append([m])
    return parts


def _words_of(run: list[dict]) -> int:
    return sum(m["size"] for m in run)


def grown(own: bytes, other: bytes) -> list[tuple[int, int]]:
    """Where equal stretches of two sequences of words (4 bytes each) end, in words of the one and of the other, from
    their begin on over one edit of EDITS after another. The first end may be (0, 0)."""
    a, b = np.frombuffer(own, np.uint32), np.frombuffer(other, np.uint32)
    i = j = 0
    ends = []
    while True:
        n = _alike_words(a[i:], b[j:])
        i, j = i + n, j + n
        ends.append((i, j))
        for x, y in EDITS:
            again = own[4 * (i + x) : 4 * (i + x + AGAIN)]
            if len(again) == 4 * AGAIN and again == other[4 * (j + y) : 4 * (j + y + AGAIN)]:
                i, j = i + x, j + y
                break
        else:
            return ends


def _shingle_set(words: np.ndarray) -> set[bytes]:
    held = words.tobytes()
    return {held[4 * k : 4 * (k + SHINGLE)] for k in range(max(1, len(words) - SHINGLE + 1))}


def grown_passage(seed: np.ndarray, left: tuple[np.ndarray, np.ndarray | None], right: tuple[np.ndarray, np.ndarray | None]) -> tuple[int, int] | None:
    """Words that a run of equal cuts (``seed``) grows by on both sides: the longest passage of LEAST_RUN words or more
    that has exact Jaccard SIMILARITY with the other document's. ``left`` and ``right``: the words next to the run here
    and there, outwards. None: there is no such passage."""
    none = np.empty(0, np.uint32)
    sides = [(own, none if other is None else other) for own, other in (left, right)]
    ends = [grown(own.tobytes(), other.tobytes()) for own, other in sides]
    for (i, x), (j, y) in sorted(product(*ends), key=lambda at: -(at[0][0] + at[1][0])):
        if len(seed) + i + j < LEAST_RUN:
            return None
        if (i, x) == ends[0][0] and (j, y) == ends[1][0]:
            return i, j  # equal words only
        here, there = (_shingle_set(np.concatenate((sides[0][of][:m][::-1], seed, sides[1][of][:n]))) for of, m, n in ((0, i, j), (1, x, y)))
        common = len(here & there)
        if common >= SIMILARITY * (len(here) + len(there) - common):
            return i, j
    return None


def run_ends(df: DataFrame, text: str, marked: DataFrame) -> DataFrame:
    """d and ends: for both ends of each of ``_runs`` the number of its last cut there, after (or before it), and the words
    that come next in the document that holds that cut first, outwards."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, marks in zip(*(batch.column(c).to_pylist() for c in ("d", "marks")), strict=True):
                for run in _runs(marks):
                    rows += [(d, m["no"], after, m["first_d"], m["first_no"]) for m, after in ((run[0], False), (run[-1], True))]
            kinds = (pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["d", "no", "after", "first_d", "first_no"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE_BYTES):
            cut = Cut(*binaries(batch.column("t")))
            rows = []
            for k, (d, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("d", "places")), strict=True)):
                rows += [(d, x["first_no"], x["after"], cut.beyond(k, x["first_no"], x["after"]).tobytes()) for x in places]
            kinds = (pa.binary(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["first_d", "first_no", "after", "words"])

    wanted = materialise(marked.mapInArrow(tidy(asked), "d binary, no int, after boolean, first_d binary, first_no int"), "run-ends")
    holders = wanted.groupBy(F.col("first_d").alias("d")).agg(F.collect_set(F.struct("first_no", "after")).alias("places"))
    texts = _with_texts(df, text, materialise(holders, "end-holders")).where("places is not null").select("d", "t", "places")
    words = materialise(texts.mapInArrow(tidy(told), "first_d binary, first_no int, after boolean, words binary").dropDuplicates(["first_d", "first_no", "after"]), "end-words")
    each = wanted.join(words, ["first_d", "first_no", "after"])
    return each.groupBy("d").agg(F.collect_list(F.struct("no", "after", "words")).alias("ends"))


def removed(text: bytes, cut: Cut, begin: int, k: int, marks: list[dict], ends: list[dict] | None) -> tuple[bytes, list[list[dict]], int]:
    """(what is left of the k-th text, the marks of each passage that goes, removed words). ``begin``: where its bytes begin in the cut."""
    gone = np.zeros(len(cut.words), bool)
    taken = [[m] for m in marks if m["kind"] == PARAGRAPH]
    for (m,) in taken:
        at = int(cut.paragraphs.by_text[k]) + m["no"]
        gone[cut.paragraphs.first[at] : cut.paragraphs.last[at]] = True
    beyond = {(x["no"], x["after"]): np.frombuffer(x["words"], np.uint32) for x in ends or ()}
    base = int(cut.cuts.by_text[k])
    for run in _runs(marks):
        a, b = int(cut.cuts.first[base + run[0]["no"]]), int(cut.cuts.last[base + run[-1]["no"]])
        left, right = ((cut.beyond(k, m["no"], after), beyond.get((m["no"], after))) for m, after in ((run[0], False), (run[-1], True)))
        if by := grown_passage(halves(cut.words[a:b]), left, right):
            gone[a - by[0] : b + by[1]] = True
            taken.append(run)
    base, end = (int(cut.paragraphs.first[i]) if i < len(cut.paragraphs.first) else len(cut.words) for i in (int(cut.paragraphs.by_text[k]), int(cut.paragraphs.by_text[k + 1])))
    own = gone[base:end]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for a, b in edges.tolist():
        out.append(text[at : int(cut.starts[base + a]) - begin])
        at = int(cut.starts[base + b]) - begin if base + b < end else len(text)
    return b"".join([*out, text[at:]]), taken, int(own.sum())


def _alike_words(own: np.ndarray, other: np.ndarray) -> int:
    """How many words two stretches have in common from their begin on."""
    n = min(len(own), len(other))
    differ = np.flatnonzero(own[:n] != other[:n])
    return int(differ[0]) if len(differ) else n


def without_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_units, n_removed, words_removed, repeats (sorted: of each removed passage the least id that holds a unit of it first), kept, kept_sha256.

    Of each class (equal cuts; paragraphs with equal words, or linked by five-word Jaccard of at least 0.8) the document
    of least doc_id keeps its occurrences (null ids last). In others alike paragraphs of LEAST_RUN words or more go, and
    what runs of repeated cuts grow to beside the first document's text, if it has LEAST_RUN words: equal words on either
    side, and words beyond edits of up to three words while the whole has a five-word Jaccard of at least 0.8 with the
    first document's passage; up to the next word that stays. A near copy of which no cut is left whole is not found. A null or empty text has no
    units and keeps an empty text. Rows that repeat one another are one document here. Units that only one document
    holds stay, however often. Words are told apart by 64 bits (in growing by 32, so a shingle by 160), units by 128. A text is cut whole, which takes about a
    hundred bytes of memory for each of its bytes. Other columns are not read; an empty table gives no rows.
    """
    joined = _with_texts(df, text, repeated(df, text)).select("doc_id", "t", "marks", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE_BYTES):
            data, offsets = binaries(batch.column("t"))
            cut = Cut(data, offsets)
            columns: list[list] = [[] for _ in range(6)]
            for k, (t, marks, ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t", "marks", "ends")), strict=True)):
                left, taken, words = removed(t, cut, int(offsets[k]), k, marks, ends) if marks else (t, [], 0)
                known = [[m["first_id"] for m in run if m["first_id"] is not None] for run in taken]
                held = sorted({min(ids) for ids in known if ids})
                n = sum(int(spans.by_text[k + 1] - spans.by_text[k]) for spans in (cut.cuts, cut.paragraphs))
                for values, x in zip(columns, (n, sum(map(len, taken)), words, held, left, hashlib.sha256(left).hexdigest()), strict=True):
                    values.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))], names=["doc_id", "n_units", "n_removed", "words_removed", "repeats", "kept", "kept_sha256"])

    schema = "doc_id long, n_units long, n_removed long, words_removed long, repeats array<long>, kept binary, kept_sha256 string"
    return joined.mapInArrow(tidy(run), schema).withColumn("kept", F.col("kept").cast("string"))


def passages_removed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the texts that ``without_repeats`` leaves; rows whose text changes keep their other columns, which may
    have any names. An empty table gives no rows."""
    row = F.struct(*(column(c) for c in df.columns)).alias("row")
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("t"), row)
    marked = repeated(df, text)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([_keyed(batch), batch.column("row")], names=["d", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE_BYTES):
            data, offsets = binaries(batch.column("t"))
            cut = Cut(data, offsets)
            rows = zip(*(batch.column(c).to_pylist() for c in ("t", "marks", "ends")), strict=True)
            left = [removed(t, cut, int(offsets[k]), k, marks, ends)[0].decode("utf-8", "replace") if marks else None for k, (t, marks, ends) in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(left, pa.string())], names=["row", "left"])

    keyed = own.mapInArrow(tidy(key), T.StructType([T.StructField("d", T.BinaryType()), T.StructField("row", df.schema)]))
    joined = keyed.join(marked.hint("merge"), "d", "left")
    left = T.StructType([T.StructField("row", df.schema), T.StructField("left", T.StringType())])
    held = F.coalesce(F.col(f"row.{quoted(text)}").cast("binary"), F.lit(b""))
    cleaned = joined.select("row", held.alias("t"), "marks", "ends").mapInArrow(tidy(run), left)
    return cleaned.select(*(F.coalesce("left", f"row.{quoted(c)}").alias(c) if c == text else F.col(f"row.{quoted(c)}").alias(c) for c in df.columns))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept")
