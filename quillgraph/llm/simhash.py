"""SimHash near-duplicates by pigeonring filtering."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BOTH, LEFT, RIGHT, added, binaries, bucketed, bundled, components, documents, materialise, paired_blocks, slices, tidy, unbundled, utf8
from .exact import _FLAGS, PART_BITS, _flag, _flagged
from .passages import _mixed, banded, grouped, tuned_bands

#: A-Z to a-z, and all white space of the contract to blanks.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))
#: Characters of scripts that set no blanks between words (Han, kana, Thai, Lao, Khmer, Myanmar), in UTF-8.
_UNSPACED = re.compile(rb"(?:[\xe3-\xe9][\x80-\xbf]|\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]|\xf0[\xa0-\xbf][\x80-\xbf])[\x80-\xbf]")
SEED = 42
BITS = 64
DISTANCE = 4
#: One segment more than differing bits allowed, so a chain of proportional budgets starts with an equal segment.
SEGMENTS = 5
#: Fingerprints under one key that one block holds; larger groups are compared block by block.
BLOCK = 2048
#: Near copies share so much (Jaccard) of their shingles of so many words.
SIMILARITY = 0.8
SHINGLE = 5
#: Texts with close fingerprints are near copies if they share so much of their word pairs: word-by-word edits break
#: shingles of five soon, but other words in another order share few pairs.
PAIRS_SIMILARITY = 0.5
#: Chance that two texts just SIMILARITY alike are compared by the bands alone; likelier above.
RECALL = 0.9999
BANDS, ROWS_IN_BAND = tuned_bands(SIMILARITY, RECALL, rows=4)
_SEEDS = _mixed(np.arange(1, BANDS * ROWS_IN_BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

def fingerprint(text: bytes, words_in_shingle: int) -> int:
    """Bit i is 1 if set in over half the XXH64 hashes of the text's word shingles (repeats count); 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = len(words)
    if n <= words_in_shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, n) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends + 1 - lengths)[: n - words_in_shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_in_shingle - 1 :].tolist(), strict=True)]
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, of: Callable[[bytes], int], text: str = "text") -> DataFrame:
    """``df`` with _fp (long: the bits of the text's fingerprint)."""
    return added(df, text, {"_fp": "long"}, lambda raw: [pa.array(np.array([of(x) for x in raw.to_pylist()], np.uint64).view(np.int64))], 4_000_000)


def word_fingerprint(text: bytes, least_letters: int = 5, least_words: int = 16) -> int:
    """SimHash of a text's distinct longer words. An edited word changes one feature, not a window of shingles, so
    texts with scattered edits that share 0.8 of their five-word shingles differ in about four bits, ones with an
    appended or cut block in about ten, unrelated ones in half. A text with too few such words gets the hash of
    its words in order: only equal ones are then close."""
    words = text.translate(_LOWER).split()
    longer = {x.strip(b".,;:!?\"'()") for x in words if len(x) >= least_letters}
    if len(longer) < least_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in longer], np.uint64)
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def _bounds(segments: int) -> list[int]:
    return [BITS * i // segments for i in range(segments + 1)]


def _segment_mask(i: int, segments: int, chain: int = 1) -> np.uint64:
    """The bits of ``chain`` consecutive segments from ring position ``i`` on."""
    cut = _bounds(segments)
    return np.uint64(sum(((1 << (cut[k + 1] - cut[k])) - 1) << cut[k] for k in {(i + c) % segments for c in range(chain)}))


def _second(i: int, segments: int, distance: int) -> range:
    """Bits of the segment after ``i``, if a chain of two may differ at all."""
    cut, j = _bounds(segments), (i + 1) % segments
    return range(cut[j], cut[j + 1]) if 2 * distance >= segments else range(0)


def _named(bits: np.ndarray, i: int) -> np.ndarray:
    """The key of masked bits at ring position ``i``; the position is its last three bits."""
    return (_mixed(bits + np.uint64(i + 1)) & np.uint64(2**64 - 8)) | np.uint64(i)


def _chain_keys(fp: np.ndarray, segments: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, is_probe) for each ring position: the bits of the segment there and of the next one.

    A pair within ``distance`` has a position from which every chain of consecutive segments keeps its cumulative
    difference within its share of ``distance`` (the pigeonring principle). With 5 segments and distance 4 the
    shares are 0.8, 1.6, 2.4, 3.2 and 4: the first segment is equal and the second differs by one bit at most. So
    one side indexes the exact key, the other probes it and each key with one bit of the second segment flipped.
    """
    keys, probes = [], []
    for i in range(segments):
        bits = fp & _segment_mask(i, segments, 2)
        for flip in (None, *_second(i, segments, distance)):
            keys.append(_named(bits if flip is None else bits ^ np.uint64(1 << flip), i))
            probes.append(np.full(len(fp), flip is not None))
    return np.concatenate(keys), np.tile(fp, len(keys)), np.concatenate(probes)


def _forest(left: np.ndarray, right: np.ndarray, position: int, segments: int, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among the fingerprints of one key: fewer links than fingerprints, however many are close.

    The key has settled the chain of two segments. Chains of three segments and more from ``position`` on are held
    against their shares one after another; what is left after the chain of all segments is within ``distance``.
    """
    every, code = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = code[: len(left)], code[len(left) :]
    label = np.arange(len(every))
    chains = [(_segment_mask(position, segments, c), c * distance // segments) for c in range(min(3, segments), segments + 1)]
    links = []
    for at in range(0, len(a), 256):
        some = a[at : at + 256]
        for to in range(0, len(b), 8192):
            other = b[to : to + 8192]
            diff = every[some][:, None] ^ every[other][None, :]
            rows, cols = np.nonzero((np.bitwise_count(diff & chains[0][0]) <= chains[0][1]) & (label[some][:, None] != label[other][None, :]))
            diff = diff[rows, cols]
            for mask, share in chains[1:]:
                stay = np.bitwise_count(diff & mask) <= share
                rows, cols, diff = rows[stay], cols[stay], diff[stay]
            for x, y in zip(some[rows].tolist(), other[cols].tolist(), strict=True):
                if label[x] != label[y]:
                    links.append((int(every[x]), int(every[y])))
                    label[label == max(label[x], label[y])] = min(label[x], label[y])
    return links


def _linked(segments: int, distance: int):  # noqa: ANN202
    """Reads rows sorted by key and block; yields a spanning forest of each block's links. A block is bounded, and so is what is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_block", "_fp", "_side")]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            key, block = columns[:2]
            new = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            rest = [x[last:] for x in columns]
            yield from groups([x[:last] for x in columns], new[:-1] if len(new) else new)
        if rest is not None:
            yield from groups(rest, np.empty(0, np.int64))

    def groups(columns: list[np.ndarray], new: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, _, fp, side = columns
        if not len(fp):
            return
        starts = np.concatenate(([0], new))
        sizes = np.diff(np.concatenate((starts, [len(fp)])))
        links = []
        for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            f, s = fp[a : a + n].view(np.uint64), side[a : a + n]
            if (s != RIGHT).any():
                links += _forest(f[s != RIGHT], f[s != LEFT], int(key[a]) & 7, segments, distance)
        if links:
            found = np.array(links, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["src", "dst"])

    return run


def _heavy_keys(fps: DataFrame, segments: int, distance: int, block: int) -> DataFrame:
    """_key, _lefts, _rights: in how many parts the index rows of a key, and all its rows, are cut where they are many.

    A key's probes are the index rows of the keys one bit away, so all are counted over the index rows alone: keys of
    more than a share of ``block`` give their count to themselves and to their neighbours. A key that is left out has
    2 * ``block`` rows at most.
    """
    most = max(len(_second(i, segments, distance)) for i in range(segments)) + 1
    kept = max(1, block // most)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("_fp").to_numpy().view(np.uint64)
            for i in range(segments):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array((fp & _segment_mask(i, segments, 2)).view(np.int64))], names=["_at", "_bits"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits, n = (batch.column(c).to_numpy() for c in ("_at", "_bits", "_n"))
            for i in range(segments):
                of, count = bits[at == i].view(np.uint64), n[at == i]
                for flip in (None, *_second(i, segments, distance)):
                    key = _named(of if flip is None else of ^ np.uint64(1 << flip), i)
                    index = count if flip is None else np.zeros(len(of), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(index), pa.array(count)], names=["_key", "_index", "_rows"])

    counts = fps.mapInArrow(tidy(masked), "_at int, _bits long").groupBy("_at", "_bits").agg(F.count("*").alias("_n"))
    counts = materialise(counts, "key-counts")
    large = counts.where(F.col("_n") > kept).mapInArrow(tidy(shared), "_key long, _index long, _rows long")
    large = large.groupBy("_key").agg(F.sum("_index").alias("_index"), F.sum("_rows").alias("_rows")).where(F.col("_rows") > block)
    # a key that is large only by its neighbours may have few index rows or none
    own = counts.where(F.col("_n") <= kept).mapInArrow(tidy(shared), "_key long, _index long, _rows long").where("_index > 0").select("_key", F.col("_index").alias("_few"))
    found = large.join(own, "_key", "left").withColumn("_index", F.greatest("_index", F.coalesce("_few", F.lit(0))))
    parts = lambda n: F.ceil(n / block).cast("int")
    return materialise(found.select("_key", parts(F.col("_index")).alias("_lefts"), parts(F.col("_rows")).alias("_rights")), "heavy-keys")


def near_links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """(src, dst) over distinct fingerprints ``fps`` (_fp, written before): links that connect exactly what Hamming distance connects.

    ``segments`` exceeds ``distance``. Every pair within ``distance`` shares a key and is compared there; of a key's
    links a spanning forest is kept. The rows of a key that has more than ``block`` are cut into parts, and each part of
    its index rows meets each part of all its rows in a block of its own, so no task and no list of links grows with a
    group. A large key without index rows is left out before the shuffle.
    """
    dealt = _dealt(fps.select("_fp"), distance, segments, block)
    ordered = dealt.repartition("_key", "_block").sortWithinPartitions("_key", "_block")
    return ordered.mapInArrow(tidy(_linked(segments, distance)), "src long, dst long")


def _dealt(fps: DataFrame, distance: int, segments: int, block: int) -> DataFrame:
    """_key, _block, _fp, _side: the rows of every block in which fingerprints meet."""
    if not distance < segments <= 8:
        raise ValueError("there must be more segments than differing bits, and 8 at most")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fp = whole.column("_fp").slice(at, 4096).to_numpy().view(np.uint64)
                key, of, probe = _chain_keys(fp, segments, distance)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(of.view(np.int64)), pa.array(probe)], names=["_key", "_fp", "_probe"])

    keyed = fps.mapInArrow(tidy(spread), "_key long, _fp long, _probe boolean")
    heavy = _heavy_keys(fps, segments, distance, block)
    whole = F.when(F.col("_probe"), RIGHT).otherwise(BOTH)
    if heavy.isEmpty():
        return keyed.select("_key", F.lit(0).cast("long").alias("_block"), "_fp", whole.alias("_side"))
    joined = keyed.join(heavy, "_key", "left").where("_lefts is null or _lefts > 0")
    lefts, rights = F.coalesce("_lefts", F.lit(1)), F.coalesce("_rights", F.lit(1))
    left, right = F.pmod(F.xxhash64("_fp"), lefts), F.pmod(F.xxhash64("_fp", F.lit(1)), rights)
    cell = lambda i, j, side: F.struct((i * rights + j).cast("long").alias("block"), F.lit(side).alias("side"))
    as_left = F.transform(F.sequence(F.lit(0), rights - 1), lambda j: cell(left, j, LEFT))
    as_right = F.transform(F.sequence(F.lit(0), lefts - 1), lambda i: cell(i, right, RIGHT))
    one = F.array(F.struct(F.lit(0).cast("long").alias("block"), whole.alias("side")))
    cells = F.when(F.col("_lefts").isNull(), one).when(F.col("_probe"), as_right).otherwise(F.concat(as_left, as_right))
    return joined.select("_key", "_fp", F.explode(cells).alias("c")).select("_key", F.col("c.block").alias("_block"), "_fp", F.col("c.side").alias("_side"))


def classes(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``marked`` (written before; with doc_id and _fp) with component_id: the least doc_id reachable over links."""
    distinct = materialise(marked.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "fingerprints")
    linked = materialise(components(near_links(distinct, distance), "simhash"), "classes")
    of = distinct.join(linked.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "_least", F.coalesce("component", "_fp").alias("_class"))
    of = materialise(of, "members")
    least = materialise(of.groupBy("_class").agg(F.min("_least").alias("component_id")), "least")
    # a class may hold many fingerprints, a fingerprint many documents: both joins read written tables, whose large keys Spark can split
    return marked.join(materialise(of.join(least, "_class").select("_fp", "component_id"), "named"), "_fp")


def near_duplicates(df: DataFrame, words_in_shingle: int = 4, distance: int = DISTANCE, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row.

    A null or empty text, or one of white space, has fingerprint zero and is linked like any other. Of null ids the
    least known id of the component counts; a component without any id has null. Repeated rows give one row each,
    other columns are not read, an empty table gives no rows. A text of any length is hashed in parts of 65536 shingles.
    """
    marked = materialise(fingerprints(df.select("doc_id", text), partial(fingerprint, words_in_shingle=words_in_shingle), text).select("doc_id", "_fp"), "simhash")
    return classes(marked, distance).select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _words(text: bytes) -> list[bytes]:
    """Lower-cased words; each character of a script without blanks is one."""
    return _UNSPACED.sub(rb" \g<0> ", text.translate(_LOWER)).split()


def word_hashes(text: bytes) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, SEED) for x in _words(text)], np.uint64)


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; fewer words are one shingle, none have none."""
    width = min(size, len(hashes))
    n = len(hashes) - width + 1 if width else 0
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value = _mixed(value * np.uint64(3) + hashes[k : k + n])
    return np.unique(value)


def band_keys(of: np.ndarray) -> np.ndarray:
    """MinHash band keys of a text's ``shingles``; none of none."""
    if not len(of):
        return of
    least = np.full(len(_SEEDS), np.uint64(2**64 - 1))
    for at in range(0, len(of), 2048):
        least = np.minimum(least, _mixed(of[None, at : at + 2048] ^ _SEEDS[:, None]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS_IN_BAND).T:
        key = _mixed(key * np.uint64(3) + row)
    return key


def _marks(raw: pa.Array) -> list[pa.Array]:
    texts = raw.to_pylist()
    fps = np.array([word_fingerprint(x) for x in texts], np.uint64).view(np.int64)
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(_words(x)), SEED) for x in texts), np.int64).reshape(-1, 2)
    return [pa.array(fps), pa.array(np.ascontiguousarray(hashes[:, 0])), pa.array(np.ascontiguousarray(hashes[:, 1])), pa.array([band_keys(shingles(word_hashes(x))).tobytes() for x in texts], pa.binary())]


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def _alike(of: list[tuple[int, int, int, np.ndarray]], distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one block's near copies (h, side, fingerprint, word hashes); left meets right."""
    five, two = [shingles(x[3]) for x in of], [shingles(x[3], 2) for x in of]
    sizes = np.array(list(map(len, five)))
    side = np.array([x[1] for x in of])
    fp = np.array([x[2] for x in of], np.int64).view(np.uint64)
    label, at = np.arange(len(of)), np.arange(len(of))
    links = []
    for i in np.flatnonzero(side != RIGHT).tolist():
        sized = (sizes >= SIMILARITY * sizes[i]) & (SIMILARITY * sizes <= sizes[i])
        close = np.bitwise_count(fp ^ fp[i]) <= distance
        for j in np.flatnonzero((sized | close) & (side != LEFT) & ((side == RIGHT) | (side[i] == LEFT) | (at > i)) & (label != label[i])).tolist():
            if label[i] != label[j] and (sized[j] and _jaccard(five[i], five[j]) >= SIMILARITY or close[j] and _jaccard(two[i], two[j]) >= PAIRS_SIMILARITY):
                links.append((of[i][0], of[j][0]))
                label[label == label[j]] = label[i]
    return links


def _verified(distance: int):  # noqa: ANN202
    """Reads rows sorted by (key, block); yields a spanning forest of each block's links."""

    def closed(rows: list) -> Iterator[pa.RecordBatch]:
        if links := _alike(rows, distance):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            data, offsets = binaries(batch.column("words"))
            for k, (key, block, *rest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "block", "h", "side", "_fp")), strict=True)):
                if (key, block) != at:
                    yield from closed(rows)
                    at, rows = (key, block), []
                rows.append((*rest, np.frombuffer(data[offsets[k] : offsets[k + 1]].tobytes(), np.uint32).astype(np.uint64)))
        yield from closed(rows)

    return run


def _at(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``stored`` (bucketed by _part, with _seq) whose number is a _row of ``rows``: a number is its part, then PART_BITS
    of the place there. Only flags of places go to the parts, so no text is shuffled."""
    places = rows.select(F.shiftright("_row", PART_BITS).alias("_part"), F.col("_row").bitwiseAND((1 << PART_BITS) - 1).cast("int").alias("_seq"))
    flags = places.groupBy("_part").applyInArrow(lambda t: _flagged(t, t.column("_part")[0].as_py()), _FLAGS)
    return stored.join(flags.hint("shuffle_hash"), "_part").where(_flag())


def alike_links(stored: DataFrame, distinct: DataFrame, text: str, distance: int, segments: int) -> DataFrame:
    """(src, dst) over h of ``distinct`` (h, the _row of one such text in ``stored``, _fp, _bands): verified links between texts
    that share a MinHash band or a component of fingerprints within ``distance``."""
    banded_rows = distinct.select("h", F.col("_bands").alias("bands")).mapInArrow(tidy(banded), "key long, h long")
    near = components(near_links(materialise(distinct.select("_fp").distinct(), "near-distinct"), distance, segments), "near-fps")
    near = materialise(near.select(F.col("node").alias("_fp"), "component"), "near-fp-classes")
    close = distinct.select("_fp", "h").join(near, "_fp", "left").select(F.xxhash64(F.coalesce("component", "_fp")).alias("key"), "h")
    groups = banded_rows.unionByName(close).repartition("key").sortWithinPartitions("key", "h").mapInArrow(tidy(grouped), "key long, h long").distinct()
    groups = materialise(groups, "near-groups")
    wanted = materialise(groups.select(F.col("h").alias("_row")).distinct(), "near-wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 4_000_000):
            # half of each word's hash: a shingle of five, or a pair, is told apart by 160 or 64 bits
            words = [(word_hashes(x) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("_fp"), pa.array(words, pa.binary())], names=["h", "_fp", "words"])

    held = _at(stored, wanted).select(F.col("_row").alias("h"), "_fp", utf8(text).alias("t")).mapInArrow(tidy(hashed), "h long, _fp long, words binary")
    held = materialise(held, "near-words")
    sizes = materialise(groups.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "near-sizes")
    dealt = groups.join(sizes, "key").select("key", "h", F.explode(paired_blocks(F.col("h"), F.col("blocks"))).alias("at")).select("key", "h", "at.block", "at.side")
    checked = dealt.join(held, "h").select("key", "block", "side", "h", "_fp", "words").repartition("key", "block").sortWithinPartitions("key", "block")
    return checked.mapInArrow(tidy(_verified(distance)), "src long, dst long")


def without_near_copies(df: DataFrame, distance: int = 6, segments: int = 7, text: str = "text") -> DataFrame:
    """``df`` with the row of least doc_id (null last) of each component of near copies; of equal ids one row.

    Near copies have equal words by 128 bits (texts without words too), or share SIMILARITY of their five-word shingles, or have
    fingerprints within ``distance`` and share PAIRS_SIMILARITY of their word pairs; both are exact Jaccard over words told apart by 32 bits. Texts
    that share just SIMILARITY may differ in 16 of 64 bits, for which pigeonring has no selective keys, so MinHash
    bands find candidates besides it. Every link is verified. Short texts are compared in the same way; one of less
    than SHINGLE words has only equal copies. A null text is like an empty one; columns may have any names; an empty
    table gives no rows.
    """
    stored = added(bundled(df, text), text, {"_fp": "long", "h": "long", "g": "long", "_bands": "binary"}, _marks, 4_000_000).withColumn("_row", F.monotonically_increasing_id())
    stored = stored.withColumns({"_part": F.shiftright("_row", PART_BITS), "_seq": F.col("_row").bitwiseAND((1 << PART_BITS) - 1).cast("int")})
    stored = bucketed(stored, "near_rows", max(1, df.rdd.getNumPartitions()), "_part")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_least")
    distinct = stored.groupBy("h", "g").agg(least, F.first("_fp").alias("_fp"), F.first("_bands").alias("_bands")).drop("h", "g")
    distinct = materialise(distinct.withColumn("h", F.col("_least._row")), "near-texts")
    linked = components(alike_links(stored, distinct, text, distance, segments), "near")
    of = distinct.select("h", "_least").join(materialise(linked, "near-classes").withColumnRenamed("node", "h"), "h", "left")
    stay = of.groupBy(F.coalesce("component", "h")).agg(F.min("_least").alias("m")).select(F.col("m._row").alias("_row"))
    return unbundled(_at(stored, materialise(stay, "near-stay")), df.columns, text)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
