"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, documents, kept_for_stage, slices, tidy, utf8
from .words import SPECIAL, PieceCoder, byte_letter

#: Above every rank and position.
NONE = 1 << 62
NO_PAIR = np.uint64(2**64 - 1)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Pieces of at most so many bytes are encoded many at a time.
MANY_BYTES = 64
NO_RANK = np.int32((2**31 - 1) // MANY_BYTES)
NOTHING = np.int32(2**31 - 1)


class SegmentTreeBpe:
    """Encodes pieces. Each node holds the least ``rank * 2**32 + position`` of its span, so the root is the
    leftmost pair of lowest rank; a merge changes at most three leaves, each with one walk to the root."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        ids = self.vocab
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        for rank, (a, b) in enumerate(merges):
            self.pairs[ids[a], ids[b]] = (rank << 32, ids[a + b])
        self._fill(np.array([a << 32 | b for a, b in self.pairs], np.uint64))
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.token: list[str] = [""] * (1 + max([*ids.values(), *SPECIAL.values()]))
        for token, i in (ids | SPECIAL).items():
            self.token[i] = token
        self.letter = [ids[c] for c in byte_letter()]
        self.last = [ids[c + self.suffix] for c in byte_letter()]
        self.letters = np.array([self.letter, self.last], np.int32)

    def encode_many(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers. Pieces whose trees have the same size are merged in step, one merge each at a time."""
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        raws = [x.encode("utf-8", "surrogateescape") for x in pieces]
        for k, raw in enumerate(raws):
            if len(raw) > MANY_BYTES:
                out[k] = packed(self.encode(pieces[k]))
            elif raw:
                by_size.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append(k)
        for leaves, members in by_size.items():
            for at in range(0, len(members), 4096):
                some = members[at : at + 4096]
                for k, ids in zip(some, self._in_step([raws[k] for k in some], leaves), strict=True):
                    out[k] = ids
        return out

    def _fill(self, keys: np.ndarray) -> None:
        """An open-addressing table from pair to rank, at most a quarter full, that many pairs are looked up in at once."""
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.slot_key = np.full(size, NO_PAIR, np.uint64)
        self.slot_rank = np.full(size, NO_RANK, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at] == NO_PAIR
            place, first = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.slot_key[place], self.slot_rank[place] = keys[left[taken]], left[taken]
            stay = np.ones(len(left), bool)
            stay[taken] = False
            left, at = left[stay], (at[stay] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where there is none (an id below 0 is no neighbour)."""
        key = a.astype(np.int64).view(np.uint64) << np.uint64(32) | b.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
        at = self._slot(key)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot_rank[at], NO_RANK)
        more = np.flatnonzero((held != key) & (held != NO_PAIR))
        for _ in range(1, self.probes):
            if not len(more):
                break
            at[more] = (at[more] + 1) & (len(self.slot_key) - 1)
            held = self.slot_key[at[more]]
            hit = held == key[more]
            out[more[hit]] = self.slot_rank[at[more[hit]]]
            more = more[~hit & (held != NO_PAIR)]
        return out

    def _in_step(self, raws: list[bytes], leaves: int) -> list[bytes]:
        """Nodes hold ``rank * MANY_BYTES + position`` in 32 bits."""
        n = len(raws)
        size = np.fromiter(map(len, raws), np.int64, n)
        text = np.frombuffer(b"".join([x.ljust(leaves, b"\0") for x in raws]), np.uint8).reshape(n, leaves)
        column = np.arange(leaves, dtype=np.int32)
        there = column < size[:, None]
        wide = leaves + 1
        ids = np.full((n, wide), -1, np.int32)  # the last column is the neighbour that no piece has
        ids[:, :leaves] = np.where(there, self.letters[0][text], -1)
        ids[np.arange(n), size - 1] = self.letters[1][text[np.arange(n), size - 1]]
        after = np.tile(np.minimum(np.arange(1, leaves + 2, dtype=np.int32), leaves), n)
        before = np.tile(np.arange(-1, leaves, dtype=np.int32), (n, 1))
        before[:, 0] = leaves
        tree = np.full((n, 2 * leaves), NOTHING, np.int32)
        rows, columns = np.nonzero(there[:, 1:])
        rank = self._pair(ids[rows, columns], ids[rows, columns + 1])
        found = rank < NO_RANK
        tree[rows[found], leaves + columns[found]] = rank[found] * MANY_BYTES + columns[found]
        width = leaves
        while width > 1:
            level = tree[:, width : 2 * width]
            width //= 2
            np.minimum(level[:, ::2], level[:, 1::2], out=tree[:, width : 2 * width])
        ids, before, tree = ids.reshape(-1), before.reshape(-1), tree.reshape(-1)  # flat places are cheaper to look up
        row = np.flatnonzero(tree[1 :: 2 * leaves] < NOTHING)
        while len(row):
            base, root = row * wide, row * (2 * leaves)
            least = tree[root + 1]
            i = least % MANY_BYTES
            j = after[base + i]
            k = after[base + j]
            h = before[base + i]
            ids[base + i] = new = self.merged[least // MANY_BYTES]
            ids[base + j] = -1
            after[base + i] = k
            before[base + k] = i
            ids[base + leaves] = -1
            rank = self._pair(np.concatenate((new, ids[base + h])), np.concatenate((ids[base + k], new)))
            place = np.concatenate((i, h))
            value = np.concatenate((np.full(len(row), NOTHING, np.int32), np.where(rank < NO_RANK, rank * MANY_BYTES + place, NOTHING)))
            node = np.concatenate((j, place))
            real = node < leaves
            roots = np.concatenate((root, root, root))[real]
            node = node[real] + leaves
            tree[roots + node] = value[real]
            for _ in range(leaves.bit_length() - 1):  # all leaves have the same depth
                node = node >> 1
                child = roots + 2 * node
                tree[roots + node] = np.minimum(tree[child], tree[child + 1])
            row = row[tree[root + 1] < NOTHING]
        ids = ids.reshape(n, wide)
        left = ids >= 0
        flat = ids[left].astype("<u4").tobytes()
        ends = np.cumsum(4 * left.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogateescape")
        n = len(raw)
        if not n:
            return []
        ids = [self.letter[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if n == 1:
            return ids
        pairs = self.pairs
        leaves = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * leaves)
        for i in range(n - 1):
            if found := pairs.get((ids[i], ids[i + 1])):
                tree[leaves + i] = found[0] | i
        for node in range(leaves - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        while (least := tree[1]) != NONE:
            i = least & 0xFFFFFFFF
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            before[k] = i
            h = before[i]
            changed = [(i, (found[0] | i) if k < n and (found := pairs.get((ids[i], ids[k]))) else NONE)]
            if j < n - 1:
                changed.append((j, NONE))
            if h >= 0:
                changed.append((h, (found[0] | h) if (found := pairs.get((ids[h], ids[i]))) else NONE))
            for at, value in changed:
                node = leaves + at
                if tree[node] == value:
                    continue
                tree[node] = value
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    value = a if a < b else b
                    if tree[node] == value:
                        break
                    tree[node] = value
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: tokens joined by spaces."""
        return " ".join([self.token[i] for i in ids])


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def piece_coder(path: str, tokens: bool) -> PieceCoder:
    """Codes texts by segment trees; without ``tokens`` the pieces' bytes are left empty. Kept for a stage."""
    return kept_for_stage(_piece_coder, path, tokens)


def _piece_coder(path: str, tokens: bool) -> PieceCoder:
    bpe = SegmentTreeBpe(path)
    token = [x.encode("utf-8", "surrogateescape") + b" " for x in bpe.token]

    def both(ids: bytes) -> tuple[bytes, bytes]:
        return ids, b"".join([token[i] for i in memoryview(ids).cast("I")]) if tokens else b""

    def made(chunks: list[list[str]]) -> list[tuple[bytes, bytes]]:
        new = list({piece for pieces in chunks for piece in pieces})
        ids = dict(zip(new, bpe.encode_many(new), strict=True))
        return [both(ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[x] for x in pieces])) for pieces in chunks]

    return PieceCoder(path, made, lambda text: both(packed([SPECIAL[text]])))


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ids (binary: little-endian unsigned 32-bit integers) and decoded (string), of each whole text."""

    def values(raw: pa.Array) -> list[pa.Array]:
        pairs = list(piece_coder(path, True).coded(raw, tokens=True))
        return [pa.array([bytes(x[0]) for x in pairs], pa.binary()), pa.array([bytes(x[1][:-1]) for x in pairs], pa.binary())]

    return added(df, text, {"ids": "binary", "decoded": "binary"}, values).withColumn("decoded", F.col("decoded").cast("string"))


def _coded(batches: Iterator[pa.RecordBatch], path: str, column: str) -> Iterator[tuple[list[memoryview], list[memoryview], pa.RecordBatch]]:
    coder = piece_coder(path, True)
    for batch in slices(batches, column, 6_000_000):
        pairs = list(coder.coded(batch.column(column), tokens=True))
        yield [x[0] for x in pairs], [x[1][:-1] for x in pairs], batch  # without the space after the last token


def bpe_digests(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: the digests of what ``encode_decode`` returns, taken
    while the batch is in memory.

    A null text counts as empty (no tokens, digests of nothing); repeated rows and null ids give one row each; other
    columns are not read; bytes that are no UTF-8 count as U+FFFD; an empty table gives no rows. Cost of a piece of n
    bytes: O(n log n), whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, decoded, batch in _coded(batches, path, "t"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("t")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), vocabulary())
