"""Splitting texts into the pieces that ``word_bpe_49k.json`` encodes one by one.

The tokenizer drops white space and encodes each piece of its split pattern alone, so a text's ids are those of
its pieces one after another. Texts of plain Latin letters are split here, by white space first and then, once for
each distinct chunk, by the pattern. Any other text is normalised and split by the tokenizers library itself, so
that Unicode tables and control characters are the library's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: The split pattern and the special tokens of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}

_pattern = regex.compile(PATTERN)
_special = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
_unsure = re.compile(rb"\xc2[\x80-\xa0]|\xc4\xb0|\xc9[\x90-\xbf]")
#: UTF-8 bytes of white space that any library splits at, of printable ASCII, and of U+00A0 to U+024F.
_PLAIN = bytes([9, 10, 11, 12, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xCA)])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def is_plain(raw: bytes) -> bool:
    """Whether every library agrees on how the text is lower-cased and split: no controls, no U+00A0, no dotted capital I."""
    return not raw.translate(None, _PLAIN) and (raw.isascii() or not _unsure.search(raw)) and (b"<|" not in raw or not _special.search(raw.decode()))


class Generations:
    """A cache by string in two generations of about ``most_bytes`` each; what is met again moves to the newer one."""

    #: Bytes of an entry besides those of its strings: objects and places in the dictionary.
    ENTRY = 300

    def __init__(self, most_bytes: int):
        self.most_bytes, self.size = most_bytes, 0
        self.newer: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def find(self, keys: list[str]) -> tuple[list, list[int]]:
        """(the values, None where there is none; where there is none)"""
        out = list(map(self.newer.get, keys))
        missing = [k for k, x in enumerate(out) if x is None]
        if not self.older:
            return out, missing
        new, again, values = [], [], []
        for k in missing:
            value = self.older.get(keys[k])
            if value is None:
                new.append(k)
            else:
                out[k] = value
                again.append(keys[k])
                values.append(value)
        self.add(again, values)
        return out, new

    def add(self, keys: list[str], values: list, value_bytes: int = 0) -> None:
        size = sum(map(len, keys)) + value_bytes + self.ENTRY * len(keys)
        if size > self.most_bytes:  # one slice that fills a generation is not kept
            return
        if self.size + size > self.most_bytes:
            self.older, self.newer, self.size = self.newer, {}, 0
        self.newer.update(zip(keys, values, strict=True))
        self.size += size


class PieceCoder:
    """Codes texts chunk by chunk, each distinct chunk once for a slice of texts.

    ``made(chunks)`` takes a list of piece lists and returns (units, bytes) for each: its ids as little-endian
    unsigned 32-bit integers, and its tokens' bytes, each token followed by a space. Both are kept in two
    generations of about ``most_bytes`` each; a chunk that is met again moves to the newer one.
    """

    def __init__(self, path: str, made: Callable[[list[list[str]]], list[tuple[bytes, bytes]]], special: Callable[[str], tuple[bytes, bytes]], most_bytes: int = 24_000_000):
        self.path, self.made, self.special = path, made, special
        self.kept: Generations = Generations(most_bytes)

    def coded(self, texts: pa.Array, tokens: bool) -> Iterator[tuple[memoryview, memoryview | None]]:
        """For each text of a binary array (null: empty) its ids and, if ``tokens``, its tokens' bytes."""
        raws = [x or b"" for x in texts.to_pylist()]
        odd = {k: x for k, x in enumerate(raws) if not is_plain(x)}
        plain = pa.array([b"" if k in odd else x for k, x in enumerate(raws)] if odd else raws, pa.binary()).cast(pa.string())
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(plain)))
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        values = self._values(coded.dictionary.to_pylist())
        ids, ids_at = _ragged([x[0] for x in values], code, offsets, np.uint32)
        said, said_at = _ragged([x[1] for x in values], code, offsets, np.uint8) if tokens else (None, None)
        for k in range(len(raws)):
            if k in odd:
                parts = self._other(odd[k].decode("utf-8", "replace"))
                yield memoryview(b"".join([x[0] for x in parts])), memoryview(b"".join([x[1] for x in parts])) if tokens else None
            else:
                yield ids[ids_at[k] : ids_at[k + 1]].data.cast("B"), said[said_at[k] : said_at[k + 1]].data if tokens else None

    def _values(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        out, new = self.kept.find(chunks)
        values = self.made([[x] if (x := chunks[k]).isalpha() else _pattern.findall(x) for k in new])
        for k, value in zip(new, values, strict=True):
            out[k] = value
        self.kept.add([chunks[k] for k in new], values, sum(len(a) + len(b) for a, b in values))
        return out

    def _other(self, text: str) -> list[tuple[bytes, bytes]]:
        return [x for part in _special.split(text) for x in ([self.special(part)] if part in SPECIAL else self._exotic(part))]

    def _exotic(self, text: str) -> list[tuple[bytes, bytes]]:
        t = tokenizer(self.path)
        pieces = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
        unmapped = _byte_letters()
        words = [bytes(unmapped[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]
        return self.made([words]) if words else []


def _ragged(values: list[bytes], code: np.ndarray, offsets: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(the values of all codes one after another, where each text's begin)."""
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(b"".join(values), kind)
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // width
    starts = np.cumsum(lengths) - lengths
    of = lengths[code]
    ends = np.concatenate(([0], np.cumsum(of)))
    index = np.repeat(starts[code] - ends[:-1], of)
    index += np.arange(ends[-1])
    return flat[index], ends[offsets]


@lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, by the published rule, and back."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def byte_letter() -> list[str]:
    letters = {b: c for c, b in _byte_letters().items()}
    return [letters[b] for b in range(256)]
