"""Token counts of a unigram vocabulary by a Viterbi pass that keeps counts only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import documents, kept_for_stage, slices, tidy, utf8
from .words import Generations

SPACE = "▁"
#: Fixed value: how far below the least score an unknown character is.
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Counts the pieces of the best path.

    Aho-Corasick enumerates the pieces that end at each place, longest first; a path replaces another only if its
    score is greater, so ties go to the longest last piece, as in the tokenizers. A character that is no piece
    scores UNKNOWN_PENALTY below the least piece; a run of them counts as its bytes if bytes have pieces, else as
    one. Each place carries score and count alone: no path is built.
    """

    def __init__(self, pieces: list[tuple[str, float]], bytes_have_pieces: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.by_bytes = bytes_have_pieces
        # a path has a break wherever a word begins, if no piece goes on over such a place
        self.by_words = any(p == SPACE for p, _ in pieces) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.kept = Generations(24_000_000)

    def viterbi(self, text: str) -> tuple[int, float]:
        """(count, score) of ``text``, whose blanks are written as SPACE."""
        n = len(text)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        unknown = [False] * (n + 1)
        done = 0  # places up to here are settled

        def unmatched(end: int, single: bool, score: float | None) -> None:
            """Settle ``end`` after its pieces; without a piece of this one character it may be unknown."""
            if not single and (score is None or best[end - 1] + self.unknown > score):
                best[end] = best[end - 1] + self.unknown
                unknown[end] = True
                count[end] = count[end - 1] + (len(text[end - 1].encode("utf-8", "replace")) if self.by_bytes else not unknown[end - 1])

        score: float | None = None
        single = False
        end = 0
        for last, (length, of) in self.automaton.iter(text):
            if last + 1 != end:
                if end:
                    unmatched(end, single, score)
                for done in range(max(done, end) + 1, last + 1):
                    unmatched(done, False, None)
                end, score, single = last + 1, None, False
            start = end - length
            candidate = best[start] + of
            if score is None or candidate > score:
                best[end] = score = candidate
                count[end] = count[start] + 1
            single = single or length == 1
        if end:
            unmatched(end, single, score)
        for place in range(max(done, end) + 1, n + 1):
            unmatched(place, False, None)
        return count[n], best[n]

    def of(self, chunks: list[str]) -> list[tuple[int, float]]:
        out, new = self.kept.find(chunks)
        for k in new:
            out[k] = self.viterbi(chunks[k])
        self.kept.add([chunks[k] for k in new], [out[k] for k in new])
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(count, score) of each text: blanks as SPACE and one before the text; an empty text has none."""
        written = [SPACE + x.replace(" ", SPACE) if x else "" for x in texts]
        if not self.by_words:
            pairs = [self.viterbi(x) for x in written]
            return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.float64)
        chunks = [_chunk.findall(x) for x in written]
        ends = np.cumsum([0, *map(len, chunks)])
        coded = pa.array([x for of in chunks for x in of], pa.large_string()).dictionary_encode()
        found = self.of(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        out = []
        for k, kind in ((0, np.int64), (1, np.float64)):
            sums = np.concatenate((np.zeros(1, kind), np.cumsum(np.array([x[k] for x in found], kind)[code])))
            out.append(sums[ends[1:]] - sums[ends[:-1]])
        return out[0], out[1]


_chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def counter(path: str) -> UnigramCounter:
    """A counter over the ordinary pieces and stored scores of a sentencepiece file. Kept for a stage."""
    return kept_for_stage(_counter, path)


def _counter(path: str) -> UnigramCounter:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    ordinary = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in ordinary], any(model.is_byte(i) for i in ids))


def token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, score of each whole text: pieces on its best path, and the path's score.

    The pieces and scores are those that the file stores, whatever it was trained as: ``piece_bpe_32k.model`` is a BPE
    model whose scores are merge ranks, so its own BPE encoder counts otherwise than this unigram Viterbi over them.
    A null text counts as empty: no tokens, score 0. Repeated rows and null ids give one row each; other columns are
    not read; bytes that are no UTF-8 count as U+FFFD; a text of any length is one pass in time and memory
    proportional to it; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 4_000_000):
            n, score = counter(path).counts([x.decode("utf-8", "replace") for x in batch.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(score)], names=["doc_id", "n_tokens", "score"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("t")).mapInArrow(tidy(run), "doc_id long, n_tokens long, score double")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
