"""Document quality by attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import added, binaries, documents, materialise, slices, tidy, utf8

PASSAGE_WORDS = 64
#: Labelled documents that the classifier is fitted on at most, chosen by a hash of doc_id; all their passages take part.
SAMPLE_ROWS = 4000
#: Passages that the classifier is fitted on at most, and that one document of the sample has at most; both bound the driver's memory.
SAMPLE_PASSAGES, DOCUMENT_PASSAGES = 2**17, 2**11
#: A run of more bytes without white space counts as several words.
LONGEST_WORD = 4096
#: Bytes that are encoded at a time; a longer text is encoded in pieces.
PIECE_BYTES = 1_000_000
HASHED = 48
STATISTICS = 14
WIDTH = STATISTICS + HASHED
THRESHOLD = 0.3

#: What a byte counts as: 0 white space, 1 lower-case letter, 2 upper-case letter, 3 digit, 4 sentence mark, 5 bar, 6 other mark, 7 byte of a longer character.
_CLASS = np.full(256, 6, np.uint8)
for _bytes, _class in ((b" \t\n\x0b\x0c\r", 0), (bytes(range(97, 123)), 1), (bytes(range(65, 91)), 2), (b"0123456789", 3), (b".,;:?'-\"", 4), (b"|", 5), (bytes(range(128, 256)), 7)):
    _CLASS[list(_bytes)] = _class
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _ODD, np.uint64)), np.cumprod(np.full(n, inverse, np.uint64))


@dataclass
class Said:
    """What a text that is encoded in pieces has said before: hashes of words and of triples, and its last two words."""

    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    triples: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    last: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))


def _word_starts(solid: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Which bytes begin a word."""
    head = np.empty(len(solid), bool)
    head[:1] = True
    head[1:] = ~solid[:-1] | (text_of[1:] != text_of[:-1])
    head &= solid
    if len(head):
        begins = np.flatnonzero(head)
        lengths = np.add.reduceat(solid.astype(np.int64), begins) if len(begins) else begins
        for at, n in zip(begins[lengths > LONGEST_WORD].tolist(), lengths[lengths > LONGEST_WORD].tolist(), strict=True):
            head[at : at + n : LONGEST_WORD] = True
    return head


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages [n, WIDTH], index of the first passage of each text and the end).

    A passage is PASSAGE_WORDS words, and LONGEST_WORD bytes of a longer run without white space are one word; a text without words is one passage without words. Features: shares of kinds
    of characters and word shapes, how much of it the text has said before, and a hashed bag of its byte pairs.
    A text of more than PIECE_BYTES is encoded in pieces that carry what it has said, with the same result.
    """
    long = np.flatnonzero(np.diff(offsets) > PIECE_BYTES)
    if not len(long):
        return _encode(data, offsets)
    parts, counts, at = [], [], 0
    for k in (*long.tolist(), len(offsets) - 1):
        if k > at:
            x, first = _encode(data[offsets[at] : offsets[k]], offsets[at : k + 1] - offsets[at])
            parts.append(x)
            counts += np.diff(first).tolist()
        if k < len(offsets) - 1:
            parts += (of := list(_pieces(data[offsets[k] : offsets[k + 1]])))
            counts.append(sum(map(len, of)))
        at = k + 1
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Features of one long text, a piece of whole passages after another."""
    said, at = Said(), 0
    while at < len(data):
        size = PIECE_BYTES
        while at + size < len(data):
            some = data[at : at + size]
            begins = np.flatnonzero(_word_starts(_CLASS[some] > 0, np.zeros(len(some), np.int8)))
            if len(begins) > PASSAGE_WORDS:
                size = int(begins[(len(begins) - 1) // PASSAGE_WORDS * PASSAGE_WORDS])
                break
            size *= 2
        piece = data[at : at + size]
        yield _encode(piece, np.array([0, len(piece)]), said)[0]
        at += size


def _encode(data: np.ndarray, offsets: np.ndarray, said: Said | None = None) -> tuple[np.ndarray, np.ndarray]:
    texts = len(offsets) - 1
    kind = _CLASS[data]
    solid = kind > 0
    text_of = np.repeat(np.arange(texts, dtype=np.int32), np.diff(offsets))
    head = _word_starts(solid, text_of)
    starts = np.flatnonzero(head)
    word_text = text_of[starts]
    words_before = np.searchsorted(starts, offsets)
    in_text = np.arange(len(starts)) - words_before[word_text]
    passages = np.maximum(1, -(-np.diff(words_before) // PASSAGE_WORDS))
    first = np.concatenate(([0], np.cumsum(passages)))
    total = int(first[-1])
    word_passage = first[word_text] + in_text // PASSAGE_WORDS
    # a byte belongs to the passage of the last word begun before it
    at = np.maximum(np.cumsum(head) - 1, 0)
    byte_passage = np.where(np.searchsorted(starts, np.arange(len(data)), "right") > words_before[text_of], word_passage[at] if len(starts) else 0, first[text_of]) if len(data) else np.empty(0, np.int64)
    counts = np.bincount(byte_passage * 8 + kind, minlength=total * 8).reshape(total, 8).astype(np.float64)
    size = np.maximum(counts.sum(axis=1), 1)
    n_words = np.bincount(word_passage, minlength=total).astype(np.float64)
    nw = np.maximum(n_words, 1)
    # 64-bit hashes of words: sums of byte * odd**i, moved to a common start
    powers, inverses = _powers(len(data) + 1)
    ends = starts + (np.add.reduceat(solid.astype(np.int64), starts) if len(starts) else 0)  # white space up to the next word adds nothing
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)))
        h = (sums[np.minimum(ends, len(data))] - sums[starts]) * inverses[starts]
        salted = (h ^ (h >> np.uint64(29))) * _ODD + word_text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        ahead = said.last if said else salted[:0]
        run = np.concatenate((ahead, salted))
        triple = run[2:] + run[1:-1] * np.uint64(3) + run[:-2] * np.uint64(7) if len(run) > 2 else np.empty(0, np.uint64)

    def said_before(values: np.ndarray) -> np.ndarray:
        order = np.argsort(values, kind="stable")
        again = np.zeros(len(values), bool)
        again[order[1:]] = values[order[1:]] == values[order[:-1]]
        return again

    word_known, triple_known = said_before(salted), said_before(triple)
    if said:
        word_known |= np.isin(salted, said.words)
        triple_known |= np.isin(triple, said.triples)
        said.words, said.triples, said.last = np.union1d(said.words, salted), np.union1d(said.triples, triple), run[-2:]
    word_again = np.bincount(word_passage, word_known, minlength=total) / nw
    triple_again = np.bincount(word_passage[len(salted) - len(triple) :], triple_known, minlength=total) / nw if len(triple) else np.zeros(total)
    shouted = np.bincount(word_passage, kind[starts] == 2, minlength=total) / nw
    marked = np.bincount(word_passage, kind[np.maximum(ends - 1, 0)] == 6, minlength=total) / nw if len(starts) else np.zeros(total)
    shares = counts / size[:, None]
    word_bytes = (size - counts[:, 0]) / nw
    out = np.empty((total, WIDTH), np.float32)
    out[:, :STATISTICS] = np.column_stack((shares[:, 1:8], word_again, triple_again, shouted, marked, np.log1p(word_bytes), np.log1p(n_words), n_words == 0))
    if len(data) > 1:
        pair = (data[:-1].astype(np.int64) * 31 + data[1:].astype(np.int64) * 17) % HASHED
        within = byte_passage[1:] == byte_passage[:-1]
        bag = np.bincount(byte_passage[:-1][within] * HASHED + pair[within], minlength=total * HASHED).reshape(total, HASHED)
    else:
        bag = np.zeros((total, HASHED))
    out[:, STATISTICS:] = bag / size[:, None]
    return out, first


@dataclass
class GatedAttention:
    """score = sigmoid(c . z + b), z = sum of a_k h_k over passages, a = softmax of w . (tanh(V h) * sigmoid(U h))."""

    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    def _attention(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        tanh = np.tanh(x @ self.v)
        gate = 1 / (1 + np.exp(-np.clip(x @ self.u, -30, 30)))
        e = (tanh * gate) @ self.w
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), np.diff(first)))
        return tanh, gate, e / np.repeat(np.add.reduceat(e, first[:-1]), np.diff(first))

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        a = self._attention(x, first)[2]
        z = np.add.reduceat(x * a[:, None], first[:-1], axis=0)
        return 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -30, 30)))

    @classmethod
    def fit(cls, features: np.ndarray, first: np.ndarray, labels: np.ndarray, hidden: int = 16, steps: int = 800, rate: float = 0.03, decay: float = 1e-4) -> GatedAttention:
        """Full-batch Adam on the logistic loss; deterministic."""
        rng = np.random.default_rng(0)
        d = features.shape[1]
        mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
        prior = float(np.clip(labels.mean(), 0.01, 0.99))
        v, u, w = (rng.normal(0, 0.1, of).astype(np.float32) for of in ((d, hidden), (d, hidden), hidden))
        m = cls(mean, scale, v, u, w, np.zeros(d, np.float32), float(np.log(prior / (1 - prior))))
        x = np.clip((features - mean) / scale, -8, 8).astype(np.float32)
        bags, sizes, n = first[:-1], np.diff(first), len(labels)
        state: dict[str, tuple] = {}
        for step in range(1, steps + 1):
            tanh, gate, a = m._attention(x, first)
            z = np.add.reduceat(x * a[:, None], bags, axis=0)
            p = 1 / (1 + np.exp(-np.clip(z @ m.c + m.b, -30, 30)))
            dl = ((p - labels) / n).astype(np.float32)
            da = np.repeat(dl, sizes) * (x @ m.c)
            de = a * (da - np.repeat(np.add.reduceat(a * da, bags), sizes))
            dh = de[:, None] * m.w
            grads = {
                "c": z.T @ dl + decay * m.c, "b": float(dl.sum()), "w": (tanh * gate).T @ de + decay * m.w,
                "v": x.T @ (dh * gate * (1 - tanh**2)) + decay * m.v, "u": x.T @ (dh * tanh * gate * (1 - gate)) + decay * m.u,
            }
            for k, g in grads.items():
                m1, m2 = state.get(k, (0.0, 0.0))
                m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * np.square(g)
                state[k] = (m1, m2)
                setattr(m, k, getattr(m, k) - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8))
        return m


def remainder(doc_id: str = "doc_id"):  # noqa: ANN201
    """crc32(doc_id as text) mod 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit_quality(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, passages: int = SAMPLE_PASSAGES, longest: int = DOCUMENT_PASSAGES) -> GatedAttention | None:
    """Fit on at most ``rows`` documents of ``df`` that have a quality label; passages are encoded on the executors.

    The sample is drawn from ids that ``df`` has, by a hash. Of these documents those of at most ``longest`` passages
    take part, with all their passages, in the order of the hash as long as they have ``passages`` together. So what is sent
    to the driver (4 * WIDTH bytes a passage) is bounded whatever the length of the texts. Of rows with the same id the
    least text counts, of contradicting labels the larger one. Null ids and labels are not used. Equal scores have no
    part in fitting. Returns None where nothing is labelled.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("_quality"))
    known = known.join(df.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded by ``rows``, so it may be broadcast
    texts = df.select("doc_id", utf8("text").alias("t")).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id", "_quality").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", PIECE_BYTES):
            x, first = encode(*binaries(batch.column("t")))
            bags = [x[a:b].astype("<f4").tobytes() if b - a <= longest else None for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_quality"), pa.array(np.diff(first), pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "_quality", "n", "x"])

    bags = materialise(texts.mapInArrow(tidy(run), "doc_id long, _quality int, n long, x binary"), "quality-bags").where(F.col("n") <= longest)
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # one task for at most ``rows`` ids
    chosen = bags.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= passages).select("doc_id")
    found = bags.join(F.broadcast(chosen), "doc_id").select("doc_id", "_quality", "x").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    bags = [np.frombuffer(x, "<f4").reshape(-1, WIDTH) for x in found.column("x").to_pylist()]
    first = np.concatenate(([0], np.cumsum([len(x) for x in bags])))
    return GatedAttention.fit(np.concatenate(bags), first, found.column("_quality").to_numpy().astype(float))


def scored(df: DataFrame, model: GatedAttention | None, text: str = "text") -> DataFrame:
    """``df`` with score (0 to 1): the attention-weighted passages of the whole text.

    Without a model each row has 0.5. A null text counts as empty, and empty texts are scored too. Equal texts have
    equal scores; repeated rows give one row each. A text of any length is encoded in pieces of PIECE_BYTES. All other
    columns are kept whatever they are called, but for one named score, which is replaced. An empty table gives no rows.
    """
    if model is None:
        return df.withColumn("score", F.lit(0.5))
    return added(df, text, {"score": "double"}, lambda raw: [pa.array(model.score(*encode(*binaries(raw))).astype(np.float64))], PIECE_BYTES)


def quality_model(spark: SparkSession, sf_dir: str) -> GatedAttention | None:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(remainder() != 0)
    return fit_quality(documents(spark, sf_dir), labels)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are read only of rows that are not held out; a repeated or null doc_id gives one row for each of its rows."""
    found = scored(documents(spark, sf_dir).select("doc_id", "text"), quality_model(spark, sf_dir))
    return found.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
