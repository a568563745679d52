"""Field-weighted BM25 over an inverted index in blocks, held as DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.tokens import index_tokens, query_words
from ..workers import checkpointed

#: Fixed values of the formula.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Records of a block: a row of postings has those of one term in one block.
BLOCK = 1024
#: What scores are compared to: nine places, as they are ranked.
NEAR = 1e-8
#: A block's arrays: of its records, and, entry by entry, of a term's (place of the record in the block, number of the column, tf).
RECORDS, ENTRIES = ["uid", "ordinal", "dl"], ["slot", "col", "tf"]


@dataclass(frozen=True)
class KeywordIndex:
    """blocks, terms (term, df), and the number of records and of their tokens.

    A row of blocks has the postings of one term in one block of records (segment, block): n records, the largest tf
    of each column (tf_max) and the least length (dl_min), and in arrays its entries: place of the record in the block, number of the
    column and tf; and the positions of all entries, one after another. The row with a null term has the block's records
    instead: uid, ordinal and length. df of a term is the sum of its rows of terms. ``gone`` (uid, _at) takes records out
    of segments below _at.
    """

    blocks: DataFrame
    terms: DataFrame
    columns: list[str]
    n_docs: int
    total_len: int
    gone: DataFrame | None = field(default=None)

    @cached_property
    def records(self) -> DataFrame:
        """The rows of the blocks' records."""
        return self.blocks.where("term is null").select("segment", "block", *RECORDS)

    @cached_property
    def marked(self) -> DataFrame:
        """``records`` with dead: of each record, whether a later segment takes it out. A pass over all records, whose rows alone meet ``gone``."""
        each = self.records.select("segment", "block", F.posexplode(F.arrays_zip(*RECORDS)).alias("_no", "_r")).select("segment", "block", "_no", "_r.*")
        live = without_gone(each, self.gone).select("segment", "block", "_no", F.lit(False).alias("dead"))
        told = each.join(live, ["segment", "block", "_no"], "left").groupBy("segment", "block").agg(F.array_sort(F.collect_list(F.struct("_no", *RECORDS, F.coalesce("dead", F.lit(True)).alias("dead")))).alias("_r"))
        return told.select("segment", "block", *(F.col(f"_r.{c}").alias(c) for c in (*RECORDS, "dead")))

    def entries(self, blocks: DataFrame, positions: bool = False, most: bool = False) -> DataFrame:
        """(term, uid, ordinal, dl, col, tf), and positions if wanted, of the entries of ``blocks`` of live records. Rows of terms meet their
        block's records before anything is exploded. ``most``: the blocks are a large share of all, so records are marked as dead before,
        and no entry is shuffled for it."""
        most = most and self.gone is not None
        met = blocks.select("segment", "block", "term", *ENTRIES, *(["positions"] if positions else [])).join(self.marked if most else self.records, ["segment", "block"])
        ends = F.aggregate("tf", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))  # only for phrases
        met = met.withColumn("_ends", ends) if positions else met

        def entry(x: Column, i: Column) -> Column:
            record = [F.get(c, x["slot"].cast("int")).alias(c) for c in RECORDS]
            told = [F.slice("positions", F.get("_ends", i) + 1, x["tf"]).alias("positions")] if positions else []
            dead = [F.get("dead", x["slot"].cast("int")).alias("dead")] if most else []
            return F.struct(*record, x["col"].cast("int").alias("col"), x["tf"].alias("tf"), *told, *dead)

        flat = met.select("segment", "term", F.inline(F.transform(F.arrays_zip(*ENTRIES), entry)))
        if most:
            return flat.where("not dead").drop("segment", "dead")
        return without_gone(flat, self.gone).drop("segment")

    @cached_property
    def postings(self) -> DataFrame:
        """(term, uid, ordinal, dl, col, tf, positions)"""
        return self.entries(self.blocks.where("term is not null"), positions=True, most=True)

    @property
    def counts(self) -> DataFrame:
        """(term, uid, ordinal, dl, col, tf): ``postings`` without positions, which are not read then."""
        return self.entries(self.blocks.where("term is not null"), most=True)

    @cached_property
    def lengths(self) -> DataFrame:
        """(uid, ordinal, dl) of all records"""
        return without_gone(self.records.select("segment", F.inline(F.arrays_zip(*RECORDS))), self.gone).drop("segment")

    @property
    def average(self) -> float:
        return float(self.total_len / self.n_docs) if self.n_docs else 1.0


def without_gone(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """``rows`` (uid, segment) without those that a later segment takes out."""
    if gone is None:
        return rows
    return rows.join(gone.select(F.col("uid").alias("_uid"), "_at"), (F.col("uid") == F.col("_uid")) & (F.col("segment") < F.col("_at")), "left_anti")


def tokenised(records: DataFrame, columns: list[str], uid: str = "uid", ordinal: str = "ordinal") -> DataFrame:
    """uid, ordinal and tokens: an array for each of ``columns`` (strings, or arrays joined by `` · ``)."""
    kinds = {f.name: f.dataType for f in records.schema}
    joined = [F.array_join(c, " · ") if isinstance(kinds[c], ArrayType) else F.col(c) for c in columns]
    tokens = F.array(*(F.coalesce(index_tokens(c), F.array().cast("array<string>")) for c in joined))
    return records.select(F.col(uid).alias("uid"), F.col(ordinal).alias("ordinal"), tokens.alias("tokens"))


def record_terms(tokens: DataFrame) -> DataFrame:
    """(term, n): records of ``tokenised`` that have the term."""
    return tokens.select(F.explode(F.array_distinct(F.flatten("tokens"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def posting_blocks(tokens: DataFrame, columns: int) -> DataFrame:
    """The blocks of ``tokenised`` records: BLOCK rows that follow one another are one. A batch is grouped where it is, as
    all postings of a record come from its row, so nothing is shuffled."""
    kind = {f.name: f.dataType.simpleString() for f in tokens.schema}
    schema = f"term string, block long, n int, tf_max array<int>, dl_min long, slot array<smallint>, col array<tinyint>, tf array<int>, positions array<int>, uid array<{kind['uid']}>, ordinal array<{kind['ordinal']}>, dl array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                yield from _grouped(whole.slice(at, BLOCK), number, columns)
                number += 1

    return tokens.mapInArrow(run, schema)


def _lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _grouped(batch: pa.RecordBatch, number: int, columns: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its records, then a row for each term, in order of its first letters' codes."""
    n = batch.num_rows
    each = batch.column("tokens").flatten()  # a list for each record and column
    sizes = np.asarray(each.value_lengths(), np.int64)
    words = each.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(each)), sizes)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    dl = sizes.reshape(n, columns).sum(axis=1)
    order = np.lexsort((pos, of, codes))
    codes, of, pos = codes[order], of[order], pos[order]
    entry = _starts(codes, of)
    tf = np.diff(np.append(entry, len(codes)))
    slot, col = of[entry] // columns, of[entry] % columns
    group = _starts(codes[entry])
    names = ["term", "block", "n", "tf_max", "dl_min", *ENTRIES, "positions", *RECORDS]
    kinds = [pa.list_(pa.int16()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    yield pa.RecordBatch.from_arrays(
        [
            pa.nulls(1, pa.string()), pa.array([number], pa.int64()), pa.array([n], pa.int32()), pa.array([[0] * columns], pa.list_(pa.int32())), pa.array([dl.min()], pa.int64()), *(pa.nulls(1, k) for k in kinds),
            _lists(batch.column("uid"), np.zeros(1)), _lists(batch.column("ordinal"), np.zeros(1)), _lists(pa.array(dl, pa.int64()), np.zeros(1)),
        ],
        names=names,
    )
    if not len(group):
        return
    most = np.stack([np.maximum.reduceat(np.where(col == k, tf, 0), group) for k in range(columns)], axis=1)
    new = np.ones(len(slot), np.int64)
    new[1:] = slot[1:] != slot[:-1]
    new[group] = 1
    yield pa.RecordBatch.from_arrays(
        [
            words.dictionary.take(pa.array(codes[entry[group]])), pa.array(np.full(len(group), number)), pa.array(np.add.reduceat(new, group), pa.int32()),
            _lists(pa.array(most.ravel(), pa.int32()), np.arange(len(group)) * columns), pa.array(np.minimum.reduceat(dl[slot], group), pa.int64()),
            _lists(pa.array(slot, pa.int16()), group), _lists(pa.array(col, pa.int8()), group), _lists(pa.array(tf, pa.int32()), group), _lists(pa.array(pos, pa.int32()), entry[group]),
            *(pa.nulls(len(group), pa.list_(k)) for k in (batch.column("uid").type, batch.column("ordinal").type, pa.int64())),
        ],
        names=names,
    )


def reblocked(entries: DataFrame, placed: DataFrame, columns: int, names: list[str]) -> DataFrame:
    """Blocks (columns ``names``) of ``entries`` (term, uid, dl, col, tf, positions) by the new places ``placed`` (uid, ordinal, dl, block,
    slot): the merge of postings, without tokenising."""
    most = F.array(*(F.coalesce(F.max(F.when(F.col("col") == k, F.col("tf"))), F.lit(0)) for k in range(columns)))
    met = entries.join(placed.select("uid", "block", "slot"), "uid")
    of = met.groupBy("term", "block").agg(F.count_distinct("slot").cast("int").alias("n"), most.alias("tf_max"), F.min("dl").alias("dl_min"), F.array_sort(F.collect_list(F.struct("slot", "col", "tf", "positions"))).alias("_e"))
    of = of.select("term", "block", "n", "tf_max", "dl_min", F.col("_e.slot").cast("array<smallint>").alias("slot"), F.col("_e.col").cast("array<tinyint>").alias("col"), F.col("_e.tf").alias("tf"), F.flatten("_e.positions").alias("positions"))
    each = placed.groupBy("block").agg(F.count("*").cast("int").alias("n"), F.min("dl").alias("dl_min"), F.array_sort(F.collect_list(F.struct("slot", *RECORDS))).alias("_r"))
    records = each.select("block", "n", F.array_repeat(F.lit(0), columns).alias("tf_max"), "dl_min", *(F.col(f"_r.{c}").alias(c) for c in RECORDS))
    return of.unionByName(records, allowMissingColumns=True).select(*names)


def keyword_index(records: DataFrame, columns: list[str], uid: str = "uid", ordinal: str = "ordinal") -> KeywordIndex:
    """An index that is computed anew in each query; ``Store`` keeps one."""
    blocks = posting_blocks(tokenised(records, columns, uid, ordinal), len(columns)).withColumn("segment", F.lit(0))
    terms = blocks.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    n, total = blocks.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()
    return KeywordIndex(blocks, terms, list(columns), n, total)


@dataclass(frozen=True)
class PieceIndex:
    """An index of texts in pieces, computed anew in each query. ``tokens`` (uid, ordinal, col, piece, tokens) of the pieces, cut between
    tokens; a record's column may have any number of them, so no row holds a long text's tokens. ``lengths`` (uid, ordinal, dl)."""

    tokens: DataFrame
    lengths: DataFrame
    columns: list[str]
    n_docs: int
    total_len: int

    @property
    def blocks(self) -> DataFrame:
        """A row for each token: pos is its place in its piece."""
        return self.tokens.select("uid", "ordinal", "col", "piece", F.posexplode("tokens").alias("pos", "term"))

    def entries(self, blocks: DataFrame, positions: bool = False, most: bool = False) -> DataFrame:
        """As ``KeywordIndex.entries``."""
        of = ["term", "uid", "ordinal", "dl", "col"]
        met = blocks.join(self.lengths, ["uid", "ordinal"])
        if not positions:
            return met.groupBy(*of).agg(F.count("*").alias("tf"))
        before = F.sum("n").over(Window.partitionBy("uid", "ordinal", "col").orderBy("piece")) - F.col("n")
        first = self.tokens.select("uid", "ordinal", "col", "piece", F.size("tokens").alias("n")).select("uid", "ordinal", "col", "piece", before.cast("int").alias("first"))
        met = met.join(first, ["uid", "ordinal", "col", "piece"])
        return met.groupBy(*of).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list(F.col("first") + F.col("pos"))).alias("positions"))

    @property
    def average(self) -> float:
        return float(self.total_len / self.n_docs) if self.n_docs else 1.0


def piece_index(pieces: DataFrame, columns: list[str]) -> PieceIndex:
    """``keyword_index`` of texts in ``pieces`` (uid, ordinal, col, piece, text; every record has one at least)."""
    tokens = pieces.select("uid", "ordinal", "col", "piece", F.coalesce(index_tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    lengths = checkpointed(tokens.groupBy("uid", "ordinal").agg(F.sum(F.size("tokens")).alias("dl")))
    n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return PieceIndex(tokens, lengths, list(columns), n, total)


@dataclass(frozen=True)
class AskedIndex:
    """An index of asked terms alone, computed anew for a batch of queries: ``blocks`` (term, uid, ordinal, dl, col, tf, positions) of the terms
    that a filter of the asked ones lets through, which are all of these and few others. Terms that nothing asks for are left
    out by the task that tokenises, so they are neither shuffled nor written."""

    blocks: DataFrame
    columns: list[str]
    n_docs: int
    total_len: int

    def entries(self, blocks: DataFrame, positions: bool = False, most: bool = False) -> DataFrame:
        """As ``KeywordIndex.entries``."""
        return blocks.select("term", "uid", "ordinal", "dl", "col", "tf", *(["positions"] if positions else []))

    @property
    def average(self) -> float:
        return float(self.total_len / self.n_docs) if self.n_docs else 1.0


#: Bits of the filter of asked terms for each of them: two are set, so about one other term in sixty is let through.
TERM_BITS = 16


def _bits_of(words: pa.Array, size: int) -> np.ndarray:
    """Two places below ``size`` for each word, by a hash of its bytes."""
    if not len(words):
        return np.empty((2, 0), np.int64)
    words = words.cast(pa.large_binary())
    _, offsets, held = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    sizes, ends = np.diff(offsets), offsets[1:] - offsets[0]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place], dtype=np.uint64)])
        h = sums[ends] - sums[ends - sizes]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.stack([(h >> np.uint64(32)) % np.uint64(size), (h & np.uint64(0xFFFFFFFF)) % np.uint64(size)]).astype(np.int64)


def term_filter(terms: DataFrame) -> np.ndarray:
    """Bits of distinct ``terms`` (term): TERM_BITS for each of them, which is what reaches the driver."""
    size = 64 * max(1, -(-terms.count() * TERM_BITS // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits_of(batch.column("term"), size))
            yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array((np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64))], names=["at", "bits"])

    set_ = terms.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[set_.column("at").to_numpy()] = set_.column("bits").to_numpy()
    return bits.view(np.uint64)


def asked_index(records: DataFrame, columns: list[str], queries: DataFrame, uid: str = "uid", ordinal: str = "ordinal", text: str = "query") -> AskedIndex:
    """An ``AskedIndex`` for a table of ``queries`` (qid, query): one pass over the records."""
    terms = query_phrases(queries, text).select(F.explode("phrase").alias("term")).distinct()
    bits, width = term_filter(terms), len(columns)
    tokens = tokenised(records, columns, uid, ordinal)
    kind = {f.name: f.dataType.simpleString() for f in tokens.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                yield _asked_entries(whole.slice(at, BLOCK), width, bits)

    schema = f"term string, uid {kind['uid']}, ordinal {kind['ordinal']}, dl long, col int, tf long, positions array<int>"
    rows = checkpointed(tokens.mapInArrow(run, schema))
    n, total = rows.where("term is null").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return AskedIndex(rows.where("term is not null"), list(columns), n, total)


def _asked_entries(batch: pa.RecordBatch, columns: int, bits: np.ndarray) -> pa.RecordBatch:
    """A row without a term for each record, and one for each term, that ``bits`` let through, of its columns."""
    n = batch.num_rows
    each = batch.column("tokens").flatten()  # a list for each record and column
    sizes = np.asarray(each.value_lengths(), np.int64)
    dl = sizes.reshape(n, columns).sum(axis=1)
    words = each.flatten().dictionary_encode()
    places = _bits_of(words.dictionary, 64 * len(bits))
    let = ((bits[places // 64] >> (places % 64).astype(np.uint64)) & np.uint64(1)).all(axis=0)
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(each)), sizes)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = np.flatnonzero(let[codes])
    kept = kept[np.lexsort((pos[kept], codes[kept], of[kept]))]
    codes, of, pos = codes[kept], of[kept], pos[kept]
    entry = _starts(of, codes)
    record = np.append(np.arange(n), of[entry] // columns)
    told = pa.concat_arrays([pa.nulls(n, pa.string()), words.dictionary.take(pa.array(codes[entry])).cast(pa.string())])
    tf, at = np.diff(np.append(entry, len(codes))), np.concatenate([np.zeros(n, np.int64), entry])
    return pa.RecordBatch.from_arrays(
        [
            told, batch.column("uid").take(pa.array(record)), batch.column("ordinal").take(pa.array(record)), pa.array(dl[record], pa.int64()), pa.array(np.append(np.zeros(n, np.int64), of[entry] % columns), pa.int32()),
            pa.array(np.append(np.zeros(n, np.int64), tf), pa.int64()), _lists(pa.array(pos, pa.int32()), at),
        ],
        names=["term", "uid", "ordinal", "dl", "col", "tf", "positions"],
    )


def query_phrases(queries: DataFrame, text: str = "query") -> DataFrame:
    """(qid, phrase_no, phrase array): each word's index tokens; a word with a separator inside is a phrase of several."""
    words = queries.select("qid", F.posexplode(query_words(F.col(text))).alias("phrase_no", "word"))
    return words.select("qid", "phrase_no", index_tokens(F.col("word")).alias("phrase")).where(F.size("phrase") > 0)


def _occurrences(index: KeywordIndex, blocks: DataFrame, phrases: DataFrame, few: bool = False, several: bool = True) -> DataFrame:
    """(phrase, uid, ordinal, dl, col, tf) of distinct phrases; the positions of a phrase's tokens are shifted to its begin and
    counted. One token alone reads tf and no positions; ``several``: a phrase may have more."""
    of = ["uid", "ordinal", "dl", "col"]
    single = phrases.where(F.size("phrase") == 1).select("phrase", F.col("phrase")[0].alias("term"))
    # a row for each term of a block meets the phrases, not a row for each entry
    one = index.entries(blocks.join(single.select("term"), "term", "left_semi"), most=not few).select(F.array("term").alias("phrase"), *of, "tf")
    if not several:
        return one
    several = phrases.where(F.size("phrase") > 1).select("phrase", F.posexplode("phrase").alias("i", "term"))
    some = blocks.join(several.select("term").distinct(), "term", "left_semi")
    begins = index.entries(some, positions=True, most=not few).join(several, "term").select("phrase", *of, F.explode(F.transform("positions", lambda p: p - F.col("i"))).alias("begin"))
    whole = begins.groupBy("phrase", *of, "begin").agg(F.count("*").alias("n")).where(F.col("n") == F.size("phrase"))
    return one.unionByName(whole.groupBy("phrase", *of).agg(F.count("*").alias("tf")))


def idf(n: int | Column, n_docs: int) -> Column:
    raw = F.log((F.lit(n_docs) - n + 0.5) / (n + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def bm25(index: KeywordIndex, queries: DataFrame, weights: dict[str, float], text: str = "query") -> DataFrame:
    """(qid, uid, ordinal, score): rows that any phrase of the query is found in. A phrase asked twice counts twice.

    Any number of queries: their phrases are joined with the postings.
    """
    asked = query_phrases(queries, text).groupBy("qid", "phrase").agg(F.count("*").alias("times"))
    return _scored(index, _asked_occurrences(index, asked), asked, weights)


def _asked_occurrences(index: KeywordIndex, asked: DataFrame) -> DataFrame:
    """``_occurrences`` of a table of phrases: blocks of other terms are left out before their entries are exploded."""
    phrases = asked.select("phrase").distinct()
    terms = phrases.select(F.explode("phrase").alias("term")).distinct()
    several = not asked.where(F.size("phrase") > 1).isEmpty()
    return _occurrences(index, index.blocks.where("term is not null").join(terms, "term", "left_semi"), phrases, several=several)


#: Rows of terms in records that are added up at a time, and words of queries that one task of ``bm25_best`` holds, on average.
FOUND, ASKED = 500_000, 100_000


def bm25_best(index: KeywordIndex | AskedIndex, queries: DataFrame, weights: dict[str, float], limit: int, text: str = "query") -> DataFrame:
    """(qid, uid, ordinal, score): of ``bm25`` the ``limit`` best of each query (by score to nine places, then ordinal).

    Queries fall into blocks by hash, and a row of a term in a record is sent to the blocks that ask for the term. A block's task meets
    the records part by part and keeps the ``limit`` best of each query so far. So the rows of all queries and all
    records that share a word, which grow with the square of the table, are never shuffled, nor are a query's best of each part.
    """
    kind = {f.name: f.dataType.simpleString() for f in index.entries(index.blocks.where("term is not null")).schema}
    asked = checkpointed(query_phrases(queries, text).groupBy("qid", "phrase").agg(F.count("*").alias("times")))
    of = _asked_occurrences(index, asked).groupBy("phrase", "uid", "ordinal", "dl").agg(F.sum(_weight(index, weights) * F.col("tf")).alias("f"))
    of = checkpointed(of)
    idfs = of.groupBy("phrase").agg(F.count("*").alias("n")).select("phrase", idf(F.col("n"), index.n_docs).alias("idf"))
    key = F.array_join("phrase", " ").alias("key")
    parts, blocks = max(1, -(-of.count() // FOUND)), max(1, -(-asked.count() // ASKED), asked.sparkSession.sparkContext.defaultParallelism)
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block")
    found = of.join(idfs, "phrase").select("phrase", "uid", "ordinal", (F.col("idf") * _saturated(index, F.col("f"), F.col("dl"))).alias("part_score"))
    sent = found.join(asked.select("phrase", block).distinct(), "phrase").select("block", F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part"), key, "uid", "ordinal", "part_score")
    words = asked.select(block, F.lit(-1).cast("long").alias("part"), key, F.col("qid").cast("long").alias("qid"), "times")
    rows = sent.unionByName(words, allowMissingColumns=True).repartition(blocks, "block").sortWithinPartitions("block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best, held = None, None, 0
        for (block, part), some in _runs(batches):
            if part == -1:  # a block begins
                if best is not None:
                    yield from best.to_batches()
                asked, best, held = some, None, block
            elif asked is not None and block == held:
                best = _best_of(some, asked, limit, best)
        if best is not None:
            yield from best.to_batches()

    return rows.mapInArrow(run, f"qid long, uid {kind['uid']}, ordinal {kind['ordinal']}, score double")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """((block, part), rows) of sorted batches."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        block, part = (batch.column(c).to_numpy() for c in ("block", "part"))
        starts = _starts(block, part)
        for a, b in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist(), strict=True):
            now = (int(block[a]), int(part[a]))
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _best_of(some: pa.Table, of: pa.Table, limit: int, before: pa.Table | None = None) -> pa.Table:
    """Each query's ``limit`` best of one part, ``some`` (key, uid, ordinal, part_score), and of those ``before``; ``of`` (key, qid, times) is what is asked."""
    keys = pc.unique(some.column("key"))
    code, word = (pc.index_in(t.column("key"), keys).fill_null(-1).combine_chunks().to_numpy(zero_copy_only=False) for t in (some, of))
    by_key = np.argsort(code, kind="stable")
    first = np.searchsorted(code[by_key], np.arange(len(keys) + 1))
    uids = pc.unique(some.column("uid"))
    record = pc.index_in(some.column("uid"), uids).combine_chunks().to_numpy(zero_copy_only=False)
    place = np.zeros(len(uids), np.int64)
    place[record] = pc.fill_null(some.column("ordinal").cast(pa.int64()), -(2**63)).to_numpy()
    score, record = some.column("part_score").to_numpy()[by_key], record[by_key]
    qid, times = of.column("qid").to_numpy(), of.column("times").to_numpy()
    known = np.flatnonzero(word >= 0)
    known = known[np.argsort(qid[known], kind="stable")]
    starts = np.append(_starts(qid[known]), len(known))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        rows = [(slice(first[word[k]], first[word[k] + 1]), times[k]) for k in known[a:b].tolist()]
        near, inverse = np.unique(np.concatenate([record[at] for at, _ in rows]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([score[at] * n for at, n in rows]))
        if len(near) > limit:
            kept = np.lexsort((place[near], -np.round(total, 9)))[:limit]
            near, total = near[kept], total[kept]
        out.append((np.full(len(near), qid[known[a]]), near, total))
    ids, near, total = (np.concatenate([x[k] for x in out]) if out else np.empty(0, kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
    at = pc.index_in(uids, some.column("uid").combine_chunks()).take(pa.array(near))
    best = pa.table({"qid": pa.array(ids), "uid": uids.take(pa.array(near)), "ordinal": some.column("ordinal").take(at), "score": pa.array(total)})
    if before is None:
        return best
    both = pa.concat_tables([before, best]).combine_chunks()
    qid, order = both.column("qid").to_numpy(), pc.fill_null(both.column("ordinal").cast(pa.int64()), -(2**63)).to_numpy()
    kept = np.lexsort((order, -np.round(both.column("score").to_numpy(), 9), qid))
    first = _starts(qid[kept])
    place = np.arange(len(kept)) - np.repeat(first, np.diff(np.append(first, len(kept))))
    return both.take(pa.array(kept[place < limit]))


def bm25_of(index: KeywordIndex | PieceIndex, queries: list[tuple[int, str]], weights: dict[str, float], limit: int | None = None) -> DataFrame:
    """``bm25`` of a few queries: their terms are literals of the filter, so a scan of a stored index skips row groups without
    them. With a ``limit`` rows that cannot be among a query's ``limit`` best may be left out: blocks that cannot hold one
    are not read. A phrase of several tokens has to be found everywhere, for its idf. An index in pieces is read whole."""
    spark = index.blocks.sparkSession
    times = Counter((r["qid"], tuple(r["phrase"])) for r in query_phrases(spark.createDataFrame(queries, "qid long, query string")).collect())
    phrases = {p for _, p in times}
    blocks = index.blocks.where(F.col("term").isin(sorted({t for p in phrases for t in p})))
    if isinstance(index, KeywordIndex) and limit is not None and all(len(p) == 1 for p in phrases):
        return _pruned(index, blocks, {(q, p[0]): n for (q, p), n in times.items()}, weights, limit)
    asked = spark.createDataFrame([(q, list(p), n) for (q, p), n in times.items()], "qid long, phrase array<string>, times long")
    found = _occurrences(index, blocks, F.broadcast(spark.createDataFrame([(list(p),) for p in sorted(phrases)], "phrase array<string>")), few=True)
    return _scored(index, found, F.broadcast(asked), weights)  # as many rows as the queries have words


def _saturated(index: KeywordIndex, f: Column, dl: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / F.lit(index.average)))


def _scored(index: KeywordIndex, found: DataFrame, asked: DataFrame, weights: dict[str, float]) -> DataFrame:
    of = found.groupBy("phrase", "uid", "ordinal", "dl").agg(F.sum(_weight(index, weights) * F.col("tf")).alias("f"))
    idfs = of.groupBy("phrase").agg(F.count("*").alias("n")).select("phrase", idf(F.col("n"), index.n_docs).alias("idf"))
    part = F.col("idf") * _saturated(index, F.col("f"), F.col("dl"))
    return of.join(idfs, "phrase").join(asked, "phrase").groupBy("qid", "uid", "ordinal").agg(F.sum(part * F.col("times")).alias("score"))


def _weight(index: KeywordIndex, weights: dict[str, float]) -> Column:
    return F.element_at(F.array(*(F.lit(float(weights.get(c, 0.0))) for c in index.columns)), F.col("col") + 1)


def block_bounds(index: KeywordIndex, blocks: DataFrame, asked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(qid, segment, block, bound): no record of the block has a higher score in the query. Reads no entry of any posting."""
    most = sum(F.lit(float(weights.get(c, 0.0))) * F.element_at("tf_max", k + 1) for k, c in enumerate(index.columns))
    each = blocks.select("term", "segment", "block", _saturated(index, most, F.col("dl_min")).alias("_of")).join(asked, "term")
    terms = each.groupBy("qid", "segment", "block", "term").agg(F.max(F.col("_of") * F.col("weight")).alias("_of"))
    return terms.groupBy("qid", "segment", "block").agg(F.sum("_of").alias("bound"))


def _term_weights(index: KeywordIndex, times: dict[tuple[int, str], int]) -> DataFrame:
    """(qid, term, weight): idf times how often it is asked; idf comes from the dictionary. As many rows as the queries have words."""
    spark = index.blocks.sparkSession
    df = {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(sorted({t for _, t in times}))).groupBy("term").agg(F.sum("df").alias("df")).collect()}
    rows = [(q, t, int(df[t]), n) for (q, t), n in times.items() if df.get(t, 0) > 0]
    made = spark.createDataFrame(rows, "qid long, term string, n long, times long")
    return F.broadcast(made.select("qid", "term", (idf(F.col("n"), index.n_docs) * F.col("times")).alias("weight")))


def _exact(index: KeywordIndex, blocks: DataFrame, asked: DataFrame, weights: dict[str, float]) -> DataFrame:
    entries = index.entries(blocks)
    of = entries.groupBy("term", "uid", "ordinal", "dl").agg(F.sum(_weight(index, weights) * F.col("tf")).alias("f"))
    return of.join(asked, "term").groupBy("qid", "uid", "ordinal").agg(F.sum(F.col("weight") * _saturated(index, F.col("f"), F.col("dl"))).alias("score"))


def surviving(index: KeywordIndex, blocks: DataFrame, times: dict[tuple[int, str], int], weights: dict[str, float], limit: int) -> tuple[DataFrame, DataFrame]:
    """(blocks that may hold one of a query's ``limit`` best, the weights of the terms).

    The ``limit`` blocks of the highest bounds are scored first; the score of place ``limit`` among their records is a
    threshold, and blocks whose bound is below it are skipped.
    """
    asked = _term_weights(index, times)
    bounds = block_bounds(index, blocks, asked, weights)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "segment", "block"))
    best = bounds.withColumn("_place", place).where(F.col("_place") <= limit).select("segment", "block").distinct()
    first = _exact(index, blocks.join(F.broadcast(best), ["segment", "block"], "left_semi"), asked, weights)  # limit rows a query
    held = first.withColumn("_place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("_place") == limit)
    least = {r["qid"]: r["score"] for r in held.select("qid", "score").collect()}
    if not least or limit < 1:
        return blocks, asked
    threshold = F.coalesce(*(F.when(F.col("qid") == q, F.lit(x)) for q, x in least.items()), F.lit(0.0))
    kept = bounds.where(F.col("bound") * (1 + NEAR) >= threshold - NEAR).select("segment", "block").distinct()
    return blocks.join(kept, ["segment", "block"], "left_semi"), asked


def _pruned(index: KeywordIndex, blocks: DataFrame, times: dict[tuple[int, str], int], weights: dict[str, float], limit: int) -> DataFrame:
    kept, asked = surviving(index, blocks, times, weights, limit)
    return _exact(index, kept, asked, weights)
