"""Shards from a k-d tree over metadata, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, materialise

#: Bits of a point's place in its dimension, then bits that set groups of one place apart, then bits that do so for a group's rows.
PLACE_BITS, GROUP_BITS, ROW_BITS = 24, 60, 36
#: A key is two longs of WORD_BITS: the place and the first bits of the group, then its other bits and the row.
WORD_BITS = 60
UPPER_BITS = WORD_BITS - PLACE_BITS
#: Bits that one histogram pass settles.
DIGIT_BITS = 12
GROUP = ["_hash", "text_crc32", "size"]


def _place(name: str, low: float, high: float) -> Column:
    """A dimension's value scaled to PLACE_BITS over the range of the whole table."""
    if high <= low:
        return F.lit(0).cast("long")
    return F.floor((F.col(name) - F.lit(low)) / F.lit(high - low) * F.lit(2**PLACE_BITS - 1)).cast("long")


def _medians(points: DataFrame, nodes: dict[int, tuple[str, float]], keys: dict[int, Column]) -> dict[int, int]:
    """For each node the key below which its share of the bytes lies, nearest by a whole point.

    A distributed weighted median by radix: each pass sums the bytes by the next DIGIT_BITS of the key, under the
    digits found so far, until these are the digits of one row alone. At most 2**DIGIT_BITS sums a node reach the driver
    in a pass. ``keys`` are the upper words of the keys; the lower one is the column _low.
    """
    key = F.coalesce(*(F.when(F.col("_node") == n, k) for n, k in keys.items()))
    keyed = points.where(F.col("_node").isin(list(nodes))).select("_node", F.col("size").alias("_weight"), key.alias("_key"), "_low")
    prefix = dict.fromkeys(nodes, 0)
    below = dict.fromkeys(nodes, 0)
    goal: dict[int, float] = {}
    cuts: dict[int, int] = {}
    for at in range(2 * WORD_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        if at >= WORD_BITS:
            found = {n: F.shiftright("_key", at - WORD_BITS + DIGIT_BITS) == p for n, p in prefix.items()}
            digit = F.shiftright("_key", at - WORD_BITS)
        else:
            known = WORD_BITS - DIGIT_BITS - at
            found = {n: (F.col("_key") == p >> known) & (F.shiftright("_low", at + DIGIT_BITS) == p & (1 << known) - 1) for n, p in prefix.items()}
            digit = F.shiftright("_low", at)
        under = F.coalesce(*(F.when(F.col("_node") == n, of) for n, of in found.items() if n not in cuts))
        sums: dict[int, list[tuple[int, int, int]]] = {n: [] for n in nodes if n not in cuts}
        for r in keyed.where(under).groupBy("_node", digit.bitwiseAND(2**DIGIT_BITS - 1).alias("d")).agg(F.sum("_weight").alias("w"), F.count("*").alias("n")).collect():
            sums[r["_node"]].append((r["d"], r["w"], r["n"]))
        for n, of in sums.items():
            of.sort()
            if n not in goal:
                goal[n] = nodes[n][1] * sum(w for _, w, _ in of)
            for d, w, rows in of:
                if below[n] + w >= goal[n] or d == of[-1][0]:
                    prefix[n] = prefix[n] << DIGIT_BITS | d
                    if rows == 1 or at == 0:
                        # the median point goes to the side that leaves the halves nearest to their shares
                        cuts[n] = prefix[n] + int(below[n] + w - goal[n] <= goal[n] - below[n]) << at
                    break
                below[n] += w
        if len(cuts) == len(nodes):
            break
    return cuts


def kd_shards(df: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to ``shards`` - 1, near equal in bytes) and slot (gapless from 0 in each shard) of each row.

    Points of the tree are rows that lie where their group of equal texts lies: its size, least doc_id, and least
    language and source (where ``df`` has such columns) are the dimensions. A node with more than one shard is split at
    the weighted median of its widest dimension, until each leaf holds the target, the table's bytes over ``shards``.
    Rows of one place are ordered by group (GROUP_BITS of a hash of its text), then by row, so a boundary cuts at most
    the one group that it meets, at the row that leaves the halves nearest to their shares, however large the group is
    and however many groups are at its place.

    Null texts have size 1; nulls in other columns form a value of their own. A row's number, fixed by the first write,
    sets rows that repeat one another apart, null ids included. Ties of a median need no rule: no two groups and hardly
    two rows of a group have the same key, and rows that do go the same way. A text of any length is one point, so a
    shard may exceed its target by that text. Other columns are not read; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = F.coalesce(column(text).cast("binary"), F.lit(b""))
    words = [c for c in ("lang", "source") if c in df.columns]
    dims = ["d_size", "d_doc", *(f"d_{c}" for c in words)]
    rows = df.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_hash"),
        *(F.coalesce(F.crc32(column(c).cast("binary")), F.lit(-1)).alias(f"d_{c}") for c in words), F.monotonically_increasing_id().alias("_no"),
    )
    rows = materialise(rows, "shard-rows")
    groups = rows.groupBy(*GROUP).agg(F.coalesce(F.min("doc_id").cast("double"), F.lit(-1.0)).alias("d_doc"), *(F.min(f"d_{c}").cast("double").alias(f"d_{c}") for c in words))
    of_group = F.shiftrightunsigned(F.xxhash64("_hash"), 64 - GROUP_BITS)
    of_row = F.shiftrightunsigned(F.xxhash64("_no"), 64 - ROW_BITS)
    rest = WORD_BITS - ROW_BITS  # bits of the group in the lower word
    low = F.shiftleft(of_group.bitwiseAND(2**rest - 1), ROW_BITS) + of_row
    # both sides are written, so that adaptive execution can split the rows of a large group
    points = rows.select("doc_id", "_no", *GROUP).join(materialise(groups, "shard-groups"), GROUP)
    points = points.select("doc_id", "_no", "size", "text_crc32", F.col("size").cast("double").alias("d_size"), *dims[1:], F.shiftright(of_group, rest).alias("_upper"), low.alias("_low"), F.lit(0).alias("_node"))
    points = materialise(points, "shard-points")
    ends = points.agg(*(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max))), F.sum("size").alias("bytes")).first()
    place = {d: _place(d, ends[f"low_{d}"] or 0.0, ends[f"high_{d}"] or 0.0) for d in dims}
    open_nodes = {0: (0, shards)}  # node -> first shard, shards
    while ends["bytes"] and (split := {n: of for n, of in open_nodes.items() if of[1] > 1}):
        width = points.where(F.col("_node").isin(list(split))).groupBy("_node").agg(*((F.max(place[d]) - F.min(place[d])).alias(d) for d in dims)).collect()
        widest = {r["_node"]: max(dims, key=lambda d, r=r: r[d]) for r in width}
        split = {n: of for n, of in split.items() if n in widest}
        if not split:
            break
        keys = {n: F.shiftleft(place[widest[n]], UPPER_BITS) + F.col("_upper") for n in split}
        cuts = _medians(points, {n: (widest[n], (of[1] // 2) / of[1]) for n, of in split.items()}, keys)
        leaf: Column = F.col("_node")
        for n, (first, count) in split.items():
            half = count // 2
            below, above = 2 * n + 1, 2 * n + 2
            upper, lower = divmod(cuts[n], 1 << WORD_BITS)
            leaf = F.when(F.col("_node") == n, F.when((keys[n] < upper) | (keys[n] == upper) & (F.col("_low") < lower), below).otherwise(above)).otherwise(leaf)
            del open_nodes[n]
            open_nodes |= {below: (first, half), above: (first + half, count - half)}
        points = materialise(points.withColumn("_node", leaf), "shard-tree")
    shard = F.coalesce(*(F.when(F.col("_node") == n, first) for n, (first, _) in open_nodes.items()), F.lit(0))
    return _slotted(points.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "_no"))


def _slotted(dealt: DataFrame) -> DataFrame:
    """``dealt`` with slot. Rows of a shard are numbered in buckets by their number; a bucket's first slot is the sum of those before it."""
    buckets = max(32, dealt.count() // 1_000_000)
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64("_no"), F.lit(buckets)))
    sizes = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    first = sizes.select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_first"))
    number = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_no"))
    return dealt.withColumn("_number", number).join(first, ["shard", "_bucket"]).withColumn("slot", (F.col("_first") + F.col("_number") - 1).cast("long")).drop("_no", "_bucket", "_number", "_first")


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards(documents(spark, sf_dir), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
