"""A mix of sources by weight: capped water-filling, then seeded whole and fractional repetitions, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, materialise, numbered

SEED = 11
#: How often the mix takes a document at most.
EPOCHS = 3
#: Weights of the sources in order, repeated.
WEIGHTS = (1, 2, 3)
#: Rounds that bring a source nearer to its target, each by documents of one size.
CORRECTIONS = 4
#: Documents of a source and size that are put in order together at most, on average.
TOGETHER = 10_000
OUTPUTS = ("size", "source_size", "target", "times")


def word_count(text: Column) -> Column:
    """The number of runs of other characters than white space. A run becomes one letter and white space nothing, so no
    array of words is made."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long")


def _unit(digest: Column) -> Column:
    """A number of [0, 1) from a hex digest."""
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") / F.lit(2.0**32)


def _same(left: dict[str, str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in left.items()])


def water_filled(sources: DataFrame, epochs: float) -> DataFrame:
    """``sources`` (size, weight; written before) with target: all sizes shared by weight, each at most ``epochs`` times its
    source's size.

    Clamped sources leave the sharing and the others share what is left, until no other is above its cap. A round is one
    aggregation of which three numbers reach the driver; there are as many as sets of sources that are clamped at once.
    """
    cap = F.col("size") * F.lit(epochs)
    total = sources.agg(F.sum("size")).first()[0] or 0
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        held, weights, n = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == clamped or not weights:
            break
        level, clamped = (total - (held or 0)) / weights, n
    share = cap if level is None or not weights else F.least(cap, F.lit(level) * F.col("weight"))
    return sources.withColumn("target", share.cast("double"))


def _extra(groups: DataFrame, epochs: int) -> DataFrame:
    """``groups`` (_source, _size, n documents, source_size, target) with whole repetitions of each document and extra: how many
    documents of the group are taken once more.

    The documents of a source in order of size are sampled systematically, each with the fraction's probability, from a seeded
    start. Then documents of the one size that brings the source nearest to its target are taken more or less often, within
    0 and ``epochs``, some times over. All windows are over one source and read a row for each of its sizes.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _unit(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce("_source", F.lit("")))))
    by = Window.partitionBy("_source")
    groups = groups.withColumn("_whole", F.floor(ratio)).withColumn("_part", ratio - F.col("_whole")).withColumn("_upto", F.sum("n").over(by.orderBy(F.desc("_size"))))
    sampled = F.floor(F.col("_part") * F.col("_upto") + start) - F.floor(F.col("_part") * (F.col("_upto") - F.col("n")) + start)
    groups = groups.withColumn("_reps", (F.col("_whole") * F.col("n") + F.when(F.col("_size") > 0, sampled).otherwise(F.lit(0))).cast("long"))
    for _ in range(CORRECTIONS):
        groups = groups.withColumn("_miss", F.col("target") - F.sum(F.col("_reps") * F.col("_size")).over(by))
        room = F.when(F.col("_miss") > 0, F.col("n") * epochs - F.col("_reps")).otherwise(F.col("_reps"))
        step = F.when(F.col("_size") > 0, F.least(F.floor(F.abs("_miss") / F.col("_size") + 0.5), room)).otherwise(F.lit(0))
        groups = groups.withColumn("_step", step.cast("long")).withColumn("_rest", F.abs(F.abs("_miss") - F.col("_step") * F.col("_size")))
        nearest = F.min(F.when((F.col("_step") > 0) & (F.col("_rest") < F.abs("_miss")), F.struct("_rest", (-F.col("_size")).alias("z")))).over(by)
        groups = groups.withColumn("_best", -nearest["z"])
        groups = groups.withColumn("_reps", F.when(F.col("_size") == F.col("_best"), F.col("_reps") + F.signum("_miss").cast("long") * F.col("_step")).otherwise(F.col("_reps")))
    return groups.select("_source", "_size", "n", "source_size", "target", F.floor(F.col("_reps") / F.col("n")).alias("whole"), F.pmod("_reps", "n").alias("extra"))


def _edges(points: DataFrame, groups: DataFrame) -> DataFrame:
    """_source, _size, edge, take, tied: of a group those digests below ``edge`` are taken once more, and ``take`` of the
    ``tied`` rows that have it. Only the bucket of digests in which a group's edge lies is put in order."""
    some = groups.where("extra > 0 and extra < n").select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), "n", "extra")
    open_points = points.join(some, _same({"_source": "_s", "_size": "_z"}))
    open_points = open_points.withColumn("_bucket", F.floor(_unit(F.col("_digest")) * (F.floor(F.col("n") / TOGETHER) + 1)))
    sums = open_points.groupBy("_source", "_size", "_bucket", "extra").agg(F.sum("rows").alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy("_source", "_size").orderBy("_bucket"))
    cut = sums.withColumn("_before", upto - F.col("_rows")).where((F.col("_before") < F.col("extra")) & (F.col("_before") + F.col("_rows") >= F.col("extra")))
    cut = cut.select(F.col("_source").alias("_s2"), F.col("_size").alias("_z2"), F.col("_bucket").alias("_b2"), "_before")
    inside = open_points.join(cut, _same({"_source": "_s2", "_size": "_z2", "_bucket": "_b2"}))
    inside = inside.withColumn("_before", F.col("_before") + F.sum("rows").over(Window.partitionBy("_source", "_size").orderBy("_digest")) - F.col("rows"))
    edge = inside.where((F.col("_before") < F.col("extra")) & (F.col("_before") + F.col("rows") >= F.col("extra")))
    return edge.select("_source", "_size", F.col("_digest").alias("edge"), (F.col("extra") - F.col("_before")).alias("take"), F.col("rows").alias("tied"))


def mixed(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``df`` with size (words of the text), source_size, target (words of its source in the mix) and times: how often the mix
    takes the row, from 0 to ``epochs``.

    Sources in order of code points, null last, have ``weights``, repeated; together they share all words, and none gets more
    than ``epochs`` times its own. A document is taken whole times, as its source's share says, and a seeded sample
    of the source once more, chosen by the digest of seed, doc_id and text, so reruns agree however the table is dealt.
    Documents of CORRECTIONS sizes are then taken more or less often, where that brings the source nearer to its target.

    Null texts have size 0, as empty ones; these are taken as often as whole repetitions say. Ties: rows with equal
    id, text and source are interchangeable, and as many as the sample needs are taken, whichever they are. A null
    source is a source, a null id an id. A text of any length is one row and is never cut. Columns of ``df`` that are called
    as an output are replaced, others kept; an empty table gives no rows.
    """
    names = [c for c in df.columns if c not in OUTPUTS]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(column(text), F.lit(""))))
    rows = df.select(F.struct(*(column(c) for c in names)).alias("row"), column(source).cast("string").alias("_source"), word_count(column(text)).alias("_size"), digest.alias("_digest"))
    points = materialise(rows.groupBy("_source", "_size", "_digest").agg(F.count("*").alias("rows")), "mix-points")
    groups = materialise(points.groupBy("_source", "_size").agg(F.sum("rows").alias("n")), "mix-groups")
    sources = materialise(groups.groupBy("_source").agg(F.sum(F.col("_size") * F.col("n")).alias("size")), "mix-sizes")
    placed = numbered(sources, [], [F.col("_source").asc_nulls_last()], "mix-sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("index", F.lit(len(weights))) + 1).cast("int"))
    sources = water_filled(materialise(placed.withColumn("weight", weight), "mix-weights"), epochs)
    sources = sources.select(F.col("_source").alias("_s"), F.col("size").alias("source_size"), "target")
    plan = materialise(_extra(groups.join(sources, _same({"_source": "_s"})).drop("_s"), epochs), "mix-plan")
    edges = materialise(_edges(points, plan), "mix-edges")
    renamed = edges.select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), "edge", "take", "tied")
    decided = plan.join(renamed, _same({"_source": "_s", "_size": "_z"}), "left")
    decided = decided.select(F.col("_source").alias("_of"), F.col("_size").alias("_as"), "n", "source_size", "target", "whole", "extra", "edge", "take", "tied")
    met = rows.join(decided, _same({"_source": "_of", "_size": "_as"}))
    more = F.when(F.col("extra") <= 0, 0).when(F.col("extra") >= F.col("n"), 1).when(F.col("_digest") != F.col("edge"), (F.col("_digest") < F.col("edge")).cast("int")).when(F.col("take") >= F.col("tied"), 1)
    met = met.withColumn("_more", more)
    found = met.where("_more is not null")
    if not edges.where("take < tied").isEmpty():
        found = found.unionByName(_some_of(met.where("_more is null")))
    times = (F.col("whole") + F.col("_more")).cast("int")
    return found.select(*(F.col("row").getField(c).alias(c) for c in names), F.col("_size").alias("size"), "source_size", "target", times.alias("times"))


def _some_of(tied: DataFrame) -> DataFrame:
    """Rows that repeat one another at an edge: ``take`` of each group's are taken. Numbered in salts, so that no task gets all."""
    tied = materialise(tied.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.floor(F.col("tied") / TOGETHER) + 1)), "mix-tied")
    key = ["_source", "_size"]
    sums = tied.groupBy(*key, "_salt").agg(F.count("*").alias("_rows"))
    before = sums.select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_salt").alias("_t"), (F.sum("_rows").over(Window.partitionBy(*key).orderBy("_salt")) - F.col("_rows")).alias("_before"))
    number = F.row_number().over(Window.partitionBy(*key, "_salt").orderBy("_digest"))
    numbered_rows = tied.withColumn("_number", number).join(before, _same({"_source": "_s", "_size": "_z", "_salt": "_t"}))
    return numbered_rows.withColumn("_more", (F.col("_before") + F.col("_number") <= F.col("take")).cast("int")).select(*[c for c in tied.columns if c != "_salt"])


def repeated(mix: DataFrame) -> DataFrame:
    """The rows of ``mixed``, each as many times as the mix takes it."""
    return mix.where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_copy")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def _sql() -> str:
    steps = []
    for k in range(CORRECTIONS):
        steps.append(f"""m{k} AS (SELECT *, target - sum(reps * size) OVER (PARTITION BY source) AS miss FROM g{k}),
r{k} AS (SELECT *, CASE WHEN size > 0 THEN least(floor(abs(miss) / size + 0.5)::BIGINT, CASE WHEN miss > 0 THEN n * {EPOCHS} - reps ELSE reps END) ELSE 0 END AS step FROM m{k}),
a{k} AS (SELECT *, abs(abs(miss) - step * size) AS rest FROM r{k}),
b{k} AS (SELECT *, -(min(CASE WHEN step > 0 AND rest < abs(miss) THEN {{'a': rest, 'z': -size}} END) OVER (PARTITION BY source)).z AS best FROM a{k}),
g{k + 1} AS (SELECT source, size, n, source_size, target, CASE WHEN size = best THEN reps + sign(miss)::BIGINT * step ELSE reps END AS reps FROM b{k})""")
    return rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {EPOCHS} * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS weight, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, cap::DOUBLE / weight AS fill, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT min_by(level, fill) FROM o WHERE fill >= level) * weight) AS target FROM o),
u AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio, ('0x' || left(md5('{SEED}:' || coalesce(source, '')), 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM t),
c AS (SELECT source, size, count(*) AS n FROM d GROUP BY source, size),
p AS (SELECT c.source, size, n, source_size, target, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS part, start, sum(n) OVER (PARTITION BY c.source ORDER BY size DESC) AS upto FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source),
g0 AS (SELECT source, size, n, source_size, target, whole * n + CASE WHEN size > 0 THEN (floor(part * upto + start) - floor(part * (upto - n) + start))::BIGINT ELSE 0 END AS reps FROM p),
{", ".join(steps)},
k AS (SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY digest) AS place FROM d)
SELECT doc_id, k.size, source_size, target, ((reps // n + CASE WHEN place <= reps % n THEN 1 ELSE 0 END) * k.size)::BIGINT AS taken FROM k JOIN g{CORRECTIONS} g ON k.source IS NOT DISTINCT FROM g.source AND k.size = g.size"""


ORACLE_SQL = _sql()
