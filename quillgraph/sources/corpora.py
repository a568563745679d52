"""Corpora over the driver's tables: an outline of regions, nations, customers and orders, and documents with vectors."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import file_system, shared_folder, workers_find_library
from .snapshot import Meta, Store

TABLES = ("region", "nation", "customer", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outline_ctes(spark_dialect: bool) -> str:
    """WITH e AS (entities), in Spark's or DuckDB's SQL.

    Pages are regions, a skipped page and a daily note; below regions stand nations, customers, and each
    customer's orders and ``tags::`` child. Stub lists are reversed on odd ids, so their order is not the outline's.
    """
    array = (lambda *x: f"array({', '.join(x)})") if spark_dialect else (lambda *x: f"[{', '.join(x)}]")
    listed, reverse = ("array_sort(collect_list(id))", "reverse") if spark_dialect else ("list(id ORDER BY id)", "list_reverse")
    names = {t: f"{{{t}}}" if spark_dialect else t for t in TABLES}

    def uid(letter: str, key: str) -> str:
        return f"concat('{letter}', lpad(CAST({key} AS STRING), 8, '0'))"

    def entity(ident: str, uid_: str, string: str, title: str, page: str, parent: str, parents: list[str], order: str, time: str, edited: str, source: str) -> str:
        path = array(*(f"CAST({p} AS BIGINT)" for p in parents)) if parents else f"CAST({array()} AS {'array<bigint>' if spark_dialect else 'BIGINT[]'})"
        return f"""SELECT CAST({ident} AS BIGINT) AS id, {uid_} AS uid, {string} AS string, {title} AS title, CAST({page} AS BIGINT) AS page_id,
  CAST({parent} AS BIGINT) AS parent_id, {path} AS path, CAST({order} AS BIGINT) AS ord, CAST({time} AS BIGINT) AS time, CAST({edited} AS BIGINT) AS edit_time FROM {source}"""

    none = "CAST(NULL AS STRING)"
    region, nation, customer = "1000000 + {r}", "2000000 + {n}", "10000000 + {c}"
    r, n, c = region.format(r="n_regionkey"), nation.format(n="n_nationkey"), customer.format(c="c_custkey")
    people = f"{names['customer']} JOIN {names['nation']} ON c_nationkey = n_nationkey"
    bought = f"{names['orders']} JOIN {names['customer']} ON o_custkey = c_custkey JOIN {names['nation']} ON c_nationkey = n_nationkey"
    parts = [
        entity(region.format(r="r_regionkey"), uid("R", "r_regionkey"), none, "concat('Region [[', r_name, ']]')", "NULL", "NULL", [], "r_regionkey", "1000", "NULL", names["region"]),
        entity(n, uid("N", "n_nationkey"), "concat('**nation** [[', n_name, ']] #c:blue #nat-', CAST(n_nationkey AS STRING))", none, r, r, [r], "100 - n_nationkey", "2000", "3000 + n_nationkey", names["nation"]),
        entity(c, uid("C", "c_custkey"), f"concat('Owner:: ', c_name, '  of ((', {uid('N', 'n_nationkey')}, ')) #[[', c_mktsegment, ']]')", none, r, n, [r, n], "c_custkey", "c_custkey", "NULL", people),
        entity("500000000 + c_custkey", uid("T", "c_custkey"), "CASE WHEN c_custkey % 2 = 0 THEN concat('tags:: [[', c_mktsegment, ']] #cust') ELSE concat('tags:: ', c_mktsegment, ' , plain,, ') END", none, r, c, [r, n, c], "-1", "5", "NULL", people),
        entity("1000000000 + o_orderkey", uid("O", "o_orderkey"), "concat('{{[[TODO]]}} order ', CAST(o_orderkey AS STRING), ' [total](http://h/a(1)) ~~', o_orderpriority, '~~ __due__')" if not spark_dialect else "concat('{{{{[[TODO]]}}}} order ', CAST(o_orderkey AS STRING), ' [total](http://h/a(1)) ~~', o_orderpriority, '~~ __due__')", none, r, c, [r, n, c], "o_orderkey", "7", "8", bought),
        entity("900", "'SKIPPED01'", none, "'roam/css'", "NULL", "NULL", [], "0", "1", "NULL", "(SELECT 1 AS one) s1"),
        entity("901", "'SKIPPED02'", "'never shown'", none, "900", "900", ["900"], "0", "1", "NULL", "(SELECT 1 AS one) s2"),
        entity("902", "'01-02-2024'", none, "'January 2nd, 2024'", "NULL", "NULL", [], "0", "1", "NULL", "(SELECT 1 AS one) s3"),
        entity("903", "'DAILY0001'", "'```python\nnote on [[Rivers of [[Peru]] basin]]'", none, "902", "902", ["902"], "0", "1", "NULL", "(SELECT 1 AS one) s4"),
        entity("904", "'DAILY0002'", "'{{{{[[kanban]]}}}}'" if spark_dialect else "'{{[[kanban]]}}'", none, "902", "902", ["902"], "1", "1", "NULL", "(SELECT 1 AS one) s5"),
    ]
    union = "\nUNION ALL\n".join(parts)
    return f"""WITH raw AS ({union}),
kids AS (SELECT parent_id, {listed} AS ids FROM raw WHERE parent_id IS NOT NULL GROUP BY parent_id),
e AS (SELECT raw.id, uid, string, title, page_id, CASE WHEN raw.id % 2 = 1 THEN {reverse}(path) ELSE path END AS parents,
  CASE WHEN raw.id % 2 = 1 THEN {reverse}(ids) ELSE ids END AS children, ord, time, edit_time, raw.id AS ordinal, raw.parent_id
  FROM raw LEFT JOIN kids ON raw.id = kids.parent_id)"""


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline as entity rows."""
    found = spark.sql(outline_ctes(True) + " SELECT * FROM e", **{t: table(spark, sf_dir, t) for t in TABLES})
    return found.select("id", "uid", "string", "title", "page_id", "parents", "children", F.col("ord").alias("order"), "time", "edit_time", "ordinal")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, ordinal, text): ids serve as both."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.col("doc_id").alias("ordinal"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents, by equal ids."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.col("vec_id").alias("ordinal"), "embedding").join(ids, "uid", "left_semi")


def documents_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, ordinal, embedding) of the documents that have one, as a store has them."""
    return documents(spark, sf_dir).drop("text").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), "embedding"), "uid")


_stores: dict[tuple[str, str], tuple[SparkSession, Store]] = {}


def document_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store of the documents and their vectors, indexed once for a session and deleted with the process."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if known_store(spark, sf_dir) is None:
        store = Store(f"{shared_folder(spark)}/quillgraph-documents-{uuid.uuid4().hex}", ("text",))
        given = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), "embedding")
        store.write(spark, documents(spark, sf_dir).join(given, "uid", "left"), Meta("documents", "given", 64, "", 0))
        _stores[key] = (spark, store)
    return _stores[key][1]


def known_store(spark: SparkSession, sf_dir: str) -> Store | None:
    """``document_store`` if this session has it already."""
    return _stores.get((spark.sparkContext.applicationId, sf_dir), (None, None))[1]


@atexit.register
def _delete_stores() -> None:
    for spark, store in _stores.values():
        try:
            path, fs = file_system(spark, store.path)
            fs.delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
