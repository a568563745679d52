"""Entity rows from JSON lines, strict or lenient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITY

_RAW = "id long, uid string, string string, title string, page struct<id: long>, parents array<struct<id: long>>, children array<struct<id: long>>, `order` long, time long, `edit-time` long"
_ids = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<id: bigint>>")), lambda x: x["id"]), lambda i: i.isNotNull())


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select("id", "uid", "string", "title", F.col("page.id").alias("page_id"), _ids("parents").alias("parents"), _ids("children").alias("children"), "order", "time", F.col("`edit-time`").alias("edit_time"), "ordinal")


def read_entities(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Entities of a file of JSON lines with a uid; ordinal follows the input's order.

    Well-formed rows read the same either way. ``lenient`` takes a field of another type as null, a number that is
    no integer as null, and drops only malformed stubs of a list instead of the list.
    """
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return from_json(lines, lenient)


def from_json(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """Entities of ``lines`` (value string, ordinal long)."""
    if not lenient:
        return _shaped(lines.select(F.from_json("value", _RAW).alias("_entity"), "ordinal").select("_entity.*", "ordinal")).where("uid is not null")
    whole = F.try_parse_json("value")

    def field(name: str, kind: str, sql: str) -> Column:
        part = F.try_variant_get(whole, f"$['{name}']", "variant")
        return F.when(F.schema_of_variant(part) == kind, F.try_variant_get(whole, f"$['{name}']", sql))

    def stubs(name: str) -> Column:
        items = F.coalesce(F.try_variant_get(whole, f"$['{name}']", "array<variant>"), F.array().cast("array<variant>"))
        return F.filter(F.transform(items, lambda x: F.when(F.schema_of_variant(F.try_variant_get(x, "$.id", "variant")) == "BIGINT", F.try_variant_get(x, "$.id", "bigint"))), lambda i: i.isNotNull())

    number = lambda name: field(name, "BIGINT", "bigint")
    page = F.when(F.schema_of_variant(F.try_variant_get(whole, "$.page.id", "variant")) == "BIGINT", F.try_variant_get(whole, "$.page.id", "bigint"))
    found = lines.select(number("id").alias("id"), *(field(c, "STRING", "string").alias(c) for c in ("uid", "string", "title")), page.alias("page_id"), stubs("parents").alias("parents"), stubs("children").alias("children"), *(number(c).alias(c) for c in ("order", "time")), number("edit-time").alias("edit_time"), "ordinal")
    return found.where("uid is not null").select(*ENTITY.fieldNames())


def unwrapped(answers: DataFrame) -> DataFrame:
    """Entities of query answers (value string): each a JSON list of lists that begin with one entity; any other shape fails."""
    rows = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    each = answers.select(F.posexplode(F.coalesce(rows, F.raise_error(F.lit("the answer is no list of rows")).cast("array<variant>"))).alias("ordinal", "row"))
    entity = F.try_variant_get("row", "$[0]", "variant")
    shaped = F.when(F.startswith(F.schema_of_variant(entity), F.lit("OBJECT")), F.to_json(entity)).otherwise(F.raise_error(F.lit("a row of the answer does not begin with an entity")))
    return from_json(each.select(shaped.alias("value"), F.col("ordinal").cast("long").alias("ordinal")), lenient=True)


def uid_sweep(entities: DataFrame) -> DataFrame:
    return entities.where("uid is not null").select("uid")


def edited_since(entities: DataFrame, since: int) -> DataFrame:
    return entities.where(F.col("edit_time") > since).select("uid")


def profile(entities: DataFrame) -> DataFrame:
    """One row of counts over the graph."""
    return entities.agg(
        F.count("*").alias("entities"), F.count_if(F.col("title").isNotNull()).alias("pages"), F.count_if(F.col("string").isNotNull()).alias("blocks"),
        F.count_if(F.col("title").isNull() & F.col("string").isNull()).alias("other"), F.count("time").alias("with_time"), F.count("edit_time").alias("with_edit_time"),
        F.count_if(F.col("string") == "").alias("empty_strings"), F.coalesce(F.sum(F.length("string")), F.lit(0)).alias("characters"),
    )
