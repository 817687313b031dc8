"""Problem 2: entity-attribute-value rows into one wide row per entity.

Rows are reduced to one per (entity, field) with a map-side combined aggregate, so no entity, however many rows it has, is
held in one task; the pairs (at most one per catalog entry) then become a map per entity, whose known keys are projected
into typed columns. Values that don't read as their type are kept in ``cast_failures``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graindeck.functions import values as V
from graindeck.sources.tables import finite, folded_key, with_own_spelling

PLAIN_DIMENSIONS = ["count", "days", "multiplier"]
SQL_TYPES = {"string": "string", "integer": "bigint", "decimal": "double", "boolean": "boolean", "date": "date", "number": "double"}


def attribute_cells(attributes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(entity, field_id, kind, value, failure, at, row): label_value read by its catalog type. An attribute that isn't in
    the catalog reads as a string; rows without subject or attribute are left out, as they belong to no cell."""
    kinds = catalog.select("attribute_id", "value_type").dropDuplicates(["attribute_id"])
    a = attributes.where(F.col("subject_key").isNotNull() & F.col("attribute_id").isNotNull()).select("subject_key", "attribute_id", "label_value", "effective_as_of", "source_row_id")
    a = a.join(F.broadcast(kinds), "attribute_id", "left").withColumn("kind", F.coalesce("value_type", F.lit("string")))  # tens of rows at any scale
    a = a.withColumn("value", V.by_type(F.col("label_value"), F.col("kind")))
    shown = F.when(F.col("kind") == "string", F.regexp_replace(V.trimmed(F.col("label_value")), r"\s+", " ")).otherwise(F.col("value"))
    return a.select(folded_key("subject_key").alias("entity"), F.col("attribute_id").alias("field_id"), "kind", "value", F.when(F.col("value").isNotNull(), shown).alias("shown"),
                    F.when(F.col("value").isNull() & V.folded_text(F.col("label_value")).isNotNull(), F.col("label_value")).alias("failure"),
                    F.col("effective_as_of").alias("at"), F.col("source_row_id").alias("row"))


def metric_cells(metrics: DataFrame, catalog: DataFrame, dimensions: list[str] | None = None, common: str = "numeric_value") -> DataFrame:
    """As ``attribute_cells``: finite numeric_value of rows whose value_status is exactly 'valid', of the dimensions named. ``common``: the column with
    the value in its common unit, where that is another; a numeric_value that has none fails with the unit it was recorded in."""
    kinds = catalog.where(F.col("dimension").isin(dimensions or PLAIN_DIMENSIONS)).select("metric_id").dropDuplicates()
    m = metrics.where(F.col("subject_key").isNotNull() & (F.col("value_status") == "valid")).join(F.broadcast(kinds), "metric_id")
    value = F.when(finite(common), F.when(F.col(common) == 0, F.lit(0.0)).otherwise(F.col(common)).cast("string"))
    recorded = F.col("numeric_value").cast("string") if common == "numeric_value" else F.concat_ws(" ", F.col("numeric_value").cast("string"), "unit_code", "currency_code")
    return m.select(folded_key("subject_key").alias("entity"), F.col("metric_id").alias("field_id"), F.lit("number").alias("kind"), value.alias("value"), value.alias("shown"),
                    F.when(F.col("numeric_value").isNotNull() & value.isNull(), recorded).alias("failure"),
                    F.col("effective_as_of").alias("at"), F.col("source_row_id").alias("row"))


def resolved_pairs(cells: DataFrame) -> DataFrame:
    """One row per (entity, field): the value of the latest row that has one (a date outside 2000 to 2026 is none; ties: highest
    row id, then value), the least and the greatest value any row has, and a text that failed to cast, if any."""
    day = F.when(F.col("at").between("2000-01-01", "2026-12-31"), F.col("at"))
    order = F.struct(F.coalesce(day, F.lit("1000-01-01").cast("date")), F.coalesce("row", F.lit("")), F.col("value"))
    has = F.col("value").isNotNull()
    return cells.groupBy("entity", "field_id", "kind").agg(
        F.max_by(F.col("shown"), F.when(has, order)).alias("value"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.max("failure").alias("failure"))


def widen(pairs: DataFrame, fields: list[tuple[str, str]], entities: DataFrame) -> DataFrame:
    """subject_key, one typed column per (field, kind) of ``fields`` (':' written '_'), ``cast_failures`` (field to text) and
    ``competing``: fields whose least and greatest value, read as the column's type, differ, sorted. Fields not named go to ``others``."""
    maps = pairs.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field_id", F.struct("value", "least", "greatest"))))).alias("known"),
        F.map_from_entries(F.collect_list(F.when(F.col("failure").isNotNull(), F.struct("field_id", "failure")))).alias("cast_failures"))
    cells, competing = [], []
    for field, kind in fields:
        pair = F.col("known").getItem(field)
        typed = pair["value"].try_cast("double").cast("bigint") if kind == "integer" else pair["value"].try_cast(SQL_TYPES[kind])
        cells.append(typed.alias(field.replace(":", "_")))
        of = "double" if kind == "integer" else SQL_TYPES[kind]  # a whole number may be written with decimals; they tell values apart
        competing.append(F.when(pair["least"].try_cast(of) != pair["greatest"].try_cast(of), F.lit(field)))
    others = F.map_filter("known", lambda k, _: ~k.isin([f for f, _ in fields]))
    unnamed = F.map_keys(F.map_filter(others, lambda _, x: x["least"] != x["greatest"]))
    wide = maps.select("entity", *cells, "cast_failures", F.sort_array(F.concat(F.array_compact(F.array(F.lit(None).cast("string"), *competing)), unnamed)).alias("competing"),
                       F.transform_values(others, lambda _, x: x["value"]).alias("others"))
    return with_own_spelling(wide, "entity", entities, "subject_key", "subject_key")


def catalog_fields(attribute_catalog: DataFrame, metric_catalog: DataFrame, bound: int = 2_000) -> list[tuple[str, str]]:
    """(field, kind) of both catalogs, which name the columns; more than ``bound`` entries are refused."""
    a = attribute_catalog.select("attribute_id", "value_type").dropDuplicates(["attribute_id"]).orderBy("attribute_id").limit(bound + 1).collect()
    m = metric_catalog.select("metric_id").dropDuplicates().orderBy("metric_id").limit(bound + 1).collect()
    if len(a) + len(m) > bound:
        raise ValueError(f"more than {bound} fields")
    return [(x[0], x[1]) for x in a] + [(x[0], "number") for x in m]


def found(pairs: DataFrame, fields: list[tuple[str, str]], entities: DataFrame) -> DataFrame:
    """Cells of the wide table with two or more different values: the fields its typed columns show as competing."""
    wide = widen(pairs, fields, entities)
    return wide.select("subject_key", F.explode("competing").alias("field_id"))
