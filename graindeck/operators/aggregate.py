"""Aggregates with the null, zero and tie rules of evidence-preserving results."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(value: str | Column, order: str | Column) -> Column:
    """The non-null value of the least order (min_by alone would return a null value)."""
    value = F.col(value) if isinstance(value, str) else value
    order = F.col(order) if isinstance(order, str) else order
    return F.min_by(value, F.when(value.isNotNull(), order))


def some_value(value: str | Column) -> Column:
    """A value that doesn't depend on the order of rows: the least non-null one."""
    return F.min(value)


def percentile_linear(c: str | Column, p: float) -> Column:
    """Linear interpolation between the two nearest ranks."""
    return F.percentile(c, F.lit(p))


def percentile_nearest_rank(c: Column | str, p: float) -> Column:
    """The value at rank ceil(p n), at least 1; nulls aside."""
    return F.expr(f"percentile_disc({p}) within group (order by {c})") if isinstance(c, str) else F.call_function("percentile_disc", c, F.lit(p))


def upper_median(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """values[n div 2] of each group's sorted values, by counting: equal values are combined before anything is sorted, so a group is
    never collected. Nulls aside; groups without a value give no row."""
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*groups).orderBy(value)
    ranked = counts.withColumns({"__to": F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(Window.partitionBy(*groups))})
    at = F.floor(F.col("__all") / 2)
    return ranked.where((at < F.col("__to")) & (at >= F.col("__to") - F.col("__n"))).select(*groups, F.col(value).alias("upper_median"))


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_rows, n_nonblank, n_castfail, n_padded, n_zero) of text columns, all in one scan and one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        t = F.col(c).cast("string")
        trimmed = F.nullif(F.trim(t), F.lit(""))
        aggs += [F.count(trimmed).alias(f"a{i}"), F.count_if(trimmed.isNotNull() & trimmed.try_cast("double").isNull()).alias(f"b{i}"),
                 F.count_if(t != F.trim(t)).alias(f"c{i}"), F.count_if(trimmed.try_cast("double") == 0).alias(f"d{i}")]
    one = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("n_rows"), F.col(f"a{i}").alias("n_nonblank"), F.col(f"b{i}").alias("n_castfail"),
                               F.col(f"c{i}").alias("n_padded"), F.col(f"d{i}").alias("n_zero")) for i, c in enumerate(columns)])
    return one.select(F.inline(cells))


def status_coverage(obs: DataFrame, field: str, groups: Sequence[str] = ("family_id", "subject_grain")) -> DataFrame:
    """Per field and group: rows, distinct subjects in all and by status, the most rows of one subject, span of dates, sources.

    Two aggregates that share their first grouping (field, groups, subject), so distinct subjects need no expansion of rows.
    """
    by_subject = obs.groupBy(field, *groups, "subject_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value_status") == "valid").alias("v"), F.count_if(F.col("value_status") == "zero_excluded").alias("z"),
        F.count_if(F.col("value_status") == "parse_failed").alias("f"), F.min("effective_as_of").alias("lo"), F.max("effective_as_of").alias("hi"),
        F.count_if(F.col("effective_as_of").isNull()).alias("u"))
    known = F.col("subject_key").isNotNull()
    return by_subject.groupBy(field, *groups).agg(
        F.sum("n").alias("n_rows"), F.count_if(known).alias("n_subjects"), F.count_if(known & (F.col("v") > 0)).alias("n_valid_subjects"),
        F.count_if(known & (F.col("z") > 0)).alias("n_zero_subjects"), F.count_if(known & (F.col("f") > 0)).alias("n_failed_subjects"),
        F.max("n").alias("max_rows_per_subject"), F.min("lo").alias("as_of_min"), F.max("hi").alias("as_of_max"), F.sum("u").alias("n_unknown_as_of"))


def with_missing(coverage: DataFrame, totals: DataFrame, groups: Sequence[str] = ("family_id", "subject_grain")) -> DataFrame:
    """Coverage with subject_total of its group and how many of them have no row, never below zero."""
    out = coverage.join(totals, list(groups), "left")
    return out.withColumn("missing_subjects", F.greatest(F.coalesce("subject_total", F.lit(0)) - F.col("n_subjects"), F.lit(0)))


def variants_joined(names: Column, separator: str = "||") -> Column:
    """Distinct non-null values, sorted and joined."""
    return F.array_join(F.sort_array(F.collect_set(names)), separator)


def uniqueness(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys (null parts count as a value), rows with a null part, whether the key is unique."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    any_null = F.lit(False)
    for k in key:
        any_null |= F.col(k).isNull()
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.when(any_null, F.col("n"))), F.lit(0)).alias("n_null_keys")).withColumn(
        "is_unique", (F.col("n_rows") == F.col("n_keys")) & (F.col("n_null_keys") == 0))
