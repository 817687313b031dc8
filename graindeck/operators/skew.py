"""Problem 3: per-key results where a few keys hold most rows.

Two stages: rows of heavy keys get a random salt, partial results are made per (key, salt), and partials are merged by key.
Heavy keys are those with at least ``heavy_share`` of all rows by exact count, so there are at most 1 / heavy_share of them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(rows: DataFrame, key: str, heavy_share: float) -> DataFrame:
    """Keys with at least that share of all rows; at most 1 / heavy_share rows. A null key can be heavy too."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("t"))
    return counts.where(F.col("__n") >= F.lit(heavy_share) * total.scalar()).select(F.col(key).alias("__heavy"))


def salted(rows: DataFrame, key: str, by: Column, salts: int, heavy_share: float, counted: DataFrame | None = None) -> DataFrame:
    """Add ``__salt``: pmod(hash(by), salts) on rows of heavy keys, 0 elsewhere. Hashing a row's own id, not rand(), gives the
    same salt when a lost task runs again. ``counted``: rows by which to tell heavy keys, where counting ``rows`` would make them twice."""
    heavy = F.broadcast(heavy_keys(rows if counted is None else counted, key, heavy_share))  # at most 1 / heavy_share rows
    flagged = rows.join(heavy.withColumn("__is", F.lit(True)), rows[key].eqNullSafe(F.col("__heavy")), "left").drop("__heavy")
    return flagged.withColumn("__salt", F.when(F.col("__is"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0))).drop("__is")


def per_key(rows: DataFrame, key: str, row_id: str, weight: str | None = None, item: str | None = None, salts: int = 64, heavy_share: float = 0.005, counted: DataFrame | None = None) -> DataFrame:
    """(key, n_rows[, total_weight][, n_items]): rows, sum of ``weight`` (nulls add nothing; null if all are) and number of
    distinct non-null ``item`` per key. The null key comes out as one row. An empty table gives no rows.

    The partials keep the item, so distinct items stay exact: (key, salt, item) merges to (key, item), then to key.
    """
    s = salted(rows, key, F.col(row_id), salts, heavy_share, counted)
    items = [item] if item else []
    parts = [F.count(F.lit(1)).alias("n_rows"), *([F.sum(weight).alias("total_weight")] if weight else [])]
    merge = [F.sum("n_rows").alias("n_rows"), *([F.sum("total_weight").alias("total_weight")] if weight else [])]
    partial = s.groupBy(key, "__salt", *items).agg(*parts)
    if item:
        partial = partial.groupBy(key, item).agg(*merge)
    return partial.groupBy(key).agg(*merge, *([F.count(item).alias("n_items")] if item else []))


def found(counts: DataFrame, key: str, share: float) -> DataFrame:
    """Keys with at least ``share`` of all rows (the null key counts into the total only)."""
    total = counts.agg(F.sum("n_rows").alias("t"))
    return counts.where(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(share) * total.scalar()))
