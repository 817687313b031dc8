"""Problem 4: the N highest items of every group, however large a group is.

Exact group counts part the groups. Heavy ones are range-sorted by (group, order): a salt is the task a row falls into, each
task keeps its first N rows per group, and those few are ranked again. Light groups are ranked by one window each. Ties of the
score are settled by the tie column; rows equal in both are re-deliveries and share a rank.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graindeck.session import parallelism


def top_n(rows: DataFrame, groups: list[str], score: str, tie: str, n: int, heavy_rows: int = 20_000, partitions: int | None = None) -> DataFrame:
    """The first ``n`` distinct rows of each group by ``score`` descending, then ``tie`` ascending, with their rank.

    Null scores are no items; a column named rank gives way to the result's. A group may be null in any of its columns. Groups of more than ``heavy_rows`` rows, of which there
    are at most rows / heavy_rows, take the salted way; both ways give the same result. Other columns must be functions of
    group, score and tie (re-delivered rows equal in all columns), or the least of each comes out.
    """
    rows = rows.where(F.col(score).isNotNull()).drop("rank")
    others = [c for c in rows.columns if c not in (*groups, score, tie)]
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    heavy = counts.where(F.col("__n") > heavy_rows).select(*[F.col(g).alias(f"__{g}") for g in groups])
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    hot = rows.join(heavy, same, "left_semi")
    cold = rows.join(heavy, same, "left_anti")
    order = [F.col(score).desc(), F.col(tie).asc_nulls_last()]
    # dense_rank() <= n is cut per task before any exchange, so at most n rows of a group leave a task (plus re-deliveries)
    hot = hot.repartitionByRange(partitions or parallelism(rows.sparkSession), *groups, *order).withColumn("__salt", F.spark_partition_id())
    hot = hot.withColumn("__r", F.dense_rank().over(Window.partitionBy(*groups, "__salt").orderBy(*order))).where(F.col("__r") <= n).drop("__r", "__salt")

    def ranked(df: DataFrame) -> DataFrame:
        df = df.withColumn("rank", F.dense_rank().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)
        return df.groupBy(*groups, "rank").agg(F.first(score).alias(score), F.first(tie).alias(tie), *[F.min(c).alias(c) for c in others])

    return ranked(hot).unionByName(ranked(cold)).select(*rows.columns, "rank")
