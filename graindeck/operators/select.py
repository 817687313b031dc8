"""Selecting rows: latest per subject, bounded samples, top-k with evidence, budgets."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positive_limit(n: object) -> int:
    """A row limit: a whole number of at least 1 (no boolean); else ValueError."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"not a row limit: {n!r}")
    return n


def best_of(df: DataFrame, groups: Sequence[str], order: Column, keep: Sequence[str]) -> DataFrame:
    """One row per group, the one whose ``order`` struct is least, by a map-side combined aggregate: no group is sorted or held in
    one task, unlike row_number() = 1. ``order`` must end in a unique column to be deterministic."""
    best = df.groupBy(*groups).agg(F.min_by(F.struct(*keep), order).alias("__b"))
    return best.select(*groups, "__b.*")


def latest_per_subject(obs: DataFrame, keep: Sequence[str], subject: str = "subject_key", as_of: str = "effective_as_of", row: str = "source_row_id") -> DataFrame:
    """The row of the latest date per subject, null dates last, ties by row id ascending."""
    order = F.struct(F.col(as_of).isNull(), -F.coalesce(F.datediff(as_of, F.lit("1970-01-01")), F.lit(0)), F.col(row))
    return best_of(obs.where(F.col(subject).isNotNull()), [subject], order, keep)


def bounded_sample(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; each task passes on at most n rows of a group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("__r") <= positive_limit(n)).drop("__r")


def seats(df: DataFrame, kind: str, order: Sequence[Column], budget: dict[str, int]) -> DataFrame:
    """The first rows of each kind in one merged order, as many as the kind has seats; kinds without seats drop out."""
    allowed = F.create_map(*[F.lit(x) for kv in budget.items() for x in kv])[F.col(kind)]
    return df.withColumn("seat", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("seat") <= allowed)


def top_k(df: DataFrame, value: str, key: str, n: int, descending: bool = True) -> DataFrame:
    """The first n rows by value, nulls last, ties by key."""
    v = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return df.orderBy(v, F.col(key).asc()).limit(positive_limit(n))


def evidence(selected: DataFrame, subject: str = "subject_key", provenance: Sequence[str] = ("source_id",)) -> DataFrame:
    """One row over all selected observations before any cut: universe, span of both dates, unknown and unequal dates, distinct subjects
    above one row, rows that lack one of the ``provenance`` columns, and the distinct sources, of which there are few (a null source counts as one)."""
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in provenance])
    by_source = selected.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sort_array(F.collect_set("source_id")).alias("sources"), F.count_if(F.col("source_id").isNull()).alias("null_sources"))
    per = selected.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n"), F.min("order_as_of").alias("a"), F.max("order_as_of").alias("b"), F.min("display_as_of").alias("c"), F.max("display_as_of").alias("d"),
        F.count_if(F.col("order_as_of").isNull() | F.col("display_as_of").isNull()).alias("u"), F.count_if(~F.col("order_as_of").eqNullSafe(F.col("display_as_of"))).alias("m"), F.count_if(gap).alias("g"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("universe"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.min("a").alias("order_as_of_min"), F.max("b").alias("order_as_of_max"),
                  F.min("c").alias("display_as_of_min"), F.max("d").alias("display_as_of_max"), F.coalesce(F.sum("u"), F.lit(0)).alias("unknown_as_of"), F.coalesce(F.sum("m"), F.lit(0)).alias("as_of_mismatches"), F.coalesce(F.sum("g"), F.lit(0)).alias("provenance_missing"))
    return one.join(F.broadcast(by_source), F.lit(True))  # one row each


def ordered_union(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of several lists without repeats: a key keeps the row of the first list that has it (its least rank there)."""
    tagged = None
    for i, p in enumerate(parts):
        t = p.withColumn("path", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    rest = [c for c in tagged.columns if c not in (key, "path", "rank")]
    return best_of(tagged, [key], F.struct("path", "rank"), ["path", "rank", *rest])


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only; empty when both hold the same keys."""
    a, b = (d.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__" + s, F.lit(True)) for d, s in ((left, "l"), (right, "r")))
    return a.join(b, key, "full").where(F.col("__l").isNull() | F.col("__r").isNull()).select(key, F.when(F.col("__r").isNull(), "left_only").otherwise("right_only").alias("side"))


def admit(candidates: DataFrame, budget: int, bound: int = 100_000) -> DataFrame:
    """Admission under a budget with owners: in order of tier, longest match, count and id, a candidate with an owner needs its owner
    admitted before it; the first ``budget`` that may enter do. Adds admitted and reason (admitted, owner_not_admitted, over_budget).

    The order is sequential by nature and serves one request: up to ``bound`` candidates, more are refused.
    """
    rows = candidates.select("tier", "longest", "matches", "term", "owner").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} candidates for one request")
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r["tier"], -r["longest"], -r["matches"], r["term"])):
        reason = "owner_not_admitted" if r["owner"] and r["owner"] not in seen else "over_budget" if len(seen) >= budget else "admitted"
        if reason == "admitted":
            seen.add(r["term"])
        out.append((r["term"], reason == "admitted", reason))
    return candidates.sparkSession.createDataFrame(out, "term string, admitted boolean, reason string")
