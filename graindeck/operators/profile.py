"""Problem 6: column-level data quality profile, and changes from one load to the next.

All columns are unpivoted to (column, value, load) and counted there first, which combines on the map side: a value that a
third of all rows share crosses the network once per task. The counted values are range-sorted by (column, value); sums per
task and column, a few numbers each, give every task its offset, so ranks, exact quantiles, exact distinct counts and the
cumulative curve of each load come from one sort, and the largest gap of two loads' curves is their exact
Kolmogorov-Smirnov distance.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graindeck.functions.identifiers import isin_valid
from graindeck.session import cut, parallelism
from graindeck.sources.tables import finite

# The statuses a column may hold.
VALUE_STATUSES = ["valid", "zero_excluded", "parse_failed", "date_parse_failed"]
IDENTIFIER_STATUSES = ["checksum_verified", "format_matched", "format_matched_checksum_failed", "unverified_scheme", "absent", "declared_by_source", "placeholder"]
NUMBERS = {"double", "float", "int", "bigint", "smallint", "tinyint"}


def value_counts(df: DataFrame, load: str, columns: list[str] | None = None, nulls_only: tuple[str, ...] = ()) -> DataFrame:
    """(column_name, text, num, rest, load, n): how often each exact value stands in each column and load, null as null.

    Columns in ``nulls_only`` count as null or not, all values alike.

    num orders a value: numbers by themselves (NaN above all), dates and timestamps by time, other types by text only (num null).
    rest is what num, a double, lacks of a long integer or a decimal.
    """
    kinds = dict(df.dtypes)
    cells = []
    for c in columns or df.columns:
        kind, col = kinds[c], F.col(f"`{c}`")
        rest = F.lit(None).cast("double")
        if kind in NUMBERS or kind.startswith("decimal"):
            num = F.when(col == 0, F.lit(0.0)).otherwise(col.cast("double"))
            if kind == "bigint" or kind.startswith("decimal"):
                exact = "decimal(38,0)" if kind == "bigint" else f"decimal(38,{kind.rstrip(')').split(',')[-1]})"
                rest = (col.try_cast(exact) - num.try_cast(exact)).cast("double")
        elif kind == "date":
            num = F.datediff(col, F.lit("1970-01-01")).cast("double")
        elif kind.startswith("timestamp"):
            num = F.unix_micros(col.cast("timestamp")).cast("double")
        else:
            num = F.lit(None).cast("double")
        if c in nulls_only:
            num, rest, col = F.lit(None).cast("double"), F.lit(None).cast("double"), F.when(col.isNotNull(), F.lit(""))
        # booleans, arrays and structs profile by their text
        cells.append(F.struct(F.lit(c).alias("column_name"), (F.to_json(col) if kind.startswith(("array", "map", "struct")) and c not in nulls_only else col.cast("string")).alias("text"), num.alias("num"), rest.alias("rest")))
    return df.select(F.col(load).alias("load"), F.explode(F.array(*cells)).alias("c")).groupBy("c.column_name", "c.text", "c.num", "c.rest", "load").agg(F.count(F.lit(1)).alias("n"))


def column_profile(counts: DataFrame, points: tuple[float, ...] = (0.01, 0.25, 0.5, 0.75, 0.99), partitions: int | None = None) -> DataFrame:
    """(column_name, n_rows, n_null, null_rate, n_distinct, minimum, maximum, quantiles): exact, any column type.

    quantiles maps each point to the value at that rank of the non-null rows (the lower of two). A column that is null throughout
    has null minimum, maximum and an empty map. NaN is a value and sorts above all numbers.
    """
    spark = counts.sparkSession
    values = counts.groupBy("column_name", "text", "num", "rest").agg(F.sum("n").alias("n"))
    # written once: a second run of the sort could draw its range borders elsewhere and give other buckets
    sorted_values = values.repartitionByRange(partitions or parallelism(spark), "column_name", "num", "rest", "text").withColumn("bucket", F.spark_partition_id())
    values = cut(sorted_values, "profile-values")
    ordered = values.where(F.col("text").isNotNull())
    offsets = ordered.groupBy("column_name", "bucket").agg(F.sum("n").alias("__b"))  # tasks times columns, some thousand rows
    before = Window.partitionBy("column_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("column_name", "bucket", F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("offset"), F.sum("__b").over(Window.partitionBy("column_name")).alias("present"))
    inside = Window.partitionBy("column_name", "bucket").orderBy("num", "rest", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ordered.withColumn("upto", F.sum("n").over(inside)).join(offsets, ["column_name", "bucket"])
    last, first = F.col("offset") + F.col("upto"), F.col("offset") + F.col("upto") - F.col("n")
    rank = lambda p: F.ceil(F.lit(p) * F.col("present"))
    hits = F.filter(F.array(*[F.when((rank(p) > first) & (rank(p) <= last), F.lit(str(p))) for p in points]), lambda x: x.isNotNull())
    at = ranked.select("column_name", "text", "num", "rest", "n", hits.alias("hits"))
    ends = at.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.min_by("text", F.struct("num", "rest", "text")).alias("minimum"), F.max_by("text", F.struct("num", "rest", "text")).alias("maximum"),
        F.map_from_entries(F.flatten(F.collect_list(F.when(F.size("hits") > 0, F.transform("hits", lambda h: F.struct(h, F.col("text"))))))).alias("quantiles"))
    totals = values.groupBy("column_name").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    return totals.join(ends, "column_name", "left").select(
        "column_name", "n_rows", "n_null", (F.col("n_null") / F.col("n_rows")).alias("null_rate"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "minimum", "maximum",
        F.coalesce("quantiles", F.create_map().cast("map<string,string>")).alias("quantiles"))


def load_order(sources: DataFrame, present: DataFrame) -> DataFrame:
    """(load, before): each load of ``present`` with the feed's load before it that has rows there, by collected_at then id."""
    w = Window.partitionBy("source_name").orderBy("collected_at", "source_id")
    own = sources.join(present.select(F.col("load").alias("source_id")), "source_id", "left_semi")
    return own.select(F.col("source_id").alias("load"), F.lag("source_id").over(w).alias("before")).where(F.col("before").isNotNull())


def load_shifts(counts: DataFrame, sources: DataFrame, partitions: int | None = None) -> DataFrame:
    """(column_name, load, before, share_change, value, null_change, ks): what changed from the feed's load before.

    The values of a load and of the load before it are merged in one order with both cumulative counts. share_change is the
    largest step between neighbours of the two curves, that is, of the share of one exact non-null value among all rows of its
    load (``value`` is that value, the least of equals); ks is the largest gap between the curves over non-null values. Counts add
    up as integers and are divided once, so no order of addition changes a figure. null_change is that of the share of nulls.
    """
    spark, counts = counts.sparkSession, cut(counts, "profile-counts")
    sizes = counts.groupBy("column_name", "load").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("n"))), F.lit(0)).alias("present"))
    order = load_order(sources, counts.select("load").distinct())
    past = sizes.select("column_name", F.col("load").alias("before"), F.col("rows").alias("rows_before"), F.col("present").alias("present_before"))
    sized = cut(sizes.join(order, "load").join(past, ["column_name", "before"]), "profile-loads")  # loads times columns
    # each count serves its load and the load after it
    own = counts.where(F.col("text").isNotNull()).select("column_name", "num", "rest", "text", "load", "n")
    both = own.join(F.broadcast(order.select("load")), "load").withColumn("m", F.lit(0).cast("bigint")).unionByName(
        own.withColumnRenamed("load", "before").join(F.broadcast(order), "before").select("column_name", "num", "rest", "text", "load", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("m")))
    steps = both.groupBy("column_name", "load", "num", "rest", "text").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    steps = steps.repartitionByRange(partitions or parallelism(spark), "column_name", "load", "num", "rest", "text").withColumn("bucket", F.spark_partition_id())
    steps = cut(steps, "profile-steps")  # written once, as above
    sums = steps.groupBy("column_name", "load", "bucket").agg(F.sum("n").alias("__n"), F.sum("m").alias("__m"))
    w = Window.partitionBy("column_name", "load").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("column_name", "load", "bucket", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias("from" + c) for c in ("__n", "__m")])
    line = Window.partitionBy("column_name", "load", "bucket").orderBy("num", "rest", "text")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = steps.withColumns({"upto_n": F.sum("n").over(upto), "upto_m": F.sum("m").over(upto)})
    curve = curve.withColumns({"step_n": F.col("upto_n") - F.lag("upto_n", 1, 0).over(line), "step_m": F.col("upto_m") - F.lag("upto_m", 1, 0).over(line)})
    curve = curve.join(sums, ["column_name", "load", "bucket"]).join(F.broadcast(sized), ["column_name", "load"])
    share = lambda c, of: c / F.greatest(F.col(of), F.lit(1))
    curve = curve.select("column_name", "load", "text", F.abs(share(F.col("step_n"), "rows") - share(F.col("step_m"), "rows_before")).alias("d"),
                         F.abs(share(F.col("from__n") + F.col("upto_n"), "present") - share(F.col("from__m") + F.col("upto_m"), "present_before")).alias("gap"))
    gone = curve.groupBy("column_name", "load").agg(F.max("d").alias("share_change"), F.min_by("text", F.struct(-F.col("d"), F.col("text"))).alias("value"), F.max("gap").alias("ks"))
    nulls = F.abs(share(F.col("rows") - F.col("present"), "rows") - share(F.col("rows_before") - F.col("present_before"), "rows_before"))
    return sized.join(gone, ["column_name", "load"], "left").select(
        "column_name", "load", "before", F.coalesce("share_change", F.lit(0.0)).alias("share_change"), "value", nulls.alias("null_change"), F.coalesce("ks", F.lit(0.0)).alias("ks"))


def metric_violations(metrics: DataFrame) -> DataFrame:
    """(table_name, column_name, item_key) of metric rows that break the pattern of value_status or raw_text_value, each once.

    A null status is outside the list. Rows without metric_id or source_row_id have no key and come out with a null one.
    """
    s, v = F.col("value_status"), F.col("numeric_value")
    status = (F.coalesce(~s.isin(VALUE_STATUSES), F.lit(True))
              | ((s == "valid") & (~finite(v) | (v == 0))) | ((s == "zero_excluded") & (v.isNull() | (v != 0))) | ((s == "parse_failed") & v.isNotNull()))
    text = v.isNotNull() & ~F.col("raw_text_value").rlike("[0-9]")
    key = F.concat("metric_id", F.lit("@"), "source_row_id")
    return _broken(metrics, "metric_observation", key, {"value_status": status, "raw_text_value": text})


def holding_violations(holdings: DataFrame) -> DataFrame:
    """The same for identifier_status of holdings."""
    s, held = F.col("identifier_status"), F.col("held_security_id_raw")
    bad = (F.coalesce(~s.isin(IDENTIFIER_STATUSES), F.lit(True)) | ((s == "absent") & held.isNotNull()) | ((s != "absent") & held.isNull())
           | ((s == "checksum_verified") & ~isin_valid(held)))
    return _broken(holdings, "holding_observation", F.col("holding_key"), {"identifier_status": bad})


def _broken(df: DataFrame, name: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    marks = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(c)) for c, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.lit(name).alias("table_name"), F.explode(marks).alias("column_name"), key.alias("item_key")).distinct()


def found(metrics: DataFrame, holdings: DataFrame, sources: DataFrame, change: float = 0.25) -> DataFrame:
    """Violations, and the loads in which a status or the nulls of the text shifted by more than ``change``."""
    out = metric_violations(metrics).unionByName(holding_violations(holdings)).withColumn("case_kind", F.lit("violation"))
    for name, df, rules in (("metric_observation", metrics, {"value_status": "share_change", "raw_text_value": "null_change"}), ("holding_observation", holdings, {"identifier_status": "share_change"})):
        shifts = load_shifts(value_counts(df, "source_id", list(rules), ("raw_text_value",)), sources)
        for column, measure in rules.items():
            out = out.unionByName(shifts.where((F.col("column_name") == column) & (F.round(measure, 12) > change)).select(
                F.lit(name).alias("table_name"), "column_name", F.col("load").alias("item_key"), F.lit("shift").alias("case_kind")))
    return out.select("case_kind", "table_name", "column_name", "item_key")
