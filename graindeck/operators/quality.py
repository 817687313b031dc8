"""Constraints as queries: what breaks them comes out as rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.operators.aggregate import uniqueness
from graindeck.operators.relate import dangling


def uniqueness_suite(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row per table and key: rows, distinct keys, rows with a null part, unique or not."""
    out = None
    for name, (df, key) in tables.items():
        one = uniqueness(df, key).select(F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key_columns"), "n_rows", "n_keys", "n_null_keys", "is_unique")
        out = one if out is None else out.unionByName(one)
    return out


def reference_suite(paths: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """One row per path: child rows whose non-null key no parent has."""
    out = None
    for name, (child, key, parent, parent_key) in paths.items():
        one = dangling(child, key, parent, parent_key).agg(F.count(F.lit(1)).alias("n_dangling")).select(F.lit(name).alias("path"), "n_dangling")
        out = one if out is None else out.unionByName(one)
    return out


def completeness(observed: DataFrame, coverage: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row: groups observed, groups covered, and whether every observed group has its coverage row."""
    o, c = observed.select(*groups).distinct(), coverage.select(*groups)
    missing = o.join(c, list(groups), "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    return o.agg(F.count(F.lit(1)).alias("n_observed")).join(F.broadcast(c.agg(F.count(F.lit(1)).alias("n_covered"))), F.lit(True)).join(F.broadcast(missing), F.lit(True)).withColumn(
        "complete", (F.col("n_missing") == 0) & (F.col("n_observed") == F.col("n_covered")))


def custody(df: DataFrame, expected_rows: int, expected_columns: Sequence[str]) -> list[str]:
    """What doesn't agree with the record of a load: row count, order of columns. Empty if all does."""
    problems = []
    if list(df.columns) != list(expected_columns):
        problems.append(f"columns are {df.columns}, recorded were {list(expected_columns)}")
    if (n := df.count()) != expected_rows:
        problems.append(f"{n} rows, recorded were {expected_rows}")
    return problems


def hash_summary(sources: DataFrame) -> DataFrame:
    """Loads by whether their content is what was recorded."""
    return sources.groupBy(F.coalesce(F.col("hash_matches").cast("string"), F.lit("unknown")).alias("hash_matches")).agg(F.count(F.lit(1)).alias("n"))


def conflict_records(pairs: DataFrame, key: str, left: str, right: str, group: str, policy: str) -> DataFrame:
    """(key, conflict_group, left_value, right_value, policy) where both sides have a value and they differ."""
    return pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).select(
        key, F.lit(group).alias("conflict_group"), F.col(left).alias("left_value"), F.col(right).alias("right_value"), F.lit(policy).alias("policy"))


def shapes(triples: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """(node, shape, problem) over triples (s, p, o, o_type): for nodes of ``target`` class, how often ``path`` stands (min, max), its values
    (``in``), their datatype, the class of what they point at, any one of several paths (``any_of``), or any one of several constraints (``or``: a list of
    such rules, of which a node must break less than all). One aggregate per shape or alternative."""
    kinds = triples.where(F.col("p") == "rdf:type").select(F.col("s").alias("node"), F.col("o").alias("class"))
    out = None
    for r in rules:
        if "or" in r:
            broken = shapes(triples, [{**a, "name": str(i), "target": r["target"]} for i, a in enumerate(r["or"])])
            one = broken.groupBy("node").agg(F.countDistinct("shape").alias("n")).where(F.col("n") == len(r["or"])).select("node", F.lit(r["name"]).alias("shape"), F.lit("no_alternative").alias("problem"))
            out = one if out is None else out.unionByName(one)
            continue
        nodes = kinds.where(F.col("class") == r["target"]).select("node").distinct()
        paths = r.get("any_of", [r["path"]] if "path" in r else [])
        t = triples.where(F.col("p").isin(paths)).select(F.col("s").alias("node"), "o", "o_type")
        if "class" in r:
            typed = kinds.where(F.col("class") == r["class"]).select(F.col("node").alias("o"), F.lit(True).alias("is_class")).distinct()
            t = t.join(typed, "o", "left")
        bad = F.lit(False)
        if "in" in r:
            bad |= ~F.col("o").isin(list(r["in"]))
        if "datatype" in r:
            bad |= F.coalesce(F.col("o_type") != r["datatype"], F.lit(True))
        if "class" in r:
            bad |= F.col("is_class").isNull()
        g = nodes.join(t, "node", "left").groupBy("node").agg(F.count("o").alias("n"), F.count_if(F.col("o").isNotNull() & bad).alias("bad"))
        problems = F.filter(F.array(F.when(F.col("n") < r.get("min", 0), F.lit("too_few")), F.when(F.col("n") > r.get("max", 2**31 - 1), F.lit("too_many")), F.when(F.col("bad") > 0, F.lit("bad_value"))), lambda x: x.isNotNull())
        one = g.select("node", F.lit(r["name"]).alias("shape"), F.explode(problems).alias("problem"))
        out = one if out is None else out.unionByName(one)
    return out


def term_completeness(terms: DataFrame, required: dict[str, Column]) -> DataFrame:
    """(semantic_id, missing): for each term the required parts it lacks; ``required`` maps a part to the condition that it's there."""
    gaps = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in required.items()]), lambda x: x.isNotNull())
    return terms.select("semantic_id", F.explode(gaps).alias("missing"))


def physical_names(payload: Sequence[str], tables: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Physical table or column names that a payload meant to carry meanings only lets slip, by word."""
    import re

    words = {w for text in payload for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]+", text)}
    return sorted(words & {*tables, *columns})


def inventory(tables: dict[str, DataFrame], grains: dict[str, str]) -> DataFrame:
    """(table_name, grain, n_rows, n_columns) of named tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), F.lit(grains.get(name)).alias("grain"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def source_row_ids(rows: DataFrame, keys: Sequence[str] = ("source_id",), row: str = "source_row_id") -> DataFrame:
    """Per load: rows, different row ids, rows without one, and whether its ids are unique once re-delivered rows, equal in all columns, count once."""
    once = rows.distinct().groupBy(*keys, row).agg(F.count(F.lit(1)).alias("n"))
    g = once.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count(row).alias("n_ids"), F.coalesce(F.sum(F.when(F.col(row).isNull(), F.col("n"))), F.lit(0)).alias("n_without"))
    return g.withColumn("is_unique", (F.col("n_rows") == F.col("n_ids")) & (F.col("n_without") == 0))


def field_catalogue(df: DataFrame, columns: Sequence[str], zeros: Sequence[str] = ("0", "0.0", "0.00", "0.000", "0.0000")) -> DataFrame:
    """(column_name, n_rows, n_filled, n_distinct, n_zero_like, shortest, longest) of text columns: one pass, distinct values counted as two grouped steps."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.nullif(F.trim(F.col(c)), F.lit("")).alias("value")) for c in columns])
    values = df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("value").isNotNull()
    return values.groupBy("column_name").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("n_filled"), F.count("value").alias("n_distinct"),
                                             F.coalesce(F.sum(F.when(F.col("value").isin(list(zeros)), F.col("n"))), F.lit(0)).alias("n_zero_like"), F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"))


def catalogue_differences(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(column_name, measure, recorded, now) where a table's catalogue of today isn't the recorded one; a column on one side only differs in all measures."""
    measures = ["n_rows", "n_filled", "n_distinct", "n_zero_like", "shortest", "longest"]
    long = lambda df, name: df.select("column_name", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("bigint").alias(name)) for m in measures])))
    j = long(recorded, "recorded").join(long(now, "now"), ["column_name", "measure"], "full")
    return j.where(~F.col("recorded").eqNullSafe(F.col("now"))).select("column_name", "measure", "recorded", "now")


def binding_mismatches(bindings: DataFrame, terms: DataFrame, kinds: dict[str, list[str]], support: dict[str, list[str]]) -> DataFrame:
    """(semantic_id, family_id, rule): where a catalog binding and the term it binds disagree: not_declared, kind, family, grain, unit, period, operation, currency_missing
    (the term requires one, none is bound) and currency_undeclared (bound, but the term has no policy).

    ``bindings``: semantic_id, binding_kind, family_id, subject_grain, unit_code, period_code, operations, currency_source; ``terms``: semantic_id, term_kind, families, grains,
    term_unit, term_period, allowed, currency_policy. Grain, unit, period, operations and currency are checked of metrics and attributes; empty families bind any.
    """
    as_map = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))]).cast("map<string,array<string>>")
    j = bindings.join(terms.withColumn("declared", F.lit(True)), "semantic_id", "left")
    text = lambda c, d="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    measured, known = F.col("binding_kind").isin("metric", "attribute"), F.col("declared").isNotNull()
    expected = as_map(kinds)[F.col("binding_kind")]
    supported = F.exists("allowed", lambda o: as_map(support)[o].isNotNull() & ~F.arrays_overlap(as_map(support)[o], F.coalesce("operations", F.array().cast("array<string>"))))
    rules = {
        "not_declared": ~known, "kind": expected.isNotNull() & ~F.array_contains(expected, F.col("term_kind")), "family": (F.size("families") > 0) & ~F.array_contains("families", F.col("family_id")),
        "grain": measured & ~F.array_contains("grains", F.col("subject_grain")), "unit": measured & (text("term_unit") != text("unit_code")), "period": (F.col("binding_kind") == "metric") & (text("term_period", "none") != text("period_code", "none")),
        "operation": measured & supported, "currency_missing": measured & (text("currency_policy") != "") & (text("currency_source", "none") == "none"), "currency_undeclared": measured & (text("currency_policy") == "") & (text("currency_source", "none") != "none")}
    hits = F.array_compact(F.array(*[F.when(F.coalesce(bad & (known | F.lit(r == "not_declared")), F.lit(False)), F.lit(r)) for r, bad in rules.items()]))
    return j.select("semantic_id", "family_id", F.explode(hits).alias("rule")).distinct()


def relation_mismatches(observed: DataFrame, declared: DataFrame, terms: DataFrame, paths: DataFrame) -> DataFrame:
    """(subject, rule): relation kinds observed in data but not declared, predicates that are no term, and join paths that don't exist. ``declared``: relation_kind, forward_id,
    inverse_id, path_ids (an array); a kind declared without a forward predicate is one that can't be executed, and is checked no further."""
    kinds = observed.select("relation_kind").distinct()
    unknown = kinds.join(declared.select("relation_kind"), "relation_kind", "left_anti").select(F.col("relation_kind").alias("subject"), F.lit("relation_undeclared").alias("rule"))
    used = declared.join(kinds, "relation_kind", "left_semi").where(F.col("forward_id").isNotNull())
    predicates = used.select("path_ids", F.explode(F.array_compact(F.array("forward_id", "inverse_id"))).alias("subject"))
    known = predicates.join(terms.select(F.col("semantic_id").alias("subject")).distinct().withColumn("t", F.lit(True)), "subject", "left")
    absent = known.where(F.col("t").isNull()).select("subject", F.lit("predicate_undeclared").alias("rule"))
    lost = known.where(F.col("t").isNotNull()).select("subject", F.explode("path_ids").alias("path_id")).join(paths.select("path_id"), "path_id", "left_anti").select("subject", F.lit("unknown_path").alias("rule"))
    return unknown.unionByName(absent).unionByName(lost).distinct()
