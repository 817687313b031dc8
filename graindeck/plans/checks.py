"""Queries of validation, binding rules, evidence outcomes, ledgers and custody, on planted cases where the tables hold none (groups J to N)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graindeck.functions import records as Rec
from graindeck.operators import evaluate as E
from graindeck.operators import govern as G
from graindeck.operators import quality as Q
from graindeck.operators import select as S
from graindeck.operators import validate as V
from graindeck.plans.registry import Register, by_key
from graindeck.sources.tables import finite, folded_subjects

register = Register()
QUERIES, ORACLES = register.queries, register.oracles
METRICS = by_key("metric_observation")


def _values(rows: list[tuple], names: str) -> str:
    """Rows as SQL, the planted truth of a query."""
    word = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(word, r)) + ')' for r in rows)}) v({names})"


# ---- K16: one request of twenty-two requirements, each of which meets one check

_QUESTION = "Top 5 funds by return desc, and bonds above 3% that they hold"


def _requirement(i: str, kind: str = "listing", status: str = "mapped", span: str = "funds", targets: tuple = ("ds_fund",), fields: tuple = (), conditions: tuple = (), ordering=None, limit=None, aggregation=None, relation=None) -> tuple:
    return ("q1", i, kind, status, span, list(targets), list(fields), list(conditions), ordering, limit, aggregation, relation)


# (requirement, decision, codes)
_PLANTED = [
    (_requirement("a", "ranking", span="Top 5 funds", ordering=("fd_return", "desc"), limit="Top 5"), "mapped", ""),
    (_requirement("b", "attribute_lookup"), "unresolved", "requirement_incomplete"),
    (_requirement("c", targets=()), "unresolved", "empty_requirement,missing_target_dataset"),
    (_requirement("d", targets=("ds_elsewhere",)), "unresolved", "unknown_ref"),
    (_requirement("e", targets=("fd_return",)), "unresolved", "ref_kind_mismatch"),
    (_requirement("f", "attribute_lookup", targets=("ds_bond",), fields=(("fd_return", "output"),)), "unresolved", "cross_family_field"),
    (_requirement("g", "attribute_lookup", fields=(("fd_of_class", "output"),)), "unresolved", "field_grain_mismatch"),
    (_requirement("h", "attribute_lookup", fields=(("fd_unproven", "output"),)), "unresolved", "field_scope_unproven"),
    (_requirement("i", status="ambiguous", targets=("ds_elsewhere",)), "ambiguous", "requirement_ambiguous"),
    (_requirement("j", status="unresolved"), "unresolved", "requirement_unresolved"),
    (_requirement("k", span="bonds above 3%", conditions=(("fd_return", "above", "3%"),)), "mapped", ""),
    (_requirement("l", conditions=(("fd_return", "above", "funds"),)), "unresolved", "canonicalization_refused"),
    (_requirement("m", span="shares of last year"), "unresolved", "span_alignment_failed"),
    (_requirement("n", span=" "), "unresolved", "missing_source_span"),
    (_requirement("o", targets=("ds_security",), relation=("pr_holds", "en_fund")), "mapped", ""),
    (_requirement("p", relation=("pr_holds", "en_security")), "mapped", ""),
    (_requirement("q", targets=("ds_security",), relation=("pr_holds", "en_lost")), "unresolved", "entity_unresolved"),
    (_requirement("r", targets=("ds_security",), relation=("pr_holds", "en_issuer")), "ambiguous", "relation_direction_undecidable"),
    (_requirement("s", relation=("pr_holds", "en_fund")), "unresolved", "relation_target_mismatch"),
    (_requirement("t", "grouping"), "unresolved", "canonicalizer_unavailable"),
    (_requirement("u", targets=("ds_index",), relation=("pr_tracks", "en_fund")), "unresolved", "cross_family_predicate"),
    (_requirement("v", "aggregation", aggregation=("fd_size", "Top")), "unresolved", "canonicalization_refused,cross_family_field"),
]


def _submission(t) -> DataFrame:
    make = t("region").sparkSession.createDataFrame
    seen = lambda ref, kind, sid, families=(), grains=("product",), scope=None, unit=None, ops=(): ("q1", ref, kind, sid, list(families), list(grains), scope, unit, list(ops))
    view = make([seen("ds_fund", "dataset", "fund", ["F"]), seen("ds_bond", "dataset", "bond", ["B"]), seen("ds_security", "dataset", "security", ["F"]), seen("ds_index", "dataset", "index", ["F"]),
                 seen("fd_return", "field", "met:return", ["F"], scope="family_scoped", unit="percent_observed", ops=["order", "filter", "aggregate"]), seen("fd_size", "field", "met:size", ["B"], scope="family_scoped", unit="currency_amount", ops=["order"]),
                 seen("fd_of_class", "field", "met:class", ["F"], ["class"], "family_scoped"), seen("fd_unproven", "field", "met:open", [], ["product"], "scope_unproven"), seen("pr_holds", "predicate", "holds"), seen("pr_tracks", "predicate", "tracks")], V.VIEW)
    entities = make([("q1", "en_fund", "etf", True), ("q1", "en_security", "security", True), ("q1", "en_lost", "etf", False), ("q1", "en_issuer", "issuer", True)], "request_id string, ref string, class_id string, resolved boolean")
    relations = make([("holds", "product", "security", "held_by"), ("held_by", "security", "product", None), ("tracks", "product", "index", None)], "relation string, domain string, range string, inverse_of string")
    up = make([("fund", "product"), ("etf", "product"), ("bond", "product")], "node string, ancestor string")
    families = make([("product", ["F", "B"]), ("index", ["X"]), ("security", [])], "node string, families array<string>")
    return V.validate(make([r for r, *_ in _PLANTED], V.REQUIREMENTS), make([("q1", _QUESTION)], "request_id string, question string"), view, entities, relations, up, families)


@register(_values([(r[1], d, c) for r, d, c in _PLANTED], "requirement_id, decision, codes"))
def k16_validation(t) -> DataFrame:
    return _submission(t).select("requirement_id", "decision", F.array_join("codes", ",").alias("codes"))


@register(_values([("o", "holds", "forward"), ("p", "held_by", "inverse")], "requirement_id, relation, direction"))
def k16_relations(t) -> DataFrame:
    return _submission(t).where(F.col("relation").isNotNull()).select("requirement_id", "relation.relation", "relation.direction")


@register(_values([("q1", "unaccounted_explicit_span", sum(d != "mapped" for _, d, _ in _PLANTED))], "request_id, status, n_open"))
def k16_request_status(t) -> DataFrame:
    left = t("region").sparkSession.createDataFrame([("q1", "that they hold")], "request_id string, span string")
    return V.request_status(_submission(t), left).select("request_id", "status", F.size("open_requirements").cast("bigint").alias("n_open"))


# ---- J: populations, provenance, what was done

_ASKED = [(1, "overseas_etp", "product"), (2, "public_fund", "product"), (3, "domestic_bond", "product"), (4, "nowhere", "product")]
_DATASETS = "SELECT family_id, subject_grain, CASE WHEN family_id <> 'domestic_bond' THEN count(*) END AS population FROM subject GROUP BY family_id, subject_grain UNION ALL SELECT 'public_fund', 'product', 1"


@register(f"WITH q AS ({_values(_ASKED, 'request_id, family_id, subject_grain')}), d AS ({_DATASETS}) SELECT request_id, CASE WHEN count(d.family_id) = 1 AND max(population) IS NOT NULL THEN 'bound' ELSE 'dataset_binding_unavailable' END AS outcome, CASE WHEN count(d.family_id) = 1 THEN max(population) END AS population FROM q LEFT JOIN d USING (family_id, subject_grain) GROUP BY 1")
def j2_population_binding(t) -> DataFrame:
    """One family bound once, one twice, one without a population, one not at all."""
    spark = t("region").sparkSession
    d = t("subject").groupBy("family_id", "subject_grain").agg(F.count(F.lit(1)).alias("population")).withColumn("population", F.when(F.col("family_id") != "domestic_bond", F.col("population")))
    d = d.unionByName(spark.createDataFrame([("public_fund", "product", 1)], "family_id string, subject_grain string, population bigint"))
    return G.bind_populations(spark.createDataFrame(_ASKED, "request_id bigint, family_id string, subject_grain string"), d)


_LATEST = f"""SELECT * FROM (SELECT metric_id, family_id, subject_key, effective_as_of AS as_of, source_id, CASE WHEN unit_code IS NULL THEN NULL ELSE source_row_id END AS source_row_id, row_number() OVER (PARTITION BY metric_id, family_id, subject_key{{0}} ORDER BY effective_as_of DESC NULLS LAST, source_row_id) AS r
 FROM (SELECT DISTINCT * FROM {METRICS}) WHERE value_status = 'valid' AND numeric_value IS NOT NULL AND isfinite(numeric_value) AND subject_key IS NOT NULL) WHERE r = 1"""
_EVIDENCE = """SELECT metric_id, family_id{0}, count(*) AS universe, count(*) - count(DISTINCT subject_key) AS duplicates, count(*) FILTER (WHERE source_id IS NULL OR source_row_id IS NULL) AS provenance_missing, count(*) FILTER (WHERE as_of IS NULL) AS unknown_as_of,
 min(as_of) AS lo, max(as_of) AS hi, bool_and(coalesce(hash_matches AND length(sha256) > 0, false)) AS sources_verified FROM ({1}) LEFT JOIN (SELECT source_id, hash_matches, sha256 FROM data_source) USING (source_id) GROUP BY ALL"""


def _latest(t, *more: str) -> DataFrame:
    """Latest valid observations per metric, family and subject; rows that state no unit come without a row id, as if it had been lost."""
    m = folded_subjects(t("metric_observation")).where((F.col("value_status") == "valid") & finite("numeric_value") & F.col("subject_key").isNotNull())
    order = F.struct(F.col("effective_as_of").isNull(), -F.coalesce(F.datediff("effective_as_of", F.lit("1970-01-01")), F.lit(0)), F.col("source_row_id"))
    m = m.withColumns({"as_of": F.col("effective_as_of"), "kept_row": F.when(F.col("unit_code").isNotNull(), F.col("source_row_id")), "order": order, "asked": F.col("effective_as_of")})
    best = S.best_of(m, ["metric_id", "family_id", "subject_key", *more], F.col("order"), ["as_of", "source_id", "kept_row"])
    return best.withColumnRenamed("kept_row", "source_row_id")


@register(f"SELECT metric_id, family_id, CASE WHEN max(n) = 1 THEN 'unique_per_subject' ELSE 'latest_effective_as_of' END AS policy FROM (SELECT metric_id, family_id, subject_key, count(*) AS n FROM (SELECT DISTINCT * FROM {METRICS}) WHERE subject_key IS NOT NULL AND period_code IS NOT NULL GROUP BY ALL) GROUP BY 1, 2")
def j3_selection_policy(t) -> DataFrame:
    """How observations of each metric and family that has a period are selected, from the most rows of one subject; re-delivered rows count once."""
    m = folded_subjects(t("metric_observation")).where(F.col("subject_key").isNotNull() & F.col("period_code").isNotNull()).distinct()
    n = m.groupBy("metric_id", "family_id", "subject_key").agg(F.count(F.lit(1)).alias("n")).groupBy("metric_id", "family_id").agg(F.max("n").alias("n"))
    return n.select("metric_id", "family_id", G.policy_of(F.col("n")).alias("policy"))


_STOP = "CASE WHEN provenance_missing > 0 THEN 'provenance_binding_unavailable' WHEN duplicates > 0 THEN 'selection_policy_unavailable' WHEN as_of IS NULL OR unknown_as_of > 0 OR lo <> hi OR lo <> as_of THEN 'snapshot_incompatible' WHEN NOT sources_verified THEN 'source_integrity_mismatch' END"


@register(f"SELECT metric_id, family_id, asked, universe, provenance_missing, stopped, CASE WHEN stopped IS NULL THEN 'order ' || metric_id || ' desc 10' ELSE '' END AS applied FROM (SELECT *, as_of AS asked, {_STOP} AS stopped FROM ({_EVIDENCE.format(', as_of', _LATEST.format(', effective_as_of'))}))")
def j7_j11_outcomes(t) -> DataFrame:
    """A ranking of every metric and family on every date: complete provenance or what stops it, and the record of what was done."""
    e = G.ranking_evidence(_latest(t, "asked"), t("data_source"), ["metric_id", "family_id", "asked"])
    # a row without a date was asked for no date: such a ranking stops as its date is unknown
    e = e.withColumn("stopped", G.outcome(F.col("asked")))
    done = G.applied_operations(F.col("stopped"), F.lit("order"), F.col("metric_id"), F.lit("desc"), F.lit(10))
    text = F.array_join(F.transform(done, lambda o: F.concat_ws(" ", o["operation"], o["field_id"], o["direction"], o["row_limit"].cast("string"))), ";")
    return e.select("metric_id", "family_id", "asked", "universe", "provenance_missing", "stopped", text.alias("applied"))


@register(f"SELECT metric_id, family_id, universe, CASE WHEN unknown_as_of = 0 AND lo = hi THEN 'latest_available' ELSE 'mixed_effective_dates' END AS freshness FROM ({_EVIDENCE.format('', _LATEST.format(''))})")
def j10_freshness(t) -> DataFrame:
    e = G.ranking_evidence(_latest(t), t("data_source"), ["metric_id", "family_id"])
    return e.select("metric_id", "family_id", "universe", G.freshness(F.lit(None).cast("date"), F.col("as_of_min"), F.col("as_of_max"), F.col("unknown_as_of")).alias("freshness"))


@register(f"SELECT metric_id, family_id, asked, CASE stopped WHEN 'snapshot_incompatible' THEN 'The values are not of one date.' ELSE 'The question can''t be answered from the data.' END AS reason FROM (SELECT metric_id, family_id, as_of AS asked, {_STOP} AS stopped FROM ({_EVIDENCE.format(', as_of', _LATEST.format(', effective_as_of'))})) WHERE stopped IS NOT NULL")
def j12_failure_reasons(t) -> DataFrame:
    """What a caller may read about every ranking that was stopped: no code, table or id."""
    e = G.ranking_evidence(_latest(t, "asked"), t("data_source"), ["metric_id", "family_id", "asked"]).withColumn("stopped", G.outcome(F.col("asked"))).where(F.col("stopped").isNotNull())
    return e.select("metric_id", "family_id", "asked", Rec.safe_reason(F.col("stopped")).alias("reason"))


# ---- L12: rules of bindings and relations

# semantic_id, binding_kind, family_id, subject_grain, unit_code, period_code, operations, currency_source
_BOUND = [("met:ok", "metric", "F", "product", "percent_observed", "1y", ["order"], "none"), ("met:lost", "metric", "F", "product", "", "", ["order"], "none"), ("met:kind", "metric", "F", "product", "", "", ["order"], "none"),
          ("met:far", "metric", "B", "product", "", "", ["order"], "none"), ("met:grain", "metric", "F", "class", "", "", ["order"], "none"), ("met:unit", "metric", "F", "product", "ratio", "", ["order"], "none"), ("met:period", "metric", "F", "product", "", "1y", ["order"], "none"),
          ("met:op", "metric", "F", "product", "", "", ["order"], "none"), ("met:cash", "metric", "F", "product", "", "", ["order"], "none"), ("met:coin", "metric", "F", "product", "", "", ["order"], "column"), ("att:period", "attribute", "F", "product", "", "3y", ["filter"], "none")]
# semantic_id, term_kind, families, grains, term_unit, term_period, allowed, currency_policy
_TERMS = [("met:ok", "measure", ["F"], ["product"], "percent_observed", "1y", ["order"], ""), ("met:kind", "entity", ["F"], ["product"], None, None, ["order"], ""), ("met:far", "measure", ["F"], ["product"], None, None, ["order"], ""), ("met:grain", "measure", [], ["product"], None, None, ["order"], ""),
          ("met:unit", "measure", ["F"], ["product"], "percent_observed", None, ["order"], ""), ("met:period", "measure", ["F"], ["product"], None, None, ["order"], ""), ("met:op", "measure", ["F"], ["product"], None, None, ["order", "aggregate", "unheard_of"], ""),
          ("met:cash", "measure", ["F"], ["product"], None, None, ["order"], "fund_currency"), ("met:coin", "measure", ["F"], ["product"], None, None, ["order"], None), ("att:period", "attribute", ["F"], ["product"], None, None, ["filter"], "")]


@register(_values([("met:lost", "F", "not_declared"), ("met:kind", "F", "kind"), ("met:far", "B", "family"), ("met:grain", "F", "grain"), ("met:unit", "F", "unit"), ("met:period", "F", "period"), ("met:op", "F", "operation"), ("met:cash", "F", "currency_missing"), ("met:coin", "F", "currency_undeclared")], "semantic_id, family_id, rule"))
def l12_binding_rules(t) -> DataFrame:
    make = t("region").sparkSession.createDataFrame
    b = make(_BOUND, "semantic_id string, binding_kind string, family_id string, subject_grain string, unit_code string, period_code string, operations array<string>, currency_source string")
    terms = make(_TERMS, "semantic_id string, term_kind string, families array<string>, grains array<string>, term_unit string, term_period string, allowed array<string>, currency_policy string")
    return Q.binding_mismatches(b, terms, {"metric": ["measure"], "attribute": ["attribute"]}, {"order": ["order"], "aggregate": ["aggregate"], "filter": ["filter"]})


@register("SELECT DISTINCT metric_id AS semantic_id, family_id, 'unit' AS rule FROM metric_observation JOIN metric_catalog USING (metric_id) WHERE coalesce(unit_code, '') <> coalesce(common_unit, '')")
def l12_unit_rule(t) -> DataFrame:
    """The units as recorded, metric by metric and family by family, against the catalog's."""
    m = t("metric_observation").select("metric_id", "family_id", "unit_code").distinct()
    none, text = F.array().cast("array<string>"), lambda v: F.lit(v).cast("string")
    b = m.select(F.col("metric_id").alias("semantic_id"), F.lit("metric").alias("binding_kind"), "family_id", F.lit("product").alias("subject_grain"), "unit_code", text(None).alias("period_code"), none.alias("operations"), text("none").alias("currency_source"))
    terms = t("metric_catalog").select(F.col("metric_id").alias("semantic_id"), F.lit("measure").alias("term_kind"), none.alias("families"), F.array(F.lit("product")).alias("grains"), F.col("common_unit").alias("term_unit"), text(None).alias("term_period"), none.alias("allowed"), text("").alias("currency_policy"))
    return Q.binding_mismatches(b, terms, {"metric": ["measure"]}, {})


@register("SELECT DISTINCT relation_kind AS subject, 'relation_undeclared' AS rule FROM holding_observation WHERE relation_kind NOT IN ('direct_holding') UNION ALL SELECT 'rel:held_by', 'predicate_undeclared' UNION ALL SELECT 'rel:holds', 'unknown_path'")
def l12_relation_rules(t) -> DataFrame:
    make = t("region").sparkSession.createDataFrame
    declared = make([("direct_holding", "rel:holds", "rel:held_by", ["to_portfolio", "to_nowhere"]), ("unseen", "rel:unseen", None, ["to_nowhere"])], "relation_kind string, forward_id string, inverse_id string, path_ids array<string>")
    seen = t("holding_observation").select("relation_kind").where(F.col("relation_kind").isNotNull())
    return Q.relation_mismatches(seen, declared, make([("rel:holds",)], "semantic_id string"), make([("to_portfolio",)], "path_id string"))


# ---- N: custody

_TABLES = {"holding_observation": "source_id", "metric_observation": "source_id, metric_id", "attribute_observation": "source_id, attribute_id"}


@register(" UNION ALL ".join(f"SELECT '{n}' AS table_name, source_id, {'NULL' if k == 'source_id' else k.split(', ')[1]} AS field_id, count(*) AS n_rows, count(DISTINCT source_row_id) AS n_ids, count(*) FILTER (WHERE source_row_id IS NULL) AS n_without, count(*) = count(DISTINCT source_row_id) AS is_unique FROM (SELECT DISTINCT * FROM {n}) GROUP BY {k}" for n, k in _TABLES.items()))
def n5_source_row_ids(t) -> DataFrame:
    """Row ids of every load (and metric or attribute), re-delivered rows once."""
    parts = []
    for name, k in _TABLES.items():
        keys = k.split(", ")
        parts.append(Q.source_row_ids(t(name), keys).withColumns({"table_name": F.lit(name), "field_id": F.col(keys[1]) if len(keys) > 1 else F.lit(None).cast("string")}))
    return parts[0].select(*(cols := ["table_name", "source_id", "field_id", "n_rows", "n_ids", "n_without", "is_unique"])).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols))


_PROFILED = ["raw_text_value", "unit_code", "currency_code", "value_status", "as_of_status"]
_CATALOGUE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({{v}}) AS n_filled, count(DISTINCT {{v}}) AS n_distinct, count(*) FILTER (WHERE {{v}} IN ('0', '0.0', '0.00', '0.000', '0.0000')) AS n_zero_like, min(length({{v}})) AS shortest, max(length({{v}})) AS longest FROM {{t}}".replace("{v}", f"nullif(trim({c}, ' '), '')") for c in _PROFILED)
_LONG = "SELECT column_name, unnest(['n_rows', 'n_filled', 'n_distinct', 'n_zero_like', 'shortest', 'longest']) AS measure, unnest([n_rows, n_filled, n_distinct, n_zero_like, shortest, longest]) AS n FROM ({})"
_OFFICIAL = "(SELECT * FROM metric_observation WHERE source_id IN (SELECT source_id FROM data_source WHERE source_kind = 'official'))"


@register(_CATALOGUE.replace("{t}", "metric_observation"))
def n12_field_catalogue(t) -> DataFrame:
    return Q.field_catalogue(t("metric_observation"), _PROFILED)


@register(f"SELECT column_name, measure, a.n AS recorded, b.n AS now FROM ({_LONG.format(_CATALOGUE.replace('{t}', _OFFICIAL))}) a FULL JOIN ({_LONG.format(_CATALOGUE.replace('{t}', 'metric_observation'))}) b USING (column_name, measure) WHERE a.n IS DISTINCT FROM b.n")
def n12_verification(t) -> DataFrame:
    """The catalogue recorded when only official loads were there, against the table of today."""
    m = t("metric_observation")
    official = t("data_source").where(F.col("source_kind") == "official").select("source_id")
    return Q.catalogue_differences(Q.field_catalogue(m.join(F.broadcast(official), "source_id", "left_semi"), _PROFILED), Q.field_catalogue(m, _PROFILED))  # source loads, tens at any scale


# ---- M: audits, ledgers, plan options, payloads

_RANKED = "SELECT user_id AS case_id, event_type AS id, row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, event_type) AS rank FROM events GROUP BY user_id, event_type"
_GOLD = "SELECT user_id AS case_id, arg_min(event_type, event_id) AS id FROM events GROUP BY user_id"


@register(f"""WITH g AS (SELECT case_id, CASE WHEN case_id % 5 = 0 THEN 'view' ELSE id END AS id FROM ({_GOLD}) WHERE case_id % 11 <> 0), a AS (SELECT case_id, id, id AS x FROM g UNION ALL SELECT case_id, id, CASE id WHEN 'click' THEN 'view' ELSE 'click' END FROM g WHERE id IN ('click', 'view')),
 b AS (SELECT a.case_id, a.id, min(r.rank) AS rank FROM a LEFT JOIN ({_RANKED}) r ON r.case_id = a.case_id AND r.id = a.x GROUP BY 1, 2) SELECT k, count(DISTINCT case_id) AS n_cases, count(*) AS n_required, count(*) FILTER (WHERE rank <= k) AS n_found, round(count(*) FILTER (WHERE rank <= k) / count(*), 6) AS recall, count(*) FILTER (WHERE rank <= k) AS n_complete FROM b, unnest([1, 2]) c(k) GROUP BY 1""")
def m11_rescored_gold(t) -> DataFrame:
    """An audit drops every eleventh case, sets every fifth to view, and counts click and view for each other; the stored rankings are scored again."""
    e = t("events")
    gold = e.groupBy(F.col("user_id").alias("case_id")).agg(F.min_by("event_type", "event_id").alias("id"))
    drops, overrides = gold.where(F.col("case_id") % 11 == 0), gold.where(F.col("case_id") % 5 == 0).withColumn("new_id", F.lit("view"))
    inverses = e.sparkSession.createDataFrame([("click", "view")], "id string, inverse string")
    best = e.groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("id")).agg(F.max("value").alias("v"))
    from pyspark.sql import Window

    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("v").desc(), "id")))
    return E.rescore_rankings(ranked, E.accepted_gold(gold, drops, overrides, inverses), [1, 2])


def _names(t) -> DataFrame:
    """Names of parts, each once: what is said of a question goes by its wording, so it is found once for a name and given to all parts that bear it."""
    return t("part").where(F.col("p_name").isNotNull()).select("p_name").distinct()


def _of_every_part(t, found: DataFrame) -> DataFrame:
    """Rows by name (question_id) for every part of the name."""
    parts = t("part").select("p_partkey", F.col("p_name").alias("question_id"))
    return parts.join(found.hint("merge"), "question_id").withColumn("question_id", F.col("p_partkey")).select(*found.columns)


def _scanned(t) -> DataFrame:
    """Questions made of a part's name, a limit, a foreign word and the name's first word again; forms are names and their words."""
    p = _names(t)
    q = p.select(F.col("p_name").alias("question_id"), F.concat("p_name", F.lit(" top 5 zzz highest, "), F.split("p_name", " ")[0]).alias("question"))
    names = p.select(F.col("p_name").alias("text"))
    words = p.select(F.explode(F.split("p_name", " ")).alias("text")).distinct()
    return E.scan_forms(q, names.unionByName(words).distinct().select(F.concat(F.lit("f:"), "text").alias("form_id"), "text"))


@register("SELECT p_partkey AS question_id, place, text, state, frame FROM (SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS w FROM part WHERE p_name IS NOT NULL), LATERAL (SELECT * FROM (VALUES (0, p_name, 'form', 1), (1, 'top', 'direction', 1), (2, '5', 'number', 1), (3, 'zzz', 'unknown', 1), (4, 'highest,', 'direction', 1), (5, w, 'form', 2)) v(place, text, state, frame))")
def m18_question_ledger(t) -> DataFrame:
    return _of_every_part(t, E.question_ledger(_scanned(t))).select("question_id", "place", "text", "state", "frame")


@register("SELECT p_partkey AS question_id, 3 AS n_anchors, CASE WHEN array_length(string_split(p_name, ' ')) > 1 THEN 2 ELSE 3 END AS n_found, CASE WHEN array_length(string_split(p_name, ' ')) > 1 THEN 1 ELSE 0 END AS n_swallowed, 1 AS n_unknown, 'comparison' AS collapsed, false AS passed FROM part WHERE p_name IS NOT NULL")
def m26_case_ledger(t) -> DataFrame:
    """Each case expects its name, its first word and its last word as anchors, a direction and a comparison: the last word is swallowed by the name, the comparison collapsed."""
    s = _scanned(t)
    form = lambda c: F.concat(F.lit("f:"), c)
    words = F.split("p_name", " ")
    expected = _names(t).select(F.col("p_name").alias("question_id"), F.array(form(F.col("p_name")), form(words[0]), form(F.element_at(words, -1))).alias("anchors"), F.array(F.lit("direction"), F.lit("comparison")).alias("states"))
    found = E.case_ledger(E.question_ledger(s), s, expected).withColumn("collapsed", F.array_join("collapsed", ","))
    return _of_every_part(t, found)


_SLOTS = "SELECT user_id AS question_id, event_type AS slot, event_type || floor(value / 25)::BIGINT AS reading FROM events WHERE user_id % 3 <> 0 OR value < 25"


@register(f"""WITH s AS (SELECT DISTINCT question_id, slot, reading FROM ({_SLOTS})), n AS (SELECT question_id, max(r) AS most, count(*) AS slots, round(exp(sum(ln(r))))::BIGINT AS n FROM (SELECT question_id, slot, count(*) AS r FROM s GROUP BY ALL) GROUP BY 1)
 SELECT question_id, n AS n_options, CASE WHEN most > 8 THEN 'readings' WHEN slots > 8 THEN 'slots' WHEN n > 32 THEN 'options' WHEN n > 16 THEN 'kept' END AS reason, most > 8 OR slots > 8 OR n > 16 AS blocked FROM n""")
def m19_option_counts(t) -> DataFrame:
    """Readings of each kind of event by fours of its value; every third user has small values only."""
    e = t("events").where((F.col("user_id") % 3 != 0) | (F.col("value") < 25))
    s = e.select(F.col("user_id").alias("question_id"), F.col("event_type").alias("slot"), F.concat("event_type", F.floor(F.col("value") / 25).cast("string")).alias("reading"))
    return E.plan_options(s).select("question_id", "n_options", "reason", "blocked")


@register(_values([(1, 4, 3, "a1|b1;a1|b2;a2|b2", False, None), (2, 1, 0, "", True, "impossible"), (3, 9, 0, "", True, "readings"), (4, 27, 27, "", True, "kept")], "question_id, n_options, n_kept, options, blocked, reason"))
def m19_planted_options(t) -> DataFrame:
    """Two readings that can't stand together, a question whose only option goes so, one slot with too many readings, and too many options that may be."""
    make = t("region").sparkSession.createDataFrame
    rows = [(1, "a", "a1"), (1, "a", "a2"), (1, "b", "b1"), (1, "b", "b2"), (1, "b", None), (2, "a", "a2"), (2, "b", "b1")] + [(3, "a", f"r{i}") for i in range(9)] + [(4, s, f"{s}{i}") for s in "xyz" for i in range(3)]
    out = E.plan_options(make(rows, "question_id bigint, slot string, reading string"), conflicts=make([("a2", "b1")], "reading string, other string"))
    return out.withColumn("options", F.array_join("options", ";"))


@register("""SELECT *, length(payload) AS n_chars, octet_length(encode(payload)) AS n_bytes, ceil(length(payload) / 4.0)::BIGINT AS token_estimate FROM (SELECT p_size AS question_id, '[' || string_agg('{"semantic_id":"p' || p_partkey || '","kind":"' || p_brand || '","label":"' || p_name || '"}', ',' ORDER BY 'p' || p_partkey, p_brand, p_name) || ']' AS payload, count(*) AS n_candidates FROM part GROUP BY 1)""")
def m28_view_payload(t) -> DataFrame:
    """Parts of one size as the candidates of a question."""
    c = t("part").select(F.col("p_size").alias("question_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("semantic_id"), F.col("p_brand").alias("kind"), F.col("p_name").alias("label"))
    return E.view_payload(c)


@register(_values([(1, "e1", "r2", 0.95), (1, "e2", "r1", 0.1), (2, "e1", "r1", 0.5)], "case_id, expected, returned, score"))
def m15_greedy_match(t) -> DataFrame:
    rows = [(1, "e1", "r1", 0.9), (1, "e1", "r2", 0.95), (1, "e2", "r2", 0.9), (1, "e2", "r1", 0.1), (2, "e1", "r1", 0.5), (2, "e2", "r1", 0.5)]
    return E.greedy_match(t("region").sparkSession.createDataFrame(rows, "case_id bigint, expected string, returned string, score double"))


@register("SELECT doc_id, replace(regexp_replace(text, '(?i)bearer\\s+[A-Za-z0-9._\\-]+', 'Bearer [redacted]', 'g'), 'fund', '[redacted]') AS text FROM documents WHERE text IS NOT NULL")
def m17_redaction(t) -> DataFrame:
    """Every text without one word that is treated as a secret."""
    return E.redact(t("documents").where(F.col("text").isNotNull()).select("doc_id", "text"), "text", ["fund"])


@register(_values([("a", "r1", "order", "desc", None), ("a", "r1", "limit", "5", None), ("a", "r2", None, None, None), ("b", None, None, None, "unreadable")], "output_id, requirement_id, slot, value, problem"))
def m24_nested_outputs(t) -> DataFrame:
    rows = [("a", '{"requirements": [{"id": "r1", "slots": {"order": "desc", "limit": "5"}}, {"id": "r2", "slots": {}}]}'), ("b", "not json")]
    return E.decode_nested(t("region").sparkSession.createDataFrame(rows, "output_id string, body string"), "output_id", "body")


@register("SELECT 'r9' AS id, 'unknown_owner' AS problem WHERE false UNION ALL SELECT 'n' || n_nationkey, 'unknown_owner' FROM nation WHERE n_regionkey = 4 UNION ALL SELECT 'n' || n_nationkey, 'term_without_form' FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT 'x', 'form_of_no_term' UNION ALL SELECT 'r0', 'repeated_term'")
def m27_registry_problems(t) -> DataFrame:
    """Nations owned by regions; region 4 is no term, region 0 is one twice, every seventh nation has no form, and one form belongs to nothing."""
    n, r = t("nation"), t("region")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = r.where(F.col("r_regionkey") != 4).select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("owner"))
    terms = regions.unionByName(regions.where(F.col("id") == "r0")).unionByName(n.select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("owner")))
    forms = n.where(F.col("n_nationkey") % 7 != 0).select(key("n", "n_nationkey").alias("id")).unionByName(regions.select("id")).unionByName(r.limit(1).select(F.lit("x").alias("id")))
    return E.registry_problems(terms, forms)


@register("SELECT n_nationkey AS case_id, 'other_question' AS problem FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey, 'unknown_id' FROM nation WHERE n_regionkey = 3 UNION ALL SELECT n_nationkey, 'required_and_confusable' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, 'nothing_required' FROM nation WHERE n_regionkey = 2")
def m13_case_problems(t) -> DataFrame:
    """Cases of nations: region 3 is outside the vocabulary, region 1 required and confusable, region 2 requires nothing, every fifth question isn't the recorded one."""
    own = F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    none = F.array().cast("array<string>")
    cases = t("nation").select(F.col("n_nationkey").alias("case_id"), F.lit("h").alias("question_hash"), F.when(F.col("n_nationkey") % 5 == 0, "other").otherwise("h").alias("recorded_hash"),
                               F.when(F.col("n_regionkey") == 2, none).otherwise(own).alias("required"), F.when(F.col("n_regionkey") == 1, own).otherwise(none).alias("confusable"))
    return E.case_problems(cases, t("region").where(F.col("r_regionkey") != 3).select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id")))
