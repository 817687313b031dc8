"""Queries of governed execution, capability resolution and data quality (groups J, L, N)."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graindeck.operators import aggregate as A
from graindeck.operators import govern as G
from graindeck.operators import quality as Q
from graindeck.operators import relate as R
from graindeck.plans.registry import Register, by_key
from graindeck.sources.tables import folded_key, folded_subjects, own_subjects

register = Register()
QUERIES, ORACLES = register.queries, register.oracles
METRICS = by_key("metric_observation")
FAMILY, GRAIN = "overseas_etp", "product"
ORDER = G.Binding("met:return_3m", FAMILY, GRAIN, "metric_observation", "metric_id", "met:return_3m", "numeric_value", ("order", "filter", "aggregate"), zero_semantics="excluded")
DISPLAY = G.Binding("met:nav_per_unit", FAMILY, GRAIN, "metric_observation", "metric_id", "met:nav_per_unit", "numeric_value", ("order",))


def _selected(metric: str, more: str = "") -> str:
    return (f"SELECT * FROM (SELECT subject_key, numeric_value, effective_as_of, source_id, source_row_id, row_number() OVER (PARTITION BY subject_key ORDER BY effective_as_of DESC NULLS LAST, source_row_id) AS r "
            f"FROM (SELECT DISTINCT * FROM {METRICS}) WHERE metric_id = '{metric}' AND value_status = 'valid' AND numeric_value IS NOT NULL AND subject_key IS NOT NULL {more}) WHERE r = 1")


def _evidence(as_of: str | None, order: str = 'met:return_3m', display: str = 'met:nav_per_unit', family: str = FAMILY) -> str:
    cond = f"AND effective_as_of = DATE '{as_of}'" if as_of else ""
    want = f"AND min(o_date) = DATE '{as_of}'" if as_of else ""
    return f"""WITH o AS ({_selected(order, 'AND numeric_value <> 0 ' + cond)}), d AS ({_selected(display, cond)}),
 b AS (SELECT o.subject_key, o.numeric_value AS order_value, d.numeric_value AS display_value, o.effective_as_of AS o_date, d.effective_as_of AS d_date, o.source_row_id AS order_row, d.source_row_id AS display_row, o.source_id AS s1, d.source_id AS s2 FROM o JOIN d USING (subject_key)),
 e AS (SELECT count(*) AS universe, (SELECT count(DISTINCT subject_key) FROM subject WHERE family_id = '{family}' AND subject_grain = '{GRAIN}') AS population, count(*) - count(DISTINCT subject_key) AS duplicates, count(*) FILTER (WHERE s1 IS NULL OR s2 IS NULL OR order_row IS NULL OR display_row IS NULL) AS provenance_missing,
  count(*) FILTER (WHERE o_date IS NULL OR d_date IS NULL) AS unknown_as_of, count(*) FILTER (WHERE o_date IS DISTINCT FROM d_date) AS as_of_mismatches,
  coalesce(count(*) FILTER (WHERE o_date IS NULL OR d_date IS NULL) = 0 AND count(*) FILTER (WHERE o_date IS DISTINCT FROM d_date) = 0 AND min(o_date) = max(o_date) {want}, false) AS snapshot_compatible,
  coalesce((SELECT bool_and(coalesce(hash_matches, false) AND length(coalesce(sha256, '')) > 0) FROM (SELECT s1 AS s FROM b UNION SELECT s2 FROM b) u LEFT JOIN data_source ON source_id = s), false) AS sources_verified FROM b)
 SELECT subject_key, order_value, display_value, o_date AS order_as_of, order_row, display_row, e.*, 'observed' AS coverage, '{"exact_requested" if as_of else "latest_available"}' AS freshness, false AS global_ranking_claim_allowed
 FROM (SELECT * FROM b ORDER BY order_value DESC NULLS LAST, subject_key LIMIT 10), e"""


def _top(t, as_of: str | None, order: G.Binding = ORDER, display: G.Binding = DISPLAY) -> DataFrame:
    obs = t("metric_observation")
    return G.governed_top_k(obs, obs, order, display, t("data_source"), t("subject"), 10, as_of)


@register(_evidence(None))
def j5_governed_topk(t) -> DataFrame:
    """The flagship: a ranking of the latest observations with the evidence of the whole."""
    return _top(t, None)


@register(_evidence("2026-08-03"))
def j6_snapshot_check(t) -> DataFrame:
    """The same under one requested date, on which few subjects have both values, or none."""
    return _top(t, "2026-08-03")


@register(_evidence("2026-08-03", "met:return_3y", "met:return_3y", "public_fund"))
def j6_one_date(t) -> DataFrame:
    """A field ranked and shown under one requested date."""
    b = G.Binding("met:return_3y", "public_fund", GRAIN, "metric_observation", "metric_id", "met:return_3y", "numeric_value", ("order",), zero_semantics="excluded")
    return _top(t, "2026-08-03", b, replace(b, zero_semantics="included"))


_BINDINGS = "SELECT metric_id AS semantic_id, family_id, min(subject_grain) AS subject_grain, CASE WHEN dimension = 'share' THEN ['order', 'filter', 'aggregate'] WHEN dimension = 'amount' THEN ['order', 'filter'] ELSE ['order'] END AS operations FROM (SELECT DISTINCT metric_id, family_id, subject_grain, dimension FROM metric_observation JOIN metric_catalog USING (metric_id)) GROUP BY metric_id, family_id, dimension"


def _bindings(t) -> DataFrame:
    b = t("metric_observation").select("metric_id", "family_id", "subject_grain").distinct().join(F.broadcast(t("metric_catalog").select("metric_id", "dimension")), "metric_id")  # tens of rows
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    ops = F.when(F.col("dimension") == "share", lit("order", "filter", "aggregate")).when(F.col("dimension") == "amount", lit("order", "filter")).otherwise(lit("order"))
    return b.groupBy(F.col("metric_id").alias("semantic_id"), "family_id", "dimension").agg(F.min("subject_grain").alias("subject_grain")).select("semantic_id", "family_id", "subject_grain", ops.alias("operations"))


_REQUESTS = [("met:return_1y", "public_fund", "product_class", "order"), ("met:return_1y", "public_fund", "product", "order"), ("met:return_1y", "nowhere", "product", "order"), ("met:nothing", "public_fund", "product", "order"),
             ("met:holding_count", "overseas_etp", "product", "aggregate"), ("met:total_fee", "domestic_etp", "product", "filter")]


@register(f"WITH b AS ({_BINDINGS}), q(request_id, semantic_id, family_id, subject_grain, operation) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}', '{d}')" for i, (a, b, c, d) in enumerate(_REQUESTS)) + ") SELECT request_id, "
          "CASE WHEN n1 = 0 THEN 'unknown_field' WHEN n2 = 0 THEN 'family_not_bound' WHEN n3 = 0 THEN 'grain_not_bound' WHEN n3 > 1 THEN 'binding_not_unique' WHEN n4 = 0 THEN 'operation_not_permitted' ELSE 'resolved' END AS outcome FROM (SELECT request_id, count(b.semantic_id) AS n1, "
          "count(*) FILTER (WHERE b.family_id = q.family_id) AS n2, count(*) FILTER (WHERE b.family_id = q.family_id AND b.subject_grain = q.subject_grain) AS n3, count(*) FILTER (WHERE b.family_id = q.family_id AND b.subject_grain = q.subject_grain AND list_contains(b.operations, q.operation)) AS n4 FROM q LEFT JOIN b USING (semantic_id) GROUP BY request_id)")
def j1_resolution_funnel(t) -> DataFrame:
    b = _bindings(t)
    q = b.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(_REQUESTS)], "request_id bigint, semantic_id string, family_id string, subject_grain string, operation string")
    return G.resolution_funnel(b, q)


@register(f"WITH o AS ({_selected('met:return_3m', 'AND numeric_value <> 0')}) SELECT subject_key, numeric_value AS value, effective_as_of AS as_of, source_id, source_row_id FROM o")
def j4_selected_observations(t) -> DataFrame:
    return own_subjects(G.selected(t("metric_observation"), ORDER), t("subject"))


@register("SELECT source_id, coalesce(hash_matches AND length(sha256) > 0, false) AS verified, coalesce(n, 0) AS n_rows FROM data_source LEFT JOIN (SELECT source_id, count(*) AS n FROM metric_observation GROUP BY 1) USING (source_id)")
def j8_source_integrity(t) -> DataFrame:
    n = t("metric_observation").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return t("data_source").join(n, "source_id", "left").select("source_id", F.coalesce(F.col("hash_matches") & (F.length("sha256") > 0), F.lit(False)).alias("verified"), F.coalesce("n", F.lit(0)).alias("n_rows"))


_STATE = f"SELECT metric_id, family_id, count(DISTINCT subject_key) AS observed, count(*) FILTER (WHERE effective_as_of IS NULL) AS unknown, min(effective_as_of) AS lo, max(effective_as_of) AS hi FROM {METRICS} GROUP BY ALL"


def _states(t) -> DataFrame:
    per = folded_subjects(t("metric_observation")).groupBy("metric_id", "family_id", "subject_key").agg(F.count_if(F.col("effective_as_of").isNull()).alias("u"), F.min("effective_as_of").alias("lo"), F.max("effective_as_of").alias("hi"))
    return per.groupBy("metric_id", "family_id").agg(F.count("subject_key").alias("observed"), F.sum("u").alias("unknown"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@register(f"SELECT s.metric_id, s.family_id, CASE WHEN p.n IS NULL THEN 'unknown' WHEN s.observed = 0 THEN 'unavailable' WHEN s.metric_id LIKE '%price%' AND s.observed >= p.n THEN 'full' WHEN s.metric_id LIKE '%price%' THEN 'partial' ELSE 'observed' END AS state FROM ({_STATE}) s LEFT JOIN (SELECT family_id, count(*) AS n FROM subject GROUP BY 1) p USING (family_id)")
def j9_l9_coverage_state(t) -> DataFrame:
    p = t("subject").groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))
    declared = F.when(F.col("metric_id").contains("price"), "full").otherwise("observed")
    return _states(t).join(p, "family_id", "left").select("metric_id", "family_id", G.coverage_state(F.col("observed"), F.col("n"), declared).alias("state"))


@register(f"SELECT metric_id, family_id, CASE WHEN lo IS NULL THEN 'unknown' WHEN unknown > 0 THEN 'partial_unknown' WHEN lo = hi THEN 'single' ELSE 'mixed' END AS state FROM ({_STATE})")
def l10_snapshot_state(t) -> DataFrame:
    return _states(t).select("metric_id", "family_id", G.snapshot_state(F.col("unknown"), F.col("lo"), F.col("hi")).alias("state"))


@register(f"WITH o AS ({_selected('met:holder_count', 'AND isfinite(numeric_value)')}) SELECT subject_key, numeric_value, effective_as_of, source_row_id FROM o ORDER BY numeric_value DESC NULLS LAST, subject_key LIMIT 15")
def j14_metric_rank(t) -> DataFrame:
    from graindeck.operators import select as S
    from graindeck.sources.tables import finite

    m = t("metric_observation").where((F.col("metric_id") == "met:holder_count") & (F.col("value_status") == "valid") & finite("numeric_value"))
    latest = S.latest_per_subject(folded_subjects(m), ["numeric_value", "effective_as_of", "source_row_id"])
    return S.top_k(own_subjects(latest, t("subject")), "numeric_value", "subject_key", 15)


PF = r"lower(regexp_replace(portfolio_key, '\s', '', 'g'))"


@register(f"SELECT s.family_id, count(*) AS n_subjects FROM subject s WHERE subject_key IN (SELECT m.subject_key FROM (SELECT *, {PF} AS k FROM product_portfolio_map) m JOIN (SELECT *, {PF} AS k FROM holding_observation) h USING (k) JOIN security_master x USING (security_key) WHERE x.security_type = 'bond' AND h.relation_kind = 'direct_holding') GROUP BY 1")
def j15_relation_filter(t) -> DataFrame:
    bonds = t("security_master").where(F.col("security_type") == "bond").select("security_key")
    held = t("holding_observation").where(F.col("relation_kind") == "direct_holding").withColumn("portfolio_key", folded_key("portfolio_key")).join(bonds, "security_key", "left_semi")
    edges = t("product_portfolio_map").withColumn("portfolio_key", folded_key("portfolio_key"))
    return R.holding_any(t("subject"), edges, held, F.lit(True)).groupBy("family_id").agg(F.count(F.lit(1)).alias("n_subjects"))


@register("SELECT metric_id AS semantic_id, CASE WHEN dimension IN ('share', 'amount') THEN 'field' ELSE 'dataset' END AS kind FROM metric_catalog")
def l1_candidate_kind(t) -> DataFrame:
    n = F.when(F.col("dimension").isin("share", "amount"), 1).otherwise(0)
    return t("metric_catalog").select(F.col("metric_id").alias("semantic_id"), G.candidate_kind(F.lit(False), F.lit(False), n, F.lit(1), F.lit("product")).alias("kind"))


_MEMBERS = "SELECT 'f' || (n_regionkey % 2) AS family_id, 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation"


@register(f"WITH m AS (SELECT family_id, node FROM ({_MEMBERS}) UNION SELECT family_id, parent FROM ({_MEMBERS}) WHERE family_id = 'f0') SELECT family_id, node FROM m WHERE NOT EXISTS (SELECT 1 FROM ({_MEMBERS}) e JOIN m o ON o.node = e.parent WHERE e.node = m.node AND o.family_id = m.family_id)")
def l2_minimal_cover(t) -> DataFrame:
    n = t("nation").select(F.concat(F.lit("f"), (F.col("n_regionkey") % 2).cast("string")).alias("family_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    members = n.select("family_id", "node").unionByName(n.where(F.col("family_id") == "f0").select("family_id", F.col("parent").alias("node"))).distinct()
    return G.minimal_cover(members, R.closure(n, "node", "parent"))


@register("SELECT metric_id AS semantic_id, CASE WHEN metric_id LIKE '%fee' THEN ['declared_family'] ELSE coalesce(f, []) END AS families, CASE WHEN metric_id LIKE '%fee' THEN 'declared' WHEN f IS NOT NULL THEN 'served' ELSE 'unproven' END AS basis FROM metric_catalog LEFT JOIN (SELECT metric_id, list_sort(list(DISTINCT family_id)) AS f FROM metric_observation GROUP BY 1) USING (metric_id)")
def l3_effective_families(t) -> DataFrame:
    declared = F.when(F.col("metric_id").endswith("fee"), F.array(F.lit("declared_family")))
    terms = t("metric_catalog").select(F.col("metric_id").alias("semantic_id"), declared.alias("declared"))
    return G.effective_families(terms, t("metric_observation").select(F.col("metric_id").alias("semantic_id"), "family_id").distinct())


@register("WITH adm AS (SELECT DISTINCT family_id FROM subject WHERE subject_key IN (SELECT subject_key FROM subject ORDER BY subject_key LIMIT 3)) SELECT DISTINCT m.metric_id, m.family_id FROM metric_observation m JOIN adm USING (family_id)")
def l4_l5_family_closure(t) -> DataFrame:
    """Fields bound to the families of what a budget admitted; the closure is exempt from the budget."""
    admitted = t("subject").orderBy("subject_key").limit(3).select("family_id").distinct()
    return t("metric_observation").select("metric_id", "family_id").distinct().join(F.broadcast(admitted), "family_id").select("metric_id", "family_id")  # three rows at most


@register("WITH r(relation, domain, range, inverse_of) AS (VALUES ('holds', 'product', 'security', 'held_by'), ('held_by', 'security', 'product', 'holds'), ('exposed_to', 'product', 'security', NULL), ('issued_by', 'security', 'issuer', NULL)) "
          "SELECT a.relation, b.relation AS sibling FROM r a JOIN r b ON a.relation <> b.relation AND list_sort([a.domain, a.range]) = list_sort([b.domain, b.range]) WHERE NOT coalesce(a.inverse_of = b.relation, false) AND NOT coalesce(b.inverse_of = a.relation, false)")
def l6_relation_siblings(t) -> DataFrame:
    rows = [("holds", "product", "security", "held_by"), ("held_by", "security", "product", "holds"), ("exposed_to", "product", "security", None), ("issued_by", "security", "issuer", None)]
    return G.siblings(t("region").sparkSession.createDataFrame(rows, "relation string, domain string, range string, inverse_of string"))


_TERMS = "SELECT m.metric_id AS semantic_id, f.family_id, CASE WHEN m.dimension = 'days' THEN ['aggregate'] ELSE ['order'] END AS ops FROM metric_catalog m, (SELECT DISTINCT family_id FROM subject) f"


@register(f"SELECT semantic_id, family_id, CASE WHEN n = 0 THEN 'unavailable' WHEN ok = 0 THEN 'unsupported' WHEN ok > 1 THEN 'ambiguous' ELSE 'resolved' END AS state FROM (SELECT t.semantic_id, t.family_id, count(b.semantic_id) AS n, count(*) FILTER (WHERE list_has_any(t.ops, b.operations)) AS ok FROM ({_TERMS}) t LEFT JOIN ({_BINDINGS}) b USING (semantic_id, family_id) GROUP BY ALL)")
def l7_capability(t) -> DataFrame:
    ops = F.when(F.col("dimension") == "days", F.array(F.lit("aggregate"))).otherwise(F.array(F.lit("order")))
    terms = t("metric_catalog").join(F.broadcast(t("subject").select("family_id").distinct()), F.lit(True)).select(F.col("metric_id").alias("semantic_id"), "family_id", ops.alias("operations"))  # two catalogs
    return G.capability(terms, _bindings(t))


@register(f"SELECT family_id, subject_grain, list_sort(list(DISTINCT op)) AS operations, count(DISTINCT semantic_id) AS n_fields FROM (SELECT family_id, subject_grain, semantic_id, unnest(operations) AS op FROM ({_BINDINGS})) GROUP BY ALL")
def l8_target_summary(t) -> DataFrame:
    return G.target_summary(_bindings(t))


@register(f"SELECT DISTINCT semantic_id, op AS operation FROM (SELECT semantic_id, unnest(['order', 'aggregate', 'compare']) AS op, operations FROM ({_BINDINGS})) WHERE CASE op WHEN 'order' THEN list_contains(operations, 'order') WHEN 'aggregate' THEN list_contains(operations, 'aggregate') ELSE list_contains(operations, 'filter') END")
def l11_executable_operations(t) -> DataFrame:
    b = _bindings(t)
    semantic = b.select("semantic_id").distinct().withColumn("operations", F.array(F.lit("order"), F.lit("aggregate"), F.lit("compare")))
    return G.executable_operations(semantic, b.select("semantic_id", "operations"), {"order": ["order"], "aggregate": ["aggregate"], "compare": ["filter"]})


@register("SELECT coalesce(a.attribute_id, b.attribute_id) AS attribute_id, CASE WHEN a.attribute_id IS NULL THEN 'missing_left' ELSE 'missing_right' END AS rule FROM attribute_catalog a FULL JOIN (SELECT DISTINCT attribute_id FROM attribute_observation WHERE attribute_id NOT IN ('att:hedged', 'att:trustee')) b ON a.attribute_id = b.attribute_id WHERE a.attribute_id IS NULL OR b.attribute_id IS NULL")
def l12_registry_mismatch(t) -> DataFrame:
    b = t("attribute_observation").where(~F.col("attribute_id").isin("att:hedged", "att:trustee")).select("attribute_id").distinct()
    return R.mismatches(t("attribute_catalog").select("attribute_id"), b, "attribute_id", [])


_KEYS = {"subject": ["subject_key"], "portfolio": ["portfolio_key"], "product_portfolio_map": ["map_id"], "security_master": ["security_key"], "security_master ": ["isin"], "data_source": ["source_id"], "holding_observation": ["holding_key"], "documents": ["doc_id"], "attribute_observation": ["attribute_id", "source_row_id"],
         "metric_observation": ["metric_id", "source_row_id"], "metric_catalog": ["metric_id"], "attribute_catalog": ["attribute_id"], "unit_reference": ["unit_id"], "currency_rate": ["currency_code"], "source_target": ["source"], "pack_spec": ["spec_id"]}


def _unique(name: str, key: list[str]) -> str:
    k = key[0] if len(key) == 1 else f"({', '.join(key)})"
    nulls = " OR ".join(f"{c} IS NULL" for c in key)
    n_keys = f"count(DISTINCT {k}) + (count(*) FILTER (WHERE {nulls}) > 0)::INT" if len(key) == 1 else f"count(DISTINCT {k})"
    return f"SELECT '{name}' AS table_name, '{','.join(key)}' AS key_columns, count(*) AS n_rows, {n_keys} AS n_keys, count(*) FILTER (WHERE {nulls}) AS n_null_keys, count(*) = {n_keys} AND count(*) FILTER (WHERE {nulls}) = 0 AS is_unique FROM {name.strip()}"


@register(" UNION ALL ".join(_unique(n, k) for n, k in _KEYS.items()))
def n1_uniqueness_suite(t) -> DataFrame:
    return Q.uniqueness_suite({n: (t(n.strip()), k) for n, k in _KEYS.items()})


_REFS = {"metric_to_subject": ("metric_observation", "subject_key", "subject", "subject_key"), "attribute_to_subject": ("attribute_observation", "subject_key", "subject", "subject_key"), "holding_to_portfolio": ("holding_observation", "portfolio_key", "portfolio", "portfolio_key"), "map_to_subject": ("product_portfolio_map", "subject_key", "subject", "subject_key"), "map_to_portfolio": ("product_portfolio_map", "portfolio_key", "portfolio", "portfolio_key"),
         "holding_to_security": ("holding_observation", "security_key", "security_master", "security_key"), "holding_to_source": ("holding_observation", "source_id", "data_source", "source_id"), "lineitem_to_orders": ("lineitem", "l_orderkey", "orders", "o_orderkey")}


def _folded(k: str) -> str:
    return rf"lower(regexp_replace({k}, '\s', '', 'g'))" if k in ("subject_key", "portfolio_key") else k


@register(" UNION ALL ".join(f"SELECT '{n}' AS path, count(*) AS n_dangling FROM {c} WHERE {k} IS NOT NULL AND {_folded(k)} NOT IN (SELECT {_folded(pk)} FROM {p} WHERE {pk} IS NOT NULL)" for n, (c, k, p, pk) in _REFS.items()))
def n2_references(t) -> DataFrame:
    of = lambda name, k: t(name).withColumn(k, folded_key(k)) if k in ("subject_key", "portfolio_key") else t(name)
    return Q.reference_suite({n: (of(c, k), k, of(p, pk), pk) for n, (c, k, p, pk) in _REFS.items()})


@register("SELECT count(*) AS n_observed, count(*) AS n_covered, 0 AS n_missing, true AS complete FROM (SELECT DISTINCT metric_id, family_id, subject_grain FROM metric_observation)")
def n3_coverage_complete(t) -> DataFrame:
    m = t("metric_observation")
    return Q.completeness(m, A.status_coverage(m, "metric_id"), ["metric_id", "family_id", "subject_grain"])


@register("WITH o AS (SELECT DISTINCT metric_id, family_id, subject_grain FROM metric_observation), c AS (SELECT DISTINCT metric_id, family_id, subject_grain FROM metric_observation WHERE value_status = 'parse_failed') SELECT (SELECT count(*) FROM o) AS n_observed, (SELECT count(*) FROM c) AS n_covered, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM c)) AS n_missing, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM c)) = 0 AS complete")
def n3_coverage_gaps(t) -> DataFrame:
    """Coverage made from the failed rows alone, which leaves groups out."""
    m = t("metric_observation")
    return Q.completeness(m, A.status_coverage(m.where(F.col("value_status") == "parse_failed"), "metric_id"), ["metric_id", "family_id", "subject_grain"])


@register("SELECT coalesce(hash_matches::VARCHAR, 'unknown') AS hash_matches, count(*) AS n FROM data_source GROUP BY 1")
def n6_hash_summary(t) -> DataFrame:
    return Q.hash_summary(t("data_source"))


@register("SELECT map_id, 'official_product_name' AS conflict_group, s.display_name AS left_value, m.external_product_name AS right_value, 'official_value_kept' AS policy FROM product_portfolio_map m JOIN subject s USING (subject_key) WHERE s.display_name <> m.external_product_name")
def n7_conflict_records(t) -> DataFrame:
    j = t("product_portfolio_map").join(t("subject").select("subject_key", "display_name"), "subject_key")
    return Q.conflict_records(j, "map_id", "display_name", "external_product_name", "official_product_name", "official_value_kept")


@register("SELECT security_key AS node, 'SecurityShape' AS shape, 'too_few' AS problem FROM security_master WHERE isin IS NULL AND ticker IS NULL UNION ALL SELECT security_key, 'TypeShape', 'bad_value' FROM security_master WHERE security_type <> 'equity' UNION ALL SELECT security_key, 'TickerShape', 'too_few' FROM security_master WHERE ticker IS NULL UNION ALL SELECT security_key, 'CodeOrBondShape', 'no_alternative' FROM security_master WHERE isin IS NULL AND NOT coalesce(security_type = 'bond', false)")
def n8_shapes(t) -> DataFrame:
    """Conformance of securities as triples: an identifier of some kind, a type of a list, a ticker, an ISIN unless a bond."""
    s = t("security_master")
    lit = F.lit
    cells = F.array(F.struct(lit("rdf:type").alias("p"), lit("Security").alias("o")), F.struct(lit("isin").alias("p"), F.col("isin").alias("o")), F.struct(lit("ticker").alias("p"), F.col("ticker").alias("o")), F.struct(lit("type").alias("p"), F.col("security_type").alias("o")))
    triples = s.select(F.col("security_key").alias("s"), F.inline(cells)).where(F.col("o").isNotNull()).withColumn("o_type", lit("xsd:string"))
    return Q.shapes(triples, [{"name": "SecurityShape", "target": "Security", "any_of": ["isin", "ticker"], "min": 1}, {"name": "TypeShape", "target": "Security", "path": "type", "in": ["equity"]}, {"name": "TickerShape", "target": "Security", "path": "ticker", "min": 1, "max": 1},
                              {"name": "CodeOrBondShape", "target": "Security", "or": [{"path": "isin", "min": 1}, {"path": "type", "in": ["bond"], "min": 1}]}])


@register("SELECT metric_id AS semantic_id, 'period' AS missing FROM metric_catalog WHERE period_code IS NULL UNION ALL SELECT metric_id, 'unit' FROM metric_catalog WHERE common_unit IS NULL")
def n9_term_completeness(t) -> DataFrame:
    return Q.term_completeness(t("metric_catalog").withColumnRenamed("metric_id", "semantic_id"), {"period": F.col("period_code").isNotNull(), "unit": F.col("common_unit").isNotNull()})


_INV = {"subject": "product or class", "portfolio": "portfolio", "metric_observation": "observation", "holding_observation": "holding", "documents": "text"}


@register(" UNION ALL ".join(f"SELECT '{n}' AS table_name, '{g}' AS grain, (SELECT count(*) FROM {n}) AS n_rows, (SELECT count(*) FROM duckdb_columns() WHERE table_name = '{n}' AND NOT internal) AS n_columns" for n, g in _INV.items()))
def n13_inventory(t) -> DataFrame:
    return Q.inventory({n: t(n) for n in _INV}, _INV)
