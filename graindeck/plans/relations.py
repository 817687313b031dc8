"""Queries of joins, aggregates, windows and top-k (groups C, D, E, F)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graindeck.operators import aggregate as A
from graindeck.operators import relate as R
from graindeck.operators import select as S
from graindeck.plans.registry import Register, by_key
from graindeck.sources.tables import folded_key, folded_subjects, own_subjects

register = Register()
QUERIES, ORACLES = register.queries, register.oracles
METRICS = by_key("metric_observation")
PF = r"lower(regexp_replace(portfolio_key, '\s', '', 'g'))"


def _map(t) -> DataFrame:
    return t("product_portfolio_map").withColumn("portfolio_key", folded_key("portfolio_key"))


def _holdings(t) -> DataFrame:
    return t("holding_observation").withColumn("portfolio_key", folded_key("portfolio_key"))


@register("SELECT o_orderkey, o_totalprice, c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o_totalprice > 200000")
def c1_using_join(t) -> DataFrame:
    o = t("orders").where(F.col("o_totalprice") > 200000).select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    return o.join(t("customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "o_totalprice", "c_name")


@register("SELECT map_id, subject_key, coalesce(subject_key IN (SELECT subject_key FROM subject), false) AS matched FROM product_portfolio_map")
def c2_left_match_flag(t) -> DataFrame:
    return R.with_match_flag(t("product_portfolio_map"), t("subject"), "subject_key").select("map_id", "subject_key", "matched")


@register(f"SELECT h.family_id, p.portfolio_id_scheme, count(*) AS n FROM holding_observation h LEFT JOIN (SELECT {PF} AS k, portfolio_id_scheme FROM portfolio) p ON coalesce(lower(regexp_replace(h.portfolio_key, '\\s', '', 'g')), '') = p.k GROUP BY ALL")
def c3_left_normalised_key(t) -> DataFrame:
    """Rows are counted per key before the join, so a hot key crosses it once."""
    h = t("holding_observation").groupBy("family_id", F.coalesce(folded_key("portfolio_key"), F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    p = t("portfolio").select(folded_key("portfolio_key").alias("k"), "portfolio_id_scheme")
    return h.join(p, "k", "left").groupBy("family_id", "portfolio_id_scheme").agg(F.sum("n").alias("n"))


@register(f"SELECT c.family_id, c.subject_grain, c.n, s.total FROM (SELECT family_id, subject_grain, count(DISTINCT subject_key) AS n FROM {METRICS} WHERE metric_id = 'met:total_fee' GROUP BY ALL) c LEFT JOIN (SELECT family_id, subject_grain, count(*) AS total FROM subject GROUP BY ALL) s USING (family_id, subject_grain)")
def c4_two_key_left(t) -> DataFrame:
    c = folded_subjects(t("metric_observation")).where(F.col("metric_id") == "met:total_fee").groupBy("family_id", "subject_grain").agg(F.countDistinct("subject_key").alias("n"))
    return c.join(t("subject").groupBy("family_id", "subject_grain").agg(F.count(F.lit(1)).alias("total")), ["family_id", "subject_grain"], "left")


@register("SELECT m.map_id, 'official_product_name' AS conflict_group, s.display_name AS official, m.external_product_name AS external FROM product_portfolio_map m JOIN subject s USING (subject_key) WHERE s.display_name <> m.external_product_name")
def c5_conflict_join(t) -> DataFrame:
    j = t("product_portfolio_map").join(t("subject").select("subject_key", F.col("display_name").alias("official")), "subject_key").where(F.col("official") != F.col("external_product_name"))
    return j.select("map_id", F.lit("official_product_name").alias("conflict_group"), "official", F.col("external_product_name").alias("external"))


@register(f"SELECT DISTINCT {PF} AS portfolio_key FROM holding_observation WHERE portfolio_key IS NOT NULL AND {PF} NOT IN (SELECT {PF} FROM product_portfolio_map WHERE portfolio_key IS NOT NULL)")
def c6_null_aware_anti(t) -> DataFrame:
    return R.null_aware_anti(_holdings(t).select("portfolio_key").distinct(), _map(t), "portfolio_key")


@register("SELECT holding_key, security_key FROM (SELECT DISTINCT holding_key, security_key FROM holding_observation) h WHERE security_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM security_master s WHERE s.security_key = h.security_key AND s.ticker IS NOT NULL)")
def c7_dangling(t) -> DataFrame:
    h = t("holding_observation").select("holding_key", "security_key").distinct()
    return R.dangling(h, "security_key", t("security_master").where(F.col("ticker").isNotNull()), "security_key").select("holding_key", "security_key")


_EDGES = f"SELECT DISTINCT m.subject_key, m.family_id, h.relation_kind, h.security_key FROM (SELECT *, {PF} AS k FROM product_portfolio_map) m JOIN (SELECT *, {PF} AS k FROM holding_observation) h USING (k) WHERE h.security_key IS NOT NULL"


@register(f"SELECT subject_key, relation_kind, count(*) AS n_securities FROM (SELECT DISTINCT subject_key, relation_kind, security_key FROM ({_EDGES})) GROUP BY ALL")
def c8_relation_forward(t) -> DataFrame:
    return R.relation(_map(t), _holdings(t)).select("subject_key", "relation_kind", "security_key").distinct().groupBy("subject_key", "relation_kind").agg(F.count(F.lit(1)).alias("n_securities"))


@register(f"SELECT security_key, relation_kind, family_id, count(DISTINCT subject_key) AS n_subjects FROM ({_EDGES}) GROUP BY ALL")
def c9_relation_inverse(t) -> DataFrame:
    return R.inverse(_map(t), _holdings(t))


@register(f"SELECT subject_key, family_id FROM subject WHERE subject_key IN (SELECT m.subject_key FROM (SELECT *, {PF} AS k FROM product_portfolio_map) m JOIN (SELECT *, {PF} AS k FROM holding_observation) h USING (k) WHERE h.currency = 'JPY')")
def c10_semi_dedup(t) -> DataFrame:
    return R.holding_any(t("subject"), _map(t), _holdings(t), F.col("currency") == "JPY").select("subject_key", "family_id")


@register(f"SELECT subject_key, metric_id, source_row_id FROM {METRICS} WHERE subject_key IN (SELECT subject_key FROM subject WHERE display_name IS NULL)")
def c11_in_list_semi(t) -> DataFrame:
    nameless = t("subject").where(F.col("display_name").isNull()).select(folded_key("subject_key").alias("__key"), F.col("subject_key").alias("__own"))
    m = t("metric_observation").select(folded_key("subject_key").alias("__key"), "metric_id", "source_row_id")
    return m.join(nameless, "__key").select(F.col("__own").alias("subject_key"), "metric_id", "source_row_id")


@register(f"""SELECT f.family_id, (SELECT count(*) FROM subject s WHERE s.family_id = f.family_id) AS n_subjects, (SELECT count(*) FROM portfolio p WHERE p.family_id = f.family_id) AS n_portfolios,
 (SELECT count(*) FROM product_portfolio_map m WHERE m.family_id = f.family_id AND m.portfolio_key IS NOT NULL) AS n_mapped, (SELECT count(DISTINCT holding_key) FROM holding_observation h WHERE h.family_id = f.family_id) AS n_holdings,
 (SELECT count(DISTINCT {PF}) FROM holding_observation h WHERE h.family_id = f.family_id) AS n_held_portfolios FROM (SELECT DISTINCT family_id FROM subject) f""")
def c12_decorrelated_counts(t) -> DataFrame:
    """Correlated counts as one aggregate per table, joined by family."""
    n = lambda c: F.count(F.lit(1)).alias(c)
    parts = [t("portfolio").groupBy("family_id").agg(n("n_portfolios")), t("product_portfolio_map").where(F.col("portfolio_key").isNotNull()).groupBy("family_id").agg(n("n_mapped")),
             t("holding_observation").groupBy("family_id", "holding_key").agg(n("x")).groupBy("family_id").agg(n("n_holdings")),
             _holdings(t).where(F.col("portfolio_key").isNotNull()).groupBy("family_id", "portfolio_key").agg(n("x")).groupBy("family_id").agg(n("n_held_portfolios"))]
    out = t("subject").groupBy("family_id").agg(n("n_subjects"))
    for p in parts:
        out = out.join(p, "family_id", "left")
    return out.na.fill(0)


@register("SELECT DISTINCT h.holding_key, coalesce(u.status, h.identifier_status) AS identifier_status FROM holding_observation h LEFT JOIN (SELECT isin AS held_security_id_raw, 'listed' AS status FROM security_master WHERE isin IS NOT NULL) u USING (held_security_id_raw)")
def c13_update_from(t) -> DataFrame:
    h = t("holding_observation").select("holding_key", "held_security_id_raw", "identifier_status").distinct()
    u = t("security_master").where(F.col("isin").isNotNull()).select(F.col("isin").alias("held_security_id_raw"), F.lit("listed").alias("identifier_status"))
    return R.update_from(h, u, "held_security_id_raw", ["identifier_status"]).select("holding_key", "identifier_status")


@register(f"SELECT 'portfolio_to_holding' AS path, count(*) AS matched_parents, max(n) AS max_children FROM (SELECT {PF} AS k, count(*) AS n FROM holding_observation WHERE portfolio_key IS NOT NULL GROUP BY 1) JOIN (SELECT DISTINCT {PF} AS k FROM portfolio) USING (k) "
          "UNION ALL SELECT 'subject_to_map', count(*), max(n) FROM (SELECT subject_key, count(*) AS n FROM product_portfolio_map WHERE subject_key IS NOT NULL GROUP BY 1) JOIN (SELECT DISTINCT subject_key FROM subject) USING (subject_key) "
          "UNION ALL SELECT 'security_to_holding', count(*), max(n) FROM (SELECT security_key, count(*) AS n FROM holding_observation WHERE security_key IS NOT NULL GROUP BY 1) JOIN (SELECT security_key FROM security_master) USING (security_key)")
def c14_join_cardinality(t) -> DataFrame:
    pf = t("portfolio").withColumn("portfolio_key", folded_key("portfolio_key"))
    paths = {"portfolio_to_holding": (pf, "portfolio_key", _holdings(t), "portfolio_key"), "subject_to_map": (t("subject"), "subject_key", t("product_portfolio_map"), "subject_key"),
             "security_to_holding": (t("security_master"), "security_key", t("holding_observation"), "security_key")}
    out = None
    for name, p in paths.items():
        one = R.join_cardinality(*p).select(F.lit(name).alias("path"), "matched_parents", "max_children")
        out = one if out is None else out.unionByName(one)
    return out


@register("SELECT f.form, count(*) AS n_documents FROM (SELECT unnest(['fund', 'bond', '채권', '운용', 'risk', '환매']) AS form) f JOIN documents d ON contains(d.text, f.form) GROUP BY 1")
def c15_containment(t) -> DataFrame:
    d = t("documents")
    forms = d.sparkSession.createDataFrame([(x,) for x in ("fund", "bond", "채권", "운용", "risk", "환매")], "form string")
    return R.containment(d.select("doc_id", "text"), "text", forms, "form").groupBy("form").agg(F.count(F.lit(1)).alias("n_documents"))


@register("SELECT f.form, count(*) AS n_documents FROM (SELECT DISTINCT issuer_name AS form FROM security_master WHERE length(issuer_name) > 0) f JOIN documents d ON contains(d.text, f.form) GROUP BY 1")
def c15_containment_any(t) -> DataFrame:
    """Issuers named in documents: the vocabulary grows with the data."""
    pairs = R.containment_any(t("documents"), "doc_id", "text", t("security_master").select(F.col("issuer_name").alias("form")), "form")
    return pairs.groupBy("form").agg(F.count(F.lit(1)).alias("n_documents"))


@register("WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents) SELECT f.form, count(*) AS n_documents FROM (SELECT unnest(['fund', 'bond', 'risk', 'glossary', 'price']) AS form) f JOIN w ON w.w = f.form GROUP BY 1")
def c15_containment_of_words(t) -> DataFrame:
    """Vocabulary words in documents as an equi-join, for vocabularies of any size."""
    d = t("documents")
    forms = d.sparkSession.createDataFrame([(x,) for x in ("fund", "bond", "risk", "glossary", "price")], "form string")
    return R.containment_of_words(d.select("doc_id", "text"), "text", forms, "form", 1).groupBy("form").agg(F.count(F.lit(1)).alias("n_documents"))


@register("SELECT e.vec_id, q.vec_id AS query_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.3 AND e.vec_id <> q.vec_id")
def c16_cross_vectors(t) -> DataFrame:
    """A stated query set (ids divisible by 50) against all vectors, in blocks of queries."""
    from graindeck.operators.retrieve import search_blocks

    e = t("embeddings").select("vec_id", "embedding")
    return search_blocks(e, e.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", threshold=0.3).where(F.col("vec_id") != F.col("query_id"))


@register("SELECT a.metric_id AS term, b.metric_id AS neighbour, list_sort(list_filter([CASE WHEN a.dimension = b.dimension THEN 'same_dimension' END, CASE WHEN a.period_code = b.period_code THEN 'same_period' END], lambda x: x IS NOT NULL)) AS reasons FROM metric_catalog a JOIN metric_catalog b ON a.metric_id <> b.metric_id AND (a.dimension = b.dimension OR a.period_code = b.period_code)")
def c17_neighbours(t) -> DataFrame:
    terms = t("metric_catalog").select(F.col("metric_id").alias("term"), "dimension", "period_code")
    return R.neighbours(terms, {"same_dimension": (["dimension"], None), "same_period": (["period_code"], None)})


_EDGE = "SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey < 3 THEN 'west' ELSE 'east' END FROM region UNION ALL SELECT 'west', 'world' UNION ALL SELECT 'east', 'world' UNION ALL SELECT 'world', 'all' UNION ALL SELECT 'all', 'world'"


@register(f"WITH RECURSIVE e AS ({_EDGE}), c(node, ancestor) AS (SELECT a, b FROM e UNION SELECT c.node, e.b FROM c JOIN e ON c.ancestor = e.a) SELECT node, ancestor FROM c")
def c18_closure(t) -> DataFrame:
    """Ancestors in a graph with a cycle."""
    n = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("b"))
    r = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("a"), F.when(F.col("r_regionkey") < 3, "west").otherwise("east").alias("b"))
    more = n.sparkSession.createDataFrame([("west", "world"), ("east", "world"), ("world", "all"), ("all", "world")], "a string, b string")
    return R.closure(n.unionByName(r).unionByName(more), "a", "b")


@register("SELECT coalesce(a.metric_id, b.metric_id) AS metric_id, unnest(list_filter([CASE WHEN a.metric_id IS NULL THEN 'missing_left' END, CASE WHEN b.metric_id IS NULL THEN 'missing_right' END, CASE WHEN a.metric_id IS NOT NULL AND b.metric_id IS NOT NULL AND a.period_code IS DISTINCT FROM b.period_code THEN 'period_code' END], lambda x: x IS NOT NULL)) AS rule "
          "FROM metric_catalog a FULL JOIN (SELECT metric_id, min(period_code) AS period_code FROM metric_observation WHERE metric_id <> 'met:leverage' GROUP BY 1) b ON a.metric_id = b.metric_id")
def c19_registry_mismatch(t) -> DataFrame:
    b = t("metric_observation").where(F.col("metric_id") != "met:leverage").groupBy("metric_id").agg(F.min("period_code").alias("period_code"))
    return R.mismatches(t("metric_catalog"), b, "metric_id", ["period_code"])


@register("SELECT metric_id, lo <= DATE '2026-07-15' AND DATE '2026-07-15' <= hi AND lo IS NOT NULL AS covered FROM (SELECT metric_id, min(effective_as_of) AS lo, max(effective_as_of) AS hi FROM metric_observation GROUP BY 1)")
def c20_asof_cover(t) -> DataFrame:
    m = t("metric_observation").groupBy("metric_id").agg(F.min("effective_as_of").alias("lo"), F.max("effective_as_of").alias("hi"))
    return m.select("metric_id", F.coalesce(F.lit("2026-07-15").cast("date").between(F.col("lo"), F.col("hi")), F.lit(False)).alias("covered"))


@register("WITH x AS (SELECT metric_id, list(DISTINCT family_id) AS f, list(DISTINCT subject_grain) AS g FROM metric_observation GROUP BY 1) SELECT a.metric_id AS term, b.metric_id AS other FROM x a JOIN x b ON a.metric_id < b.metric_id AND list_has_any(a.f, b.f) AND list_has_any(a.g, b.g)")
def c21_overlap_join(t) -> DataFrame:
    """Terms whose families and grains both overlap: an equi-join on the exploded families, then a test of the grains."""
    x = t("metric_observation").groupBy("metric_id").agg(F.collect_set("family_id").alias("f"), F.collect_set("subject_grain").alias("g"))  # families and grains: a handful
    fam = x.select("metric_id", "g", F.explode("f").alias("k"))
    pairs = fam.alias("a").join(fam.alias("b"), "k").where((F.col("a.metric_id") < F.col("b.metric_id")) & F.arrays_overlap("a.g", "b.g"))
    return pairs.select(F.col("a.metric_id").alias("term"), F.col("b.metric_id").alias("other")).distinct()


# ---- D: aggregates


@register(f"SELECT subject_key, count(*) AS n_rows, count(DISTINCT source_id) AS n_sources FROM {METRICS} WHERE subject_key IS NOT NULL GROUP BY 1")
def d1_entity_rollup(t) -> DataFrame:
    m = folded_subjects(t("metric_observation")).where(F.col("subject_key").isNotNull()).groupBy("subject_key", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return own_subjects(m.groupBy("subject_key").agg(F.sum("n").alias("n_rows"), F.count("source_id").alias("n_sources")), t("subject"))


@register(f"SELECT subject_key, arg_min(raw_text_value, source_row_id || metric_id) AS first_text FROM {METRICS} WHERE subject_key IS NOT NULL GROUP BY 1")
def d2_arg_min_first(t) -> DataFrame:
    m = folded_subjects(t("metric_observation")).where(F.col("subject_key").isNotNull())
    return own_subjects(m.groupBy("subject_key").agg(A.first_by("raw_text_value", F.concat("source_row_id", "metric_id")).alias("first_text")), t("subject"))


@register("SELECT security_key, min(security_name_raw) AS some_name, min(currency) AS some_currency FROM holding_observation WHERE security_key IS NOT NULL GROUP BY 1")
def d3_any_value(t) -> DataFrame:
    return t("holding_observation").where(F.col("security_key").isNotNull()).groupBy("security_key").agg(A.some_value("security_name_raw").alias("some_name"), A.some_value("currency").alias("some_currency"))


_PROFILED = ["subject_key", "subject_grain", "family_id", "metric_id", "raw_text_value", "unit_code", "currency_code", "period_code", "as_of_status", "value_status", "source_id", "source_row_id"]  # every text column


@register(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(nullif(trim({c}), '')) AS n_nonblank, count(*) FILTER (WHERE nullif(trim({c}), '') IS NOT NULL AND TRY_CAST(trim({c}) AS DOUBLE) IS NULL) AS n_castfail, count(*) FILTER (WHERE {c} <> trim({c})) AS n_padded, count(*) FILTER (WHERE TRY_CAST(trim({c}) AS DOUBLE) = 0) AS n_zero FROM metric_observation" for c in _PROFILED))
def d4_column_profile(t) -> DataFrame:
    return A.column_statistics(t("metric_observation"), _PROFILED)


@register(f"SELECT metric_id, count(DISTINCT subject_key) FILTER (WHERE value_status = 'valid') AS n_valid, count(DISTINCT subject_key) FILTER (WHERE value_status = 'zero_excluded') AS n_zero, count(DISTINCT subject_key) FILTER (WHERE value_status = 'parse_failed') AS n_failed FROM {METRICS} GROUP BY 1")
def d5_status_distincts(t) -> DataFrame:
    c = A.status_coverage(folded_subjects(t("metric_observation")), "metric_id", [])
    return c.select("metric_id", F.col("n_valid_subjects").alias("n_valid"), F.col("n_zero_subjects").alias("n_zero"), F.col("n_failed_subjects").alias("n_failed"))


_COVER = f"""SELECT metric_id, family_id, subject_grain, count(*) AS n_rows, count(DISTINCT subject_key) AS n_subjects, count(DISTINCT subject_key) FILTER (WHERE value_status = 'valid') AS n_valid_subjects,
 count(DISTINCT subject_key) FILTER (WHERE value_status = 'zero_excluded') AS n_zero_subjects, count(DISTINCT subject_key) FILTER (WHERE value_status = 'parse_failed') AS n_failed_subjects, max(n) AS max_rows_per_subject,
 min(effective_as_of) AS as_of_min, max(effective_as_of) AS as_of_max, count(*) FILTER (WHERE effective_as_of IS NULL) AS n_unknown_as_of
 FROM (SELECT *, count(*) OVER (PARTITION BY metric_id, family_id, subject_grain, subject_key) AS n FROM {METRICS}) GROUP BY ALL"""


@register(f"SELECT c.*, s.subject_total, greatest(coalesce(s.subject_total, 0) - c.n_subjects, 0) AS missing_subjects FROM ({_COVER}) c LEFT JOIN (SELECT family_id, subject_grain, count(*) AS subject_total FROM subject GROUP BY ALL) s USING (family_id, subject_grain)")
def d6_semantic_coverage(t) -> DataFrame:
    totals = t("subject").groupBy("family_id", "subject_grain").agg(F.count(F.lit(1)).alias("subject_total"))
    return A.with_missing(A.status_coverage(folded_subjects(t("metric_observation")), "metric_id"), totals)


@register(f"SELECT family_id, count(DISTINCT {PF}) AS n_portfolios, count(DISTINCT security_key) AS n_securities, count(DISTINCT holding_key) AS n_holdings, count(DISTINCT holding_key) FILTER (WHERE security_key IS NULL) AS n_unresolved FROM holding_observation GROUP BY 1")
def d7_holdings_coverage(t) -> DataFrame:
    """Distinct counts of three columns as three small aggregates, none of which expands the rows."""
    h = _holdings(t)
    one = lambda c, n: h.where(F.col(c).isNotNull()).groupBy("family_id", c).agg(F.lit(1).alias("x")).groupBy("family_id").agg(F.count(F.lit(1)).alias(n))
    rows = h.groupBy("family_id", "holding_key").agg(F.max(F.col("security_key").isNull()).alias("u")).groupBy("family_id").agg(F.count("holding_key").alias("n_holdings"), F.count_if("u").alias("n_unresolved"))
    return rows.join(one("portfolio_key", "n_portfolios"), "family_id", "left").join(one("security_key", "n_securities"), "family_id", "left").na.fill(0)


@register(f"SELECT family_id, relation_kind, count(*) AS n_rows, count(DISTINCT {PF}) AS n_portfolios, count(DISTINCT security_key) AS n_securities, count(*) FILTER (WHERE security_key IS NULL) AS n_unresolved, min(coalesce(effective_as_of, requested_as_of)) AS as_of_min, max(coalesce(effective_as_of, requested_as_of)) AS as_of_max FROM holding_observation GROUP BY ALL")
def d8_relation_summary(t) -> DataFrame:
    h = _holdings(t).withColumn("d", F.coalesce("effective_as_of", "requested_as_of"))
    pair = h.groupBy("family_id", "relation_kind", "portfolio_key", "security_key").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    return pair.groupBy("family_id", "relation_kind").agg(
        F.sum("n").alias("n_rows"), F.countDistinct("portfolio_key").alias("n_portfolios"), F.countDistinct("security_key").alias("n_securities"),
        F.coalesce(F.sum(F.when(F.col("security_key").isNull(), F.col("n"))), F.lit(0)).alias("n_unresolved"), F.min("lo").alias("as_of_min"), F.max("hi").alias("as_of_max"))


@register("SELECT DISTINCT family_id, portfolio_key FROM product_portfolio_map WHERE portfolio_key IS NOT NULL")
def d9_distinct(t) -> DataFrame:
    return t("product_portfolio_map").where(F.col("portfolio_key").isNotNull()).select("family_id", "portfolio_key").distinct()


@register("SELECT family_id, count(*) AS n_groups, max(n) AS largest FROM (SELECT family_id, upper(substr(display_name, 1, 4)) AS g, count(*) AS n FROM subject WHERE display_name IS NOT NULL GROUP BY ALL) GROUP BY 1")
def d10_class_groups(t) -> DataFrame:
    g = t("subject").where(F.col("display_name").isNotNull()).groupBy("family_id", F.upper(F.substring("display_name", 1, 4)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"))


@register("SELECT family_id, value_status, count(*) AS n FROM metric_observation GROUP BY ALL")
def d11_group_counts(t) -> DataFrame:
    return t("metric_observation").groupBy("family_id", "value_status").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT metric_id, coalesce(unit_code, '') AS unit_code, coalesce(currency_code, '') AS currency_code, sum(numeric_value::DECIMAL(38,6))::DOUBLE / count(numeric_value) AS mean, sum(numeric_value::DECIMAL(38,6))::DOUBLE AS total, min(numeric_value) AS least, max(numeric_value) AS most, count(numeric_value) AS n FROM metric_observation WHERE value_status = 'valid' AND numeric_value IS NOT NULL AND isfinite(numeric_value) AND numeric_value <> 0 GROUP BY ALL")
def d12_measure_agg(t) -> DataFrame:
    """Every metric as recorded, per unit and currency as written: values of different units are never added up. Sums are exact, to a millionth."""
    from graindeck.sources.tables import finite

    m = t("metric_observation").where((F.col("value_status") == "valid") & finite("numeric_value") & (F.col("numeric_value") != 0))
    total = F.sum(F.col("numeric_value").cast("decimal(28,6)")).cast("double")
    v, written = F.col("numeric_value"), [F.coalesce(c, F.lit("")).alias(c) for c in ("unit_code", "currency_code")]
    return m.groupBy("metric_id", *written).agg((total / F.count(v)).alias("mean"), total.alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(v).alias("n"))


@register(f"SELECT {PF} AS portfolio_key, count(*) AS n_rows, count(DISTINCT security_key) AS n_securities FROM holding_observation WHERE security_key IS NOT NULL AND portfolio_key IS NOT NULL GROUP BY 1 HAVING count(*) > count(DISTINCT security_key)")
def d13_duplicate_holders(t) -> DataFrame:
    h = _holdings(t).where(F.col("security_key").isNotNull() & F.col("portfolio_key").isNotNull()).groupBy("portfolio_key", "security_key").agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("portfolio_key").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_securities")).where(F.col("n_rows") > F.col("n_securities"))


@register(f"SELECT count(*) - count(DISTINCT subject_key) AS unselected_duplicates FROM (SELECT subject_key FROM {METRICS} WHERE metric_id = 'met:return_1y' AND value_status = 'valid' AND isfinite(numeric_value) ORDER BY numeric_value DESC NULLS LAST, source_row_id, subject_key LIMIT 100)")
def d14_unselected_duplicates(t) -> DataFrame:
    from graindeck.sources.tables import finite

    m = t("metric_observation").where((F.col("metric_id") == "met:return_1y") & (F.col("value_status") == "valid") & finite("numeric_value"))
    m = folded_subjects(m)
    top = m.orderBy(F.col("numeric_value").desc_nulls_last(), "source_row_id", "subject_key").limit(100)
    return top.agg((F.count(F.lit(1)) - F.countDistinct("subject_key")).alias("unselected_duplicates"))


@register(f"SELECT held_isin_raw AS identifier, count(*) AS n_rows, count(DISTINCT {PF}) AS n_portfolios, array_to_string(list_sort(list(DISTINCT security_name_raw)), '||') AS names FROM holding_observation WHERE held_isin_raw IS NOT NULL AND family_id = 'public_fund' GROUP BY 1")
def d15_unique_identifiers(t) -> DataFrame:
    """Distinct (identifier, name) first; a name list per identifier holds distinct spellings, never rows."""
    h = _holdings(t).where(F.col("held_isin_raw").isNotNull() & (F.col("family_id") == "public_fund")).groupBy(F.col("held_isin_raw").alias("identifier"), "portfolio_key", "security_name_raw").agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("identifier").agg(F.sum("n").alias("n_rows"), F.countDistinct("portfolio_key").alias("n_portfolios"), A.variants_joined(F.col("security_name_raw")).alias("names"))


@register("SELECT held_isin_raw AS identifier, security_name_raw AS name, count(*) AS n_rows, count(DISTINCT snapshot_scope) AS n_scopes FROM holding_observation WHERE held_isin_raw IS NOT NULL GROUP BY ALL")
def d16_identifier_pairs(t) -> DataFrame:
    h = t("holding_observation").where(F.col("held_isin_raw").isNotNull())
    return h.groupBy(F.col("held_isin_raw").alias("identifier"), F.col("security_name_raw").alias("name")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("snapshot_scope").alias("n_scopes"))


@register("SELECT count(DISTINCT held_isin_raw) AS n_ids, count(DISTINCT (held_isin_raw, security_name_raw)) FILTER (WHERE held_isin_raw IS NOT NULL AND security_name_raw IS NOT NULL) AS n_pairs, count(DISTINCT security_name_raw) AS n_names FROM holding_observation")
def d17_export_summary(t) -> DataFrame:
    p = t("holding_observation").select("held_isin_raw", "security_name_raw").distinct()
    return p.agg(F.countDistinct("held_isin_raw").alias("n_ids"), F.count_if(F.col("held_isin_raw").isNotNull() & F.col("security_name_raw").isNotNull()).alias("n_pairs"), F.countDistinct("security_name_raw").alias("n_names"))


_LONG = ["quantity_value", "value_amount", "weight_value"]


@register(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_nonnull, count(*) FILTER (WHERE {c} = 0) AS n_zero, count(*) FILTER (WHERE {c} <> 0) AS n_nonzero FROM holding_observation" for c in _LONG))
def d18_profile_long(t) -> DataFrame:
    aggs = [x for c in _LONG for x in (F.count(c).alias(f"{c}__a"), F.count_if(F.col(c) == 0).alias(f"{c}__b"), F.count_if(F.col(c) != 0).alias(f"{c}__c"))]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__a").alias("n_nonnull"), F.col(f"{c}__b").alias("n_zero"), F.col(f"{c}__c").alias("n_nonzero")) for c in _LONG])
    return t("holding_observation").agg(*aggs).select(F.inline(cells))


@register(f"SELECT round(avg(n), 6) AS mean, median(n) AS middle, max(n) AS most FROM (SELECT subject_key, count(*) AS n FROM {METRICS} GROUP BY 1)")
def d19_distribution(t) -> DataFrame:
    n = folded_subjects(t("metric_observation")).groupBy("subject_key").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("middle"), F.max("n").alias("most"))


_P = [0.05, 0.5, 0.95]


@register("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS p{int(p * 100)}" for p in _P) + " FROM lineitem GROUP BY 1")
def d20_percentile_linear(t) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(*[F.round(A.percentile_linear("l_extendedprice", p), 4).alias(f"p{int(p * 100)}") for p in _P])


@register("SELECT l_returnflag, " + ", ".join(f"quantile_disc(l_quantity, {p}) AS p{int(p * 100)}" for p in _P) + " FROM lineitem GROUP BY 1")
def d21_percentile_disc(t) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(*[A.percentile_nearest_rank("l_quantity", p).alias(f"p{int(p * 100)}") for p in _P])


@register("SELECT metric_id, list_sort(list(numeric_value))[len(list(numeric_value)) // 2 + 1] AS upper_median FROM metric_observation WHERE isfinite(numeric_value) GROUP BY 1")
def d22_upper_median(t) -> DataFrame:
    from graindeck.sources.tables import finite

    return A.upper_median(t("metric_observation").where(finite("numeric_value")), ["metric_id"], "numeric_value")


@register("SELECT round(sum(hit) / sum(n), 6) AS micro, round(avg(hit / n), 6) AS macro FROM (SELECT family_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE value_status = 'valid')::DOUBLE AS hit FROM metric_observation GROUP BY 1)")
def d23_micro_macro(t) -> DataFrame:
    g = t("metric_observation").groupBy("family_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value_status") == "valid").alias("hit"))
    return g.agg(F.round(F.sum("hit") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("macro"))


@register("SELECT metric_id, bool_and(ok) AS every_time, bool_or(ok) AS some_time, bool_or(ok) AND NOT bool_and(ok) AS unstable FROM (SELECT metric_id, source_id, avg((value_status = 'valid')::INT) > 0.9 AS ok FROM metric_observation GROUP BY ALL) GROUP BY 1")
def d24_repeats(t) -> DataFrame:
    r = t("metric_observation").groupBy("metric_id", "source_id").agg((F.avg((F.col("value_status") == "valid").cast("int")) > 0.9).alias("ok"))
    return r.groupBy("metric_id").agg(F.bool_and("ok").alias("every_time"), F.bool_or("ok").alias("some_time"), (F.bool_or("ok") & ~F.bool_and("ok")).alias("unstable"))


@register("SELECT failure, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN value_status <> 'valid' THEN 'status' END, CASE WHEN effective_as_of IS NULL THEN 'date' END, CASE WHEN unit_code IS NULL THEN 'unit' END], lambda x: x IS NOT NULL)) AS failure FROM metric_observation) GROUP BY 1")
def d25_failure_mix(t) -> DataFrame:
    f = F.filter(F.array(F.when(F.col("value_status") != "valid", F.lit("status")), F.when(F.col("effective_as_of").isNull(), F.lit("date")), F.when(F.col("unit_code").isNull(), F.lit("unit"))), lambda x: x.isNotNull())
    return t("metric_observation").select(F.explode(f).alias("failure")).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) AS n_rows, count(DISTINCT (metric_id, source_row_id)) AS n_keys, count(*) FILTER (WHERE metric_id IS NULL OR source_row_id IS NULL) AS n_null_keys, count(*) = count(DISTINCT (metric_id, source_row_id)) AND count(*) FILTER (WHERE metric_id IS NULL OR source_row_id IS NULL) = 0 AS is_unique FROM metric_observation")
def d26_uniqueness(t) -> DataFrame:
    return A.uniqueness(t("metric_observation"), ["metric_id", "source_row_id"])


# ---- E, F: windows and top-k

_LATEST = f"SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY effective_as_of DESC NULLS LAST, source_row_id) AS r FROM (SELECT DISTINCT * FROM {METRICS} WHERE metric_id = '{{}}' AND value_status = 'valid' AND isfinite(numeric_value) AND subject_key IS NOT NULL)"


def _valid(t, metric: str) -> DataFrame:
    from graindeck.sources.tables import finite

    return t("metric_observation").where((F.col("metric_id") == metric) & (F.col("value_status") == "valid") & finite("numeric_value"))


@register(f"SELECT subject_key, numeric_value, effective_as_of, source_row_id FROM ({_LATEST.format('met:return_3m')}) WHERE r = 1")
def e1_latest_per_subject(t) -> DataFrame:
    return own_subjects(S.latest_per_subject(folded_subjects(_valid(t, "met:return_3m")), ["numeric_value", "effective_as_of", "source_row_id"]), t("subject"))


@register("SELECT source_id, row_number() OVER (ORDER BY source_kind, source_name, collected_at, source_id) AS row_id FROM data_source")
def e2_surrogate_row_id(t) -> DataFrame:
    """A global row number, for a table of source loads only (one task sorts it)."""
    return t("data_source").select("source_id", F.row_number().over(Window.orderBy("source_kind", "source_name", "collected_at", "source_id")).alias("row_id"))


@register(f"SELECT k AS portfolio_key, holding_key FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY holding_key) AS r FROM (SELECT DISTINCT {PF} AS k, holding_key FROM holding_observation WHERE portfolio_key IS NOT NULL)) WHERE r <= 3")
def e3_bounded_sample(t) -> DataFrame:
    h = _holdings(t).where(F.col("portfolio_key").isNotNull()).select("portfolio_key", "holding_key").distinct()
    return S.bounded_sample(h, ["portfolio_key"], [F.col("holding_key")], 3)


@register(f"SELECT metric_id, max(n) AS most FROM (SELECT metric_id, count(*) OVER (PARTITION BY metric_id, subject_key) AS n FROM {METRICS}) GROUP BY 1")
def e4_partition_count(t) -> DataFrame:
    return folded_subjects(t("metric_observation")).groupBy("metric_id", "subject_key").agg(F.count(F.lit(1)).alias("n")).groupBy("metric_id").agg(F.max("n").alias("most"))


@register(f"SELECT count(*) AS universe, min(effective_as_of) AS lo, max(effective_as_of) AS hi, count(*) FILTER (WHERE effective_as_of IS NULL) AS unknown, list_sort(list(DISTINCT source_id)) AS sources FROM ({_LATEST.format('met:return_3m')}) WHERE r = 1")
def e5_window_evidence(t) -> DataFrame:
    s = S.latest_per_subject(folded_subjects(_valid(t, "met:return_3m")), ["effective_as_of", "source_id", "source_row_id"])
    s = s.withColumns({"order_as_of": F.col("effective_as_of"), "display_as_of": F.col("effective_as_of")})
    return S.evidence(s).select("universe", F.col("order_as_of_min").alias("lo"), F.col("order_as_of_max").alias("hi"), F.col("unknown_as_of").alias("unknown"), "sources")


@register("SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank, label FROM embeddings")
def e6_rank_in_path(t) -> DataFrame:
    return t("embeddings").select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy(F.col("embedding")[0].desc(), "vec_id")).alias("rank"))


@register("SELECT label, arg_min(vec_id, (-score, vec_id)) AS vec_id, round(max(score), 5) AS score FROM (SELECT label, vec_id, embedding[1]::DOUBLE AS score FROM embeddings) GROUP BY 1")
def e7_best_of_group(t) -> DataFrame:
    e = t("embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("score"))
    return S.best_of(e, ["label"], F.struct(-F.col("score"), F.col("vec_id")), ["vec_id", "score"]).withColumn("score", F.round("score", 5))


@register("SELECT kind, p_partkey, seat FROM (SELECT p_brand AS kind, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS seat FROM part) WHERE seat <= CASE kind WHEN 'Brand#11' THEN 3 WHEN 'Brand#22' THEN 5 ELSE 0 END")
def e8_seats_per_kind(t) -> DataFrame:
    p = t("part").select(F.col("p_brand").alias("kind"), "p_partkey", "p_retailprice")
    return S.seats(p, "kind", [F.col("p_retailprice").desc(), F.col("p_partkey")], {"Brand#11": 3, "Brand#22": 5}).select("kind", "p_partkey", "seat")


@register("SELECT label, round(avg(CASE WHEN r <= 5 THEN 1.0 / r ELSE 0 END), 6) AS mrr FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings) GROUP BY 1")
def e9_reciprocal_rank(t) -> DataFrame:
    r = t("embeddings").select("label", F.row_number().over(Window.partitionBy("label").orderBy(F.col("embedding")[0].desc(), "vec_id")).alias("rank"))
    return r.groupBy("label").agg(F.round(F.avg(F.when(F.col("rank") <= 5, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"))


@register("SELECT subject_key, display_name FROM (SELECT subject_key, display_name FROM subject ORDER BY display_name DESC NULLS LAST, subject_key LIMIT 25)")
def f1_topk_nulls_last(t) -> DataFrame:
    return S.top_k(t("subject").select("subject_key", "display_name"), "display_name", "subject_key", 25)


@register("SELECT subject_key, numeric_value FROM metric_observation WHERE metric_id = 'met:return_3m' AND value_status = 'valid' AND isfinite(numeric_value) ORDER BY numeric_value DESC, subject_key LIMIT 20")
def f2_rank_without_selection(t) -> DataFrame:
    """The negative control: ranking rows, not selected observations, can show a subject twice."""
    return S.top_k(_valid(t, "met:return_3m").select("subject_key", "numeric_value"), "numeric_value", "subject_key", 20)


_DOT = "SELECT q.vec_id AS query_id, e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q"


@register(f"SELECT query_id, vec_id, round(s, 5) AS score FROM ({_DOT}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 20")
def f4_vector_topk(t) -> DataFrame:
    """The first 20 rows for each of the stated queries."""
    from graindeck.operators.retrieve import search_blocks

    e = t("embeddings").select("vec_id", "embedding")
    return search_blocks(e, e.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", top_k=20).select("query_id", "vec_id", "score")


@register(f"SELECT query_id, label, vec_id, round(s, 5) AS score FROM (SELECT query_id, label, arg_min(vec_id, (-s, vec_id)) AS vec_id, max(s) AS s FROM ({_DOT}) GROUP BY query_id, label) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label) <= 5")
def f5_topk_after_dedup(t) -> DataFrame:
    """The cut applies to semantic ids, not to their forms, for each of the stated queries."""
    from graindeck.operators.retrieve import search_blocks

    e = t("embeddings").select("vec_id", "label", "embedding")
    s = search_blocks(e, e.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", digits=None).join(e.select("vec_id", "label"), "vec_id")
    best = S.best_of(s, ["query_id", "label"], F.struct(-F.col("score"), F.col("vec_id")), ["vec_id", "score"])
    return S.bounded_sample(best, ["query_id"], [F.col("score").desc(), F.col("label")], 5).withColumn("score", F.round("score", 5))


@register("SELECT term, r <= 10 AS admitted, CASE WHEN r <= 10 THEN 'admitted' ELSE 'over_budget' END AS reason FROM (SELECT metric_id AS term, row_number() OVER (ORDER BY (dimension = 'share')::INT, length(metric_id) DESC, metric_id) AS r FROM metric_catalog)")
def f8_budgeted_admission(t) -> DataFrame:
    """Metrics admitted under a budget."""
    m = t("metric_catalog").select((F.col("dimension") == "share").cast("int").alias("tier"), F.length("metric_id").alias("longest"), F.lit(1).alias("matches"), F.col("metric_id").alias("term"), F.lit(None).cast("string").alias("owner"))
    return S.admit(m, 10)


@register("SELECT * FROM (VALUES ('owner', true, 'admitted'), ('late', true, 'admitted'), ('owned', true, 'admitted'), ('early', false, 'owner_not_admitted'), ('last', false, 'over_budget')) v(term, admitted, reason)")
def f8_owned_admission(t) -> DataFrame:
    """Three seats: one term whose owner comes before it, one whose owner comes after it, one that comes too late."""
    rows = [(1, 9, 1, "early", "late"), (1, 8, 1, "owner", None), (1, 7, 1, "owned", "owner"), (1, 6, 1, "late", None), (2, 9, 1, "last", None)]
    return S.admit(t("region").sparkSession.createDataFrame(rows, "tier int, longest int, matches int, term string, owner string"), 3)


@register("SELECT family_id, subject_key FROM (SELECT family_id, subject_key, row_number() OVER (PARTITION BY family_id ORDER BY subject_key) AS r FROM subject) WHERE r <= 5")
def f9_sample_head(t) -> DataFrame:
    return S.bounded_sample(t("subject").select("family_id", "subject_key"), ["family_id"], [F.col("subject_key")], 5)
