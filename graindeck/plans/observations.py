"""Queries of scans, projections, predicates and scalar functions (groups A, B, G, H)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graindeck.functions.identifiers import isin_valid
from graindeck.functions import text as T
from graindeck.operators import observe as O
from graindeck.operators import select as S
from graindeck.plans.registry import Register

register = Register()
QUERIES, ORACLES = register.queries, register.oracles
FOLD = r"lower(regexp_replace({}, '\s', '', 'g'))"
WEIGHTS = {"met:quantity": ("l_quantity", "count"), "met:price": ("l_extendedprice", "currency_amount"), "met:discount": ("l_discount", "ratio"), "met:tax": ("l_tax", "ratio")}


@register("SELECT 'part#' || p_partkey AS source_row_id, p_partkey, p_name, p_size FROM part")
def a5_parquet_row_id(t) -> DataFrame:
    return t("part").select(F.concat(F.lit("part#"), F.col("p_partkey").cast("string")).alias("source_row_id"), "p_partkey", "p_name", "p_size")


@register("SELECT column_name, column_index AS position FROM duckdb_columns() WHERE table_name = 'metric_observation' AND NOT internal")
def a10_metadata(t) -> DataFrame:
    df = t("metric_observation")
    return df.sparkSession.createDataFrame([(f.name, i + 1) for i, f in enumerate(df.schema.fields)], "column_name string, position int")


@register("SELECT attribute_id, source_row_id, label_value AS as_text, TRY_CAST(TRY_CAST(nullif(trim(label_value), '') AS DOUBLE) AS DOUBLE) AS as_double, "
          "CAST(round(TRY_CAST(nullif(trim(label_value), '') AS DECIMAL(38,9))) AS BIGINT) AS as_bigint, TRY_CAST(nullif(trim(label_value), '') AS DECIMAL(18,4))::DOUBLE AS as_numeric "
          "FROM attribute_observation")
def b1_typed_projection(t) -> DataFrame:
    """Raw text of every attribute cast as each declared type."""
    a = t("attribute_observation")
    label = F.col("label_value")
    return a.select("attribute_id", "source_row_id", label.alias("as_text"), O.typed(label, "double precision").alias("as_double"), O.typed(label, "bigint").alias("as_bigint"),
                    O.typed(label, "numeric(18,4)").cast("double").alias("as_numeric"))


@register("SELECT doc_id, nullif(trim(source), '') AS source, nullif(trim(lang), '') AS lang FROM documents")
def b2_trim_null(t) -> DataFrame:
    return t("documents").select("doc_id", O.trim_to_null("source").alias("source"), O.trim_to_null("lang").alias("lang"))


_METRICS = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{m}' AS metric_id, {c}::DOUBLE AS numeric_value, '{u}' AS unit_code, CASE WHEN {c} IS NULL THEN 'parse_failed' WHEN {c} = 0 THEN 'zero_excluded' ELSE 'valid' END AS value_status FROM lineitem" for m, (c, u) in WEIGHTS.items())


@register(_METRICS)
def b3_metric_unpivot(t) -> DataFrame:
    return O.unpivot_metrics(t("lineitem"), ["l_orderkey", "l_linenumber"], WEIGHTS)


@register("SELECT security_key, 'att:type' AS attribute_id, nullif(trim(security_type), '') AS code_value, nullif(trim(security_name), '') AS label_value, NULL::DATE AS date_value, 'valid' AS value_status FROM security_master "
          "WHERE nullif(trim(security_type), '') IS NOT NULL OR nullif(trim(security_name), '') IS NOT NULL "
          "UNION ALL SELECT security_key, 'att:ticker', NULL, nullif(trim(ticker), ''), NULL, 'valid' FROM security_master WHERE nullif(trim(ticker), '') IS NOT NULL")
def b4_attribute_unpivot(t) -> DataFrame:
    return O.unpivot_attributes(t("security_master"), ["security_key"], {"att:type": {"code": "security_type", "label": "security_name"}, "att:ticker": {"key": "ticker"}})


@register("SELECT value_status, count(*) AS n FROM (SELECT CASE WHEN numeric_value IS NULL THEN 'parse_failed' WHEN numeric_value = 0 THEN 'zero_excluded' ELSE 'valid' END AS value_status FROM metric_observation) GROUP BY 1")
def b5_metric_status(t) -> DataFrame:
    return t("metric_observation").groupBy(O.metric_status(F.col("numeric_value")).alias("value_status")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT attribute_id, source_row_id, CASE WHEN nullif(trim(label_value), '') IS NOT NULL AND d IS NULL THEN 'date_parse_failed' ELSE 'valid' END AS status FROM (SELECT *, "
          "CASE WHEN length(regexp_replace(label_value, '[^0-9]', '', 'g')) = 8 THEN TRY_CAST(try_strptime(regexp_replace(label_value, '[^0-9]', '', 'g'), '%Y%m%d') AS DATE) END AS d "
          "FROM attribute_observation JOIN attribute_catalog USING (attribute_id) WHERE value_type = 'date')")
def b6_date_status(t) -> DataFrame:
    a = t("attribute_observation").join(F.broadcast(t("attribute_catalog").where(F.col("value_type") == "date")), "attribute_id")  # tens of rows
    return a.select("attribute_id", "source_row_id", O.date_status(F.col("label_value"), O.strict_date("label_value")).alias("status"))


@register("SELECT family_id, CASE WHEN metric_id LIKE 'met:return%' THEN CASE WHEN effective_as_of IS NOT NULL THEN 'effective_declared' ELSE 'unknown' END ELSE 'not_declared' END AS status, count(*) AS n FROM metric_observation GROUP BY ALL")
def b7_asof_status(t) -> DataFrame:
    return t("metric_observation").groupBy("family_id", O.as_of_status(F.col("metric_id").startswith("met:return"), F.col("effective_as_of")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT DISTINCT holding_key, CASE WHEN family_id = 'domestic_etp' THEN d END AS requested, CASE WHEN family_id <> 'domestic_etp' THEN d END AS effective, "
          "CASE WHEN d IS NULL THEN 'unknown' WHEN family_id = 'domestic_etp' THEN 'requested_only' ELSE 'effective_reported' END AS status FROM (SELECT *, coalesce(effective_as_of, requested_as_of) AS d FROM holding_observation)")
def b8_asof_split(t) -> DataFrame:
    h = t("holding_observation").select("holding_key", "family_id", F.coalesce("effective_as_of", "requested_as_of").alias("d"))
    role = F.when(F.col("family_id") == "domestic_etp", "requested").otherwise("effective")
    r, e, s = O.as_of_split(role, F.col("d"))
    return h.select("holding_key", r.alias("requested"), e.alias("effective"), s.alias("status")).distinct()


@register("SELECT scheme, status, promote, count(*) AS n FROM (SELECT CASE WHEN x = '' THEN 'cnn:NoIdentifierProvided' WHEN regexp_matches(x, '^[A-Z]{2}[A-Z0-9]{9}[0-9]$') THEN 'cnn:IsinIdentifier' "
          "WHEN regexp_matches(x, '^[0-9]{6}$') THEN 'cnn:KrxShortCodeIdentifier' WHEN regexp_matches(x, '^[A-Z0-9]{6}$') THEN 'cnn:SourceTickerIdentifierRaw' ELSE 'cnn:SourceDeclaredIdentifierRaw' END AS scheme, "
          "CASE WHEN x = '' THEN 'absent' WHEN regexp_matches(x, '^[A-Z]{2}[A-Z0-9]{9}[0-9]$') OR regexp_matches(x, '^[0-9]{6}$') THEN 'format_matched' ELSE 'unverified_scheme' END AS status, "
          "regexp_matches(x, '^[A-Z]{2}[A-Z0-9]{9}[0-9]$') OR regexp_matches(x, '^[0-9]{6}$') AS promote FROM (SELECT coalesce(trim(held_security_id_raw), '') AS x FROM holding_observation)) GROUP BY ALL")
def b9_identifier_classify(t) -> DataFrame:
    """Distinct identifiers are classified once, then counted by their rows."""
    ids = t("holding_observation").groupBy("held_security_id_raw").agg(F.count(F.lit(1)).alias("rows"))
    scheme, status, promote = O.classify_identifier(F.col("held_security_id_raw"))
    return ids.groupBy(scheme.alias("scheme"), status.alias("status"), promote.alias("promote")).agg(F.sum("rows").alias("n"))


@register("SELECT portfolio_key, CASE WHEN nullif(trim(portfolio_id_raw), '') IS NULL THEN 'absent' WHEN regexp_matches(trim(portfolio_id_raw), '^[A-Za-z]*0+$') THEN 'placeholder' ELSE 'declared_by_source' END AS status FROM portfolio")
def b10_identifier_status(t) -> DataFrame:
    return t("portfolio").select("portfolio_key", O.official_status(F.col("portfolio_id_raw")).alias("status"))


_SOURCE = "CASE WHEN source_reference LIKE 'L2 via %' THEN '[level2:lookthrough parent=' || substr(source_reference, 8) || ']' WHEN source_reference LIKE 'L1%' THEN '[level1:direct]' ELSE source_reference END"


@register(f"SELECT DISTINCT holding_key, CASE WHEN family_id = 'public_fund' AND regexp_matches(s, '\\[level([0-9]+):direct\\]') THEN 'direct_holding' WHEN family_id = 'public_fund' AND regexp_matches(s, '\\[level([0-9]+):lookthrough parent=([^\\]]+)\\]') THEN 'look_through_exposure' "
          f"WHEN family_id IN ('domestic_etp', 'overseas_etp') AND s <> '' THEN 'direct_holding' ELSE 'unclassified' END AS kind, CASE WHEN family_id = 'public_fund' THEN nullif(regexp_extract(s, '\\[level([0-9]+):lookthrough parent=([^\\]]+)\\]', 2), '') END AS parent "
          f"FROM (SELECT *, {_SOURCE} AS s FROM holding_observation)")
def b11_relation_kind(t) -> DataFrame:
    ref = F.col("source_reference")
    s = F.when(ref.startswith("L2 via "), F.concat(F.lit("[level2:lookthrough parent="), F.substring(ref, F.lit(8), F.length(ref)), F.lit("]"))).when(ref.startswith("L1"), "[level1:direct]").otherwise(ref)
    h = t("holding_observation").withColumn("s", s)
    kind, parent = O.relation_kind(F.col("family_id"), F.col("s"))
    return h.select("holding_key", kind.alias("kind"), parent.alias("parent")).distinct()


@register("SELECT subject_key, CASE family_id WHEN 'public_fund' THEN 'fund' WHEN 'domestic_etp' THEN 'etp' WHEN 'overseas_etp' THEN 'etp' WHEN 'domestic_bond' THEN 'bond' END AS family FROM subject")
def b12_family_remap(t) -> DataFrame:
    return t("subject").select("subject_key", O.remap(F.col("family_id"), {"public_fund": "fund", "domestic_etp": "etp", "overseas_etp": "etp", "domestic_bond": "bond"}).alias("family"))


@register("SELECT DISTINCT subject_key, numeric_value, source_row_id FROM metric_observation WHERE metric_id = 'met:return_1y' AND value_status = 'valid' AND numeric_value IS NOT NULL AND numeric_value <> 0 AND effective_as_of = DATE '2026-08-03'")
def b13_registry_predicate(t) -> DataFrame:
    p = O.bound_predicate("metric_id", "met:return_1y", "numeric_value", as_of=("effective_as_of", "2026-08-03"), zero_excluded=True)
    return t("metric_observation").where(p).select("subject_key", "numeric_value", "source_row_id").distinct()


@register("SELECT op, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS op FROM part WHERE p_size {s} 25" for k, s in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">="))) + ") GROUP BY op")
def b14_comparison_filters(t) -> DataFrame:
    """All six comparisons in one scan."""
    ops = ["eq", "ne", "lt", "lte", "gt", "gte"]
    hits = F.filter(F.array(*[F.when(O.compare(F.col("p_size"), op, 25), F.lit(op)) for op in ops]), lambda x: x.isNotNull())
    return t("part").select(F.explode(hits).alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#12', 'Brand#23', 'Brand#34') OR contains(p_name, 'a')")
def b15_in_contains(t) -> DataFrame:
    role = "label_or_code"
    return t("part").where(O.compare(F.col("p_brand"), "in", ["Brand#12", "Brand#23", "Brand#34"], role) | O.compare(F.col("p_name"), "contains", "a", role)).select("p_partkey", "p_brand", "p_type")


@register("SELECT subject_key, source_row_id, metric_id FROM metric_observation WHERE unit_code IS DISTINCT FROM currency_code")
def b16_null_safe_ne(t) -> DataFrame:
    return t("metric_observation").where(~F.col("unit_code").eqNullSafe(F.col("currency_code"))).select("subject_key", "source_row_id", "metric_id")


@register("SELECT m.map_id, m.external_product_name, s.display_name FROM product_portfolio_map m JOIN subject s USING (subject_key) WHERE m.external_product_name IS NOT NULL AND s.display_name IS NOT NULL AND m.external_product_name <> s.display_name")
def b17_conflict_predicate(t) -> DataFrame:
    j = t("product_portfolio_map").join(t("subject").select("subject_key", "display_name"), "subject_key")
    return j.where(O.conflict(F.col("external_product_name"), F.col("display_name"))).select("map_id", "external_product_name", "display_name")


@register("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2 FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) >= 0.5")
def b18_score_threshold(t) -> DataFrame:
    from graindeck.functions.vectors import dot

    norm = dot(F.col("embedding"), F.col("embedding"))
    return t("embeddings").where(norm >= 0.5).select("vec_id", F.round(norm, 6).alias("norm2"))


@register("SELECT subject_key AS entity_key, 'subject' AS kind, family_id FROM subject UNION ALL SELECT portfolio_key, 'portfolio', family_id FROM portfolio UNION ALL SELECT security_key, 'security', NULL FROM security_master")
def g1_subject_union(t) -> DataFrame:
    parts = [t("subject").select(F.col("subject_key").alias("entity_key"), F.lit("subject").alias("kind"), "family_id"), t("portfolio").select(F.col("portfolio_key").alias("entity_key"), F.lit("portfolio").alias("kind"), "family_id"),
             t("security_master").select(F.col("security_key").alias("entity_key"), F.lit("security").alias("kind"), F.lit(None).cast("string").alias("family_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("SELECT o_custkey AS key, CASE WHEN min(path) = 0 THEN 'orders' ELSE 'bank' END AS first_path FROM (SELECT o_custkey, 0 AS path FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
def g2_ordered_union(t) -> DataFrame:
    a = t("orders").where(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("key")).distinct().withColumn("rank", F.lit(1))
    b = t("customer").where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("key"), F.lit(1).alias("rank"))
    return S.ordered_union([a, b], "key").select("key", F.when(F.col("path") == 0, "orders").otherwise("bank").alias("first_path"))


@register("SELECT subject_key, 'left_only' AS side FROM (SELECT subject_key FROM subject EXCEPT SELECT subject_key FROM product_portfolio_map WHERE subject_key IS NOT NULL) UNION ALL SELECT subject_key, 'right_only' FROM (SELECT subject_key FROM product_portfolio_map WHERE subject_key IS NOT NULL EXCEPT SELECT subject_key FROM subject)")
def g3_difference(t) -> DataFrame:
    return S.difference(t("subject"), t("product_portfolio_map"), "subject_key")


@register("SELECT (SELECT count(*) FROM (SELECT subject_key FROM subject EXCEPT SELECT subject_key FROM metric_observation)) = 0 AND (SELECT count(*) FROM (SELECT family_id FROM subject EXCEPT SELECT family_id FROM metric_observation)) = 0 AS equal_sets")
def g4_set_equality(t) -> DataFrame:
    gone = t("subject").select("subject_key").join(t("metric_observation").select("subject_key"), "subject_key", "left_anti").agg(F.count(F.lit(1)).alias("a"))
    fams = t("subject").select("family_id").distinct().join(t("metric_observation").select("family_id").distinct(), "family_id", "left_anti").agg(F.count(F.lit(1)).alias("b"))
    return gone.join(F.broadcast(fams), F.lit(True)).select(((F.col("a") == 0) & (F.col("b") == 0)).alias("equal_sets"))


_FAMS = "(SELECT subject_key, list_sort(list(DISTINCT metric_id)) AS m FROM metric_observation WHERE subject_key IS NOT NULL GROUP BY 1)"


@register(f"SELECT subject_key, list_has_any(m, ['met:leverage', 'met:duration_days']) AS overlaps, list_has_all(m, ['met:price_close']) AS covers, len(list_intersect(m, ['met:return_1y', 'met:return_3y', 'met:return_ytd']))::INT AS n_shared FROM {_FAMS}")
def g5_g6_array_sets(t) -> DataFrame:
    from graindeck.functions.text import covers

    m = t("metric_observation").where(F.col("subject_key").isNotNull()).groupBy("subject_key").agg(F.collect_set("metric_id").alias("m"))  # at most one entry per catalog metric
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    return m.select("subject_key", F.arrays_overlap("m", arr("met:leverage", "met:duration_days")).alias("overlaps"), covers(arr("met:price_close"), F.col("m")).alias("covers"),
                    F.size(F.array_intersect("m", arr("met:return_1y", "met:return_3y", "met:return_ytd"))).alias("n_shared"))


@register("SELECT p_partkey, nullif(trim(p_name), '') AS name, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand, p_brand || '/' || p_type AS both, CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS size_class FROM part")
def h1_text_basics(t) -> DataFrame:
    return t("part").select("p_partkey", O.trim_to_null("p_name").alias("name"), F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), F.lit("none")).alias("brand"), F.concat("p_brand", F.lit("/"), "p_type").alias("both"),
                            F.when(F.col("p_size") > 25, "large").when(F.col("p_size") > 10, "middle").otherwise("small").alias("size_class"))


@register("SELECT attribute_id, source_row_id, CASE WHEN length(d) = 8 THEN CAST(try_strptime(d, '%Y%m%d') AS DATE) END AS as_date FROM (SELECT *, regexp_replace(label_value, '[^0-9]', '', 'g') AS d FROM attribute_observation WHERE attribute_id IN ('att:issue_date', 'att:maturity_date', 'att:setup_date', 'att:listing_date'))")
def h2_strict_date(t) -> DataFrame:
    a = t("attribute_observation").where(F.col("attribute_id").isin("att:issue_date", "att:maturity_date", "att:setup_date", "att:listing_date"))
    return a.select("attribute_id", "source_row_id", O.strict_date("label_value").alias("as_date"))


@register("SELECT holding_key, regexp_matches(security_name_raw, '[0-9]+-[0-9]+') AS is_series, regexp_extract(security_name_raw, '([0-9.]+)\\s*%', 1) AS coupon, regexp_replace(security_name_raw, '[^A-Za-z]', '', 'g') AS letters FROM (SELECT DISTINCT holding_key, security_name_raw FROM holding_observation) WHERE security_name_raw IS NOT NULL")
def h3_h4_h5_regex(t) -> DataFrame:
    h = t("holding_observation").select("holding_key", "security_name_raw").distinct().where(F.col("security_name_raw").isNotNull())
    n = F.col("security_name_raw")
    return h.select("holding_key", n.rlike("[0-9]+-[0-9]+").alias("is_series"), F.regexp_extract(n, r"([0-9.]+)\s*%", 1).alias("coupon"), F.regexp_replace(n, "[^A-Za-z]", "").alias("letters"))


@register("SELECT DISTINCT holding_key, greatest(weight_value, quantity_value) AS larger FROM holding_observation")
def h6_greatest_ignoring_nulls(t) -> DataFrame:
    return t("holding_observation").select("holding_key", F.greatest("weight_value", "quantity_value").alias("larger")).distinct()


_LUHN = ("list_sum(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (CAST(substr(r, i, 1) AS INT) * 2) // 10 + (CAST(substr(r, i, 1) AS INT) * 2) % 10 ELSE CAST(substr(r, i, 1) AS INT) END)) % 10 = 0")


@register("SELECT isin, " + _LUHN + " AS valid FROM (SELECT isin, reverse(array_to_string(list_transform(string_split(isin, ''), lambda c: CASE WHEN ascii(c) >= 65 THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')) AS r "
          "FROM (SELECT DISTINCT held_security_id_raw AS isin FROM holding_observation WHERE regexp_matches(held_security_id_raw, '^[A-Z]{2}[A-Z0-9]{9}[0-9]$')))")
def h7_isin_checksum(t) -> DataFrame:
    h = t("holding_observation").select(F.col("held_security_id_raw").alias("isin")).where(F.col("isin").rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")).distinct()
    return h.select("isin", isin_valid(F.col("isin")).alias("valid"))


@register("SELECT metric_id, pattern FROM metric_catalog JOIN (VALUES ('met:return_*'), ('met:nav_per_unit'), ('*_fee')) p(pattern) ON regexp_matches(metric_id, '^' || replace(pattern, '*', '.*') || '$')")
def h8_note_expansion(t) -> DataFrame:
    """Names and globs of a note, spread over the columns they mean."""
    spark = t("metric_catalog").sparkSession
    note = spark.createDataFrame([("met:return_*, met:nav_per_unit; *_fee",)], "note string")
    return T.expand_note(note, "note", t("metric_catalog").select("metric_id"), "metric_id")


@register()
def h9_normalize_nfkc(t) -> DataFrame:
    """Retrieval normalisation of every document (NFKC and casefold, which SQL lacks)."""
    return t("documents").select("doc_id", T.retrieval_normal(F.col("text")).alias("normal"))


@register()
def h10_span_normalize(t) -> DataFrame:
    return t("documents").select("doc_id", T.span_normal(F.col("text")).alias("normal"))


@register("SELECT s.subject_key, CASE WHEN contains(d.text, s.display_name) THEN 'exact' WHEN contains(lower(d.text), lower(s.display_name)) THEN 'normalized' ELSE 'not_in_question' END AS alignment, count(*) AS n FROM documents d JOIN subject s USING (subject_key) WHERE s.display_name IS NOT NULL AND d.text IS NOT NULL GROUP BY ALL")
def h11_span_alignment(t) -> DataFrame:
    """Is the subject's name in the document, as written or but for case?"""
    j = t("documents").where(F.col("text").isNotNull()).join(t("subject").where(F.col("display_name").isNotNull()).select("subject_key", "display_name"), "subject_key")
    a = T.alignment(F.col("text"), F.col("display_name"), F.lower("text"), F.lower("display_name"))
    return j.groupBy("subject_key", a.alias("alignment")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p_partkey, len(list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, 1) = 'e'))::INT AS n_e FROM part")
def h12_overlapping_occurrences(t) -> DataFrame:
    return t("part").select("p_partkey", F.size(T.occurrences(F.col("p_name"), F.lit("e"))).alias("n_e"))


_SIZE = "list_max(list_filter(range(greatest(2, ceil(0.3 * length(form))::BIGINT), length(form)), lambda k: len(list_filter(range(1, length(form) - k + 2), lambda i: contains(question, substr(form, i, k)))) > 0))"


@register(f"SELECT p_partkey, CASE WHEN k IS NOT NULL THEN substr(form, list_min(list_filter(range(1, length(form) - k + 2), lambda i: contains(question, substr(form, i, k)))), k) END AS fragment FROM (SELECT *, {_SIZE} AS k FROM (SELECT a.p_partkey, a.p_name AS form, b.p_name AS question FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1))")
def h13_longest_fragment(t) -> DataFrame:
    """The longest fragment of each part's name that the name of the part before it contains."""
    p = t("part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("question"))
    return p.join(q, "p_partkey").select("p_partkey", T.longest_fragment(F.col("p_name"), F.col("question"), 2, 0.3).alias("fragment"))


@register("SELECT p_partkey, least(1.0, (p_size::DOUBLE) / 30)::DOUBLE AS score FROM part")
def h14_coverage_score(t) -> DataFrame:
    return t("part").select("p_partkey", T.coverage_score(F.col("p_size"), F.lit(30)).alias("score"))


@register("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2 FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))")
def h15_l2_normalise(t) -> DataFrame:
    from graindeck.functions.vectors import dot, unit

    return t("embeddings").select("vec_id", unit(F.col("embedding")).alias("v")).select("vec_id", F.round(dot(F.col("v"), F.col("v")), 6).alias("norm2"))


@register("SELECT q.vec_id AS query_id, a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q")
def h16_dot_product(t) -> DataFrame:
    """Every row with each of the stated queries."""
    from graindeck.operators.retrieve import search_blocks

    e = t("embeddings").select("vec_id", "embedding")
    return search_blocks(e, e.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding").select("query_id", "vec_id", "score")


@register("SELECT column_name, relation, count(*) AS n FROM (SELECT 'name' AS column_name, CASE WHEN m.external_product_name = s.display_name THEN '=' ELSE '<>' END AS relation FROM product_portfolio_map m JOIN subject s USING (subject_key) WHERE m.external_product_name IS NOT NULL AND s.display_name IS NOT NULL) GROUP BY ALL")
def h24_text_relation(t) -> DataFrame:
    j = t("product_portfolio_map").join(t("subject").select("subject_key", "display_name"), "subject_key").where(F.col("external_product_name").isNotNull() & F.col("display_name").isNotNull())
    rel = F.when(F.col("external_product_name") != F.col("display_name"), "<>").otherwise("=")
    return j.groupBy(F.lit("name").alias("column_name"), rel.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT c, CASE WHEN trim(label_value) IN ('0', '0.0', '0.00', '0.000', '0.0000') THEN 'zero_like' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT attribute_id AS c, label_value FROM attribute_observation WHERE label_value IS NOT NULL) GROUP BY ALL")
def h23_zero_like(t) -> DataFrame:
    a = t("attribute_observation").where(F.col("label_value").isNotNull())
    return a.groupBy(F.col("attribute_id").alias("c"), F.when(T.zero_like(F.col("label_value")), "zero_like").otherwise("other").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT raw_text_value, regexp_replace(raw_text_value, '(\\s|,|%|퍼센트|pct|bps|bp|원|달러|엔|유로)', '', 'g') AS literal, count(*) AS n FROM metric_observation WHERE raw_text_value IS NOT NULL GROUP BY ALL")
def h21_loose_literal(t) -> DataFrame:
    m = t("metric_observation").where(F.col("raw_text_value").isNotNull())
    return m.groupBy("raw_text_value", T.loose_literal(F.col("raw_text_value")).alias("literal")).agg(F.count(F.lit(1)).alias("n"))


# HMAC written out: the key padded to 64 bytes, xored with 0x36 and 0x5c
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in b"bench-salt".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@register(f"SELECT metric_id, 'fd_' || left(sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode('fd') || '\\x00'::BLOB || encode(metric_id)))), 32) AS ref, true AS well_formed FROM metric_catalog")
def h17_h18_opaque_references(t) -> DataFrame:
    """Opaque references of metrics and whether they are well formed."""
    from graindeck.functions.references import is_reference, reference

    m = t("metric_catalog").select("metric_id")
    return m.select("metric_id", reference("fd", F.col("metric_id"), "bench-salt").alias("ref")).withColumn("well_formed", is_reference(F.col("ref"), "fd"))


@register("SELECT sha256(string_agg(metric_id || '|' || dimension || '|' || common_unit, ';' ORDER BY metric_id)) AS digest FROM metric_catalog")
def h19_h20_content_digest(t) -> DataFrame:
    from graindeck.functions.references import content_digest

    return t("metric_catalog").agg(content_digest(F.concat_ws("|", "metric_id", "dimension", "common_unit")).alias("digest"))


@register("SELECT subject_key, url_encode(subject_key) AS node FROM subject")
def h22_quoted_node(t) -> DataFrame:
    return t("subject").select("subject_key", F.url_encode("subject_key").alias("node"))


@register()
def h25_seeded_order(t) -> DataFrame:
    """A seeded permutation of the catalog: order by a keyed hash, ties by id."""
    from graindeck.functions.references import seeded_key

    return t("metric_catalog").select("metric_id", seeded_key(F.col("metric_id"), 17).alias("order_key"))
