"""Queries of candidate retrieval, the span compiler and offline evaluation (groups I, K, M)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graindeck.functions import records as Rec
from graindeck.functions import spans as K
from graindeck.functions import text as T
from graindeck.operators import evaluate as E
from graindeck.operators import retrieve as R
from graindeck.plans.registry import Register

register = Register()
QUERIES, ORACLES = register.queries, register.oracles


def _terms(t) -> DataFrame:
    """Parts as a vocabulary: the name is a label, its words are aliases, the type a definition."""
    return t("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("semantic_id"), F.array("p_name").alias("labels"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("definition"))


_FORMS = "SELECT DISTINCT 'p' || p_partkey AS semantic_id, role, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS text FROM (SELECT p_partkey, 'id' AS role, 'p' || p_partkey AS x FROM part UNION ALL SELECT p_partkey, 'label', p_name FROM part UNION ALL SELECT p_partkey, 'alias', p_brand FROM part UNION ALL SELECT p_partkey, 'definition', p_type FROM part) WHERE trim(x) <> ''"
_NORMAL = "lower(regexp_replace({}, '[\\s_]+', '', 'g'))"


@register(f"SELECT sha256(semantic_id || chr(1) || role || chr(1) || text) AS form_id, semantic_id, role, text, {_NORMAL.format('text')} AS normal FROM ({_FORMS})")
def i1_form_explosion(t) -> DataFrame:
    return R.surface_forms(_terms(t))


@register("SELECT role, tier FROM (VALUES ('label', ['exact', 'normalized', 'phrase', 'substring']), ('alias', ['exact', 'normalized', 'phrase', 'substring']), ('id', ['exact', 'normalized', 'phrase']), ('definition', ['exact', 'normalized', 'phrase'])) r(role, tiers), unnest(tiers) u(tier)")
def i2_role_contract(t) -> DataFrame:
    return t("region").sparkSession.createDataFrame([(r, x) for r, (tiers, _) in R.ROLES.items() for x in tiers], "role string, tier string")


def _questions(t) -> DataFrame:
    """Names of parts as questions, one per different name."""
    q = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("question_id"))
    return q.select("question_id", F.col("p_name").alias("question"), T.retrieval_normal(F.col("p_name")).alias("question_normal"))


def _word_forms(t) -> DataFrame:
    """Whole names and their words as forms of one vocabulary."""
    names = t("part").select(F.col("p_name").alias("text")).distinct().withColumn("role", F.lit("label"))
    words = t("part").select(F.explode(F.split("p_name", " ")).alias("text")).distinct().withColumn("role", F.lit("alias"))
    both = names.unionByName(words).where(F.col("text") != "")
    normal = T.retrieval_normal(F.col("text"))
    return both.select(F.concat("role", F.lit(":"), "text").alias("form_id"), F.concat(F.lit("t:"), F.lower("text")).alias("semantic_id"), "role", "text", normal.alias("normal"))


_Q = f"SELECT min(p_partkey) AS question_id, p_name AS question, {_NORMAL.format('p_name')} AS question_normal FROM part GROUP BY p_name"
_V = f"SELECT role || ':' || text AS form_id, 't:' || lower(text) AS semantic_id, role, text, {_NORMAL.format('text')} AS normal FROM (SELECT DISTINCT 'label' AS role, p_name AS text FROM part UNION SELECT DISTINCT 'alias', unnest(string_split(p_name, ' ')) FROM part) WHERE text <> ''"
_WHOLE = "CASE WHEN trim(question) = text THEN 'exact' WHEN question_normal = normal THEN 'normalized' WHEN contains(question_normal, normal) THEN 'phrase' END"
_CONTAINED = f"SELECT question_id, form_id, semantic_id, role, text, normal, question_normal, {_WHOLE} AS tier FROM ({_Q}) q, ({_V}) v WHERE trim(question) = text OR question_normal = normal OR contains(question_normal, normal)"
# the length of the longest fragment of a form, of six tenths of it at least, that stands in the question
_FRAGMENT = "list_max(list_filter(range(greatest(2, ceil(0.6 * length(normal))::BIGINT), length(normal)), lambda k: len(list_filter(range(1, length(normal) - k + 2), lambda i: contains(question_normal, substr(normal, i, k)))) > 0))"
_TIER = f"SELECT *, CASE WHEN tier = 'substring' THEN fragment / length(normal) ELSE 1.0 END AS score FROM (SELECT *, coalesce({_WHOLE}, CASE WHEN fragment IS NOT NULL THEN 'substring' END) AS tier FROM (SELECT *, CASE WHEN NOT contains(question_normal, normal) THEN {_FRAGMENT} END AS fragment FROM ({_Q}) q, ({_V}) v)) WHERE tier IS NOT NULL"


def _matched(t) -> DataFrame:
    """All four tiers."""
    return R.match_pairs(R.candidate_pairs(_questions(t), _word_forms(t)))


def _contained(t) -> DataFrame:
    """Forms that stand in the question whole, which is all that the probe and the ledger scan for."""
    return _matched(t).where(F.col("tier") != "substring")


@register(f"SELECT question_id, form_id, tier FROM ({_TIER})")
def i3_tiers(t) -> DataFrame:
    """Tiers of every question against the vocabulary, fragments too."""
    return _matched(t).select("question_id", "form_id", "tier")


# a phrase is shadowed if each of its places lies within a place of a longer form that the question grounds
_PLACES = "SELECT question_id, form_id, tier, length(normal) AS n, unnest(list_filter(range(1, length(question_normal) - length(normal) + 2), lambda i: substr(question_normal, i, length(normal)) = normal)) AS spot FROM t WHERE tier <> 'substring'"
_SHADOWED = f"""WITH t AS ({{}}), p AS ({_PLACES}), s AS (SELECT a.question_id, a.form_id FROM (SELECT DISTINCT question_id, form_id, n, spot FROM p WHERE tier = 'phrase') a LEFT JOIN p b ON b.question_id = a.question_id AND b.n > a.n AND b.spot <= a.spot AND a.spot + a.n <= b.spot + b.n GROUP BY 1, 2, a.spot HAVING count(b.form_id) = 0)
 SELECT t.question_id, t.form_id, CASE WHEN t.tier = 'phrase' AND NOT EXISTS (SELECT 1 FROM s WHERE s.question_id = t.question_id AND s.form_id = t.form_id) THEN 'substring' ELSE t.tier END AS tier FROM t"""


@register(_SHADOWED.format(_TIER))
def i4_shadowed(t) -> DataFrame:
    """Names as questions hold their words inside the whole name, so each of these phrases is shadowed by it."""
    return R.downgrade_shadowed(_matched(t)).select("question_id", "form_id", "tier")


_LINES = "SELECT p_partkey AS question_id, p_name || ' and ' || string_split(p_name, ' ')[1] AS question FROM part"
_PLANTED = f"SELECT question_id, form_id, semantic_id, role, text, normal, question_normal, {_WHOLE} AS tier FROM (SELECT question_id, question, {_NORMAL.format('question')} AS question_normal FROM ({_LINES})) q, ({_V}) v WHERE contains(question_normal, normal)"


@register(_SHADOWED.format(_PLANTED) + " WHERE t.tier <> 'substring'")
def i4_shadowed_or_free(t) -> DataFrame:
    """A name and its first word again: that word also stands free of the name and stays a phrase, the others are shadowed. Tiers go by the wording, so
    they are found once for a name and given to all parts that bear it."""
    name = F.col("p_name")
    q = t("part").where(name.isNotNull()).select(name.alias("question_id"), F.concat(name, F.lit(" and "), F.split(name, " ")[0]).alias("question")).distinct()
    q = q.withColumn("question_normal", T.retrieval_normal(F.col("question")))
    m = R.match_pairs(R.candidate_pairs(q, _word_forms(t), fragments=False)).where(F.col("tier") != "substring")
    found = R.downgrade_shadowed(m).select(F.col("question_id").alias("p_name"), "form_id", "tier")
    return t("part").select(F.col("p_partkey").alias("question_id"), "p_name").join(found.hint("merge"), "p_name").drop("p_name")


@register(f"SELECT question_id, semantic_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY k, -score, -length(normal), form_id) AS place FROM (SELECT *, CASE tier WHEN 'exact' THEN 1 WHEN 'normalized' THEN 2 WHEN 'phrase' THEN 3 ELSE 4 END AS k FROM ({_TIER})) "
          "QUALIFY row_number() OVER (PARTITION BY question_id, semantic_id ORDER BY k, -score, -length(normal), form_id) = 1) WHERE place IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY place) <= 50")
def i5_best_per_term(t) -> DataFrame:
    return R.best_per_term(_matched(t)).select("question_id", "semantic_id", "tier")


_QV = "SELECT e.vec_id, e.label, q.vec_id AS query_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE e.vec_id <> q.vec_id"


def _scores(t, threshold: float) -> DataFrame:
    e = t("embeddings").select("vec_id", "label", "embedding")
    # scores are rounded to five digits after the search: what rounds up to the threshold is searched too
    s = R.search_blocks(e, e.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", threshold - 1e-5).where((F.col("vec_id") != F.col("query_id")) & (F.col("score") >= threshold))
    return s.join(e.select("vec_id", "label"), "vec_id")


@register(f"SELECT query_id, semantic_id, entry, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, semantic_id) AS rank FROM (SELECT query_id, label AS semantic_id, arg_min(vec_id, (-score, vec_id)) AS entry, max(score) AS score FROM ({_QV}) WHERE score >= 0.05 GROUP BY ALL)) WHERE rank <= 5")
def i6_embedding_search(t) -> DataFrame:
    s = _scores(t, 0.05).select("query_id", F.col("label").alias("semantic_id"), F.col("vec_id").alias("entry"), "score")
    return R.embedding_candidates(s, R.Settings(threshold=0.05, top_k=5))


_M = ("SELECT coalesce(r.question_id, v.question_id) AS question_id, coalesce(r.semantic_id, v.semantic_id) AS semantic_id, r.tier IS NOT NULL AS groundable, r.rank AS rule_rank, v.score AS similarity, v.rank AS vector_rank FROM (SELECT n_nationkey AS question_id, n_regionkey AS semantic_id, 'exact' AS tier, 1 AS rank FROM nation WHERE n_nationkey % 3 <> 0) r "
      "FULL JOIN (SELECT n_nationkey AS question_id, r_regionkey AS semantic_id, round(1.0 / (1 + abs(n_regionkey - r_regionkey)), 6) AS score, row_number() OVER (PARTITION BY n_nationkey ORDER BY abs(n_regionkey - r_regionkey), r_regionkey) AS rank FROM nation, region) v ON r.question_id = v.question_id AND r.semantic_id = v.semantic_id")


def _merged(t) -> DataFrame:
    n, r = t("nation"), t("region")
    rule = n.where(F.col("n_nationkey") % 3 != 0).select(F.col("n_nationkey").alias("question_id"), F.col("n_regionkey").alias("semantic_id"), F.lit("exact").alias("tier"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    v = n.join(F.broadcast(r), F.lit(True)).select(F.col("n_nationkey").alias("question_id"), F.col("r_regionkey").alias("semantic_id"), F.round(1.0 / (1 + F.abs(F.col("n_regionkey") - F.col("r_regionkey"))), 6).alias("score"))  # five regions
    v = v.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "semantic_id")))
    return R.merge_paths(rule, v)


@register(f"SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY groundable DESC, rule_rank ASC NULLS LAST, similarity DESC NULLS LAST, semantic_id) AS position FROM ({_M})")
def i7_merge_paths(t) -> DataFrame:
    return _merged(t).select("question_id", "semantic_id", "groundable", "rule_rank", "similarity", "vector_rank", "position")


@register("SELECT n_nationkey AS question_id, n_regionkey AS semantic_id, 'unavailable' AS vector_path, NULL::DOUBLE AS similarity, 1 AS position FROM nation WHERE n_nationkey % 3 <> 0")
def i10_path_isolation(t) -> DataFrame:
    """The rule path alone, the vector path not being there: its results stay and say so."""
    n = t("nation").where(F.col("n_nationkey") % 3 != 0)
    rule = n.select(F.col("n_nationkey").alias("question_id"), F.col("n_regionkey").alias("semantic_id"), F.lit("exact").alias("tier"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    return R.merge_paths(rule, None).select("question_id", "semantic_id", "vector_path", "similarity", "position")


@register("SELECT 1 AS question_id, lower(regexp_replace(p_brand, '[\\s_]+', '', 'g')) AS normal, arg_min(p_brand, (length(p_brand), p_brand)) AS display, list_sort(list(DISTINCT 'p' || p_partkey)) AS ids FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1")
def i8_ambiguity(t) -> DataFrame:
    """Brands that name several parts."""
    m = t("part").select(F.lit(1).alias("question_id"), F.col("p_brand").alias("text"), T.retrieval_normal(F.col("p_brand")).alias("normal"), F.lit("exact").alias("tier"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("semantic_id"))
    return R.ambiguities(m)


@register("SELECT n_nationkey AS question_id, CASE WHEN n_nationkey % 3 = 0 THEN 'unresolved' WHEN n_nationkey % 5 = 1 THEN 'ambiguous' ELSE 'candidates' END AS status, 5 AS n_candidates FROM nation")
def i9_status(t) -> DataFrame:
    q = t("nation").select(F.col("n_nationkey").alias("question_id"))
    return R.question_status(q, _merged(t), q.where(F.col("question_id") % 5 == 1))


@register("SELECT 'missing_forms' AS problem, count(*) AS n FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'other_registry', 1")
def i11_i13_index_usable(t) -> DataFrame:
    """An index that lacks every fourth form and was built from another registry."""
    forms = t("part").select(F.col("p_partkey").cast("string").alias("form_id"), F.lit("label").alias("role"))
    index = t("part").where(F.col("p_partkey") % 4 != 0).select(F.col("p_partkey").cast("string").alias("form_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    return R.index_usable(forms, index, "registry-a", "registry-b")


@register("SELECT 'missing_forms' AS problem, count(*) FILTER (WHERE vec_id % 10 = 3) AS n FROM embeddings UNION ALL SELECT 'unknown_forms', count(*) FILTER (WHERE vec_id % 10 = 7) FROM embeddings UNION ALL SELECT 'unequal_widths', 1 UNION ALL SELECT 'other_provider', 1")
def i11_i13_vectors_usable(t) -> DataFrame:
    """The table's vectors as an index of a vocabulary: every tenth form has none, every tenth vector no form, one vector is short, and another model made them."""
    e = t("embeddings").select(F.col("vec_id").cast("string").alias("form_id"), (F.col("vec_id") % 10).alias("r"), F.when(F.col("vec_id") == 0, F.slice("embedding", 1, 2)).otherwise(F.col("embedding")).alias("vector"))
    forms = e.where(F.col("r") != 7).select("form_id", F.lit("label").alias("role"))
    return R.index_usable(forms, e.where(F.col("r") != 3).select("form_id", "vector"), "registry", "registry", "model-b/1", "model-a/1")


@register("SELECT * FROM (VALUES ('min_substring_chars', '2', 'default; tune with the sweep of evaluate.py'), ('substring_ratio', '0.6', 'default; tune with the sweep of evaluate.py'), ('max_candidates', '10', 'set by hand'), ('threshold', '0.2', 'recall of m1_cross_form_sweep'), ('top_k', '20', 'default; tune with the sweep of evaluate.py')) v(name, value, basis)")
def i16_settings(t) -> DataFrame:
    s = R.Settings(max_candidates=10, threshold=0.2, bases=(("threshold", "recall of m1_cross_form_sweep"),))
    return t("region").sparkSession.createDataFrame(s.recorded(), "name string, value string, basis string")


# names that several parts share, and a question that names nothing
_NQ = f"SELECT min(p_partkey) AS question_id, p_name AS question, {_NORMAL.format('p_name')} AS question_normal FROM part GROUP BY p_name UNION ALL SELECT -1, 'zzz', 'zzz'"
_NV = f"SELECT DISTINCT 'p' || p_partkey AS semantic_id, p_name AS text, {_NORMAL.format('p_name')} AS normal FROM part"
_NAMED = f"SELECT question_id, normal, arg_min(text, (length(text), text)) AS display, list_sort(list(DISTINCT semantic_id)) AS ids FROM ({_NQ}) q, ({_NV}) v WHERE contains(question_normal, normal) GROUP BY question_id, normal"


def _named(t) -> tuple[DataFrame, DataFrame]:
    p = t("part").where(F.col("p_name").isNotNull())
    q = p.groupBy(F.col("p_name").alias("question")).agg(F.min("p_partkey").cast("bigint").alias("question_id")).unionByName(p.sparkSession.createDataFrame([(-1, "zzz")], "question_id bigint, question string"))
    q = q.withColumn("question_normal", T.retrieval_normal(F.col("question")))
    f = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("semantic_id"), F.lit("label").alias("role"), F.col("p_name").alias("text"), T.retrieval_normal(F.col("p_name")).alias("normal"))
    # one form per different text, so that a name many parts share meets a question once
    once = f.select("role", "text", "normal").distinct().withColumn("form_id", F.col("text"))
    m = R.match_pairs(R.candidate_pairs(q, once)).where(F.col("tier") != "substring")
    return q, m.join(f.select("semantic_id", "text"), "text")


@register(f"SELECT * FROM ({_NAMED}) WHERE len(ids) > 1")
def i8_ambiguous_names(t) -> DataFrame:
    return R.ambiguities(_named(t)[1])


@register(f"SELECT q.question_id, CASE WHEN count(n.normal) = 0 THEN 'unresolved' WHEN max(len(ids)) > 1 THEN 'ambiguous' ELSE 'candidates' END AS status, coalesce(sum(len(ids)), 0)::BIGINT AS n_candidates FROM ({_NQ}) q LEFT JOIN ({_NAMED}) n USING (question_id) GROUP BY 1")
def i9_question_status(t) -> DataFrame:
    q, m = _named(t)
    return R.question_status(q, m.withColumn("groundable", F.lit(True)), R.ambiguities(m))


@register("SELECT e.vec_id, q.vec_id AS query_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY rank <= 10")
def i14_inner_product_topk(t) -> DataFrame:
    e = t("embeddings").select("vec_id", "embedding")
    return R.search_blocks(e, e.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", top_k=10)


@register(f"SELECT question_id, semantic_id, max(length(normal)) AS longest, count(*) AS matches FROM ({_CONTAINED}) GROUP BY ALL")
def i17_lexical_probe(t) -> DataFrame:
    return _contained(t).groupBy("question_id", "semantic_id").agg(F.max(F.length("normal")).alias("longest"), F.count(F.lit(1)).alias("matches"))


@register("SELECT DISTINCT x AS term FROM (SELECT 'n' || n_nationkey AS x FROM nation UNION ALL SELECT 'r' || n_regionkey FROM nation)")
def i18_ownership_closure(t) -> DataFrame:
    n = t("nation")
    own = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("term"))
    return own.unionByName(n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("term"))).distinct()


@register("SELECT family_id, list_sort(list(metric_id) FILTER (WHERE ok)) AS supported, list_sort(list(metric_id) FILTER (WHERE NOT ok)) AS unsupported FROM (SELECT family_id, metric_id, avg((value_status = 'valid')::INT) >= 0.9 AS ok FROM metric_observation GROUP BY ALL) GROUP BY 1")
def i19_capability_partition(t) -> DataFrame:
    m = t("metric_observation").groupBy("family_id", "metric_id").agg((F.avg((F.col("value_status") == "valid").cast("int")) >= 0.9).alias("ok"))
    lists = [F.sort_array(F.collect_list(F.when(c, F.col("metric_id")))) for c in (F.col("ok"), ~F.col("ok"))]  # at most one entry per catalog metric
    none = lambda c: F.when(F.size(c) > 0, c)
    return m.groupBy("family_id").agg(none(lists[0]).alias("supported"), none(lists[1]).alias("unsupported"))


# ---- K: spans. The same texts on both sides.

SPANS = ["높은 순", "가장 낮은", "상위 또는 하위", "높지 않은", "상위험", "desc", "이상", "이하인", "< 또는 <=", ">= ", "보다 큰", "not above", "아닌", "평균", "가중 평균", "총합", "최대", "몇 개", "평균이 아니",
         "상위 10개", "top 5", "2024", "2024개", "10%", "3개월", "10 이상", "1,00개", "5.5개", "-3개", "0개", "3천개", "ETF 200", "열 개", "3%", "1,234.5%", "1조 5000억", "2억개", "7일", "약 3%", "12,34"]


def _rx(s: str) -> str:
    return s.replace("'", "''")


def _values(t) -> DataFrame:
    return t("region").sparkSession.createDataFrame([(i, s.lower().strip()) for i, s in enumerate(SPANS)], "span_id bigint, text string")


_SPAN_ROWS = "(VALUES " + ", ".join(f"({i}, '{s.lower().strip()}')" for i, s in enumerate(SPANS)) + ") s(span_id, text)"
_MEAN = "list_filter([{}], lambda x: x IS NOT NULL)"


def _meaning_sql(table: dict[str, list[str]]) -> str:
    said = f"regexp_extract_all(text, '({_rx(K.alternatives(K._words(table) + K.CONNECTIVES))})', 1)"
    return _MEAN.format(", ".join(f"CASE WHEN list_has_any({said}, [{', '.join(repr(f) for f in forms)}]) THEN '{m}' END" for m, forms in table.items()))


def _negated_sql(table: dict[str, list[str]] | None, comparison: bool = False) -> str:
    marks = K.NEGATIONS + ([] if comparison else K.NEGATIONS_OUTSIDE_COMPARISON)
    parts = ["|".join(marks), f"(?:^|[^0-9a-z])(?:{'|'.join(K.NEGATIONS_ASCII)})(?:[^0-9a-z]|$)"] + ([f"안\\s*(?:{K.alternatives(K._words(table))})"] if table else [])
    return f"regexp_matches(text, '{_rx('|'.join(f'(?:{p})' for p in parts))}')"


def _read_sql(table: dict[str, list[str]], name: str, before: str = "", comparison: bool = False) -> str:
    cover = f"regexp_matches(text, '^(?: *(?:{_rx(K.alternatives(K._words(table) + K.CONNECTIVES))}))+ *$')"
    refusal = f"CASE {before} WHEN {_negated_sql(table, comparison)} THEN 'negated_expression_unsupported' WHEN NOT {cover} OR len(m) = 0 THEN '{name}_unsupported' WHEN len(m) > 1 THEN '{name}_ambiguous' END"
    return f"SELECT span_id, CASE WHEN refusal IS NULL THEN m[1] END AS value, refusal FROM (SELECT *, {refusal} AS refusal FROM (SELECT *, {_meaning_sql(table)} AS m FROM {_SPAN_ROWS}))"


def _read(t, struct) -> DataFrame:
    return _values(t).select("span_id", struct.alias("r")).select("span_id", "r.value", "r.refusal")


@register(f"SELECT span_id, regexp_matches(text, '^(?: *(?:{_rx(K.alternatives(K._words(K.DIRECTIONS) + K.CONNECTIVES))}))+ *$') AS covered FROM {_SPAN_ROWS}")
def k1_full_cover(t) -> DataFrame:
    return _values(t).select("span_id", K.covered(F.col("text"), K.DIRECTIONS).alias("covered"))


@register(_read_sql(K.DIRECTIONS, "direction"))
def k2_direction(t) -> DataFrame:
    return _read(t, K.read_direction(F.col("text")))


@register(_read_sql(K.COMPARISONS, "comparison", comparison=True))
def k3_comparison(t) -> DataFrame:
    return _read(t, K.read_comparison(F.col("text")))


@register(_read_sql(K.AGGREGATES, "aggregation_function", f"WHEN regexp_matches(text, '{'|'.join(K.AGGREGATE_MODIFIERS)}') THEN 'aggregation_function_unsupported'"))
def k4_aggregate(t) -> DataFrame:
    return _read(t, K.read_aggregate(F.col("text")))


_NUMS = f"regexp_extract_all(text, '({K.NUMBER})', 1)"
_BAD = f"len(list_filter(regexp_split_to_array(text, '[^0-9,.]+'), lambda r: regexp_matches(r, '[0-9]') AND NOT regexp_matches(r, '^{K.NUMBER}$'))) > 0"


def _peeled_sql(lead: list[str]) -> str:
    """Sign, number, magnitude and rest of each span, taken off one after the other."""
    first = "CASE " + " ".join(f"WHEN starts_with(text, '{w}') THEN '{w}'" for w in sorted(lead, key=len, reverse=True)) + " ELSE '' END" if lead else "''"
    signs = ", ".join(f"'{m}'" for m in K.MAGNITUDES)
    return (f"SELECT *, ltrim(substr(text, length({first}) + 1)) AS b1, CASE WHEN left(b1, 1) IN ('-', '+') THEN left(b1, 1) ELSE '' END AS sign, ltrim(substr(b1, length(sign) + 1)) AS b2, regexp_extract(b2, '^{K.NUMBER}') AS written, replace(written, ',', '') AS number, "
            f"ltrim(substr(b2, length(written) + 1)) AS b3, CASE WHEN left(b3, 1) IN ({signs}) THEN left(b3, 1) ELSE '' END AS magnitude, trim(substr(b3, length(magnitude) + 1)) AS rest FROM {_SPAN_ROWS}")


_W = "TRY_CAST(number AS DECIMAL(38,9))"


@register(f"SELECT span_id, CASE WHEN refusal IS NULL THEN CAST({_W} AS BIGINT) END AS value, refusal FROM (SELECT *, CASE WHEN {_negated_sql(None)} THEN 'negated_expression_unsupported' WHEN regexp_matches(text, '%|퍼센트') THEN 'limit_is_proportion' WHEN regexp_matches(text, '{_rx(K.alternatives(K.LIMIT_PERIODS))}') THEN 'limit_unsupported' "
          f"WHEN regexp_matches(text, '{_rx(K.alternatives(K.LIMIT_RANGES))}') THEN 'limit_unsupported' WHEN {_BAD} THEN 'limit_unsupported' WHEN len({_NUMS}) = 0 THEN 'limit_unsupported' WHEN len({_NUMS}) > 1 THEN 'limit_ambiguous' WHEN number = '' OR rest NOT IN ('', {', '.join(repr(c) for c in K.LIMIT_COUNTERS)}) THEN 'limit_unsupported' "
          f"WHEN sign <> '' THEN 'limit_not_positive' WHEN magnitude <> '' THEN 'limit_unsupported' WHEN rest = '' AND regexp_matches(number, '^[0-9]{{4}}$') THEN 'limit_unsupported' "
          f"WHEN {_W} IS NULL OR {_W} <> floor({_W}) OR {_W} <= 0 THEN 'limit_not_positive' END AS refusal FROM ({_peeled_sql(K.LIMIT_PREFIXES)}))")
def k5_limit(t) -> DataFrame:
    return _read(t, K.read_limit(F.col("text")))


_ALLM = ", ".join(repr(m) for ms in K.UNIT_MARKERS.values() for m in ms)
_SIZES = " ".join(f"WHEN '{m}' THEN {n}" for m, n in K.MAGNITUDES.items())


@register(f"SELECT span_id, CASE WHEN refusal IS NULL THEN round((CASE sign WHEN '-' THEN -1 ELSE 1 END) * CAST(number AS DOUBLE) * (CASE magnitude {_SIZES} ELSE 1 END), 6) END AS value, refusal "
          f"FROM (SELECT *, CASE WHEN {_negated_sql(None)} THEN 'negated_expression_unsupported' WHEN {_BAD} THEN 'value_unsupported' WHEN len({_NUMS}) <> 1 THEN 'value_unsupported' WHEN number = '' THEN 'value_unsupported' "
          f"WHEN rest <> '' AND rest IN ({_ALLM}) AND rest NOT IN ('%', '퍼센트') THEN 'value_unit_mismatch' WHEN rest <> '' AND rest NOT IN ({_ALLM}) THEN 'value_unsupported' END AS refusal FROM ({_peeled_sql([])}))")
def k6_typed_value(t) -> DataFrame:
    """Spans as values of a field in percent."""
    r = _read(t, K.read_value(F.col("text"), F.lit("percent_observed")))
    return r.withColumn("value", F.round(F.col("value").cast("double"), 6))


@register(f"SELECT span_id, {_negated_sql(K.DIRECTIONS)} AS negated FROM {_SPAN_ROWS}")
def k7_negation(t) -> DataFrame:
    return _values(t).select("span_id", K.negated(F.col("text"), K.DIRECTIONS).alias("negated"))


@register(f"SELECT span_id, {_BAD} AS malformed FROM {_SPAN_ROWS}")
def k8_malformed_number(t) -> DataFrame:
    return _values(t).select("span_id", K.malformed_number(F.col("text")).alias("malformed"))


@register(f"SELECT a.span_id, d.value AS direction, l.value AS row_limit FROM {_SPAN_ROWS.replace('s(span_id', 'a(span_id')} JOIN ({_read_sql(K.DIRECTIONS, 'direction')}) d USING (span_id) JOIN ({ORACLES['k5_limit']}) l USING (span_id) WHERE d.refusal IS NULL OR l.refusal IS NULL")
def k9_requirement(t) -> DataFrame:
    """Each slot of a requirement is read or refused by itself."""
    c = F.col("text")
    r = _values(t).select("span_id", K.read_direction(c).alias("d"), K.read_limit(c).alias("l"))
    return r.where(F.col("d.refusal").isNull() | F.col("l.refusal").isNull()).select("span_id", F.col("d.value").alias("direction"), F.col("l.value").alias("row_limit"))


LINES = ["REQ|id=r1|kind=order|span=높은 순", "COND|id=r1|op=gte|value=3%", "BAD|x", "REQ|id=r2|id=r3", "|a=b", "END"]
_LINE_ROWS = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(LINES)) + ") s(line_id, line)"
_PARTS = "list_transform(string_split(line, '|')[2:], lambda p: trim(string_split(p, '=')[1]))"


@register(f"SELECT line_id, trim(string_split(line, '|')[1]) AS token, CASE WHEN trim(string_split(line, '|')[1]) = '' THEN 'empty_token' WHEN len(list_filter(string_split(line, '|')[2:], lambda p: NOT contains(p, '='))) > 0 THEN 'missing_value' WHEN len(list_distinct({_PARTS})) < len({_PARTS}) THEN 'duplicate_key' END AS problem FROM {_LINE_ROWS}")
def k11_record_parse(t) -> DataFrame:
    df = t("region").sparkSession.createDataFrame(list(enumerate(LINES)), "line_id bigint, line string")
    return df.select("line_id", Rec.parse_line(F.col("line")).alias("p")).select("line_id", "p.token", "p.problem")


@register("SELECT * FROM (VALUES (1, 1, 'REQ', NULL), (1, 2, 'COND', NULL), (1, 3, 'BAD', 'missing_value'), (1, 4, 'REQ', 'duplicate_key'), (1, 5, '', 'empty_token'), (1, 6, 'END', NULL), (2, 1, 'REQ', NULL), (2, 2, 'END', 'end_before_last_line'), (2, 3, 'REQ', 'no_end')) v(request_id, line_no, token, problem)")
def k12_multi_line_records(t) -> DataFrame:
    df = t("region").sparkSession.createDataFrame([(1, "\n".join(LINES)), (2, "REQ|id=a\nEND\nREQ|id=b")], "request_id bigint, body string")
    return Rec.parse_records(df, "request_id", "body").select("request_id", "line_no", "token", "problem")


@register("WITH f AS (SELECT l_orderkey AS request, l_linenumber AS requirement, l_returnflag AS slot, l_linestatus AS value FROM lineitem), p AS (SELECT request, requirement, slot, count(*) AS n, min(value) <> max(value) AS c FROM f GROUP BY ALL), g AS (SELECT request, requirement, max(CASE WHEN c THEN 2 WHEN n > 1 THEN 1 ELSE 0 END) AS w FROM p GROUP BY ALL), k AS (SELECT DISTINCT o_orderkey AS request, 1 AS requirement FROM orders) "
          "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN k.request IS NULL THEN 'orphan' WHEN w = 2 THEN 'conflict' WHEN w = 1 THEN 'duplicate' WHEN w IS NULL THEN 'empty_requirement' ELSE 'ok' END AS problem FROM g FULL JOIN k ON g.request = k.request AND g.requirement = k.requirement) GROUP BY 1")
def k13_grouped_flat(t) -> DataFrame:
    """Line items as flat records of requirements (order, line number)."""
    rows = t("lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("requirement"), F.col("l_returnflag").alias("slot"), F.col("l_linestatus").alias("value"))
    known = t("orders").select(F.col("o_orderkey").alias("request"), F.lit(1).alias("requirement"))
    return Rec.assemble(rows, known, "request", "requirement").groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p_partkey, 'PART|brand=' || p_brand || '|size=' || p_size AS line FROM part")
def k14_render(t) -> DataFrame:
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return t("part").select("p_partkey", Rec.render_line(F.lit("PART"), m).alias("line"))


@register("SELECT request_id, direction, problem FROM (VALUES (1, 'forward', NULL), (2, 'inverse', NULL), (3, NULL, 'anchor_not_an_end'), (4, 'forward', NULL)) v(request_id, direction, problem)")
def k17_relation_direction(t) -> DataFrame:
    spark = t("region").sparkSession
    rel = spark.createDataFrame([("holds", "product", "security")], "relation string, domain string, range string")
    up = spark.createDataFrame([("etf", "product"), ("fund", "product"), ("share", "security")], "node string, ancestor string")
    req = spark.createDataFrame([(1, "holds", "etf"), (2, "holds", "share"), (3, "holds", "issuer"), (4, "holds", "product")], "request_id bigint, relation string, anchor_class string")
    return Rec.relation_direction(rel, up, req)


@register("SELECT source_id, CASE WHEN hash_matches THEN NULL ELSE 'A source could not be verified.' END AS reason FROM data_source")
def k18_k19_safe_reasons(t) -> DataFrame:
    code = F.when(~F.col("hash_matches"), F.lit("source_not_verified"))
    return t("data_source").select("source_id", Rec.safe_reason(code).alias("reason"))


@register("""SELECT source_id, '{"status":"' || CASE WHEN hash_matches THEN 'ok' ELSE 'refused' END || '","answer":"' || CASE WHEN hash_matches THEN source_kind ELSE 'no_data' END || '","evidence":"","as_of":"' || substr(collected_at, 1, 10) || '","note":""}' AS body FROM data_source""")
def k20_envelope(t) -> DataFrame:
    ok = F.col("hash_matches")
    return t("data_source").select("source_id", Rec.envelope(F.when(ok, "ok"), F.when(ok, F.col("source_kind")), F.lit(None).cast("string"), F.substring("collected_at", 1, 10), F.lit(None).cast("string")).alias("body"))


# ---- M: evaluation


_BEST = f"SELECT query_id, label, max(score) AS score FROM ({_QV}) GROUP BY ALL"


@register(f"WITH q AS (SELECT vec_id AS query_id, label AS own FROM embeddings WHERE vec_id % 50 = 0), b AS (SELECT s.*, q.own, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM ({_BEST}) s JOIN q USING (query_id)), g AS (SELECT t AS threshold, k AS top_k FROM unnest([0.0, 0.1, 0.2]) a(t), unnest([1, 5]) b(k)) "
          "SELECT threshold, top_k, round(coalesce(sum(hit), 0) / (SELECT count(*) FROM q), 6) AS recall, round(coalesce(sum(rr), 0) / (SELECT count(*) FROM q), 6) AS mrr, round(coalesce(sum(n), 0) / (SELECT count(*) FROM q), 6) AS mean_candidates, round(coalesce(sum(o), 0) / (SELECT count(*) FROM q), 6) AS mean_competing FROM g LEFT JOIN (SELECT threshold AS t, top_k AS k, query_id, max((label = own)::INT) AS hit, max(CASE WHEN label = own THEN 1.0 / rank END) AS rr, count(*) AS n, count(*) FILTER (WHERE label <> own) AS o FROM g, b WHERE score >= threshold AND rank <= top_k GROUP BY ALL) p ON p.t = g.threshold AND p.k = g.top_k GROUP BY ALL")
def m1_cross_form_sweep(t) -> DataFrame:
    own = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    s = _scores(t, 0.0).join(own, "query_id").select("query_id", "query_label", F.col("label").alias("semantic_id"), "score")
    return E.cross_form_sweep(s, [0.0, 0.1, 0.2], [1, 5])


def _returned(t) -> DataFrame:
    s = t("events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("id"), "value").groupBy("case_id", "id").agg(F.max("value").alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("score").desc(), "id")))


_RET = "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS rank FROM (SELECT user_id AS case_id, event_type AS id, max(value) AS score FROM events GROUP BY ALL)"
_REQ = "SELECT user_id AS case_id, arg_min(event_type, event_id) AS id FROM events GROUP BY user_id"


def _required(t) -> DataFrame:
    return t("events").groupBy(F.col("user_id").alias("case_id")).agg(F.min_by("event_type", "event_id").alias("id"))


@register(f"SELECT count(*) AS n_cases, count(*) FILTER (WHERE n = h) AS n_complete, round(sum(h) / sum(n), 6) AS micro_recall, round(avg(h / n), 6) AS macro_recall FROM (SELECT q.case_id, count(*)::DOUBLE AS n, count(r.id)::DOUBLE AS h FROM ({_REQ}) q LEFT JOIN (SELECT * FROM ({_RET}) WHERE rank <= 2) r ON q.case_id = r.case_id AND q.id = r.id GROUP BY 1)")
def m2_recall_at_k(t) -> DataFrame:
    return E.recall_at(_returned(t), _required(t), 2)


@register("SELECT p AS point, round(v, 6) AS threshold FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9, 0.95]) AS p, unnest((SELECT quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 0.9, 0.95]) FROM events)) AS v)")
def m4_quantile_thresholds(t) -> DataFrame:
    return E.quantile_thresholds(t("events"), "value")


@register(f"SELECT q.case_id, q.id, CASE WHEN score IS NULL THEN 'not_scored' WHEN score < 50 THEN 'threshold' WHEN rank > 2 THEN 'top_k' WHEN coalesce(rank + 1, 99) > 2 THEN 'merge' ELSE 'found' END AS reason FROM ({_REQ}) q LEFT JOIN ({_RET}) r ON q.case_id = r.case_id AND q.id = r.id")
def m5_miss_reason(t) -> DataFrame:
    return E.miss_reason(_returned(t).withColumn("merged_rank", F.col("rank") + 1), _required(t), 50, 2, 2)


@register(f"SELECT kind, count(*) AS n_required, sum(h) AS n_found, round(avg(h), 6) AS recall FROM (SELECT substr(q.id, 1, 1) AS kind, (r.id IS NOT NULL)::INT AS h FROM ({_REQ}) q LEFT JOIN (SELECT * FROM ({_RET}) WHERE rank <= 1) r ON q.case_id = r.case_id AND q.id = r.id) GROUP BY 1")
def m6_recall_by_kind(t) -> DataFrame:
    q = _required(t).withColumn("kind", F.substring("id", 1, 1)).withColumn("equivalents", F.lit(None).cast("array<string>"))
    return E.recall_by(_returned(t).where(F.col("rank") <= 1), q, "kind")


@register(f"SELECT category, count(*) AS n FROM (SELECT CASE WHEN q.id IS NOT NULL AND r.id IS NOT NULL THEN 'correct' WHEN q.id IS NOT NULL THEN 'missing' WHEN r.id LIKE 'c%' THEN 'confusable' ELSE 'irrelevant' END AS category FROM ({_REQ}) q FULL JOIN (SELECT * FROM ({_RET}) WHERE rank <= 2) r ON q.case_id = r.case_id AND q.id = r.id) GROUP BY 1")
def m7_confusion(t) -> DataFrame:
    r = _returned(t)
    return E.confusion(r.where(F.col("rank") <= 2), _required(t), r.where(F.col("id").startswith("c")))


@register(f"SELECT case_id, round(CASE WHEN nr > 0 THEN b::DOUBLE / nr ELSE 0 END, 6) AS precision, nr - b AS n_irrelevant, ne - b AS n_missing, ne = b AS complete FROM (SELECT q.case_id, 1 AS ne, count(r.id) AS nr, count(r.id) FILTER (WHERE r.id = q.id) AS b FROM ({_REQ}) q LEFT JOIN (SELECT * FROM ({_RET}) WHERE rank <= 2) r ON q.case_id = r.case_id GROUP BY ALL)")
def m8_case_precision(t) -> DataFrame:
    r = _returned(t).where(F.col("rank") <= 2).groupBy("case_id").agg(F.collect_set("id").alias("returned"))  # two at most
    return E.case_precision(_required(t).select("case_id", F.array("id").alias("expected")).join(r, "case_id", "left").withColumn("returned", F.coalesce("returned", F.array().cast("array<string>"))))


@register(f"SELECT round(avg(coalesce(k, 0)), 6) AS recall_by_kind, round(avg(coalesce(l, 0)), 6) AS recall_by_list FROM ({_REQ}) q LEFT JOIN (SELECT case_id, id, (row_number() OVER (PARTITION BY case_id, substr(id, 1, 1) ORDER BY rank) <= CASE substr(id, 1, 1) WHEN 'c' THEN 1 WHEN 'p' THEN 1 WHEN 'v' THEN 1 END)::INT AS k, (rank <= 3)::INT AS l FROM ({_RET})) r ON q.case_id = r.case_id AND q.id = r.id")
def m9_budget_sim(t) -> DataFrame:
    r = _returned(t).withColumn("kind", F.substring("id", 1, 1))
    return E.budget_simulation(r, _required(t), {"c": 1, "p": 1, "v": 1})


@register("SELECT run_id, round(sum(p) / sum(n), 6) AS pass_rate, count(*) FILTER (WHERE a) AS n_every, count(*) FILTER (WHERE s AND NOT a) AS n_unstable, count(*) FILTER (WHERE NOT s) AS n_none, round(sum(l) / sum(n), 4) AS mean_latency, max(m) AS max_latency FROM (SELECT event_type AS run_id, user_id, bool_and(value > 30) AS a, bool_or(value > 30) AS s, count(*) FILTER (WHERE value > 30)::DOUBLE AS p, count(*)::DOUBLE AS n, sum(value) AS l, max(value) AS m FROM events GROUP BY ALL) GROUP BY 1")
def m16_run_summary(t) -> DataFrame:
    return E.run_summary(t("events").select(F.col("event_type").alias("run_id"), F.col("user_id").alias("case_id"), (F.col("value") > 30).alias("passed"), F.col("value").alias("latency_ms")))


@register()
def m18_span_ledger(t) -> DataFrame:
    """Overlapping matches of words and whole names, resolved longest first."""
    m = _contained(t).select("question_id", "form_id", F.explode("starts").alias("start"), F.col("reach").cast("int").alias("length"))
    return E.span_ledger(m.withColumn("start", F.col("start").cast("int")))


@register()
def m19_plan_options(t) -> DataFrame:
    s = t("events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("slot"), F.floor(F.col("value") / 25).cast("string").alias("reading")).distinct()
    return E.plan_options(s)


@register("SELECT p_name, n_keys, CASE WHEN r > 1 THEN 'ambiguous' ELSE 'collapsed' END AS outcome, CASE WHEN r = 1 THEN least_key END AS chosen FROM (SELECT p_name, count(DISTINCT p_partkey) AS n_keys, count(DISTINCT (p_brand, p_size > 25)) AS r, min(p_partkey) AS least_key FROM part GROUP BY 1) WHERE n_keys > 1")
def m20_homonym(t) -> DataFrame:
    p = t("part").withColumn("large", F.col("p_size") > 25)
    return E.homonyms(p, "p_name", "p_partkey", ["p_brand", "large"])


@register("SELECT source_name, count(*) AS n_reports, count(DISTINCT (source_kind, hash_matches)) <= 1 AS comparable FROM data_source GROUP BY 1")
def m12_comparability(t) -> DataFrame:
    """The loads of every feed as its reports."""
    return E.comparable(t("data_source"), ["source_kind", "hash_matches"], ["source_name"])


@register("SELECT doc_id, length(text) AS n_chars, octet_length(encode(text)) AS n_bytes, (length(text) - o + ceil(o / 4.0))::BIGINT AS token_estimate FROM (SELECT *, length(regexp_replace(text, '[\\p{Hangul}\\p{Han}\\p{Hiragana}\\p{Katakana}]', '', 'g')) AS o FROM documents) WHERE text IS NOT NULL")
def m25_payload_size(t) -> DataFrame:
    d = t("documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), T.token_estimate(F.col("text")).alias("token_estimate"))



@register(f"SELECT t AS threshold, round(count(q.id)::DOUBLE / (SELECT count(*) FROM ({_REQ})), 6) AS recall, round(count(r.id)::DOUBLE / (SELECT count(DISTINCT user_id) FROM events), 6) AS mean_candidates, round((count(r.id) - count(q.id))::DOUBLE / (SELECT count(DISTINCT user_id) FROM events), 6) AS mean_competing, count(r.id) FILTER (WHERE r.case_id % 7 = 0) AS false_positives "
          f"FROM unnest([10.0, 50.0, 90.0]) g(t) LEFT JOIN ({_RET}) r ON r.score >= t LEFT JOIN ({_REQ}) q ON q.case_id = r.case_id AND q.id = r.id GROUP BY t")
def m3_threshold_sweep(t) -> DataFrame:
    q = _required(t)
    return E.threshold_sweep(_returned(t), q, q.where(F.col("case_id") % 7 == 0), [10.0, 50.0, 90.0])


@register("SELECT dimension, count(*) AS n_entities, count(*) FILTER (WHERE metric_id NOT IN (SELECT metric_id FROM metric_observation WHERE value_status = 'zero_excluded')) AS n_never_returned FROM metric_catalog GROUP BY 1")
def m10_entity_gaps(t) -> DataFrame:
    seen = t("metric_observation").where(F.col("value_status") == "zero_excluded").select(F.col("metric_id").alias("id"))
    return E.entity_gaps(t("metric_catalog").withColumnRenamed("metric_id", "id"), seen, "dimension")


@register(f"SELECT family, count(*) AS n_required, count(r.id) AS n_found, round(count(r.id)::DOUBLE / count(*), 6) AS recall FROM (SELECT *, unnest([substr(id, 1, 1), 'all']) AS family FROM ({_REQ})) q LEFT JOIN (SELECT * FROM ({_RET}) WHERE rank <= 1) r ON q.case_id = r.case_id AND q.id = r.id GROUP BY 1")
def m14_family_recall(t) -> DataFrame:
    q = _required(t).withColumn("families", F.array(F.substring("id", 1, 1), F.lit("all")))
    return E.family_recall(q, _returned(t).where(F.col("rank") <= 1))


@register("WITH n AS (SELECT user_id, round(exp(sum(ln(r))))::BIGINT AS n FROM (SELECT user_id, event_type, count(DISTINCT floor(value / 25)) AS r FROM events GROUP BY ALL) GROUP BY 1) SELECT cap, count(*) FILTER (WHERE n < cap) AS below, count(*) FILTER (WHERE n = cap) AS at_cap, count(*) FILTER (WHERE n > cap) AS blocked FROM n, unnest([8, 64, 1024]) c(cap) GROUP BY 1")
def m21_cap_boundaries(t) -> DataFrame:
    s = t("events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("slot"), F.floor(F.col("value") / 25).cast("string").alias("reading"))
    return E.cap_boundaries(s, [8, 64, 1024])


@register("SELECT event_type AS run_id, count(*) AS n, count(*) FILTER (WHERE value > 30) AS passed_before, count(*) FILTER (WHERE value > 50) AS passed_now, count(*) FILTER (WHERE (value > 30) <> (value > 50)) AS changed FROM events GROUP BY 1")
def m23_rescore(t) -> DataFrame:
    """Archived answers 'low', 'mid' and 'high' that passed from mid on, under criteria that accept only high."""
    answer = F.when(F.col("value") > 50, "high").when(F.col("value") > 30, "mid").otherwise("low")
    runs = t("events").select(F.col("event_type").alias("run_id"), F.col("user_id").alias("case_id"), answer.alias("answer"), (F.col("value") > 30).alias("passed"))
    return E.rescore(runs, t("events").select(F.col("user_id").alias("case_id"), F.array(F.lit("high")).alias("accepted")).distinct())
