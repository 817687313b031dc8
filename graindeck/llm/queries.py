"""Queries of the training-data problems 4, 5, 7, 8, 9 and 10 over the named tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.llm import golden, match, mix, pack, spans, tokens, topn
from graindeck.session import cut
from graindeck.sources.tables import finite, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_top_observations(spark, d).select("family_id", "metric_id", "source_row_id")


def p4_top_observations(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    """The n highest observations per family and metric, among valid finite ones in the metric's common unit."""
    units = table(spark, d, "metric_catalog").select("metric_id", "dimension", "common_unit")
    m = table(spark, d, "metric_observation").where((F.col("value_status") == "valid") & finite("numeric_value"))
    m = m.select("family_id", "metric_id", "source_row_id", "numeric_value", "unit_code", "currency_code").join(F.broadcast(units), "metric_id")  # tens of rows
    m = m.where((F.col("unit_code") == F.col("common_unit")) & ((F.col("dimension") != "amount") | (F.col("currency_code") == "KRW")))
    return topn.top_n(m.select("family_id", "metric_id", "source_row_id", "numeric_value"), ["family_id", "metric_id"], "numeric_value", "source_row_id", n)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("holding_key", "security_key")


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return match.match_holdings(table(spark, d, "holding_observation"), table(spark, d, "security_master"))


def p5_isin_matches(spark: SparkSession, d: str) -> DataFrame:
    """What the first two rules of the cascade resolve: whole codes, and codes without country and check digit or without check digit."""
    return p5_matches(spark, d).where(F.col("rule").isin("isin", "isin_part")).select("holding_key", "security_key")


def p5_violations(spark: SparkSession, d: str) -> DataFrame:
    """Counts that must be 0: matched rows that had a security, matches to no listed security, rows matched twice, confidences that are none."""
    m = cut(p5_matches(spark, d), "matches")
    known = table(spark, d, "holding_observation").where(F.col("security_key").isNotNull()).select("holding_key")
    listed = table(spark, d, "security_master").select("security_key")
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return spark.range(1).select(n(m.join(known, "holding_key", "left_semi")).alias("had_security"), n(m.join(listed, "security_key", "left_anti")).alias("not_listed"),
                                 n(m.groupBy("holding_key").count().where("count > 1")).alias("twice"), n(m.where(~F.coalesce((F.col("confidence") > 0) & (F.col("confidence") < 1), F.lit(False)))).alias("bad_confidence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return golden.found(table(spark, d, "metric_observation"), table(spark, d, "data_source"), table(spark, d, "subject"))


def p7_golden_records(spark: SparkSession, d: str) -> DataFrame:
    g = golden.golden(table(spark, d, "metric_observation"), table(spark, d, "data_source"), table(spark, d, "subject"))
    return g.withColumns({f"{f}_support": F.round(f"{f}_support", 6) for f in golden.FIELDS})


def p8_assignments(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(tokens.with_token_count(table(spark, d, "documents"), ["doc_id"]), "sizes")  # texts are tokenized once
    return pack.pack(sized, "doc_id", "n_tokens", table(spark, d, "pack_spec"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return pack.fill(p8_assignments(spark, d))


def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    """Per spec: documents packed, and counts that must be 0: containers above capacity, documents whose pieces aren't the whole text once, documents cut though they fit."""
    sized = cut(tokens.with_token_count(table(spark, d, "documents"), ["doc_id"]), "sizes")
    packed = cut(pack.pack(sized, "doc_id", "n_tokens", table(spark, d, "pack_spec")), "packed")
    over = packed.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("over_capacity"))
    per = packed.groupBy("spec_id", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.sum("token_from").alias("starts"))
    per = per.join(sized.withColumnRenamed("n_tokens", "size"), "doc_id", "left")
    whole = (F.col("n") == F.col("size")) & (F.col("starts") == F.col("capacity_tokens") * F.col("pieces") * (F.col("pieces") - 1) / 2)
    per = per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("not_whole"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("cut_though_fit"))
    return per.join(over, "spec_id")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(tokens.with_token_count(table(spark, d, "documents"), ["doc_id", "source"]), "sizes")  # texts are tokenized once
    return mix.mix(sized, table(spark, d, "source_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(p9_mixture(spark, d), table(spark, d, "source_target"))


def p9_violations(spark: SparkSession, d: str, block_tokens: int = 512) -> DataFrame:
    """Per source that has documents: counts that must be 0: slots longer than a block or of two sources, tokens used more than max_repeats times, and whether the share is off by more than 0.01."""
    sized = cut(tokens.with_token_count(table(spark, d, "documents"), ["doc_id", "source"]), "sizes")
    targets = table(spark, d, "source_target")
    mixed = cut(mix.mix(sized, targets, block_tokens=block_tokens), "mixed")
    slots = mixed.groupBy("shard_id", "slot").agg(F.sum("n_tokens").alias("n"), F.min("source").alias("source"), F.max("source").alias("other"))
    slots = slots.groupBy("source").agg(F.count_if((F.col("n") > block_tokens) | (F.col("source") != F.col("other"))).alias("bad_slots"))
    uses = mixed.groupBy("source", "doc_id", "token_from").agg(F.count(F.lit(1)).alias("uses")).join(targets, "source").groupBy("source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("used_too_often"))
    share = mix.shares(mixed, targets)
    able = share.where(F.col("n_tokens") > 0).agg(F.sum("target_share").alias("s"))
    off = (F.abs(F.col("reached_share") - F.col("target_share") / able.scalar()) > 0.01).cast("int")
    return share.where(F.col("n_tokens") > 0).select("source", off.alias("share_off")).join(slots, "source").join(uses, "source")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document of at least 200 characters, with its class of equal texts and the passage sets it stands in."""
    return spans.document_classes(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.document_pairs(table(spark, d, "documents"))


def p10_shared_parts(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_top_observations, p5_found, p5_matches, p5_isin_matches, p5_violations, p7_found, p7_golden_records, p8_assignments, p8_fill, p8_violations,
                                   p9_mixture, p9_shares, p9_violations, p10_found, p10_classes, p10_shared_parts)}

_KEY = r"lower(regexp_replace({}, '\s', '', 'g'))"
_TOP = """SELECT DISTINCT family_id, metric_id, source_row_id, numeric_value, rank FROM (SELECT *, dense_rank() OVER (PARTITION BY family_id, metric_id ORDER BY numeric_value DESC, source_row_id) AS rank FROM metric_observation JOIN metric_catalog USING (metric_id)
 WHERE value_status = 'valid' AND numeric_value IS NOT NULL AND isfinite(numeric_value) AND unit_code = common_unit AND (dimension <> 'amount' OR currency_code = 'KRW')) WHERE rank <= 10"""


def _winner(field: str, has: str) -> str:
    return f"""SELECT k, metric_id, '{field}' AS field_name, arg_min(source_row_id, (CASE WHEN value_status = 'valid' THEN 0 ELSE 1 END, CASE WHEN effective_as_of BETWEEN DATE '2000-01-01' AND DATE '2026-12-31' THEN -(effective_as_of - DATE '2000-01-01') ELSE 1 END, coalesce(source_precedence, 2147483647), source_row_id)) AS source_row_id FROM m WHERE {has} GROUP BY ALL"""


_FOUND7 = f"""WITH m AS (SELECT *, {_KEY.format('subject_key')} AS k FROM metric_observation LEFT JOIN (SELECT source_id, source_precedence FROM data_source) USING (source_id) WHERE subject_key IS NOT NULL),
 several AS (SELECT k, metric_id FROM m GROUP BY ALL HAVING count(DISTINCT source_row_id) >= 2), w AS ({' UNION ALL '.join([_winner('numeric_value', 'numeric_value IS NOT NULL AND isfinite(numeric_value)'), *[_winner(f, f'{f} IS NOT NULL') for f in ('raw_text_value', 'unit_code', 'currency_code')]])})
 SELECT coalesce(s.subject_key, w.k) AS subject_key, w.metric_id, w.field_name, w.source_row_id FROM w JOIN several USING (k, metric_id) LEFT JOIN subject s ON {_KEY.format('s.subject_key')} = w.k"""



def _elected(field: str, value: str, norm: str, has: str) -> tuple[str, str]:
    """The winner of a field and its support, as two named subqueries."""
    order = "(CASE WHEN valid THEN 0 ELSE 1 END, -day, coalesce(source_precedence, 2147483647), source_row_id)"
    return (f"e_{field} AS (SELECT DISTINCT k, metric_id, source_row_id, valid, day, source_precedence, {value} AS v, {norm} AS norm, (CASE WHEN valid THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) / greatest(coalesce(source_precedence, 100), 1) * pow(0.5::DOUBLE, (DATE '2026-12-31' - DATE '2000-01-01' - greatest(day - 1, 0)) / 90.0::DOUBLE) AS gives FROM m WHERE {has})",
            f"w_{field} AS (SELECT a.k, a.metric_id, a.x.v AS v, a.x.rid AS rid, votes / total AS support FROM (SELECT k, metric_id, arg_min({{'v': v, 'rid': source_row_id, 'norm': norm}}, {order}) AS x FROM e_{field} GROUP BY k, metric_id) a"
            f" JOIN (SELECT *, sum(votes) OVER (PARTITION BY k, metric_id) AS total FROM (SELECT k, metric_id, norm, sum(gives) AS votes FROM e_{field} GROUP BY k, metric_id, norm)) s ON s.k = a.k AND s.metric_id = a.metric_id AND s.norm = a.x.norm)")


_TEXT = r"lower(regexp_replace(trim({0}, ' '), '\s+', ' ', 'g'))"
_PARTS7 = [x for f in golden.FIELDS for x in (_elected(f, "numeric_value + 0.0", "(numeric_value + 0.0)::VARCHAR", "isfinite(numeric_value)") if f == "numeric_value" else _elected(f, f, _TEXT.format(f), f"{f} IS NOT NULL"))]
_GOLDEN = f"""WITH m AS (SELECT *, {_KEY.format('subject_key')} AS k, coalesce(value_status = 'valid', false) AS valid, CASE WHEN effective_as_of BETWEEN DATE '2000-01-01' AND DATE '2026-12-31' THEN effective_as_of - DATE '2000-01-01' + 1 ELSE 0 END AS day
 FROM metric_observation LEFT JOIN (SELECT source_id, source_precedence FROM data_source) USING (source_id) WHERE subject_key IS NOT NULL AND metric_id IS NOT NULL AND source_row_id IS NOT NULL),
 several AS (SELECT k, metric_id FROM m GROUP BY ALL HAVING count(DISTINCT source_row_id) >= 2), {', '.join(_PARTS7)}
 SELECT coalesce(s.subject_key, g.k) AS subject_key, g.metric_id, {', '.join(f'w_{f}.v AS {f}, w_{f}.rid AS {f}_row, round(w_{f}.support, 6) AS {f}_support' for f in golden.FIELDS)}
 FROM several g {' '.join(f'LEFT JOIN w_{f} ON w_{f}.k = g.k AND w_{f}.metric_id = g.metric_id' for f in golden.FIELDS)} LEFT JOIN subject s ON {_KEY.format('s.subject_key')} = g.k WHERE {' OR '.join(f'w_{f}.rid IS NOT NULL' for f in golden.FIELDS)}"""

_ISIN5 = """WITH s AS (SELECT security_key, regexp_replace(upper(isin), '[^0-9A-Z]', '', 'g') AS code FROM security_master WHERE security_key IS NOT NULL), k AS (SELECT code AS part, security_key FROM s WHERE length(code) = 12 UNION ALL SELECT substr(code, 3, 9), security_key FROM s WHERE length(code) = 12 UNION ALL SELECT substr(code, 1, 11), security_key FROM s WHERE length(code) = 12),
 u AS (SELECT part, min(security_key) AS security_key FROM k GROUP BY 1 HAVING count(DISTINCT security_key) = 1) SELECT DISTINCT h.holding_key, u.security_key FROM holding_observation h JOIN u ON u.part = regexp_replace(upper(h.held_isin_raw), '[^0-9A-Z]', '', 'g') WHERE h.security_key IS NULL"""


_WINDOWS = "SELECT doc_id, i, substr(text, i, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)"
_LEVELS = "SELECT doc_id, max(l) AS level FROM (SELECT doc_id, l, h, count(DISTINCT doc_id) OVER (PARTITION BY l, h) AS n FROM (SELECT DISTINCT doc_id, l, hash(substr(text, i, l)) AS h FROM (SELECT doc_id, text, l, unnest(range(1, length(text) - l + 2)) AS i FROM documents, (SELECT 200 << k AS l FROM range(0, 14) t(k)) WHERE length(text) >= l))) WHERE n > 1 GROUP BY 1"
_PARTS = f"""WITH w AS ({_WINDOWS}), g AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1), h AS (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w JOIN g USING (s)),
 p AS (SELECT doc_id, sum(least(coalesce(gap, 200), 200)) AS shared, count(*) FILTER (WHERE gap IS NULL OR gap > 200) AS n FROM h GROUP BY 1)
 SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared, 0)::BIGINT AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(shared, 0)::DOUBLE / length(text) ELSE 0 END AS shared_part, coalesce(n, 0) AS n_spans, coalesce(level, 0) AS longest_level
 FROM documents LEFT JOIN p USING (doc_id) LEFT JOIN ({_LEVELS}) USING (doc_id)"""
_CLASSES = """WITH c AS (SELECT text, min(doc_id) AS class_id, count(*) AS n_copies FROM documents WHERE length(text) >= 200 GROUP BY 1), w AS (SELECT DISTINCT class_id, substr(text, i, 200) AS s FROM (SELECT class_id, text, unnest(range(1, length(text) - 198)) AS i FROM c)),
 g AS (SELECT DISTINCT list_sort(list(class_id)) AS members FROM w GROUP BY s HAVING count(*) > 1), n AS (SELECT class_id, count(*) AS n_sets, max(size) AS largest_set FROM (SELECT unnest(members) AS class_id, len(members) AS size FROM g) GROUP BY 1)
 SELECT d.doc_id, c.class_id, c.n_copies, coalesce(n.n_sets, 0) AS n_sets, coalesce(n.largest_set, 0) AS largest_set FROM documents d JOIN c USING (text) LEFT JOIN n USING (class_id)"""

ORACLES = {
    "p4_found": f"SELECT family_id, metric_id, source_row_id FROM ({_TOP})",
    "p4_top_observations": _TOP,
    "p5_isin_matches": _ISIN5,
    "p5_violations": "SELECT 0 AS had_security, 0 AS not_listed, 0 AS twice, 0 AS bad_confidence",
    "p7_found": _FOUND7,
    "p7_golden_records": _GOLDEN,
    "p8_violations": "SELECT spec_id, (SELECT count(*) FROM documents) AS n_documents, 0 AS over_capacity, 0 AS not_whole, 0 AS cut_though_fit FROM pack_spec",
    "p9_violations": "SELECT t.source, 0 AS share_off, 0 AS bad_slots, 0 AS used_too_often FROM source_target t WHERE EXISTS (SELECT 1 FROM documents d WHERE regexp_replace(lower(d.source), '[^0-9a-z가-힣]', '', 'g') = regexp_replace(lower(t.source), '[^0-9a-z가-힣]', '', 'g') AND length(d.text) > 0)",
    "p10_classes": _CLASSES,
    "p10_found": f"WITH w AS (SELECT DISTINCT doc_id, s FROM ({_WINDOWS})) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b USING (s) WHERE a.doc_id < b.doc_id",
    "p10_shared_parts": _PARTS,
}
