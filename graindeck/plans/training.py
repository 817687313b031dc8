"""Queries of the general training-data problems (1, 2, 3, 6) over the named tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.functions import units as U
from graindeck.functions import values as V
from graindeck.operators import profile, skew, units, wide
from graindeck.sources.tables import folded_key, table, with_own_spelling


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    return units.normalise(t("metric_observation"), t("holding_observation"), t("metric_catalog"), t("data_source"), t("unit_reference"), t("currency_rate"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.found(_normalised(spark, d))


def p1_common_values(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d)


def p1_stated_values(spark: SparkSession, d: str) -> DataFrame:
    """The common values of rows that state their unit."""
    n = _normalised(spark, d).where(F.col("basis").isin("column", "text", "note") & F.col("value_common").isNotNull())
    return n.select("table_name", "quantity", "row_key", "unit_id", "currency_code", "value_common")


def _pairs(spark: SparkSession, d: str, dimensions: list[str] | None = None) -> DataFrame:
    a = wide.attribute_cells(table(spark, d, "attribute_observation"), table(spark, d, "attribute_catalog"))
    m = wide.metric_cells(table(spark, d, "metric_observation"), table(spark, d, "metric_catalog"), dimensions)
    return wide.resolved_pairs(a.unionByName(m))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    fields = wide.catalog_fields(table(spark, d, "attribute_catalog"), table(spark, d, "metric_catalog"))
    return wide.found(_pairs(spark, d), fields, table(spark, d, "subject"))


def p2_wide_cells(spark: SparkSession, d: str) -> DataFrame:
    """The wide table of attributes, counts, days and multipliers turned back into its cells."""
    fields = wide.catalog_fields(table(spark, d, "attribute_catalog"), table(spark, d, "metric_catalog"))
    w = wide.widen(_pairs(spark, d), fields, table(spark, d, "subject"))
    cells = []
    for field, kind in fields:
        c, number = F.col(field.replace(":", "_")), kind in ("integer", "decimal", "number")
        cells.append(F.when(c.isNotNull(), F.struct(F.lit(field).alias("field_id"), (F.lit(None) if number else c).cast("string").alias("text_value"), (c if number else F.lit(None)).cast("double").alias("number_value"))))
    return w.select("subject_key", F.inline(F.array_compact(F.array(*cells))))


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per subject; shares and amounts in percent and won through the operator of problem 1, those whose unit isn't known among the cast failures."""
    t = lambda name: table(spark, d, name)
    fields = wide.catalog_fields(t("attribute_catalog"), t("metric_catalog"))
    kinds = t("metric_catalog").where(F.col("dimension").isin("share", "amount")).select("metric_id")
    m = t("metric_observation").join(F.broadcast(kinds), "metric_id", "left_semi")  # the catalog lists metrics: tens of rows at any scale
    # a row without an id goes by its whole content, which re-delivered rows share
    key = F.coalesce("source_row_id", F.concat(F.lit("\u0001"), F.sha2(F.to_json(F.struct("*")), 256)))
    rows = units.decode(units.metric_recordings(m.withColumn("source_row_id", key), t("metric_catalog"), t("data_source")), units.states(t("unit_reference"), t("currency_rate")))
    common = rows.where(F.col("value_common").isNotNull()).groupBy("row_key").agg(F.max("value_common").alias("common"))
    m = m.withColumn("row_key", F.concat(F.col("metric_id"), F.lit("@"), key)).join(common, "row_key", "left")
    money = wide.metric_cells(m, t("metric_catalog"), ["share", "amount"], "common")
    plain = wide.metric_cells(t("metric_observation"), t("metric_catalog"))
    cells = wide.attribute_cells(t("attribute_observation"), t("attribute_catalog")).unionByName(plain).unionByName(money)
    return wide.widen(wide.resolved_pairs(cells), fields, t("subject"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holding_observation").select(folded_key("portfolio_key").alias("key"), "holding_key")
    big = skew.found(skew.per_key(h, "key", "holding_key"), "key", 0.04)
    return with_own_spelling(big, "key", table(spark, d, "portfolio"), "portfolio_key", "portfolio_key").select("portfolio_key")


def _weights(spark: SparkSession, d: str) -> DataFrame:
    """Holdings once each, with weights in percent where their unit is known."""
    t = lambda name: table(spark, d, name)
    return units.with_percent_weight(t("holding_observation"), t("data_source"), t("unit_reference")).dropDuplicates(["holding_key"])


def p3_portfolio_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, total weight in percent and distinct resolved securities of each portfolio; re-delivered rows count once."""
    h = _weights(spark, d).select(folded_key("portfolio_key").alias("key"), "holding_key", "security_key", "weight_percent").where(F.col("key").isNotNull())
    delivered = table(spark, d, "holding_observation").select(folded_key("portfolio_key").alias("key"))  # re-delivered rows too: close enough to tell heavy keys
    out = skew.per_key(h, "key", "holding_key", "weight_percent", "security_key", counted=delivered)
    return with_own_spelling(out, "key", table(spark, d, "portfolio"), "portfolio_key", "portfolio_key").select(
        "portfolio_key", "n_rows", F.round("total_weight", 4).alias("total_weight_percent"), F.col("n_items").alias("n_securities"))


def p3_family_totals(spark: SparkSession, d: str) -> DataFrame:
    """The same per family."""
    out = skew.per_key(_weights(spark, d).select("family_id", "holding_key", "security_key", "weight_percent"), "family_id", "holding_key", "weight_percent", "security_key", counted=table(spark, d, "holding_observation").select("family_id"))
    return out.select("family_id", "n_rows", F.round("total_weight", 2).alias("total_weight_percent"), F.col("n_items").alias("n_securities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.found(table(spark, d, "metric_observation"), table(spark, d, "holding_observation"), table(spark, d, "data_source"))


POINTS = (0.01, 0.25, 0.5, 0.75, 0.99)


def _both(spark: SparkSession, d: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``of`` the value counts of both tables; is_number tells columns whose values are doubles."""
    parts = []
    for name in ("metric_observation", "holding_observation"):
        df = table(spark, d, name)
        numbers = [c for c, kind in df.dtypes if kind == "double"]
        parts.append(of(profile.value_counts(df, "source_id")).withColumns({"table_name": F.lit(name), "is_number": F.col("column_name").isin(numbers)}))
    return parts[0].unionByName(parts[1])


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of both tables: nulls, distinct values, range and quantiles, those of doubles as numbers, all others as text."""
    p = _both(spark, d, lambda counts: profile.column_profile(counts, POINTS))
    ends = {"minimum": F.col("minimum"), "maximum": F.col("maximum"), **{f"q{round(100 * x):02d}": F.col("quantiles").getItem(str(x)) for x in POINTS}}
    return p.select("table_name", "column_name", "n_rows", "n_null", F.round("null_rate", 9).alias("null_rate"), "n_distinct", *[F.when(~F.col("is_number"), c).alias(k) for k, c in ends.items()],
                    *[F.when(F.col("is_number"), c).cast("double").alias(k + "_number") for k, c in ends.items()])


def p6_load_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Share changes and Kolmogorov-Smirnov distances of every column from each load to the next; the value whose share changed most, where it is no double."""
    s = _both(spark, d, lambda counts: profile.load_shifts(counts, table(spark, d, "data_source")))
    return s.select("table_name", "column_name", "load", "before", *[F.round(c, 9).alias(c) for c in ("share_change", "null_change", "ks")], F.when(~F.col("is_number"), F.col("value")).alias("value"))


QUERIES = {f.__name__: f for f in (p1_found, p1_common_values, p1_stated_values, p2_found, p2_wide, p2_wide_cells, p3_found, p3_portfolio_totals, p3_family_totals, p6_found, p6_profile, p6_load_shifts)}


# ---- the same results in SQL

_KEY = r"lower(regexp_replace({}, '\s', '', 'g'))"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _currency_sql(x: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(lower({x}), {_q(words)}) THEN '{code}'" for code, words in U.CURRENCY_WORDS)
    return f"CASE WHEN contains({x}, 'GBp') THEN 'GBX' {rules} END"


def _lookup_sql(x: str, words: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(_q(w) for w in ws)}) THEN '{unit}'" for unit, ws in words.items()) + " END"


def _tidy_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[\s_()\[\]]+', ' ', 'g'))"


def _share_sql(x: str) -> str:
    more = {"percent_observed": ["percent observed"], "basis_point": ["basis point"]}
    return _lookup_sql(_tidy_sql(x), {u: ws + more.get(u, []) for u, ws in U.SHARE_WORDS.items()})


def _amount_sql(x: str) -> str:
    cash = "|".join(words for _, words in U.CURRENCY_WORDS)
    bare = rf"trim(regexp_replace(regexp_replace({_tidy_sql(x)}, {_q(cash)}, ' ', 'g'), '\s+', ' ', 'g'))"
    scales = {u: ws + (["currency amount"] if u == "currency_amount" else []) for u, ws in U.SCALE_WORDS.items()}
    return f"CASE WHEN {_currency_sql(x)} = 'GBX' THEN 'currency_amount' WHEN {bare} = '' AND {_currency_sql(x)} IS NULL THEN NULL ELSE {_lookup_sql(bare, scales)} END"


def _text_sql(x: str) -> str:
    around = rf"regexp_replace({x}, '^([^0-9]*?)[-+−]?\s*[0-9][0-9,]*(?:\.[0-9]+)?(.*)$', '\1 \2', 's')"
    plain = rf"regexp_replace(regexp_replace({around}, {_q('(?i)' + U.TEXT_FILLERS)}, ' ', 'g'), '[()\[\]]', ' ', 'g')"
    return rf"CASE WHEN regexp_matches({x}, '[0-9]') THEN nullif(trim(regexp_replace({plain}, '\s+', ' ', 'g')), '') END"


def _note_sql(words: list[tuple[str, str]], x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(w)}) THEN '{u}'" for u, w in words) + " END"


_NOTES = f"""SELECT source_id, CASE WHEN b THEN {_note_sql(U.NOTE_SHARE_WORDS, 'low')} END AS note_share, CASE WHEN b AND c IS NOT NULL THEN CASE WHEN c = 'GBX' THEN 'currency_amount' ELSE coalesce({_note_sql(U.NOTE_SCALE_WORDS, "regexp_replace(low, '천분율|만분율|백분율', ' ', 'g')")}, 'currency_amount') END END AS note_amount, CASE WHEN b THEN c END AS note_currency
 FROM (SELECT source_id, lower(note) AS low, regexp_matches(lower(note), {_q(U.NOTE_OF_BLANKS)}) AS b, {_currency_sql('note')} AS c FROM data_source WHERE note IS NOT NULL)"""
_ROWS = """SELECT DISTINCT 'metric_observation' AS table_name, 'numeric_value' AS quantity, metric_id || '@' || source_row_id AS row_key, dimension = 'share' AS share, numeric_value AS value, unit_code AS unit, currency_code AS cur, raw_text_value AS txt, source_id FROM metric_observation JOIN metric_catalog USING (metric_id) WHERE dimension IN ('share', 'amount')
 UNION ALL SELECT DISTINCT 'holding_observation', 'weight_value', holding_key, true, weight_value, weight_unit, currency, NULL, source_id FROM holding_observation UNION ALL SELECT DISTINCT 'holding_observation', 'value_amount', holding_key, false, value_amount, value_amount_unit, currency, NULL, source_id FROM holding_observation"""
_READ = f"""WITH notes AS ({_NOTES}), r AS (SELECT *, unit IS NOT NULL AND lower(trim(unit)) = 'number' AS plain, CASE WHEN unit IS NULL OR lower(trim(unit)) = 'number' THEN {_text_sql('txt')} END AS around FROM ({_ROWS}) LEFT JOIN notes USING (source_id)),
 k AS (SELECT *, CASE WHEN unit IS NOT NULL AND NOT plain THEN CASE WHEN share THEN {_share_sql('unit')} ELSE {_amount_sql('unit')} END END AS in_column, CASE WHEN around IS NOT NULL THEN CASE WHEN share THEN {_share_sql('around')} ELSE {_amount_sql('around')} END END AS in_text FROM r),
 n AS (SELECT *, coalesce(in_column, in_text, CASE WHEN unit IS NULL THEN CASE WHEN share THEN note_share ELSE note_amount END END) AS u, CASE WHEN share THEN 'none' ELSE coalesce(CASE WHEN in_column IS NOT NULL THEN {_currency_sql('unit')} WHEN in_text IS NOT NULL THEN {_currency_sql('around')} WHEN unit IS NULL THEN note_currency END, {_currency_sql('cur')}) END AS c FROM k)"""
_P1 = f"""{_READ}
 SELECT table_name, quantity, row_key, CASE WHEN c = 'GBX' THEN 'currency_amount' ELSE u END AS recorded_unit, c AS recorded_currency FROM n WHERE value IS NOT NULL AND isfinite(value) AND u IS NOT NULL AND c IS NOT NULL AND NOT (share AND u = 'percent_observed') AND NOT (NOT share AND u = 'currency_amount' AND c = 'KRW')"""

_P1S = f"""{_READ}, v AS (SELECT *, CASE WHEN c = 'GBX' THEN 'currency_amount' ELSE u END AS unit_id FROM n WHERE u IS NOT NULL AND c IS NOT NULL AND value IS NOT NULL AND isfinite(value))
 SELECT table_name, quantity, row_key, unit_id, c AS currency_code, value * (factor_to_common * CASE WHEN share THEN 1.0 ELSE krw_per_unit END) AS value_common FROM v JOIN unit_reference r USING (unit_id) LEFT JOIN currency_rate k ON k.currency_code = c WHERE r.dimension = CASE WHEN share THEN 'share' ELSE 'amount' END"""

_BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_LABEL = f"regexp_replace(label_value, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_FOLDED = f"lower(regexp_replace({_LABEL}, '{_BLANK}+', ' ', 'g'))"
_NUM = r"TRY_CAST(regexp_replace(regexp_replace(label_value, '[\s,]', '', 'g'), '[%％]$', '') AS DOUBLE)"
_DAY = rf"regexp_replace(regexp_replace(regexp_replace({_LABEL}, '\s*[년월./]\s*', '-', 'g'), '\s*일$', ''), '^(\d{{4}})(\d{{2}})(\d{{2}})$', '\1-\2-\3')"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _cells_sql(attribute_more: str = "", metric_more: str = "") -> str:
    return f"""SELECT {_KEY.format('subject_key')} AS k, attribute_id AS field_id, CASE value_type WHEN 'string' THEN CASE WHEN {_FOLDED} NOT IN {_in(V.NO_VALUE_WORDS)} THEN {_FOLDED} END
 WHEN 'boolean' THEN CASE WHEN lower({_LABEL}) IN {_in(V.YES_WORDS)} THEN 'true' WHEN lower({_LABEL}) IN {_in(V.NO_WORDS)} THEN 'false' END
 WHEN 'date' THEN CASE WHEN try_strptime({_DAY}, '%Y-%m-%d') IS NOT NULL AND CAST(try_strptime({_DAY}, '%Y-%m-%d') AS DATE)::VARCHAR NOT IN {_in(V.PLACEHOLDER_DAYS)} THEN CAST(try_strptime({_DAY}, '%Y-%m-%d') AS DATE)::VARCHAR END
 ELSE CASE WHEN isfinite({_NUM}) THEN ({_NUM} + 0.0)::VARCHAR END END AS v{attribute_more} FROM attribute_observation JOIN attribute_catalog USING (attribute_id) WHERE subject_key IS NOT NULL
 UNION ALL SELECT {_KEY.format('subject_key')}, metric_id, (numeric_value + 0.0)::VARCHAR{metric_more} FROM metric_observation JOIN metric_catalog USING (metric_id) WHERE subject_key IS NOT NULL AND dimension IN ('count', 'days', 'multiplier') AND value_status = 'valid' AND numeric_value IS NOT NULL AND isfinite(numeric_value)"""


_CELLS = _cells_sql()
_P2 = f"SELECT coalesce(s.subject_key, c.k) AS subject_key, c.field_id FROM (SELECT k, field_id FROM ({_CELLS}) GROUP BY ALL HAVING count(DISTINCT v) >= 2) c LEFT JOIN subject s ON {_KEY.format('s.subject_key')} = c.k"

_SHOWN = r"CASE WHEN value_type = 'string' THEN regexp_replace(" + _LABEL + r", '[\s\x0B]+', ' ', 'g') END AS shown, effective_as_of AS day, source_row_id AS rid, value_type AS kind"
_P2C = f"""SELECT coalesce(s.subject_key, c.k) AS subject_key, field_id, CASE WHEN kind IN ('string', 'boolean', 'date') THEN x.s END AS text_value, CASE kind WHEN 'integer' THEN trunc(x.v::DOUBLE) WHEN 'decimal' THEN x.v::DOUBLE WHEN 'number' THEN x.v::DOUBLE END AS number_value
 FROM (SELECT k, field_id, kind, arg_max({{'s': coalesce(shown, v), 'v': v}}, (coalesce(CASE WHEN day BETWEEN DATE '2000-01-01' AND DATE '2026-12-31' THEN day END, DATE '1000-01-01'), coalesce(rid, ''), v)) AS x FROM ({_cells_sql(', ' + _SHOWN, ", NULL, effective_as_of, source_row_id, 'number'")}) WHERE v IS NOT NULL GROUP BY ALL) c LEFT JOIN subject s ON {_KEY.format('s.subject_key')} = c.k"""

_P3 = f"SELECT p.portfolio_key FROM (SELECT {_KEY.format('portfolio_key')} AS k, count(*) AS n FROM holding_observation WHERE portfolio_key IS NOT NULL GROUP BY 1) h JOIN portfolio p ON {_KEY.format('p.portfolio_key')} = h.k WHERE h.n >= 0.04 * (SELECT count(*) FROM holding_observation)"
_HELD = f"SELECT DISTINCT h.*, CASE WHEN weight_value IS NOT NULL AND isfinite(weight_value) THEN weight_value * f.factor_to_common END AS w FROM holding_observation h LEFT JOIN ({_NOTES}) n USING (source_id) LEFT JOIN unit_reference f ON f.dimension = 'share' AND f.unit_id = CASE WHEN h.weight_unit IS NULL THEN n.note_share ELSE {_lookup_sql('lower(trim(h.weight_unit))', U.SHARE_WORDS)} END"
_P3T = f"SELECT coalesce(p.portfolio_key, h.k) AS portfolio_key, n_rows, round(w, 4) AS total_weight_percent, n_securities FROM (SELECT {_KEY.format('portfolio_key')} AS k, count(*) AS n_rows, sum(w) AS w, count(DISTINCT security_key) AS n_securities FROM ({_HELD}) WHERE portfolio_key IS NOT NULL GROUP BY 1) h LEFT JOIN portfolio p ON {_KEY.format('p.portfolio_key')} = h.k"
_P3F = f"SELECT family_id, count(*) AS n_rows, round(sum(w), 2) AS total_weight_percent, count(DISTINCT security_key) AS n_securities FROM ({_HELD}) GROUP BY 1"

_ISIN_OK = r"""(regexp_matches(x, '^[A-Z]{2}[A-Z0-9]{9}[0-9]$') AND list_sum(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (CAST(substr(r, i, 1) AS INT) * 2) // 10 + (CAST(substr(r, i, 1) AS INT) * 2) % 10 ELSE CAST(substr(r, i, 1) AS INT) END)) % 10 = 0)"""
_MK = "metric_id || '@' || source_row_id"


def _shift_sql(table_name: str, column: str, value: str) -> str:
    return f"""SELECT 'shift' AS case_kind, '{table_name}' AS table_name, '{column}' AS column_name, load AS item_key FROM (WITH c AS (SELECT source_id, {value} AS v, count(*) AS n FROM {table_name} GROUP BY ALL), z AS (SELECT source_id, sum(n) AS total FROM c GROUP BY 1),
 o AS (SELECT source_id AS load, lag(source_id) OVER (PARTITION BY source_name ORDER BY collected_at, source_id) AS before FROM data_source WHERE source_id IN (SELECT source_id FROM z)), g AS (SELECT load, before, v FROM o JOIN c ON c.source_id IN (load, before) WHERE before IS NOT NULL AND v IS NOT NULL GROUP BY ALL)
 SELECT load, max(abs(coalesce(a.n, 0)::DOUBLE / za.total - coalesce(b.n, 0)::DOUBLE / zb.total)) AS d FROM g JOIN z za ON za.source_id = load JOIN z zb ON zb.source_id = before LEFT JOIN c a ON a.source_id = load AND a.v = g.v LEFT JOIN c b ON b.source_id = before AND b.v = g.v GROUP BY 1) WHERE round(d, 12) > 0.25"""


_P6 = f"""SELECT DISTINCT 'violation' AS case_kind, 'metric_observation' AS table_name, 'value_status' AS column_name, {_MK} AS item_key FROM metric_observation WHERE value_status IS NULL OR value_status NOT IN ('valid', 'zero_excluded', 'parse_failed', 'date_parse_failed') OR (value_status = 'valid' AND (numeric_value IS NULL OR NOT isfinite(numeric_value) OR numeric_value = 0)) OR (value_status = 'zero_excluded' AND (numeric_value IS NULL OR numeric_value <> 0)) OR (value_status = 'parse_failed' AND numeric_value IS NOT NULL)
 UNION ALL SELECT DISTINCT 'violation', 'metric_observation', 'raw_text_value', {_MK} FROM metric_observation WHERE numeric_value IS NOT NULL AND raw_text_value IS NOT NULL AND NOT regexp_matches(raw_text_value, '[0-9]')
 UNION ALL SELECT DISTINCT 'violation', 'holding_observation', 'identifier_status', holding_key FROM (SELECT holding_key, identifier_status AS s, held_security_id_raw AS x, reverse(array_to_string(list_transform(string_split(held_security_id_raw, ''), lambda c: CASE WHEN ascii(c) BETWEEN 65 AND 90 THEN CAST(ascii(c) - 55 AS VARCHAR) WHEN ascii(c) BETWEEN 48 AND 57 THEN c ELSE '0' END), '')) AS r FROM holding_observation)
 WHERE s IS NULL OR s NOT IN ('checksum_verified', 'format_matched', 'format_matched_checksum_failed', 'unverified_scheme', 'absent', 'declared_by_source', 'placeholder') OR (s = 'absent' AND x IS NOT NULL) OR (s <> 'absent' AND x IS NULL) OR (s = 'checksum_verified' AND NOT {_ISIN_OK})
 UNION ALL {_shift_sql('metric_observation', 'value_status', 'value_status')} UNION ALL {_shift_sql('metric_observation', 'raw_text_value', "CASE WHEN raw_text_value IS NULL THEN 'null' END")} UNION ALL {_shift_sql('holding_observation', 'identifier_status', 'identifier_status')}"""

# the columns of both tables, and which of them are doubles
_COLUMNS = {"metric_observation": "subject_key subject_grain family_id metric_id numeric_value raw_text_value unit_code currency_code period_code effective_as_of as_of_status value_status source_id source_row_id",
            "holding_observation": "holding_key family_id portfolio_key security_key relation_kind parent_portfolio_id_raw called_subject_key held_security_id_raw held_isin_raw held_ticker_raw security_name_raw identifier_scheme_id identifier_status quantity_value quantity_unit value_amount value_amount_unit currency weight_value weight_unit requested_as_of effective_as_of as_of_status snapshot_scope source_reference source_record_id source_id source_row_id"}
_DOUBLES = {"numeric_value", "quantity_value", "value_amount", "weight_value"}


def _profile_sql(t: str, c: str) -> str:
    x = c if c in _DOUBLES else f"{c}::VARCHAR"
    points = {"minimum": "v[1]", "maximum": "v[len(v)]", **{f"q{round(100 * p):02d}": f"v[ceil({p}::DOUBLE * len(v))::BIGINT]" for p in POINTS}}
    ends = ", ".join(f"{'NULL' if (c in _DOUBLES) != number else e}::{'DOUBLE' if number else 'VARCHAR'} AS {k}{'_number' if number else ''}" for number in (False, True) for k, e in points.items())
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, n_rows, n_null, round(n_null / n_rows, 9) AS null_rate, n_distinct, {ends} FROM (SELECT count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, list_sort(list({x}) FILTER (WHERE {c} IS NOT NULL)) AS v FROM {t}) WHERE n_rows > 0"


def _curves_sql(t: str, c: str) -> str:
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, load, before, round(coalesce(max(d), 0), 9) AS share_change, round(any_value(nulls), 9) AS null_change, round(coalesce(max(gap), 0), 9) AS ks, {'NULL' if c in _DOUBLES else 'arg_min(v, (-d, v)) FILTER (WHERE v IS NOT NULL)'}::VARCHAR AS value
 FROM (WITH c AS (SELECT source_id, {c if c in _DOUBLES else f'{c}::VARCHAR'} AS v, count(*) AS n FROM {t} GROUP BY ALL), z AS (SELECT source_id, sum(n) AS total, coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) AS present FROM c GROUP BY 1),
 o AS (SELECT source_id AS load, lag(source_id) OVER (PARTITION BY source_name ORDER BY collected_at, source_id) AS before FROM data_source WHERE source_id IN (SELECT source_id FROM z)),
 l AS (SELECT load, before, a.total AS ta, b.total AS tb, greatest(a.present, 1) AS pa, greatest(b.present, 1) AS pb, abs((a.total - a.present) / a.total - (b.total - b.present) / b.total) AS nulls FROM o JOIN z a ON a.source_id = load JOIN z b ON b.source_id = before),
 g AS (SELECT load, v, sum(CASE WHEN source_id = load THEN n ELSE 0 END) AS n, sum(CASE WHEN source_id = before THEN n ELSE 0 END) AS m FROM l JOIN c ON source_id IN (load, before) WHERE v IS NOT NULL GROUP BY ALL), w AS (SELECT *, sum(n) OVER u AS cn, sum(m) OVER u AS cm FROM g WINDOW u AS (PARTITION BY load ORDER BY v))
 SELECT l.*, v, abs(n / ta - m / tb) AS d, abs(cn / pa - cm / pb) AS gap FROM l LEFT JOIN w USING (load)) GROUP BY load, before"""


_P6P = " UNION ALL ".join(_profile_sql(t, c) for t, cs in _COLUMNS.items() for c in cs.split())
_P6L = " UNION ALL ".join(_curves_sql(t, c) for t, cs in _COLUMNS.items() for c in cs.split())

ORACLES = {"p1_found": _P1, "p1_stated_values": _P1S, "p2_found": _P2, "p2_wide_cells": _P2C, "p3_found": _P3, "p3_portfolio_totals": _P3T, "p3_family_totals": _P3F, "p6_found": _P6, "p6_profile": _P6P, "p6_load_shifts": _P6L}
