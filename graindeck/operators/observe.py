"""Source rows into long observations: typed projection, unpivot, statuses, ordered rules, bound predicates."""
from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses of observations, and operations by role of a field.
VALUE_STATUSES = ["valid", "zero_excluded", "parse_failed", "date_parse_failed"]
AS_OF_STATUSES = ["effective_declared", "effective_reported", "requested_only", "unknown", "not_declared"]
ROLE_OPERATIONS = {
    "date": ["eq", "ne", "lt", "lte", "gt", "gte", "order", "min", "max", "count", "group"],
    "measure": ["eq", "ne", "lt", "lte", "gt", "gte", "order", "min", "max", "avg", "sum", "count"],
    "label_or_code": ["eq", "ne", "in", "contains", "group", "count"],
    "integer_unverified_zero_semantics": ["eq", "ne", "in", "count"],
}
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def safe_column(name: str, allowed: Sequence[str] | None = None) -> Column:
    """A column by a name from outside: a plain identifier, on the list if one is given; else ValueError."""
    if not IDENTIFIER.match(name) or (allowed is not None and name not in allowed):
        raise ValueError(f"not a permitted column: {name!r}")
    return F.col(name)


def trim_to_null(c: str | Column) -> Column:
    """Spaces on either side away (no other white space); an empty rest is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def strict_date(c: str | Column) -> Column:
    """A date from exactly eight digits once everything else is stripped; else null."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd"))


def typed(c: str | Column, declared: str) -> Column:
    """A declared type from text, null where it doesn't cast: text, double precision, bigint (rounded half away from zero, exponents read),
    numeric(p,s); any other type raises ValueError."""
    c = trim_to_null(c)
    kind = declared.strip().lower()
    if kind == "text":
        return c
    if kind == "double precision":
        return c.try_cast("double")
    if kind == "bigint":
        return F.round(F.coalesce(c.try_cast("decimal(38,9)"), c.try_cast("double").try_cast("decimal(38,9)"))).try_cast("bigint")
    if m := re.match(r"^numeric\((\d+),\s*(\d+)\)$", kind):
        return c.try_cast(f"decimal({m[1]},{m[2]})")
    raise ValueError(f"undeclared type {declared!r}")


def role_of(declared: str) -> str:
    """The role a declared type gives a field."""
    kind = declared.strip().lower()
    if kind == "text":
        return "label_or_code"
    if kind == "bigint" or re.match(r"^numeric\(\d+,\s*0\)$", kind):
        return "integer_unverified_zero_semantics"
    if kind == "double precision" or re.match(r"^numeric\(\d+,\s*[1-9]\d*\)$", kind):
        return "measure"
    raise ValueError(f"undeclared type {declared!r}")


def project(df: DataFrame, schema: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Typed projection of all-text rows: every declared column cast, ``keep`` columns as they are."""
    return df.select(*keep, *[typed(safe_column(c), kind).alias(c) for c, kind in schema.items()])


def metric_status(value: Column) -> Column:
    """parse_failed for null, zero_excluded for zero, else valid."""
    return F.when(value.isNull(), "parse_failed").when(value == 0, "zero_excluded").otherwise("valid")


def date_status(text: Column, parsed: Column) -> Column:
    """date_parse_failed where a text stands that gave no date, else valid."""
    return F.when(trim_to_null(text).isNotNull() & parsed.isNull(), "date_parse_failed").otherwise("valid")


def as_of_status(declared: bool | Column, as_of: Column) -> Column:
    """effective_declared with a parsed date, unknown without; not_declared where no field declares one."""
    flag = F.lit(declared) if isinstance(declared, bool) else declared
    return F.when(~flag, "not_declared").when(as_of.isNotNull(), "effective_declared").otherwise("unknown")


def as_of_split(role: Column, as_of: Column) -> tuple[Column, Column, Column]:
    """(requested_as_of, effective_as_of, as_of_status): the role says which of the two a date is; no date, status unknown."""
    requested = F.when(role == "requested", as_of)
    effective = F.when(role == "effective", as_of)
    status = F.when(as_of.isNull(), "unknown").when(role == "requested", "requested_only").otherwise("effective_reported")
    return requested, effective, status


def unpivot_metrics(df: DataFrame, keys: Sequence[str], metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per row and metric: keys, metric_id, numeric_value, unit_code, value_status. ``metrics``: id to (column, unit).

    One scan for all metrics. A null or zero value keeps its row with its status.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("metric_id"), safe_column(c).cast("double").alias("numeric_value"), F.lit(u).alias("unit_code")) for m, (c, u) in metrics.items()])
    long = df.select(*keys, F.inline(cells))
    return long.withColumn("value_status", metric_status(F.col("numeric_value")))


def unpivot_attributes(df: DataFrame, keys: Sequence[str], attributes: dict[str, dict[str, str]]) -> DataFrame:
    """One row per row and attribute that has any slot: keys, attribute_id, code_value, label_value, date_value, value_status.

    ``attributes``: id to its slots (code, label, date, text, key, value), each naming a column. The label is the first of label, key,
    text, date text and value.
    """
    none = F.lit(None).cast("string")

    def cell(name: str, slots: dict[str, str]) -> Column:
        at = {s: (trim_to_null(safe_column(slots[s]).cast("string")) if s in slots else none) for s in ("code", "label", "date", "text", "key", "value")}
        day = strict_date(at["date"]) if "date" in slots else F.lit(None).cast("date")
        return F.struct(F.lit(name).alias("attribute_id"), at["code"].alias("code_value"), F.coalesce(*[at[s] for s in ("label", "key", "text", "date", "value")]).alias("label_value"),
                        day.alias("date_value"), date_status(at["date"], day).alias("value_status"))

    long = df.select(*keys, F.inline(F.array(*[cell(n, s) for n, s in attributes.items()])))
    return long.where(F.col("code_value").isNotNull() | F.col("label_value").isNotNull())


def first_match(text: Column, rules: Sequence[tuple[str, object]], otherwise: object = None) -> Column:
    """The value of the first (pattern, value) whose pattern is found in the text; the order is the policy. Null text: otherwise."""
    last = F.lit(otherwise)
    return reduce(lambda rest, rule: F.when(text.rlike(rule[0]), F.lit(rule[1])).otherwise(rest), reversed(list(rules)), last)


# Schemes of held securities by format, first match wins.
IDENTIFIER_RULES = [
    ("^$", "cnn:NoIdentifierProvided", "absent", False),
    ("^[A-Z]{2}[A-Z0-9]{9}[0-9]$", "cnn:IsinIdentifier", "format_matched", True),
    ("^[0-9]{6}$", "cnn:KrxShortCodeIdentifier", "format_matched", True),
    ("^[A-Z0-9]{6}$", "cnn:SourceTickerIdentifierRaw", "unverified_scheme", False),
    (".*", "cnn:SourceDeclaredIdentifierRaw", "unverified_scheme", False),
]
OFFICIAL_RULES = [("^[A-Za-z]*0+$", "placeholder"), (".*", "declared_by_source")]
RELATION_RULES = [
    ("public_fund", r"\[level([0-9]+):direct\]", "direct_holding", None),
    ("public_fund", r"\[level([0-9]+):lookthrough parent=([^\]]+)\]", "look_through_exposure", 2),
    ("domestic_etp", ".", "direct_holding", None),
    ("overseas_etp", ".", "direct_holding", None),
]


def classify_identifier(raw: Column) -> tuple[Column, Column, Column]:
    """(scheme, status, promote) of an identifier by format; null and blank are absent."""
    text = F.coalesce(F.trim(raw), F.lit(""))
    return tuple(first_match(text, [(r[0], r[i]) for r in IDENTIFIER_RULES]) for i in (1, 2, 3))


def official_status(raw: Column) -> Column:
    """absent, placeholder or declared_by_source."""
    text = trim_to_null(raw)
    return F.when(text.isNull(), "absent").otherwise(first_match(text, OFFICIAL_RULES))


def relation_kind(family: Column, source: Column, rules: Sequence[tuple[str, str, str, int | None]] = RELATION_RULES) -> tuple[Column, Column]:
    """(kind, parent): the first rule of the family whose pattern is in the source text; its group names the parent. None: unclassified, null."""
    kind, parent = F.lit("unclassified"), F.lit(None).cast("string")
    for fam, pattern, name, group in reversed(list(rules)):
        hit = (family == fam) & F.coalesce(source.rlike(pattern), F.lit(False))
        kind = F.when(hit, name).otherwise(kind)
        parent = F.when(hit, F.nullif(F.regexp_extract(source, pattern, group), F.lit("")) if group else F.lit(None).cast("string")).otherwise(parent)
    return kind, parent


def remap(c: Column, mapping: dict[str, str]) -> Column:
    """A value by a lookup held in the plan; null where it isn't listed."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]


def bound_predicate(selector: str, selected: str, value: str, status: str = "value_status", valid: str = "valid", as_of: tuple[str, str] | None = None, zero_excluded: bool = False) -> Column:
    """The rows a bound field may be read from: its selector, valid status, a value, optionally one date and no zeros."""
    p = (safe_column(selector) == F.lit(selected)) & (safe_column(status) == F.lit(valid)) & safe_column(value).isNotNull()
    if as_of:
        p &= safe_column(as_of[0]) == F.lit(as_of[1]).cast("date")
    return p & (safe_column(value) != 0) if zero_excluded else p


def compare(column: Column, operator: str, value: object, role: str = "measure") -> Column:
    """A predicate by operator name; the field's role must permit it."""
    if operator not in ROLE_OPERATIONS.get(role, []):
        raise ValueError(f"{operator!r} isn't permitted on {role!r}")
    v = F.lit(value) if not isinstance(value, (list, tuple, set)) else None
    ops = {"eq": lambda: column == v, "ne": lambda: column != v, "lt": lambda: column < v, "lte": lambda: column <= v, "gt": lambda: column > v, "gte": lambda: column >= v,
           "in": lambda: column.isin(list(value)), "contains": lambda: F.contains(column, v)}
    if operator not in ops:
        raise ValueError(f"{operator!r} is no predicate")
    return ops[operator]()


def conflict(a: Column, b: Column) -> Column:
    """Both there and different."""
    return a.isNotNull() & b.isNotNull() & (a != b)
