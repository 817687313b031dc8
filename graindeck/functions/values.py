"""Text read as typed values (Column builders). What isn't a value of the type gives null, never an error."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries that state no value, yes and no, placeholder days.
NO_VALUE_WORDS = ["", "-", "--", "—", "–", ".", "?", "n/a", "na", "n.a.", "n.a", "#n/a", "tbd", "tba", "none", "null", "nil", "nan", "unknown", "not available",
                  "미정", "미확인", "확인중", "확인 중", "해당없음", "해당 없음", "미공시", "없음"]
YES_WORDS = ["y", "yes", "true", "t", "1", "1.0", "예", "여", "o", "on"]
NO_WORDS = ["n", "no", "false", "f", "0", "0.0", "아니오", "아니요", "부", "x", "off"]
PLACEHOLDER_DAYS = ["9999-12-31", "1900-01-01", "1000-12-31", "0001-01-01", "1000-01-01"]

BLANK = r"[\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]"


def trimmed(c: Column) -> Column:
    """Without white space of any kind on either side."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def folded_text(c: Column) -> Column:
    """Trimmed, in lower case, each run of white space one space; null for entries that state no value."""
    t = F.lower(F.regexp_replace(trimmed(c), f"{BLANK}+", " "))
    return F.when(~t.isin(NO_VALUE_WORDS), t)


def number(c: Column) -> Column:
    """A finite number, thousands separators and a percent sign aside."""
    t = F.regexp_replace(c, f"{BLANK}|,", "")
    t = F.regexp_replace(t, "%$|％$", "")
    x = F.when(t.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]{1,3})?$"), t.try_cast("double"))
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def yes_no(c: Column) -> Column:
    t = F.lower(trimmed(c))
    return F.when(t.isin(YES_WORDS), F.lit(True)).when(t.isin(NO_WORDS), F.lit(False))


def day(c: Column) -> Column:
    """A possible day written year first (8 digits, or parted by - . / or the Korean words); placeholder days are none."""
    t = F.regexp_replace(trimmed(c), r"\s*[년월./]\s*", "-")
    t = F.regexp_replace(t, r"\s*일$", "")
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    ok = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{2}:\d{2}.*)?$")
    d = F.when(ok, F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d"))
    return F.when(~d.cast("string").isin(PLACEHOLDER_DAYS), d)


def by_type(c: Column, value_type: str | Column) -> Column:
    """A value in canonical text by its catalog type (string, integer, decimal, boolean, date): equal in meaning, equal in text.

    Numbers are written as doubles, so 1.10 and 1.1 are one value; -0 is 0.
    """
    kind = F.lit(value_type) if isinstance(value_type, str) else value_type
    num = number(c)
    return (F.when(kind == "string", folded_text(c))
            .when(kind.isin("integer", "decimal"), F.when(num == 0, F.lit(0.0)).otherwise(num).cast("string"))
            .when(kind == "boolean", yes_no(c).cast("string"))
            .when(kind == "date", day(c).cast("string")))
