"""Text functions of matching: normal forms, alignment, occurrences, fragments, literals."""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: signs that retrieval normalisation drops beside white space.
DROPPED = "_·ㆍ・"


@F.pandas_udf(StringType())
def _retrieval(s: pd.Series) -> pd.Series:
    drop = re.compile(rf"[\s{DROPPED}]+")
    return s.map(lambda x: None if x is None else drop.sub("", unicodedata.normalize("NFKC", x).casefold()))


@F.pandas_udf(StringType())
def _span(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()))


def retrieval_normal(c: Column) -> Column:
    """NFKC, casefold, without white space and the signs dropped. Pure ASCII stays in the JVM."""
    ascii_only = c.rlike(r"^[\x00-\x7f]*$")
    return F.when(ascii_only, F.lower(F.regexp_replace(c, r"[\s_\x1c-\x1f]+", ""))).otherwise(_retrieval(F.when(~ascii_only, c)))


def span_normal(c: Column) -> Column:
    """NFKC, white space collapsed and stripped. Pure ASCII stays in the JVM."""
    ascii_only = c.rlike(r"^[\x00-\x7f]*$")
    return F.when(ascii_only, F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f]+", " "))).otherwise(_span(F.when(~ascii_only, c)))


def alignment(text: Column, span: Column, text_normal: Column | None = None, span_normal_: Column | None = None) -> Column:
    """exact, normalized or not_in_question: where a quoted span stands in its text."""
    tn, sn = (text_normal, span_normal_) if text_normal is not None else (span_normal(text), span_normal(span))
    return F.when(F.contains(text, span), "exact").when(F.contains(tn, sn), "normalized").otherwise("not_in_question")


def occurrences(text: Column, part: Column) -> Column:
    """0-based starts of every occurrence, overlapping ones too; empty for an empty part."""
    last = F.length(text) - F.length(part)
    starts = F.when((F.length(part) > 0) & (last >= 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.substring(text, i + 1, F.length(part)) == part)


def longest_fragment(form: Column, question: Column, min_chars: int, ratio: float) -> Column:
    """The longest proper fragment of a form that the question contains, leftmost of equals, of at least max(min_chars, ceil(ratio x length))
    characters; null if there is none."""
    n = F.length(form)
    need = F.greatest(F.lit(min_chars), F.ceil(F.lit(ratio) * n)).cast("int")
    sizes = F.when((need >= 1) & (need < n), F.sequence(n - 1, need, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    found = F.filter(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(form, i, k)))), lambda f: F.contains(question, f))
    return F.try_element_at(found, F.lit(1))


def coverage_score(overlap: Column, length: Column) -> Column:
    return F.when(length > 0, F.least(F.lit(1.0), overlap / length)).otherwise(F.lit(0.0))


def covers(expected: Column, returned: Column) -> Column:
    """Is every expected entry among the returned?"""
    return F.size(F.array_except(expected, returned)) == 0


def zero_like(c: Column) -> Column:
    """The number zero written out, one to five digits; 0e0 isn't."""
    return F.trim(c).isin("0", "0.0", "0.00", "0.000", "0.0000")


def loose_literal(c: Column) -> Column:
    """A literal without spaces, commas and unit words."""
    return F.regexp_replace(c, r"(\s|,|%|퍼센트|pct|bps|bp|원|달러|엔|유로)", "")


def expand_note(notes: DataFrame, note: str, columns: DataFrame, name: str) -> DataFrame:
    """(<name>, pattern): the columns that the exact names and * globs of a note mean. Notes and column lists are small."""
    patterns = notes.select(F.explode(F.split(note, r"\s*[,;]\s*")).alias("pattern")).where(F.col("pattern") != "")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.+?()\[\]{}|^$\\])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    return columns.join(F.broadcast(patterns.withColumn("rx", regex)), F.expr(f"regexp_like({name}, rx)")).select(name, "pattern")


def token_estimate(c: Column) -> Column:
    """Tokens of a payload by rule of thumb: one per CJK character, one per four others (rounded up)."""
    other = F.length(F.regexp_replace(c, r"[\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", ""))
    return (F.length(c) - other + F.ceil(other / 4)).cast("bigint")
