"""Opaque references and content digests."""
from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("ds", "fd", "pr", "en", "cl")


def make_reference(kind: str, key: str, salt: str) -> str:
    """kind_ and 32 hex digits of HMAC-SHA256(salt, kind NUL key)."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    return f"{kind}_{hmac.new(salt.encode(), f'{kind}\0{key}'.encode(), hashlib.sha256).hexdigest()[:32]}"


def reference(kind: str, key: Column, salt: str) -> Column:
    """``make_reference`` of a column (no HMAC in the JVM); null stays null."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else make_reference(kind, x, salt))

    return f(key)


def is_reference(c: Column, kind: str | None = None) -> Column:
    return c.rlike(f"^({kind or '|'.join(KINDS)})_[0-9a-f]{{32}}$")


def content_digest(row_text: Column) -> Column:
    """SHA-256 of a small table's row texts, sorted, so it doesn't depend on the order of rows (an aggregate over a catalog)."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(row_text)), ";"), 256)


def seeded_key(key: Column, seed: int) -> Column:
    """Order by it for a permutation that a seed fixes."""
    return F.xxhash64(F.lit(seed), key)
