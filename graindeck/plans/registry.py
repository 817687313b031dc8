"""A register of queries, each with the SQL of the same result where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graindeck.sources.tables import table

def by_key(name: str) -> str:
    """SQL of a table whose subject_key is in the spelling that ``subject`` has (folded where it isn't listed)."""
    fold = r"lower(regexp_replace({}, '\s', '', 'g'))"
    return (f"(SELECT m.* REPLACE (coalesce(o.own, {fold.format('m.subject_key')}) AS subject_key) FROM {name} m LEFT JOIN (SELECT {fold.format('subject_key')} AS folded, min(subject_key) AS own FROM subject GROUP BY 1) o "
            f"ON o.folded = {fold.format('m.subject_key')})")


Query = Callable[[SparkSession, str], DataFrame]


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Callable], Query]:
        """Register ``f(t)``, t giving a table by name, under its own name; ``sql`` is its oracle."""

        def wrap(f: Callable) -> Query:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: table(spark, sf_dir, name))

            query.__name__, query.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = query
            if sql:
                self.oracles[f.__name__] = sql
            return query

        return wrap
