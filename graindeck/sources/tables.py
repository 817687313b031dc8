"""Named parquet tables and the spelling of their keys."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory: ``{sf_dir}/{name}.parquet``, a file or a directory of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded_key(key: str | Column) -> Column:
    """A key without white space and case, under which every spelling of one key is equal. Null stays null."""
    c = F.col(key) if isinstance(key, str) else key
    return F.lower(F.regexp_replace(c, r"[\s\u00a0\u200b\u3000\ufeff]", ""))


def with_own_spelling(df: DataFrame, folded: str, entities: DataFrame, key: str, out: str) -> DataFrame:
    """Put the spelling that ``entities.key`` has into ``out``; a key not listed there keeps its folded form.

    ``df`` should be grouped by ``folded`` already: the join then carries one row per key.
    """
    names = entities.select(folded_key(key).alias(folded), F.col(key).alias("__own")).where(F.col(folded).isNotNull())
    names = names.groupBy(folded).agg(F.min("__own").alias("__own"))
    return df.join(names, folded, "left").withColumn(out, F.coalesce("__own", folded)).drop("__own", folded)


def folded_subjects(df: DataFrame) -> DataFrame:
    """``df`` with every spelling of a subject_key folded to one."""
    return df.withColumn("subject_key", folded_key("subject_key"))


def own_subjects(df: DataFrame, subjects: DataFrame) -> DataFrame:
    """Folded subject_keys back in the spelling of ``subjects``."""
    return with_own_spelling(df.withColumnRenamed("subject_key", "__folded"), "__folded", subjects, "subject_key", "subject_key").select(*df.columns)


def finite(c: str | Column) -> Column:
    """Not null, not NaN, not infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
