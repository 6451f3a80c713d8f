"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.session import kept

__all__ = ["BLANK", "has_text", "kept", "one_row_per", "spread", "table", "tasks"]

#: White space as the project defines it: blanks, tabs, line ends, no-break and zero-width spaces.
BLANK = "[\\s\\u00a0\\u200b\\u200c\\u200d\\u2060\\ufeff\\u2000-\\u200a\\u202f\\u205f\\u3000]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Tasks for a stage that is bound by Python: a few waves over the cores, more if the session shuffles wider."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over enough tasks for Python work; keyed, so that a repeated task gets the same rows."""
    n = tasks(df.sparkSession)
    return df.repartition(n, *[F.xxhash64(*keys)] if keys else [])


def has_text(col):
    """True where a string has more than white space."""
    return F.coalesce(F.length(F.regexp_replace(col, BLANK, "")) > 0, F.lit(False))


def one_row_per(df: DataFrame, key: str, *order) -> DataFrame:
    """One whole row for each key, the first by ``order``; null keys are left out.

    A map-side aggregate, so a key that holds a third of all rows is reduced before the shuffle.
    """
    cols = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*cols), F.struct(*order)) if order else F.min(F.struct(*cols))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in cols])
