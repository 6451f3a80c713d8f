"""Rewards of answers given as SQL: form of the queries, and whether their results are the gold rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velarium.operators.sets import same_rows_any_order
from velarium.session import kept, query, reads_no_table


def structure(calls: Column, responses: Column) -> Column:
    """0.1 for a call with its response (0.05 for each further kind of turn missing), -0.15 for a call alone, 0 for none."""
    return F.when(calls <= 0, 0.0).when(responses <= 0, -0.15).when(responses < calls, 0.05).otherwise(0.1)


#: Words of a condition that name no column, and those that end it. Fixed values.
KEYWORDS = set("and or not in is null like between exists true false case when then else end as escape glob regexp collate nocase asc desc distinct all any some".split())
ENDS = re.compile(r"\b(?:group\s+by|order\s+by|having|limit|union|intersect|except|window)\b")
_NOISE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?(?:\*/|\Z)", re.DOTALL)


def filters_rows(sql: str | None) -> bool:
    """Whether a statement has a condition that names a column; ``where 1 = 1`` filters nothing."""
    m = re.search(r"(?is)\bwhere\b(.*)", sql or "")
    if not m:
        return False
    clause = ENDS.split(re.sub(r"'(?:[^']|'')*'", " ", m[1].lower()))[0]
    return any(w not in KEYWORDS for w in re.findall(r"[a-z_]\w*", clause))


def sorts_rows(sql: str | None) -> bool:
    """Whether a statement itself sorts its rows, outside any parentheses, strings and comments."""
    t, before = _NOISE.sub(" ", sql or ""), None
    while t != before:
        before, t = t, re.sub(r"\([^()]*\)", " ", t)
    return bool(re.search(r"(?i)\border\s+by\b", t.split("(")[0]))


def checked(sql: Column) -> Column:
    """``(filters, sorts)`` of a statement."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"filters": [filters_rows(x) for x in texts], "sorts": [sorts_rows(x) for x in texts]})

    return F.pandas_udf(run, "struct<filters: boolean, sorts: boolean>")(sql)


def _filtering(queries: Column) -> Column:
    """How many of an array's statements have a condition that names a column."""

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda a: sum(map(filters_rows, a)) if a is not None else 0).astype("int32")

    return F.pandas_udf(run, "int")(queries)


def query_form(queries: Column, failed: Column, agrees: Column) -> Column:
    """Reward of an array of SQL texts: too many (over three) -1.5, ``limit 1`` -1 each, no WHERE -0.5 each, a WHERE 0.4 each up to three, an error -2, none at all -1.5, and 2 or -1.5 for hits that agree with gold or not."""
    where = _filtering(queries)
    one = F.size(F.filter(queries, lambda s: s.rlike(r"(?i)\blimit\s+1\b")))
    score = F.when(F.size(queries) > 3, -1.5).otherwise(0.0) - 1.0 * one - 0.5 * (F.size(queries) - where) + 0.4 * F.least(where, F.lit(3)) + F.when(failed, -2.0).otherwise(0.0) + F.when(agrees, 2.0).otherwise(-1.5)
    return F.when(F.size(queries) == 0, -1.5).otherwise(score)


def numbered(df: DataFrame) -> DataFrame:
    """Rows as ``(place, row)`` in the order they have: numbered within each part, shifted by what the parts before hold."""
    s = kept(df.select(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]), {"ignoreNullFields": "false"}).alias("row"), F.monotonically_increasing_id().alias("i")))
    part = F.shiftright("i", 33).alias("part")
    counts = s.groupBy(part).agg(F.count(F.lit(1)).alias("c"))  # one row for each part
    before = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return s.select("row", "i", part).join(F.broadcast(before), "part").select((F.col("b") + F.col("i").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"), "row")


def same_rows_in_order(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results have the same rows at the same places; nothing but the verdict comes to the driver."""
    if len(a.columns) != len(b.columns):
        return False
    x, y = numbered(a), numbered(b).withColumnRenamed("row", "other")
    return x.join(y, "place", "full").where(~F.col("row").eqNullSafe(F.col("other"))).isEmpty()


def result_match(spark: SparkSession, sql: str | None, gold: DataFrame | str | None, ordered: bool = False) -> float:
    """2 if a statement reads a table and gives gold's rows (columns in any order), else -1; 0 without gold."""
    if gold is None:
        return 0.0
    try:
        if not sql or reads_no_table(spark, sql):
            return -1.0
        want = query(spark, gold) if isinstance(gold, str) else gold
        got = query(spark, sql)
        if ordered:
            return 2.0 if same_rows_in_order(got, want) else -1.0
        return 2.0 if same_rows_any_order(got, want) else -1.0
    except (PySparkException, ValueError):
        return -1.0
