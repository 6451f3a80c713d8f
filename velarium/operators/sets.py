"""Deduplication, splits, upserts and multiset equality."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key; a map-side aggregate, so frequent keys shrink before the shuffle."""
    cols = df.columns
    g = df.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return g.select(*[F.col("_r")[c].alias(c) for c in cols])


def text_key(c: Column) -> Column:
    """Hash of a text in lower case with single blanks: the first 16 hex digits of its SHA-1."""
    return F.substring(F.sha1(F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))), 1, 16)


def title_of(c: Column, most: int = 120) -> Column:
    """The first line with text, cut to ``most`` characters."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), F.trim), lambda x: x != "")
    return F.substring(F.coalesce(F.get(lines, 0), F.lit("")), 1, most)


def hash_share(key: Column, seed: int | str) -> Column:
    """A number from 0 to 1 that depends on a seed and a key only: eight hex digits of a SHA-1."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967295.0


def hash_split(df: DataFrame, key: str, seed: int, validation: float) -> DataFrame:
    """Rows with ``split``, train or val; equal keys never part."""
    return df.withColumn("split", F.when(hash_share(F.col(key), seed) < validation, "val").otherwise("train"))


def group_split(df: DataFrame, group: str, seed: int, validation: float) -> DataFrame:
    """Whole groups to validation, in hash order, until they hold the wanted share of rows; rows without a group to train."""
    n = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    h = n.withColumn("_h", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))))
    total = h.agg(F.sum("_n").alias("_t"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_h", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a group, not a row of data
    pick = h.withColumn("_b", before).crossJoin(F.broadcast(total)).where(F.col("_b") < validation * F.col("_t")).select(group, F.lit("val").alias("_s"))
    return df.join(pick, group, "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s")


#: Parts of split names, in the order they are tried. Fixed values.
SPLIT_NAMES = (("train", ("train",)), ("validation", ("val", "dev")), ("test", ("test", "heldout", "held-out")))


def split_name(name: str) -> str:
    """The usual name of a split; 'eval' has 'val' in it and so becomes validation."""
    low = name.lower()
    return next((k for k, parts in SPLIT_NAMES if any(p in low for p in parts)), name)


def make_splits(df: DataFrame, key: str, seed: int = 0, test: float = 0.1, validation: float = 0.1) -> dict[str, DataFrame]:
    """Train, validation and test rows by a seeded hash of the key; fewer than three rows stay in train."""
    if df.select(key).limit(3).count() < 3:
        return {"train": df}
    u = hash_share(F.col(key), seed)
    return {"test": df.where(u < test), "validation": df.where((u >= test) & (u < test + validation)), "train": df.where(u >= test + validation)}


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both have, counted; 0 for splits without leaks."""
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("n_common"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows replaced by key; rows of the update that share a key: the last by all columns."""
    new = first_per_key(rows, F.col(key), [c for c in rows.columns if c != key])
    return table.join(new.select(key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def upsert_children(children: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """Children with those of the updated parents replaced, so that storing twice doubles nothing."""
    return children.join(rows.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(rows.select(*children.columns))


def same_rows(a: DataFrame, b: DataFrame, columns: list[str] | None = None, places: int = 6) -> bool:
    """Whether two results hold the same rows as multisets; doubles to ``places`` decimals."""
    if len(a.columns) != len(b.columns):
        return False

    def plain(df: DataFrame) -> DataFrame:
        t = dict(df.dtypes)
        return df.select(*[(F.round(c, places) if t[c] in ("double", "float") or t[c].startswith("decimal") else F.col(c)).cast("string").alias(f"c{i}") for i, c in enumerate(columns or df.columns)])

    x, y = plain(a), plain(b if columns is None else b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def same_rows_any_order(a: DataFrame, b: DataFrame, most: int = 6) -> bool:
    """``same_rows`` for some order of the second's columns, tried for up to ``most`` columns."""
    if len(a.columns) != len(b.columns):
        return False
    if len(b.columns) > most:
        return same_rows(a, b)
    return any(same_rows(a, b.select(*p)) for p in itertools.permutations(b.columns))
