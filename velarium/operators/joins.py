"""Joins: look-ups, semi and anti joins, interval overlap, similarity and window matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.functions import numbers, text


def with_children(parents: DataFrame, key: str, **children: tuple[DataFrame, list[str]]) -> DataFrame:
    """Parents with an array of each kind of child rows, in the given order; an empty array where there are none.

    The result row holds all children of a parent, which is what the operator is for.
    """
    out = parents
    for name, (rows, order) in children.items():
        cols = order + [c for c in rows.columns if c not in (*order, key)]
        g = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(g, key, "left").withColumn(name, F.coalesce(name, F.array().cast(g.schema[name].dataType)))
    return out


def interval_overlap(left: DataFrame, right: DataFrame, on: str, start: str, end: str, width: int = 1024) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap: ``right`` columns get the suffix ``_r``.

    Both sides are laid on bins of ``width``; a pair is kept in the bin of its overlap's start only,
    so no pair comes twice and a key with very many intervals spreads over its bins.
    """
    r = right.select(*[F.col(c).alias(c if c == on else f"{c}_r") for c in right.columns])
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    a = left.where((F.col(end) > F.col(start))).withColumn("_bin", bins(start, end))
    b = r.where(F.col(f"{end}_r") > F.col(f"{start}_r")).withColumn("_bin", bins(f"{start}_r", f"{end}_r"))
    j = a.join(b, [on, "_bin"]).where((F.col(start) < F.col(f"{end}_r")) & (F.col(end) > F.col(f"{start}_r")))
    return j.where(F.col("_bin") == F.floor(F.greatest(start, f"{start}_r") / width)).drop("_bin")


def sharing(df: DataFrame, key: str, items: Column, least: int, within: str | None = None) -> DataFrame:
    """Pairs of rows, smaller key first, that share at least ``least`` items (within one group if named).

    Prefix filter: with items ordered from rare to common, two rows that share ``least`` items share
    one that is not among the ``least - 1`` most common of either, so only those are joined on.
    """
    cols = [key] + ([within] if within else [])
    x = df.select(*cols, F.explode(F.array_distinct(items)).alias("_item"))
    freq = x.groupBy("_item").agg(F.count(F.lit(1)).alias("_f"))
    sets = x.join(freq, "_item").groupBy(*cols).agg(F.sort_array(F.collect_list(F.struct("_f", "_item"))).alias("_a")).where(F.size("_a") >= least)
    sets = sets.withColumn("_a", F.col("_a._item"))
    head = sets.select(*cols, "_a", F.explode(F.slice("_a", 1, F.size("_a") - (least - 1))).alias("_item"))
    other = head.select(F.col(key).alias("_k"), F.col("_a").alias("_b"), "_item", *([within] if within else []))
    pairs = head.join(other, ["_item"] + ([within] if within else [])).where(F.col(key) < F.col("_k"))
    common = F.size(F.array_intersect("_a", "_b"))
    return pairs.select(F.col(key).alias("src"), F.col("_k").alias("dst"), common.alias("n_shared")).where(F.col("n_shared") >= least).distinct()


def similar(df: DataFrame, key: str, vector: str, within: str, least: float, rows: int = 4_096) -> DataFrame:
    """Pairs within a group, smaller key first, whose cosine is at least ``least``; exact for any threshold.

    Each group is cut into as many hash blocks as it has ``rows`` rows, and blocks meet pairwise: a
    group that holds much of all rows is compared by many tasks, each with a part of bounded size, and
    a row is copied once for each block of its own group only.
    """
    sizes = df.groupBy(within).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias("_k"))
    x = df.join(sizes, within)
    b = F.pmod(F.xxhash64(key), F.col("_k"))
    j = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_j")
    x = x.select(F.col(key).alias("_id"), within, F.col(vector).alias("_u"), numbers.norm(F.col(vector)).alias("_n"), b.alias("_b"), j).withColumn("_lo", F.least("_b", "_j")).withColumn("_hi", F.greatest("_b", "_j"))
    y = x.select(F.col("_id").alias("_id2"), within, F.col("_u").alias("_v"), F.col("_n").alias("_m"), F.col("_b").alias("_b2"), "_lo", "_hi")
    met = x.join(y, [within, "_lo", "_hi"]).where((F.col("_id") < F.col("_id2")) & ((F.col("_lo") == F.col("_hi")) | (F.col("_b") != F.col("_b2"))))
    return met.select(F.col("_id").alias("src"), F.col("_id2").alias("dst"), numbers.scaled_dot(F.col("_u"), F.col("_v"), F.col("_n") * F.col("_m")).alias("weight")).where(F.col("weight") >= least)


def window_votes(corpus: DataFrame, probes: DataFrame, width: int = 25) -> DataFrame:
    """``(probe_id, doc_id, n)``: probes matched to documents by windows of ``width`` words.

    Documents give every ``width``-th window, probes every window, so any common stretch of
    ``2 width - 1`` words meets; equal hashes are checked on the text.
    """
    toks = lambda c: text.words(F.col(c))

    def wins(df: DataFrame, stride: int) -> DataFrame:
        n = F.size("a") - (width - 1)
        s = df.where(F.size("a") >= width).select("*", F.explode(F.sequence(F.lit(1), n, F.lit(stride))).alias("i"))
        return s.withColumn("w", F.array_join(F.slice("a", F.col("i"), width), " ")).drop("a", "i")

    d = wins(corpus.select("doc_id", toks("text").alias("a")), width).distinct().withColumn("h", F.xxhash64("w"))
    p = wins(probes.select("probe_id", toks("text").alias("a")), 1).distinct().withColumn("h", F.xxhash64("w"))
    return p.join(d.withColumnRenamed("w", "w2"), "h").where("w = w2").groupBy("probe_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
