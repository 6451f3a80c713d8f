"""Graphs of chunks and memories: components, paths, neighbourhoods, pruning.

Links and labels stay distributed; each round of an iteration is written to the checkpoint folder,
so neither plans nor lost executors make it start over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velarium.session import kept


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)``: the least node that each node is connected with.

    Alternates large-star and small-star steps: neighbours are linked to the least node known, so
    chains shorten by halves and rounds grow with the logarithm of the longest. A node with very
    many links is only ever aggregated with a minimum, and its links are rewritten row by row. It goes
    on until no link changes; each round runs a job when the operator is called.
    """
    e = edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("u"), F.col(dst).alias("v")).distinct()
    e = kept(e)
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min(F.least("v", "u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = kept(small.where("u <> v").distinct())
        same = new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty()
        e = new
        if same:
            break
    nodes = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst))).where("node is not null").distinct()
    label = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def simple_paths(edges: DataFrame, hops: int, per_pair: int | None = None) -> DataFrame:
    """``(src, dst, path, n_hops)``: paths of 2 to ``hops`` edges that visit no node twice, edges taken both ways.

    ``per_pair`` is the operator's bound: of the paths of one length between two ends so many go on,
    the first by their nodes, and of each pair of ends so many come out, the shortest. It holds at
    every hop, so a dense part never gives more than that for each pair. Ends come smaller first. Loops
    and repeated edges don't count; no edges give no paths.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    step = both.select(F.col("src").alias("end"), F.col("dst").alias("next"))
    p, out = both.select("src", F.col("dst").alias("end"), F.array("src", "dst").alias("path")), None
    for n in range(2, hops + 1):
        p = p.join(step, "end").where(~F.array_contains("path", F.col("next"))).select("src", F.col("next").alias("end"), F.array_append("path", F.col("next")).alias("path"))
        if per_pair:
            p = kept(p.withColumn("_r", F.row_number().over(Window.partitionBy("src", "end").orderBy("path"))).where(F.col("_r") <= per_pair).drop("_r"))
        now = p.where(F.col("src") < F.col("end")).select("src", F.col("end").alias("dst"), "path", F.lit(n).alias("n_hops"))
        out = now if out is None else out.unionByName(now)
    if per_pair:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("src", "dst").orderBy("n_hops", "path"))).where(F.col("_r") <= per_pair).drop("_r")
    return out


def path_type(types: Column, abstract: tuple[str, ...] = ("similar", "keyphrase")) -> Column:
    """Kind of question a path gives: bridge if all links are exact, else compositional."""
    exact = F.size(F.filter(types, lambda x: x != "exact")) == 0
    vague = F.exists(types, lambda x: x.isin(*abstract))
    return F.when(exact, "bridge/specific").when(vague, "compositional/abstract").otherwise("compositional/specific")


def neighbourhood(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``(seed, node, depth)``: what is reached from each seed in at most ``hops`` directed steps, by least depth, without the seed."""
    step = links.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    front = seeds.select(F.col("node").alias("seed"), "node").distinct()
    found = None
    for depth in range(1, hops + 1):
        front = front.join(step, "node").where(F.col("next") != F.col("seed")).select("seed", F.col("next").alias("node")).distinct()
        now = front.withColumn("depth", F.lit(depth))
        found = now if found is None else found.unionByName(now)
    return found.groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def recall_linked(items: DataFrame, links: DataFrame, text: str, k: int, hops: int = 1, scope: str | None = None) -> DataFrame:
    """``(id, ts)``: memory items reached from those whose content holds ``text`` (any case), newest first, at most ``k``.

    Items are ``(id, content, scope, ts)``. Seeds come from all items and aren't results themselves
    unless reached from another one; ``scope`` only filters results, so that a path may lead through
    other scopes. Null contents match nothing. ``k`` is the read's size.
    """
    seeds = items.where(F.lower("content").contains(text.lower())).select(F.col("id").alias("node"))
    found = neighbourhood(links, seeds, hops).select(F.col("node").alias("id")).distinct()
    allowed = items if scope is None else items.where(F.col("scope") == scope)
    return allowed.select("id", "ts").distinct().join(found, "id", "left_semi").orderBy(F.desc_nulls_last("ts"), "id").limit(k)


def forget(nodes: DataFrame, links: DataFrame, keep: Column, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes that ``keep`` holds for, and links whose both ends stay."""
    left = nodes.where(keep)
    ids = left.select(key)
    return left, links.join(ids.withColumnRenamed(key, "src"), "src", "left_semi").join(ids.withColumnRenamed(key, "dst"), "dst", "left_semi").select(*links.columns)


def pack(sizes: DataFrame, target: float) -> DataFrame:
    """``(component, n, split)``: components to validation, largest first, while that brings validation nearer to ``target`` of all rows.

    Components of one size are alike, so what comes before each is found from the counts by size (few
    rows, whatever the number of components) and its place among those of its size.
    """
    total = sizes.agg(F.sum("n").alias("t"))
    small = sizes.crossJoin(F.broadcast(total)).where(F.col("n") <= 2 * target * F.col("t"))
    by_size = small.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    above = by_size.withColumn("above", F.coalesce(F.sum(F.col("n") * F.col("c")).over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("n", "above")
    taken = _places(small).join(above, "n").withColumn("before", F.col("above") + F.col("n") * F.col("place"))
    val = taken.where(F.abs(F.col("before") + F.col("n") - target * F.col("t")) <= F.abs(F.col("before") - target * F.col("t"))).select("component", F.lit("val").alias("s"))
    return sizes.join(val, "component", "left").select("component", "n", F.coalesce("s", F.lit("train")).alias("split"))


def _places(rows: DataFrame) -> DataFrame:
    """Rows with ``place``, from 0, among those of their ``n`` by component: sorted by range, then numbered within each part and shifted by what the parts before hold."""
    s = kept(rows.repartitionByRange("n", "component").sortWithinPartitions("n", "component")).withColumn("_p", F.spark_partition_id())
    counts = s.groupBy("n", "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.partitionBy("n").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("n", "_p", "_b")
    i = F.row_number().over(Window.partitionBy("n", "_p").orderBy("component")) - 1
    return s.withColumn("_i", i).join(before, ["n", "_p"]).withColumn("place", F.col("_b") + F.col("_i")).drop("_p", "_b", "_i")
