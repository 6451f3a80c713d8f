"""Ordered analytics over steps and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The last ``k`` rows of each group, numbered from the latest."""
    return df.withColumn("age", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col("age") <= k)


def signatures(steps: DataFrame, key: str = "trajectory_id", name: str = "action_name") -> DataFrame:
    """``(key, sig)``: the names of a sequence in order, joined by arrows. The result row holds the whole sequence."""
    g = steps.where(F.col(name).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("step_number", "step_id", F.col(name).alias("name")))).alias("a"))
    return g.select(key, F.array_join(F.col("a.name"), "->").alias("sig"))


def revisits(df: DataFrame, keys: list[str], stage: str, order: list[str], most: int) -> DataFrame:
    """Rows at which a stage is visited once more than ``most`` times since the counter was last reset."""
    w = Window.partitionBy(*keys, stage).orderBy(*order)
    return df.withColumn("visit", F.row_number().over(w).cast("bigint")).where(F.col("visit") % (most + 1) == 0)


def runs(df: DataFrame, keys: list[str], order: list[str], value: Column, least: int = 1) -> DataFrame:
    """``(keys, value, first, last, n)`` of each run of equal values in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    m = df.withColumn("v", value).withColumn("new", F.coalesce((~F.col("v").eqNullSafe(F.lag("v").over(w))).cast("int"), F.lit(1)))
    m = m.withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("new"))).withColumn("island", F.sum("new").over(w))
    o = F.struct(*order)
    return m.groupBy(*keys, "island").agg(F.first("v").alias("value"), F.min(o).alias("first"), F.max(o).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("island")


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> Column:
    """Mean of the row and the ``width - 1`` before it, nulls ignored."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width - 1), 0))


def drift(df: DataFrame, key: str, order: list[str], value: str, base: int = 50, sigmas: float = 1.5) -> DataFrame:
    """Per sequence: baseline mean and deviation of its first ``base`` values, and whether the mean of the last ``base`` lies below."""
    w = Window.partitionBy(key)
    r = df.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    g = r.groupBy(key).agg(F.max("n").alias("n"), F.avg(F.when(F.col("i") <= base, F.col(value))).alias("mu"), F.stddev_pop(F.when(F.col("i") <= base, F.col(value))).alias("sigma"), F.avg(F.when(F.col("i") > F.col("n") - base, F.col(value))).alias("recent"))
    low = F.when(F.col("sigma") == 0, F.col("recent") < F.col("mu")).otherwise(F.col("recent") < F.col("mu") - sigmas * F.col("sigma"))
    return g.where(F.col("n") >= base).select(key, F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), F.round("recent", 6).alias("recent"), low.cast("int").alias("drifted"))


def order_position(df: DataFrame, score: Column, tie: str) -> DataFrame:
    """Rows with ``rank0``, their position from 0 by score.

    Rows are put into ranges of scores by a hundred approximate percentiles, counted by range, and
    numbered within theirs, so no task orders more than one range. The ranges depend on the score
    only, so a repeated task numbers its rows alike.
    """
    s = df.withColumn("_s", score)
    cuts = s.agg(F.percentile_approx("_s", [i / 100 for i in range(1, 100)]).alias("_q"))  # one row
    s = s.crossJoin(F.broadcast(cuts)).withColumn("_p", F.coalesce(F.size(F.filter("_q", lambda q: q < F.col("_s"))), F.lit(0))).drop("_q")
    counts = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most a hundred rows
    i = F.row_number().over(Window.partitionBy("_p").orderBy("_s", tie)) - 1
    return s.withColumn("_i", i).join(F.broadcast(before.select("_p", "_b")), "_p").withColumn("rank0", F.col("_b") + F.col("_i")).drop("_s", "_p", "_i", "_b")


def tertiles(df: DataFrame, keys: list[str], value: str, names: tuple[str, str, str] = ("low", "mid", "high")) -> DataFrame:
    """Band of each row by the values at positions min(n-1, int(q n)) for q of one and two thirds."""
    from velarium.operators.aggregates import at_index

    at = lambda q: F.least(F.col("n") - 1, F.floor(F.col("n") * q))
    cut = at_index(df, keys, value, {"t1": at(1 / 3), "t2": at(2 / 3)})
    joined = df.where(F.col(value).isNotNull()).join(cut, keys) if keys else df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(cut))
    return joined.withColumn("band", F.when(F.col(value) < F.col("t1"), names[0]).when(F.col(value) < F.col("t2"), names[1]).otherwise(names[2])).drop("t1", "t2")


def cap_per_cell(df: DataFrame, cell: list[str], key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each cell, by the order of a seeded hash; a sampling operator."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy(h, key))).where(F.col("_r") <= most).drop("_r")


#: Words that tell a failed result. Fixed values.
FAILED = "error|exception|invalid"


def self_correction(steps: DataFrame) -> DataFrame:
    """``(trajectory_id, scsr)``: of the tool steps that failed, the share followed by a tool step that didn't; 1 without failures.

    A step stored twice counts once (the first by ``step_id``).
    """
    s = steps.where("is_tool_step").groupBy("trajectory_id", "step_number").agg(F.min_by(F.coalesce("observation", F.lit("")), "step_id").alias("o"))
    s = s.withColumn("bad", F.lower("o").rlike(FAILED))
    s = s.withColumn("next", F.lead("bad").over(Window.partitionBy("trajectory_id").orderBy("step_number")))
    n = F.count_if("bad")
    return s.groupBy("trajectory_id").agg(F.round(F.when(n == 0, 1.0).otherwise(F.count_if(F.col("bad") & ~F.col("next")) / n), 6).alias("scsr"))


def call_redundancy(calls: DataFrame) -> DataFrame:
    """``(trajectory_id, arr, ter)``: share of calls that repeat an earlier one, and of results that differ (null without results)."""
    call = F.struct(F.coalesce("tool_name", F.lit("\u0000")), F.coalesce("query", F.lit("\u0000")))
    arr, ter = 1 - F.count_distinct(call) / F.count(F.lit(1)), F.count_distinct(F.trim("result")) / F.nullif(F.count("result"), F.lit(0))
    return calls.groupBy("trajectory_id").agg(F.round(arr, 6).alias("arr"), F.round(ter, 6).alias("ter"))


def reasoning_density(steps: DataFrame) -> DataFrame:
    """``(trajectory_id, rad)``: letters of thoughts to letters of arguments, which count as an empty list at least."""
    total = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0))
    return steps.groupBy("trajectory_id").agg(F.round(total("thought") / F.greatest(F.lit(2), total("action_args_json")), 6).alias("rad"))


def plan_adherence(calls: DataFrame, plan: tuple[str, ...]) -> DataFrame:
    """``(trajectory_id, pas)``: share of calls whose tool's name holds a step of the plan, in any case."""
    n = F.lower(F.coalesce("tool_name", F.lit("")))
    hit = F.lit(False)
    for p in plan:
        hit = hit | n.contains(p.lower())
    return calls.groupBy("trajectory_id").agg(F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("pas"))


def step_efficiency(calls: DataFrame, golden: DataFrame) -> DataFrame:
    """``(trajectory_id, ase)``: golden number of calls ``n_tool_calls`` to calls made."""
    t = golden.groupBy("trajectory_id").agg(F.max("n_tool_calls").alias("n_tool_calls"))
    n = calls.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(t, "trajectory_id").select("trajectory_id", F.round(F.col("n_tool_calls") / F.col("n"), 6).alias("ase"))


def unigram_recall(prediction: Column, gold: Column) -> Column:
    """Share of gold's different words in the prediction; 0 without words in gold."""
    from velarium.functions.text import words

    p, g = F.array_distinct(words(F.coalesce(prediction, F.lit("")))), F.array_distinct(words(gold))
    return F.round(F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(p, g)) / F.size(g)), 6)


def pool_sizes(df: DataFrame, group: str, order: list[str], steps: tuple[int, ...], warm: int = 10, full: int = 70, least: float = 0.3) -> DataFrame:
    """``(step, pool)``: rows open at each training step, the easiest of each group first: ``least`` of it till ``warm``, all from ``full``, linear between; at least one."""
    w = Window.partitionBy(group)
    r = df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    share = F.when(F.col("step") < warm, least).when(F.col("step") >= full, 1.0).otherwise(least + (1 - least) * (F.col("step") - warm) / float(full - warm))
    return r.select("rn", "n", F.explode(F.array(*[F.lit(x) for x in steps])).alias("step")).groupBy("step").agg(F.count_if(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))).alias("pool"))


def chain_order(steps: DataFrame, chain: tuple[str, ...]) -> DataFrame:
    """``(trajectory_id, chain)``: how far the tools of a chain come in its order, as a share. The names of a trajectory meet in one row."""
    s = steps.where(F.col("action_name").isNotNull()).groupBy("trajectory_id").agg(F.sort_array(F.collect_list(F.struct("step_number", "step_id", "action_name"))).alias("a"))
    want, n = F.array(*[F.lit(e) for e in chain]), len(chain)
    i = F.aggregate("a.action_name", F.lit(0), lambda i, x: F.when((i < n) & (x == F.element_at(want, F.least(i + 1, F.lit(n)))), i + 1).otherwise(i))
    return s.select("trajectory_id", (i / float(n)).alias("chain"))


def recency(df: DataFrame, key: str, time: str, unit: float = 86400.0) -> DataFrame:
    """``(key, recency)``: halved for each ``unit`` of seconds between a key's newest time and the newest of all."""
    t = df.where(F.col(time).isNotNull()).groupBy(key).agg(F.max(time).alias("t"))
    return t.crossJoin(F.broadcast(t.agg(F.max("t").alias("now")))).select(key, F.round(F.pow(F.lit(0.5), F.col("now") / unit - F.col("t") / unit), 6).alias("recency"))
