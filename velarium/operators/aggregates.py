"""Aggregations of trajectories, logs and metric tables. All are partial-then-final aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velarium.functions import numbers, text


def active_groups(df: DataFrame, key: str, least: int, most: int | None = None) -> DataFrame:
    """Groups with at least ``least`` rows, most first; null and blank keys are left out."""
    g = df.where(F.trim(F.col(key)) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), key)
    return g.limit(most) if most else g


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each value."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))  # one row
    return g.crossJoin(F.broadcast(total)).select(key, "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


def spread_of(df: DataFrame, keys: list[str], value: str, missing: float | None = None) -> DataFrame:
    """Mean, sample and population deviation, least and greatest; a single value deviates by 0."""
    v = F.coalesce(F.col(value), F.lit(missing)) if missing is not None else F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std_sample"), F.round(F.stddev_pop(v), 6).alias("std_population"), F.min(v).alias("least"), F.max(v).alias("greatest")
    )


def at_index(df: DataFrame, keys: list[str], value: str, index: dict[str, Column]) -> DataFrame:
    """``(keys, names of index)``: the value at a position, from 0, of each group's sorted values; ``index`` gives the positions from the count ``n``.

    Values are counted, put into ranges by percentiles of the whole column, and the counts of ranges tell
    in which one a position lies; only those are sorted, so no task sorts a whole group. Nulls are left out.
    """
    v = df.where(F.col(value).isNotNull())
    cuts = v.agg(F.percentile_approx(value, [i / 100 for i in range(1, 100)]).alias("_q"))  # one row
    c = v.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(cuts))
    c = c.withColumn("_r", F.coalesce(F.size(F.filter("_q", lambda q: q < F.col(value))), F.lit(0))).drop("_q")
    w = Window.partitionBy(*keys)  # at most a hundred ranges a group
    ranges = c.groupBy(*keys, "_r").agg(F.sum("_c").alias("_s")).withColumn("_b", F.sum("_s").over(w.orderBy("_r")) - F.col("_s")).withColumn("n", F.sum("_s").over(w))
    ranges = ranges.withColumns({f"_i{k}": i.cast("bigint") for k, i in index.items()})
    held = lambda k: (F.col(f"_i{k}") >= F.col("_b")) & (F.col(f"_i{k}") < F.col("_b") + F.col("_s"))
    hit = F.lit(False)
    for k in index:
        hit = hit | held(k)
    mine = ranges.where(hit).withColumnsRenamed({k: f"_{k}" for k in (*keys, "_r")})
    same = F.col("_r") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    r = c.join(mine, same).withColumn("_upto", F.col("_b") + F.sum("_c").over(Window.partitionBy(*keys, "_r").orderBy(value)))
    return r.groupBy(*keys).agg(*[F.min(F.when(held(k) & (F.col("_upto") > F.col(f"_i{k}")), F.col(value))).alias(k) for k in index])


def index_percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50 = sorted[int(n/2)] and p95 = sorted[max(0, int(0.95 n) - 1)]: picks by index, not interpolated."""
    n = F.col("n")
    return at_index(df, keys, value, {"p50": F.floor(n * 0.5), "p95": F.greatest(F.lit(0), F.floor(n * 0.95) - 1)})


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: Column, places: int = 4) -> DataFrame:
    """Weighted mean of the values that aren't null; null without weight."""
    w = F.when(F.col(value).isNotNull(), weight)
    return df.groupBy(*keys).agg(F.round(F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0)), places).alias("weighted_mean"))


def composed_reward(components: DataFrame, key: str, name: str, score: str, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of named scores with weights that sum to 1; a missing score counts 0."""
    if sum(weights.values()) <= 0:
        raise ValueError("weights must have a positive sum")
    total = float(sum(weights.values()))
    w = F.coalesce(*[F.when(F.col(name) == k, F.lit(v / total)) for k, v in weights.items()], F.lit(0.0))
    return components.groupBy(key).agg(F.round(F.sum(w * F.coalesce(score, F.lit(0.0))), 6).alias("reward"))


def cost_per_group(df: DataFrame, key: str, cost: str) -> DataFrame:
    """Mean over the groups whose summed cost is positive."""
    return df.groupBy(key).agg(F.sum(cost).alias("c")).where("c > 0").agg(F.round(F.avg("c"), 6).alias("cost_per_group"), F.count(F.lit(1)).alias("n_groups"))


def dominant(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The most frequent kind of each group and its share; of equals the first by name."""
    c = df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(*keys).agg(F.max_by(kind, F.struct(F.col("c"), F.col("c") * 0)).alias("_"), F.min(F.struct((-F.col("c")).alias("c"), F.col(kind).alias("k"))).alias("top"), F.sum("c").alias("n")).select(*keys, F.col("top.k").alias("dominant"), F.round(-F.col("top.c") / F.col("n"), 4).alias("share"))


def distinct_ratio(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Different values over all values."""
    return df.groupBy(*keys).agg(F.round(F.count_distinct(value) / F.count(value), 6).alias("ratio"))


def ngram_diversity(df: DataFrame, keys: list[str], col: str, n: int = 4) -> DataFrame:
    """Different over all n-grams of lower-case words. Counted by gram first, so frequent grams shuffle once a task, as 16 bytes each."""
    grams = df.select(*keys, F.explode(text.ngrams(text.tokens(text.squeeze(F.lower(F.col(col)))), n)).alias("g")).withColumn("g", F.unhex(F.md5("g")))
    return grams.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("n_total")).withColumn("diversity", F.round(F.col("n_distinct") / F.col("n_total"), 6))


def entropy(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Entropy of a value's distribution, natural logarithm."""
    c = df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("c"))
    # -sum(p ln p) = ln N - sum(c ln c) / N, in one pass.
    return c.groupBy(*keys).agg(F.round(F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c"), 6).alias("entropy"))


def mean_pairwise_cosine(df: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """Mean cosine of all different pairs, from the sum of unit vectors: one pass and no self-join."""
    n = numbers.norm(F.col(vector))
    unit = df.where(n > 0).select(*keys, F.transform(vector, lambda x: x.cast("double") / n).alias("u"))
    sums = unit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(size)])
    square = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(size)), F.lit(0.0))
    return sums.where("n > 1").select(*keys, F.round((square - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


def recall_at_k(df: DataFrame, found: Column, gold: Column) -> DataFrame:
    """Mean share of gold that was found; rows without gold count 0 in the mean over all rows."""
    r = F.when(F.size(F.array_distinct(gold)) > 0, F.size(F.array_intersect(found, gold)) / F.size(F.array_distinct(gold))).otherwise(0.0)
    return df.agg(F.round(F.avg(r), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


def quartile_means(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Mean of the first and of the last quarter of each sequence; null for fewer than four rows."""
    w = Window.partitionBy(key)
    r = df.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    q = F.floor(F.col("n") / 4)
    return r.groupBy(key).agg(F.round(F.avg(F.when((F.col("n") >= 4) & (F.col("i") < q), F.col(value))), 6).alias("first_quarter"), F.round(F.avg(F.when((F.col("n") >= 4) & (F.col("i") >= F.col("n") - q), F.col(value))), 6).alias("last_quarter"))


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation over rows that have both values; 0 where it isn't defined."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    c = F.corr(x, y)
    return both.groupBy(*keys).agg(F.round(F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c), 5).alias("r"))


def preference(df: DataFrame, keys: list[str], chosen: str, rejected: str) -> DataFrame:
    """Win rate (strict), and mean, population deviation, least and greatest of the margins."""
    m = F.col(chosen) - F.col(rejected)
    return df.where(m.isNotNull()).groupBy(*keys).agg(
        F.round(F.avg((m > 0).cast("int")), 6).alias("win_rate"), F.round(F.avg(m), 6).alias("margin_mean"), F.round(F.stddev_pop(m), 6).alias("margin_std"), F.round(F.min(m), 6).alias("margin_min"), F.round(F.max(m), 6).alias("margin_max")
    )


def calibration_error(df: DataFrame, keys: list[str], difference: Column, right: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over half-open bins of sigmoid(difference); a confidence of exactly 1 is in no bin."""
    c = numbers.sigmoid(difference)
    b = df.withColumn("c", c).withColumn("right", right.cast("double")).withColumn("bin", F.floor(F.col("c") * bins))
    total = F.sum("n")
    g = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("conf"), F.avg("right").alias("acc"))
    gap = F.when(F.col("bin") < bins, F.col("n") * F.abs(F.col("conf") - F.col("acc"))).otherwise(0.0)
    return g.groupBy(*keys).agg(F.round(F.sum(gap) / total, 6).alias("ece"))


def pass_metrics(df: DataFrame, keys: list[str], right: Column, ks: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """pass@k, avg@k and maj@k from the number of rows and of right rows of each group."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(right).cast("int").alias("c"))
    for k in ks:
        g = g.withColumn(f"pass_at_{k}", F.round(numbers.pass_at_k(F.col("n"), F.col("c"), k), 6)).withColumn(f"maj_at_{k}", F.when(F.lit(k) > F.col("n"), 0).otherwise((F.least(F.col("c"), F.lit(k)) > k / 2).cast("int")))
    return g.withColumn("avg", F.round(F.col("c") / F.col("n"), 6))


def z_scores(df: DataFrame, batch: str, value: str) -> DataFrame:
    """Scores relative to their batch; deviation 0 counts as 1, batches of one stay unchanged."""
    s = df.groupBy(batch).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(value).alias("n"))
    d = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return df.join(s, batch).withColumn("z", F.round(F.when(F.col("n") > 1, (F.col(value) - F.col("m")) / d).otherwise(F.col(value)), 5)).drop("m", "s", "n")


def last_per_step(df: DataFrame, key: str, step: str, order: str, value: str) -> DataFrame:
    """The last value of each step for every step from 1 to the greatest, null where a step has none."""
    last = df.groupBy(key, step).agg(F.max_by(value, order).alias("last_value"))
    every = df.groupBy(key).agg(F.max(step).alias("top")).where("top >= 1").select(key, F.explode(F.sequence(F.lit(1), "top")).alias(step))
    return every.join(last, [key, step], "left")


def store_stats(runs: DataFrame, trajectories: DataFrame, steps: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: the rows of the four tables, mean reward and mean calls (0 without any)."""
    n = lambda t, name: t.agg(F.count(F.lit(1)).alias(f"n_{name}"))
    t = trajectories.agg(F.count(F.lit(1)).alias("n_trajectories"), F.coalesce(F.round(F.avg("reward"), 4), F.lit(0.0)).alias("avg_reward"), F.coalesce(F.round(F.avg("n_tool_calls"), 2), F.lit(0.0)).alias("avg_calls"))
    return t.crossJoin(n(runs, "runs")).crossJoin(n(steps, "steps")).crossJoin(n(calls, "tool_calls"))  # rows of one each


def histogram(df: DataFrame, value: str, width: int = 40) -> DataFrame:
    """``(value, n, bar)``: rows by value with a bar, ``width`` marks for the most frequent."""
    g = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.max("n").alias("top")))).select(value, "n", F.expr(f"repeat('#', cast(floor({float(width)} * n / top) as int))").alias("bar"))


def cells(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, n, mean)``: rows and mean of each cell, missing values as 0."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(value, F.lit(0.0))), 6).alias(f"mean_{value}"))


def cost_summary(df: DataFrame, keys: list[str], units: str, cost: str, latency: str) -> DataFrame:
    """``(keys, calls, units, cost, mean_latency)``: calls, sums of units and cost, and mean latency."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum(units).cast("bigint").alias("units"), F.round(F.sum(cost), 2).alias("cost"), F.round(F.avg(latency), 2).alias("mean_latency"))


def accuracy(df: DataFrame, prediction: str, gold: str) -> DataFrame:
    """Share of equal texts, trimmed and in any case, where both have text."""
    a, b = F.lower(F.trim(prediction)), F.lower(F.trim(gold))
    return df.where((a != "") & (b != "")).agg(F.round(F.avg((a == b).cast("double")), 4).alias("accuracy"))


def coverage(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(n_covered, n_docs)``: different documents with a chunk, and all."""
    d = docs.select("doc_id").where("doc_id is not null").distinct()
    covered = chunks.select("doc_id").join(d, "doc_id", "left_semi").agg(F.count_distinct("doc_id").alias("n_covered"))
    return covered.crossJoin(d.agg(F.count(F.lit(1)).alias("n_docs")))


def share_of(condition: Column, places: int = 6) -> Column:
    """Share of rows a condition holds for; a null is none."""
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), places)


def hop_and_pass_rates(df: DataFrame, keys: list[str], hops: int = 2, strict: float = 0.7, relaxed: float = 0.5) -> DataFrame:
    """``(keys, multi_hop, pass_strict, pass_relaxed)``: shares of rows with ``hops`` calls or more and with rewards over two bounds."""
    return df.groupBy(*keys).agg(share_of(F.col("n_tool_calls") >= hops).alias("multi_hop"), share_of(F.col("reward") >= strict).alias("pass_strict"), share_of(F.col("reward") >= relaxed).alias("pass_relaxed"))


def query_variety(calls: DataFrame) -> DataFrame:
    """``(trajectory_id, n_queries, unique_ratio)``: calls, and the share of different queries, trimmed and in any case, of those there are."""
    q = F.trim(F.lower(F.col("query")))
    return calls.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.count_distinct(q) / F.nullif(F.count("query"), F.lit(0)), 6).alias("unique_ratio"))


def last_per_step(df: DataFrame, key: str, step: str, value: str, order: list[str]) -> DataFrame:
    """``(key, step, last_value)``: the last known value of each step from 1 to a key's highest; null where a step has none."""
    t = df.where(F.col(key).isNotNull() & F.col(step).isNotNull())
    known = t.where(F.col(order[0]).isNotNull() & F.col(value).isNotNull())
    last = known.groupBy(key, step).agg(F.max_by(value, F.struct(*order)).alias("last_value"))
    every = t.groupBy(key).agg(F.max(step).alias("top")).where("top >= 1").select(key, F.explode(F.sequence(F.lit(1), "top")).alias(step))
    return every.join(last, [key, step], "left")


def relative_scores(df: DataFrame, key: str, group: str, score: str) -> DataFrame:
    """``(key, group, score, z)``: distance from the group's mean in its deviations; the score itself in a group of one, a deviation of 0 counts 1."""
    t = df.select(key, group, score)
    s = t.groupBy(group).agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("s"), F.count(score).alias("n"))
    z = F.when(F.col("n") > 1, (F.col(score) - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).otherwise(F.col(score))
    return t.where(F.col(score).isNotNull() & F.col(group).isNotNull()).distinct().join(s, group).select(key, group, score, F.round(z, 5).alias("z"))


def by_each(df: DataFrame, keys: list[str], passes: float = 0.5) -> DataFrame:
    """``(keys, mean_reward, pass_rate, n)`` by each key alone, the others null, in one pass."""
    cols = [F.col(k) for k in keys]
    return df.groupingSets([[c] for c in cols], *cols).agg(F.round(F.avg("reward"), 4).alias("mean_reward"), share_of(F.col("reward") >= passes, 4).alias("pass_rate"), F.count(F.lit(1)).alias("n"))
