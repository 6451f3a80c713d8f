"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import aggregates as A
from velarium.plans.registry import query, read


@query("SELECT from_address, count(*) AS n FROM emails WHERE trim(from_address) <> '' GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, from_address LIMIT 20")
def agg1_active_senders(spark: SparkSession, d: str) -> DataFrame:
    return A.active_groups(read(spark, d, "emails"), "from_address", 3, 20)  # a top-k report


@query("""
SELECT (SELECT count(*) FROM runs) AS n_runs, (SELECT count(*) FROM trajectories) AS n_trajectories, (SELECT count(*) FROM steps) AS n_steps, (SELECT count(*) FROM tool_calls) AS n_tool_calls,
 (SELECT coalesce(round(avg(reward), 4), 0) FROM trajectories) AS avg_reward, (SELECT coalesce(round(avg(n_tool_calls), 2), 0) FROM trajectories) AS avg_calls""")
def agg2_store_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.store_stats(*[read(spark, d, t) for t in ("runs", "trajectories", "steps", "tool_calls")])


@query("SELECT tool_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM tool_calls GROUP BY 1")
def agg3_tool_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(read(spark, d, "tool_calls"), "tool_name")


@query("SELECT n_tool_calls, count(*) AS n, repeat('#', CAST(floor(40.0 * count(*) / max(count(*)) OVER ()) AS INT)) AS bar FROM trajectories GROUP BY 1")
def agg4_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(read(spark, d, "trajectories"), "n_tool_calls")


@query("SELECT condition, model, count(*) AS n, round(avg(coalesce(reward, 0)), 6) AS mean_reward FROM trajectories GROUP BY 1, 2")
def agg5_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.cells(read(spark, d, "trajectories"), ["condition", "model"], "reward")


@query("SELECT l_returnflag, count(*) AS calls, CAST(sum(l_linenumber) AS BIGINT) AS units, round(sum(l_extendedprice), 2) AS cost, round(avg(l_quantity), 2) AS mean_latency FROM lineitem GROUP BY 1")
def agg6_cost_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.cost_summary(read(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber", "l_extendedprice", "l_quantity")


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std_sample, round(stddev_pop(value), 6) AS std_population, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1""")
def agg7_agg8_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.spread_of(read(spark, d, "events"), ["event_type"], "value")


@query("""
SELECT round(avg(CASE WHEN lower(trim(final_answer)) = lower(trim(gold_answer)) THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM trajectories WHERE trim(final_answer) <> '' AND trim(gold_answer) <> ''""")
def agg9_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return A.accuracy(read(spark, d, "trajectories"), "final_answer", "gold_answer")


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(CASE WHEN i = floor(n * 0.5) THEN value END) AS p50, min(CASE WHEN i = greatest(0, floor(n * 0.95) - 1) THEN value END) AS p95 FROM r GROUP BY 1""")
def agg10_index_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return A.index_percentiles(read(spark, d, "events"), ["event_type"], "value")


@query("SELECT round(avg(c), 6) AS cost_per_group, count(*) AS n_groups FROM (SELECT user_id, sum(value) AS c FROM events GROUP BY 1 HAVING sum(value) > 0)")
def agg11_cost_per_decision(spark: SparkSession, d: str) -> DataFrame:
    return A.cost_per_group(read(spark, d, "events"), "user_id", "value")


@query("SELECT trajectory_id, round(sum(reward * CASE WHEN is_tool_step THEN 2.0 ELSE 1.0 END) / nullif(sum(CASE WHEN reward IS NOT NULL THEN CASE WHEN is_tool_step THEN 2.0 ELSE 1.0 END END), 0), 6) AS weighted_mean FROM steps GROUP BY 1")
def agg13_weighted_reward(spark: SparkSession, d: str) -> DataFrame:
    return A.weighted_mean(read(spark, d, "steps"), ["trajectory_id"], "reward", F.when(F.col("is_tool_step"), 2.0).otherwise(1.0), places=6)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS i FROM c)
SELECT user_id, event_type AS dominant, round(c / n, 4) AS share FROM r WHERE i = 1""")
def agg14_dominant_type(spark: SparkSession, d: str) -> DataFrame:
    return A.dominant(read(spark, d, "events"), ["user_id"], "event_type")


@query("""
WITH s AS (SELECT trajectory_id, string_agg(action_name, '->' ORDER BY step_number, step_id) AS sig FROM steps WHERE action_name IS NOT NULL GROUP BY 1),
t AS (SELECT DISTINCT trajectory_id, run_id FROM trajectories)
SELECT run_id, round(count(DISTINCT sig) / count(sig), 6) AS ratio FROM s JOIN t USING (trajectory_id) GROUP BY 1""")
def agg15_behaviour_diversity(spark: SparkSession, d: str) -> DataFrame:
    from velarium.operators.windows import signatures

    s = signatures(read(spark, d, "steps"))
    return A.distinct_ratio(s.join(read(spark, d, "trajectories").select("trajectory_id", "run_id").distinct(), "trajectory_id"), ["run_id"], "sig")


@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS a FROM corpus_docs),
g AS (SELECT unnest(list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i+3], ' '))) AS g FROM w WHERE len(a) >= 4)
SELECT count(DISTINCT g) AS n_distinct, count(*) AS n_total, round(count(DISTINCT g) / count(*), 6) AS diversity FROM g""")
def agg16_ngram_diversity(spark: SparkSession, d: str) -> DataFrame:
    return A.ngram_diversity(read(spark, d, "corpus_docs"), [], "text")


@query("""
WITH c AS (SELECT model, condition, count(*) AS c FROM trajectories GROUP BY 1, 2)
SELECT model, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS entropy FROM c GROUP BY 1""")
def agg17_entropy(spark: SparkSession, d: str) -> DataFrame:
    return A.entropy(read(spark, d, "trajectories"), ["model"], "condition")


@query("""
WITH u AS (SELECT label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
x AS (SELECT label, unnest(list_transform(e, lambda x: x / n)) AS v, generate_subscripts(e, 1) AS i FROM u WHERE n > 0),
s AS (SELECT label, i, sum(v) AS s FROM x GROUP BY 1, 2), q AS (SELECT label, sum(s * s) AS q FROM s GROUP BY 1), c AS (SELECT label, count(*) AS n FROM u WHERE n > 0 GROUP BY 1)
SELECT label, round((q - c.n) / (c.n * (c.n - 1)), 6) AS mean_cosine FROM q JOIN c USING (label) WHERE c.n > 1""")
def agg18_mean_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).head()[0] or 0
    return A.mean_pairwise_cosine(e, ["label"], "embedding", size)


@query("SELECT (SELECT count(DISTINCT doc_id) FROM chunks WHERE doc_id IN (SELECT doc_id FROM corpus_docs)) AS n_covered, (SELECT count(DISTINCT doc_id) FROM corpus_docs) AS n_docs")
def agg19_coverage(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(read(spark, d, "corpus_docs"), read(spark, d, "chunks"))


@query("""
SELECT run_id, round(avg(CASE WHEN n_tool_calls >= 2 THEN 1.0 ELSE 0.0 END), 6) AS multi_hop, round(avg(CASE WHEN reward >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS pass_strict, round(avg(CASE WHEN reward >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pass_relaxed FROM trajectories GROUP BY 1""")
def agg20_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    return A.hop_and_pass_rates(read(spark, d, "trajectories"), ["run_id"])


@query("""
WITH g AS (SELECT doc_id, list(DISTINCT chunk_id) AS gold FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1),
f AS (SELECT doc_id, list(DISTINCT chunk_id) AS found FROM chunks WHERE chunk_index < 3 AND chunk_id IS NOT NULL GROUP BY 1)
SELECT round(avg(len(list_intersect(coalesce(found, []), gold)) / len(gold)), 6) AS recall, count(*) AS n FROM g LEFT JOIN f USING (doc_id)""")
def agg21_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "chunks").where("doc_id is not null and chunk_id is not null")
    both = c.groupBy("doc_id").agg(F.collect_set("chunk_id").alias("gold"), F.collect_set(F.when(F.col("chunk_index") < 3, F.col("chunk_id"))).alias("found"))
    return A.recall_at_k(both, F.col("found"), F.col("gold"))


@query(r"SELECT chunk_id, regexp_replace(chunk_id, '::[^:]*$', '') AS doc, CAST(regexp_replace(chunk_id, '::[^:]*$', '') = doc_id AS INT) AS same FROM chunks")
def agg22_doc_of_chunk(spark: SparkSession, d: str) -> DataFrame:
    from velarium.functions.text import doc_of

    return read(spark, d, "chunks").select("chunk_id", doc_of(F.col("chunk_id")).alias("doc"), (doc_of(F.col("chunk_id")) == F.col("doc_id")).cast("int").alias("same"))


@query("""
SELECT trajectory_id, count(*) AS n_queries, round(count(DISTINCT trim(lower(query))) / nullif(count(query), 0), 6) AS unique_ratio FROM tool_calls GROUP BY 1""")
def agg23_trace_row(spark: SparkSession, d: str) -> DataFrame:
    return A.query_variety(read(spark, d, "tool_calls"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(avg(CASE WHEN n >= 4 AND i < floor(n / 4) THEN value END), 6) AS first_quarter, round(avg(CASE WHEN n >= 4 AND i >= n - floor(n / 4) THEN value END), 6) AS last_quarter FROM r GROUP BY 1""")
def agg24_quartile_means(spark: SparkSession, d: str) -> DataFrame:
    return A.quartile_means(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query("""
WITH l AS (SELECT run_id, training_step, arg_max(reward, (timestamp, trajectory_id)) AS last_value FROM (SELECT DISTINCT trajectory_id, run_id, training_step, reward, timestamp FROM trajectories WHERE run_id IS NOT NULL AND training_step IS NOT NULL AND timestamp IS NOT NULL AND reward IS NOT NULL) GROUP BY 1, 2),
t AS (SELECT run_id, max(training_step) AS top FROM trajectories WHERE run_id IS NOT NULL GROUP BY 1 HAVING max(training_step) >= 1)
SELECT run_id, CAST(s AS INT) AS training_step, last_value FROM (SELECT run_id, unnest(range(1, top + 1)) AS s FROM t) LEFT JOIN l ON l.run_id = t_run AND l.training_step = s""".replace("SELECT run_id, CAST(s AS INT)", "SELECT t_run AS run_id, CAST(s AS INT)").replace("(SELECT run_id, unnest(range(1, top + 1)) AS s FROM t)", "(SELECT run_id AS t_run, unnest(range(1, top + 1)) AS s FROM t)"))
def agg25_last_per_step(spark: SparkSession, d: str) -> DataFrame:
    return A.last_per_step(read(spark, d, "trajectories"), "run_id", "training_step", "reward", ["timestamp", "trajectory_id"])


@query("SELECT model, round(coalesce(CASE WHEN isnan(corr(reward, n_tool_calls)) THEN 0 ELSE corr(reward, n_tool_calls) END, 0), 5) AS r FROM trajectories WHERE reward IS NOT NULL AND n_tool_calls IS NOT NULL GROUP BY 1")
def agg26_pearson(spark: SparkSession, d: str) -> DataFrame:
    return A.pearson(read(spark, d, "trajectories"), ["model"], "reward", "n_tool_calls")


@query("""
WITH p AS (SELECT question, max(reward) AS c, min(reward) AS r, min(model) AS model FROM trajectories WHERE question IS NOT NULL GROUP BY 1)
SELECT model, round(avg(CASE WHEN c - r > 0 THEN 1 ELSE 0 END), 6) AS win_rate, round(avg(c - r), 6) AS margin_mean, round(stddev_pop(c - r), 6) AS margin_std, round(min(c - r), 6) AS margin_min, round(max(c - r), 6) AS margin_max FROM p WHERE c - r IS NOT NULL GROUP BY 1""")
def agg27_preference(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "trajectories").where("question is not null").groupBy("question").agg(F.max("reward").alias("c"), F.min("reward").alias("r"), F.min("model").alias("model"))
    return A.preference(p, ["model"], "c", "r")


@query("""
WITH b AS (SELECT model, 1 / (1 + exp(-(reward * 4 - 2))) AS c, CASE WHEN has_answer_tag THEN 1.0 ELSE 0.0 END AS r FROM trajectories WHERE reward IS NOT NULL),
g AS (SELECT model, floor(c * 10) AS bin, count(*) AS n, avg(c) AS conf, avg(r) AS acc FROM b GROUP BY 1, 2)
SELECT model, round(sum(CASE WHEN bin < 10 THEN n * abs(conf - acc) ELSE 0 END) / sum(n), 6) AS ece FROM g GROUP BY 1""")
def agg29_calibration(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("reward is not null")
    return A.calibration_error(t, ["model"], F.col("reward") * 4 - 2, F.coalesce("has_answer_tag", F.lit(False)))


@query("""
WITH g AS (SELECT run_id, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (reward >= 0.5) AS INT) AS c FROM trajectories GROUP BY 1)
SELECT run_id, n, c, """ + ", ".join(f"round(CASE WHEN {k} > n OR c = 0 THEN 0.0 WHEN n - c < {k} THEN 1.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k}.0 / i)) END, 6) AS pass_at_{k}, CASE WHEN {k} > n THEN 0 ELSE CAST(least(c, {k}) > {k} / 2.0 AS INT) END AS maj_at_{k}" for k in (1, 2, 4)) + ", round(c / n, 6) AS avg FROM g")
def agg30_pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    return A.pass_metrics(read(spark, d, "trajectories"), ["run_id"], F.coalesce(F.col("reward") >= 0.5, F.lit(False)))


@query("""
WITH s AS (SELECT condition, avg(reward) AS m, stddev_pop(reward) AS s, count(reward) AS n FROM trajectories GROUP BY 1), t AS (SELECT DISTINCT trajectory_id, condition, reward FROM trajectories WHERE reward IS NOT NULL AND condition IS NOT NULL)
SELECT trajectory_id, t.condition, reward, round(CASE WHEN n > 1 THEN (reward - m) / CASE WHEN s = 0 THEN 1 ELSE s END ELSE reward END, 5) AS z FROM t JOIN s USING (condition)""")
def agg36_relative_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.relative_scores(read(spark, d, "trajectories"), "trajectory_id", "condition", "reward")


@query("""
WITH c AS (SELECT DISTINCT trajectory_id, unnest(map_keys(reward_components)) AS name, unnest(map_values(reward_components)) AS score FROM trajectories WHERE reward_components IS NOT NULL)
SELECT trajectory_id, round(sum(CASE name WHEN 'correctness' THEN 0.6 WHEN 'necessity' THEN 0.3 WHEN 'format' THEN 0.1 ELSE 0.0 END * coalesce(score, 0)), 6) AS reward FROM c GROUP BY 1""")
def agg38_composed_reward(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("reward_components is not null").select("trajectory_id", F.map_entries("reward_components").alias("e"))
    c = t.select("trajectory_id", F.explode("e").alias("x")).select("trajectory_id", F.col("x.key").alias("name"), F.col("x.value").alias("score")).distinct()
    return A.composed_reward(c, "trajectory_id", "name", "score", {"correctness": 6.0, "necessity": 3.0, "format": 1.0})


@query("SELECT condition, model, round(avg(reward), 4) AS mean_reward, round(avg(CASE WHEN reward >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS pass_rate, count(*) AS n FROM trajectories GROUP BY GROUPING SETS ((condition), (model))")
def agg40_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return A.by_each(read(spark, d, "trajectories"), ["condition", "model"])
