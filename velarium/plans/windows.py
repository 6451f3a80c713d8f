"""Queries of the ordered analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import windows as W
from velarium.plans.registry import query, read


@query("""
WITH r AS (SELECT trajectory_id, step_id, step_number, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_number DESC, step_id DESC) AS age FROM steps WHERE is_tool_step)
SELECT trajectory_id, step_id, step_number, age FROM r WHERE age <= 3""")
def win1_recent_k(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "steps").where("is_tool_step").select("trajectory_id", "step_id", "step_number")
    return W.recent(s, ["trajectory_id"], [F.desc("step_number"), F.desc("step_id")], 3)


@query("""
WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS visit FROM events)
SELECT user_id, event_type, event_id, visit FROM r WHERE visit % 4 = 0""")
def win2_loop_collapse(spark: SparkSession, d: str) -> DataFrame:
    return W.revisits(read(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id"], "event_type", ["ts", "event_id"], 3).drop("ts")


@query("""
WITH m AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m), g AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2)
SELECT user_id, CAST(count(*) FILTER (n >= 3) AS BIGINT) AS loops FROM g GROUP BY 1""")
def win3_loop_runs(spark: SparkSession, d: str) -> DataFrame:
    r = W.runs(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return r.groupBy("user_id").agg(F.count_if(F.col("n") >= 3).alias("loops"))


@query("""
WITH e AS (SELECT trajectory_id, step_number, regexp_matches(lower(coalesce(observation, '')), 'error|exception|invalid') AS bad FROM (SELECT trajectory_id, step_number, arg_min(coalesce(observation, ''), step_id) AS observation FROM steps WHERE is_tool_step GROUP BY 1, 2)),
n AS (SELECT *, lead(bad) OVER (PARTITION BY trajectory_id ORDER BY step_number) AS next FROM e)
SELECT trajectory_id, round(CASE WHEN count(*) FILTER (bad) = 0 THEN 1.0 ELSE count(*) FILTER (bad AND next = false) / count(*) FILTER (bad) END, 6) AS scsr FROM n GROUP BY 1""")
def win4_self_correction(spark: SparkSession, d: str) -> DataFrame:
    return W.self_correction(read(spark, d, "steps"))


@query("""
SELECT trajectory_id, round(1 - count(DISTINCT (tool_name, query)) / count(*), 6) AS arr, round(count(DISTINCT trim(result, ' ')) / nullif(count(result), 0), 6) AS ter FROM tool_calls GROUP BY 1""")
def win5_win6_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return W.call_redundancy(read(spark, d, "tool_calls"))


@query("""
SELECT trajectory_id, round(coalesce(sum(length(thought)), 0) / greatest(2, coalesce(sum(length(action_args_json)), 0)), 6) AS rad FROM steps GROUP BY 1""")
def win7_reasoning_action_density(spark: SparkSession, d: str) -> DataFrame:
    return W.reasoning_density(read(spark, d, "steps"))


@query("""
SELECT trajectory_id, round(count(*) FILTER (contains(lower(coalesce(tool_name, '')), 'search') OR contains(lower(coalesce(tool_name, '')), 'read')) / count(*), 6) AS pas FROM tool_calls GROUP BY 1""")
def win9_plan_adherence(spark: SparkSession, d: str) -> DataFrame:
    return W.plan_adherence(read(spark, d, "tool_calls"), ("search", "read"))


@query("""
SELECT t.trajectory_id, round(any_value(t.n_tool_calls) / count(*), 6) AS ase FROM tool_calls c JOIN (SELECT trajectory_id, max(n_tool_calls) AS n_tool_calls FROM trajectories GROUP BY 1) t USING (trajectory_id) GROUP BY 1""")
def win11_step_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return W.step_efficiency(read(spark, d, "tool_calls"), read(spark, d, "trajectories"))


@query("""
WITH t AS (SELECT DISTINCT trajectory_id, list_distinct(regexp_extract_all(lower(coalesce(final_answer, '')), '[a-z0-9]+')) AS p, list_distinct(regexp_extract_all(lower(gold_answer), '[a-z0-9]+')) AS g FROM trajectories WHERE gold_answer IS NOT NULL)
SELECT DISTINCT trajectory_id, round(CASE WHEN len(g) = 0 THEN 0.0 ELSE len(list_intersect(p, g)) / len(g) END, 6) AS recall FROM t""")
def win12_unigram_recall(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "trajectories").where("gold_answer is not null").select("trajectory_id", W.unigram_recall(F.col("final_answer"), F.col("gold_answer")).alias("recall")).distinct()


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) AS rolling FROM events")
def win13_rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.round(W.rolling_mean(None, ["user_id"], ["ts", "event_id"], "value", 5), 5).alias("rolling"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, max(n) AS n, avg(CASE WHEN i <= 50 THEN value END) AS mu, stddev_pop(CASE WHEN i <= 50 THEN value END) AS sigma, avg(CASE WHEN i > n - 50 THEN value END) AS recent FROM r GROUP BY 1)
SELECT user_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(recent, 6) AS recent, CAST(CASE WHEN sigma = 0 THEN recent < mu ELSE recent < mu - 1.5 * sigma END AS INT) AS drifted FROM g WHERE n >= 50""")
def win14_reward_drift(spark: SparkSession, d: str) -> DataFrame:
    return W.drift(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query("""
WITH t AS (SELECT DISTINCT trajectory_id, round(0.6 * (1 - coalesce(reward, 0)) + 0.4 * least(1.0, coalesce(n_tool_calls, 0) / 20.0), 6) AS score FROM trajectories)
SELECT trajectory_id, score, row_number() OVER (ORDER BY score, trajectory_id) - 1 AS rank0 FROM t""")
def win15_curriculum_order(spark: SparkSession, d: str) -> DataFrame:
    s = F.round(0.6 * (1 - F.coalesce("reward", F.lit(0.0))) + 0.4 * F.least(F.lit(1.0), F.coalesce("n_tool_calls", F.lit(0)) / 20.0), 6)
    return W.order_position(read(spark, d, "trajectories").select("trajectory_id", s.alias("score")).distinct(), F.col("score"), "trajectory_id")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL),
s AS (SELECT unnest([0, 50, 100]) AS step)
SELECT step, count(*) FILTER (rn <= greatest(1, floor(n * CASE WHEN step < 10 THEN 0.3 WHEN step >= 70 THEN 1.0 ELSE 0.3 + 0.7 * (step - 10) / 60.0 END))) AS pool FROM r CROSS JOIN s GROUP BY 1""")
def win16_curriculum_pool(spark: SparkSession, d: str) -> DataFrame:
    return W.pool_sizes(read(spark, d, "documents").where("n_chars is not null and lang is not null"), "lang", ["n_chars", "doc_id"], (0, 50, 100))


@query("""
WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL),
c AS (SELECT min(CASE WHEN i = least(n - 1, floor(n / 3.0)) THEN n_chars END) AS t1, min(CASE WHEN i = least(n - 1, floor(n * 2 / 3.0)) THEN n_chars END) AS t2 FROM r)
SELECT doc_id, CASE WHEN n_chars < t1 THEN 'low' WHEN n_chars < t2 THEN 'mid' ELSE 'high' END AS band FROM documents, c WHERE n_chars IS NOT NULL""")
def win17_tertiles(spark: SparkSession, d: str) -> DataFrame:
    return W.tertiles(read(spark, d, "documents").select("doc_id", "n_chars"), [], "n_chars").select("doc_id", "band")


@query("""
WITH r AS (SELECT trajectory_id, model, condition, row_number() OVER (PARTITION BY model, condition ORDER BY sha256('7:' || trajectory_id), trajectory_id) AS i FROM (SELECT DISTINCT trajectory_id, model, condition FROM trajectories))
SELECT trajectory_id, model, condition FROM r WHERE i <= 5""")
def win18_cap_per_cell(spark: SparkSession, d: str) -> DataFrame:
    return W.cap_per_cell(read(spark, d, "trajectories").select("trajectory_id", "model", "condition").distinct(), ["model", "condition"], "trajectory_id", 5, seed=7)


@query("""
WITH s AS (SELECT trajectory_id, list(action_name ORDER BY step_number, step_id) AS a FROM steps WHERE action_name IS NOT NULL GROUP BY 1)
SELECT trajectory_id, CASE WHEN list_position(a, 'search_corpus') > 0 AND list_position(a[list_position(a, 'search_corpus') + 1:], 'read_document') > 0 THEN 1.0 WHEN list_position(a, 'search_corpus') > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS chain FROM s""")
def win19_tool_chain(spark: SparkSession, d: str) -> DataFrame:
    return W.chain_order(read(spark, d, "steps"), ("search_corpus", "read_document"))


@query("SELECT trajectory_id, round(pow(0.5, (SELECT max(timestamp) FROM trajectories) / 86400.0 - max(timestamp) / 86400.0), 6) AS recency FROM trajectories WHERE timestamp IS NOT NULL GROUP BY 1")
def win21_recency(spark: SparkSession, d: str) -> DataFrame:
    return W.recency(read(spark, d, "trajectories"), "trajectory_id", "timestamp")
