"""Queries of row shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velarium.operators import shaping as S
from velarium.plans.registry import query, read

#: The first row of each step, as DuckDB says it.
_STEP = "(SELECT * FROM steps WHERE trajectory_id IS NOT NULL AND step_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trajectory_id, step_number ORDER BY step_id) = 1)"


@query("""
WITH t AS (SELECT DISTINCT trajectory_id, question, final_answer, coalesce(reward, 0) AS s FROM trajectories WHERE question IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY s DESC, trajectory_id) AS b, row_number() OVER (PARTITION BY question ORDER BY s, trajectory_id) AS w, count(*) OVER (PARTITION BY question) AS n FROM t)
SELECT question, max(CASE WHEN b = 1 THEN final_answer END) AS chosen, CASE WHEN max(n) > 1 THEN max(CASE WHEN w = 1 THEN final_answer END) ELSE '' END AS rejected FROM r GROUP BY 1""")
def prj5_best_worst(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").select("trajectory_id", "question", "final_answer", "reward").distinct()
    return S.best_worst(t, "question", "trajectory_id", "reward", "final_answer")


@query("""
SELECT trajectory_id, arg_max(thought, (step_number, step_id)) FILTER (thought IS NOT NULL) AS last_thought, arg_max(observation, (step_number, step_id)) FILTER (observation IS NOT NULL) AS last_observation FROM steps GROUP BY 1""")
def prj6_last_turns(spark: SparkSession, d: str) -> DataFrame:
    o = F.struct("step_number", "step_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), o))
    return read(spark, d, "steps").groupBy("trajectory_id").agg(last("thought").alias("last_thought"), last("observation").alias("last_observation"))


@query(f"""
WITH t AS (SELECT trajectory_id, min(question) AS q, min(final_answer) AS a, min(reward) AS r FROM trajectories WHERE trajectory_id IS NOT NULL GROUP BY 1), s AS {_STEP}
SELECT trajectory_id, CAST(-1 AS BIGINT) AS seq, 'observation' AS kind FROM t UNION ALL SELECT trajectory_id, 1099511627776, 'text' FROM t UNION ALL SELECT trajectory_id, 1099511627777, 'episode_reward' FROM t WHERE r IS NOT NULL
UNION ALL SELECT trajectory_id, step_number * 8, 'reasoning' FROM s WHERE thought IS NOT NULL UNION ALL SELECT trajectory_id, step_number * 8 + 1, 'tool_call' FROM s WHERE is_tool_step UNION ALL SELECT trajectory_id, step_number * 8 + 2, 'tool_result' FROM s WHERE is_tool_step
UNION ALL SELECT trajectory_id, step_number * 8 + 3, 'reward' FROM s WHERE reward IS NOT NULL UNION ALL SELECT trajectory_id, step_number * 8 + 4, 'turn_complete' FROM s""")
def prj15_events(spark: SparkSession, d: str) -> DataFrame:
    return S.events(read(spark, d, "trajectories"), read(spark, d, "steps")).select("trajectory_id", "seq", "kind")


@query(f"""
WITH s AS {_STEP}, t AS (SELECT DISTINCT trajectory_id FROM trajectories WHERE trajectory_id IS NOT NULL),
e AS (SELECT trajectory_id, 0.0 AS w FROM t UNION ALL SELECT trajectory_id, 1.0 FROM t UNION ALL SELECT trajectory_id, 1.0 FROM s WHERE thought IS NOT NULL UNION ALL SELECT trajectory_id, 2.0 FROM s WHERE is_tool_step UNION ALL SELECT trajectory_id, 0.0 FROM s WHERE is_tool_step)
SELECT trajectory_id, CAST(sum(w) AS DOUBLE) AS weight, count(*) FILTER (w = 0) AS masked FROM e GROUP BY 1""")
def prj18_segment_weights(spark: SparkSession, d: str) -> DataFrame:
    w = S.segment_weights(S.events(read(spark, d, "trajectories"), read(spark, d, "steps")))
    return w.groupBy("trajectory_id").agg(F.sum("weight").alias("weight"), F.count_if("loss_mask").alias("masked"))


@query(f"""
WITH s AS {_STEP.replace("WHERE trajectory_id", "WHERE is_tool_step AND trajectory_id")}
SELECT trajectory_id, step_number, action_name, CASE WHEN regexp_matches(lower(coalesce(observation, '')), 'error|exception|invalid') THEN 'error' ELSE 'ok' END AS status FROM s""")
def prj20_audit_records(spark: SparkSession, d: str) -> DataFrame:
    return S.errors_before(read(spark, d, "steps"))


@query("SELECT DISTINCT trajectory_id, question AS prompt, gold_answer AS gold, greatest(1, coalesce(n_tool_calls, 0)) AS optimal FROM trajectories WHERE question IS NOT NULL AND gold_answer IS NOT NULL")
def prj24_grpo_rows(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("question is not null and gold_answer is not null")
    return t.select("trajectory_id", F.col("question").alias("prompt"), F.col("gold_answer").alias("gold"), F.greatest(F.lit(1), F.coalesce("n_tool_calls", F.lit(0))).alias("optimal")).distinct()


@query("""
WITH t AS (SELECT DISTINCT trajectory_id, run_id, reward FROM trajectories WHERE reward IS NOT NULL AND run_id IS NOT NULL), m AS (SELECT run_id, avg(reward) AS m FROM t GROUP BY 1)
SELECT trajectory_id, reward >= m - 1e-12 AS label FROM t JOIN m USING (run_id)""")
def prj30_bco_labels(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("reward is not null and run_id is not null").select("trajectory_id", "run_id", "reward").distinct()
    return t.join(t.groupBy("run_id").agg(F.avg("reward").alias("m")), "run_id").select("trajectory_id", (F.col("reward") >= F.col("m") - 1e-12).alias("label"))


@query("""
WITH m AS (SELECT user_id, event_type, event_id, ts, CASE WHEN row_number() OVER w > 1 AND lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM m)
SELECT user_id, CAST(turn AS BIGINT) AS turn, event_type, string_agg(CAST(event_id AS VARCHAR), chr(10) || chr(10) ORDER BY ts, event_id) AS content FROM i GROUP BY 1, 2, 3""")
def prj32_merge_roles(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.col("event_id").cast("string").alias("content"))
    return S.merge_turns(e, ["user_id"], ["ts", "event_id"], "event_type", "content")


@query("""
WITH r AS (SELECT trajectory_id, step_number, step_id, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_number DESC, step_id DESC) AS i FROM steps WHERE is_tool_step)
SELECT trajectory_id, step_number, step_id FROM r WHERE i <= 2 UNION ALL SELECT trajectory_id, -1, -1 FROM (SELECT DISTINCT trajectory_id FROM trajectories)""")
def prj35_recent_k_context(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "steps").where("is_tool_step").select("trajectory_id", "step_number", "step_id")
    i = F.row_number().over(Window.partitionBy("trajectory_id").orderBy(F.desc("step_number"), F.desc("step_id")))
    head = read(spark, d, "trajectories").select("trajectory_id").distinct().select("trajectory_id", F.lit(-1).alias("step_number"), F.lit(-1).cast("bigint").alias("step_id"))
    return s.withColumn("i", i).where("i <= 2").drop("i").unionByName(head)


@query("SELECT DISTINCT trajectory_id, 'user: ' || question || chr(10) || 'assistant: ' || final_answer AS text FROM trajectories WHERE question IS NOT NULL AND final_answer IS NOT NULL")
def prj31_messages_text(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("question is not null and final_answer is not null").select("trajectory_id", "question", "final_answer").distinct()
    m = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("final_answer").alias("content")))
    return t.select("trajectory_id", S.as_text(m).alias("text"))


@query("SELECT trajectory_id, 'system,user,assistant' AS roles FROM (SELECT DISTINCT trajectory_id, question, final_answer FROM trajectories WHERE question IS NOT NULL)")
def prj11_prj33_system_and_fold(spark: SparkSession, d: str) -> DataFrame:
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.cast("string").alias("content"))
    t = read(spark, d, "trajectories").where("question is not null").select("trajectory_id", "question", F.col("final_answer").alias("a")).distinct()
    folded = S.fold_tool_turns(F.array(msg("user", F.col("question")), msg("tool", F.col("a")), msg("assistant", F.col("a"))))
    return t.select("trajectory_id", F.array_join(F.transform(S.with_system(folded, "Use the corpus."), lambda m: m["role"]), ",").alias("roles"))


@query("""
WITH a AS (SELECT trajectory_id FROM (SELECT DISTINCT trajectory_id FROM trajectories WHERE reward >= 0.5)), b AS (SELECT trajectory_id FROM (SELECT DISTINCT trajectory_id FROM trajectories WHERE reward < 0.5)),
n AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y) SELECT CAST(r AS BIGINT) AS rank0, CASE WHEN r < 2 * least(x, y) THEN CAST(r % 2 AS INT) WHEN x > y THEN 0 ELSE 1 END AS source FROM (SELECT unnest(range(0, x + y)) AS r, x, y FROM n)""")
def prj39_round_robin(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("reward is not null").select("trajectory_id", "reward")
    a, b = t.where("reward >= 0.5").select("trajectory_id").distinct(), t.where("reward < 0.5").select("trajectory_id").distinct()
    return S.round_robin(a, b, "trajectory_id").select("rank0", "source")
