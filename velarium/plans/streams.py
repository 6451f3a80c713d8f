"""Queries that give in batch what the stream operators give, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.plans.registry import query, read
from velarium.streaming import logs


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Steps as log records."""
    bad = F.lower(F.coalesce("observation", F.lit(""))).rlike("error|exception|invalid")
    kind = F.when(F.coalesce("is_tool_step", F.lit(False)), "tool_call").when(F.col("is_terminal"), "llm_judge").otherwise("llm")
    return read(spark, d, "steps").select(
        "trajectory_id", F.coalesce("action_name", F.lit("think")).alias("stage_name"), kind.alias("stage_type"), F.when(bad, "error").otherwise("ok").alias("status"), F.col("reward").alias("score"),
        F.col("started_at").cast("timestamp").alias("ts"), F.lit("{}").alias("state_snapshot"), "step_number", "step_id",
    )


_LOG = """log AS (SELECT trajectory_id, coalesce(action_name, 'think') AS stage_name, CASE WHEN coalesce(is_tool_step, false) THEN 'tool_call' WHEN is_terminal THEN 'llm_judge' ELSE 'llm' END AS stage_type,
 CASE WHEN regexp_matches(lower(coalesce(observation, '')), 'error|exception|invalid') THEN 'error' ELSE 'ok' END AS status, reward AS score, started_at AS ts FROM steps)"""


@query(f"WITH {_LOG} SELECT trajectory_id, stage_name, 'tool_crash' AS failure FROM log WHERE stage_type = 'tool_call' AND status = 'error'")
def str4_tool_crashes(spark: SparkSession, d: str) -> DataFrame:
    return logs.crashes(_log(spark, d))


@query(f"WITH {_LOG} SELECT trajectory_id, stage_name, 'low_score' AS failure FROM log WHERE stage_type = 'llm_judge' AND score < 0.6")
def str5_low_scores(spark: SparkSession, d: str) -> DataFrame:
    return logs.low_scores(_log(spark, d))


@query(f"WITH {_LOG} SELECT trajectory_id, stage_name, CAST(floor(count(*) / 4) AS BIGINT) AS fired FROM log GROUP BY 1, 2 HAVING count(*) >= 4")
def str3_loop_counts(spark: SparkSession, d: str) -> DataFrame:
    g = _log(spark, d).groupBy("trajectory_id", "stage_name").agg(F.floor(F.count(F.lit(1)) / 4).alias("fired"))
    return g.where("fired >= 1")


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS stage_name, count(*) AS n, round(avg(value), 6) AS mean_score FROM events GROUP BY 1, 2""")
def str13_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_type").alias("stage_name"), F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("ts"))
    return logs.windowed(e, "1 day").select("start", "stage_name", "n", F.round("mean_score", 6).alias("mean_score"))


@query("""
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
SELECT CAST(user_id AS VARCHAR) AS trajectory_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k""")
def str13_session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("trajectory_id"), F.col("ts").cast("timestamp").alias("ts"))
    return logs.sessions(e, "1 hour").select("trajectory_id", "start", "n")


@query("SELECT user_id, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 3) AS elapsed_s, round(date_diff('microsecond', max(ts), (SELECT max(ts) FROM events)) / 3.6e9, 4) AS stale_h FROM events GROUP BY 1")
def dat2_dat3_elapsed(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    g = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return g.crossJoin(F.broadcast(g.agg(F.max("b").alias("now")))).select("user_id", F.round((F.col("b") - F.col("a")) / 1e6, 3).alias("elapsed_s"), F.round((F.col("now") - F.col("b")) / 3.6e9, 4).alias("stale_h"))
