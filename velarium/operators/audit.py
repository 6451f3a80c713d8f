"""Audit logs, episodes and pipeline states as training rows and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts as labels, and those that pass an episode. Fixed values.
LABELS = {"APPROVE": 1, "DENY": 0, "REVIEW": 0}
PASSED = ("PASS", "APPROVE", "COMPLETE")


def rejected_pairs(audit: DataFrame, stage_id: str) -> DataFrame:
    """``(prompt, chosen_output, rejected_output, reason)`` of a stage's entries that a person rejected.

    Missing outputs stay null, as the log has them; other stages and other feedback give no rows.
    """
    hit = audit.where((F.col("stage_id") == stage_id) & (F.col("human_feedback") == "rejected"))
    return hit.select(F.col("input").alias("prompt"), F.col("human_output").alias("chosen_output"), F.col("model_output").alias("rejected_output"), F.col("human_explanation").alias("reason"))


def verdict_labels(audit: DataFrame, stage_id: str) -> DataFrame:
    """``(pipeline_id, input, label, verdict_label, confidence)`` of an output stage: 1 for APPROVE, 0 for DENY and REVIEW in any case.

    Other and missing verdicts give no row; a missing input is empty, a missing confidence 0.5.
    """
    v = F.upper("verdict")
    label = F.coalesce(*[F.when(v == k, F.lit(n)) for k, n in LABELS.items()])
    return audit.where((F.col("stage_id") == stage_id) & label.isNotNull()).select("pipeline_id", F.coalesce("input", F.lit("")).alias("input"), label.alias("label"), v.alias("verdict_label"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def islands(df: DataFrame, order: str, value: str, width: int = 1 << 16) -> DataFrame:
    """Rows with ``island``, the number from 1 of the run of equal values, over the whole table, that they are in.

    ``order`` is a whole number, different for each row. Runs are numbered within ranges of ``width``
    of it; the ranges' ends are compared and their counts summed up from one row each, so no task
    sorts the table. Null values are equal to each other.
    """
    x = df.withColumn("_b", F.floor(F.col(order) / width))
    w = Window.partitionBy("_b").orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) & (F.row_number().over(w) > 1)
    x = x.withColumn("_i", F.sum(new.cast("bigint")).over(w))
    held = F.struct(F.col(value).alias("v"))
    ends = x.groupBy("_b").agg(F.max("_i").alias("n"), F.min_by(held, order).alias("first"), F.max_by(held, order).alias("last"))
    over = Window.orderBy("_b")  # one row for each range
    starts = (F.lag("last").over(over).isNull() | ~F.col("first.v").eqNullSafe(F.lag("last").over(over)["v"])).cast("bigint")
    ends = ends.withColumn("s", starts).select("_b", (F.sum("s").over(over) + F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_base"))
    return x.join(ends, "_b").withColumn("island", F.col("_base") + F.col("_i")).drop("_b", "_i", "_base")


def audit_trajectories(audit: DataFrame, stage_id: str, order: str = "line") -> DataFrame:
    """``(island, pipeline_id, n_steps, reward, steps)``: one trajectory for each run of lines of one pipeline that holds the stage.

    ``steps`` are the stage's lines in order; a pipeline that comes again later in the log gives
    another trajectory. ``reward`` is the last judge score of these lines over 10, 0 without one.
    Lines without a stage type don't count and don't part runs.
    """
    lines = audit.where(F.col("stage_type").isNotNull())
    x = islands(lines, order, "pipeline_id").where((F.col("stage_id") == stage_id) & F.col("pipeline_id").isNotNull())
    judged = F.when(F.col("stage_type") == "llm_judge", F.coalesce("score", F.lit(0.5)) / 10.0)
    step = F.struct(F.col(order).alias("line"), F.coalesce("iteration", F.lit(1)).alias("step_number"), F.col("input").alias("prompt"), F.coalesce("output", F.lit("")).alias("observation"))
    g = x.groupBy("island", "pipeline_id").agg(F.count(F.lit(1)).alias("n_steps"), F.max_by(judged, F.when(judged.isNotNull(), F.col(order))).alias("r"), F.sort_array(F.collect_list(step)).alias("steps"))
    return g.select("island", "pipeline_id", "n_steps", F.coalesce("r", F.lit(0.0)).alias("reward"), "steps")


def episode_records(episodes: DataFrame, algorithm: str) -> DataFrame:
    """Training rows of finished episodes ``(pipeline_id, input, output, verdict, score)`` for bco, dpo, or grpo, ppo and rloo.

    An episode passes by its verdict; its reward is the judge's score over 10 between 0 and 1, else 1 or 0.
    """
    ok = F.coalesce(F.upper("verdict").isin(*PASSED), F.lit(False))
    ends = ["verdict", "pipeline_id"]
    if algorithm == "bco":
        return episodes.select("input", ok.cast("int").alias("label"), *ends)
    if algorithm == "dpo":
        return episodes.select("input", F.when(ok, F.col("output")).alias("chosen_output"), F.when(~ok, F.col("output")).alias("rejected_output"), *ends)
    if algorithm in ("grpo", "ppo", "rloo"):
        judged = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / 10.0))
        return episodes.select("input", "output", F.when(F.col("score").isNotNull(), judged).otherwise(ok.cast("double")).alias("reward"), *ends)
    raise ValueError(f"no records for {algorithm!r}")


def _event(seq: Column, kind: str, payload: Column) -> Column:
    return F.struct(seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), payload.cast("string").alias("payload"))


def state_events(states: DataFrame) -> DataFrame:
    """``(pipeline_id, seq, kind, payload)`` of pipeline states ``(pipeline_id, input_text, step_history, stage_outputs, reason, confidence)``.

    The input, then a call and a result for each stage visited, the reason, and the confidence over 10
    as the episode's reward if there is one. A stage without output has a null result.
    """
    n = F.size(F.coalesce("step_history", F.array().cast("array<string>")))
    visits = F.flatten(F.transform(F.coalesce("step_history", F.array().cast("array<string>")), lambda s, i: F.array(_event(i * 2 + 1, "tool_call", s), _event(i * 2 + 2, "tool_result", F.try_element_at("stage_outputs", s)))))
    ends = F.array(_event(n * 2 + 1, "text", F.coalesce("reason", F.lit(""))))
    reward = F.when(F.col("confidence").isNotNull(), F.array(_event(n * 2 + 2, "reward", F.col("confidence") / 10.0))).otherwise(F.slice(ends, 1, 0))
    every = F.concat(F.array(_event(F.lit(0), "observation", F.col("input_text"))), visits, ends, reward)
    return states.select("pipeline_id", F.explode(every).alias("e")).select("pipeline_id", "e.*")


def eval_events(evals: DataFrame, key: str) -> DataFrame:
    """``(key, seq, kind, payload)`` of ``(key, tool_calls, tool_outputs)``: all calls, then all results."""
    empty = F.array().cast("array<string>")
    calls, outs = F.coalesce("tool_calls", empty), F.coalesce("tool_outputs", empty)
    every = F.concat(F.transform(calls, lambda c, i: _event(i, "tool_call", c)), F.transform(outs, lambda c, i: _event(F.size(calls) + i, "tool_result", c)))
    return evals.select(key, F.explode(every).alias("e")).select(key, "e.*")


def eval_rows(events: DataFrame, key: str) -> DataFrame:
    """``(key, tool_calls, tool_outputs)`` of events, each in order; the way back from ``eval_events``. Null calls are left out, null results kept."""
    at = lambda kind: F.when(F.col("kind") == kind, F.struct("seq", "payload"))
    g = events.groupBy(key).agg(F.sort_array(F.collect_list(at("tool_call"))).alias("c"), F.sort_array(F.collect_list(at("tool_result"))).alias("r"))
    return g.select(key, F.filter("c.payload", lambda x: x.isNotNull()).alias("tool_calls"), F.col("r.payload").alias("tool_outputs"))


def flat_outputs(outputs: Column) -> Column:
    """Stage outputs, a map of maps, as one map with the keys ``stage.output.key``, ``stage.key`` and ``key``.

    A key that several stages have is the last one's in the order of the map. Null maps give null.
    """
    entries = F.flatten(F.transform(F.map_entries(outputs), lambda s: F.transform(F.map_entries(s["value"]), lambda e: F.struct(s["key"].alias("s"), e["key"].alias("k"), e["value"].alias("v")))))
    long = F.flatten(F.transform(entries, lambda e: F.array(F.struct(F.concat(e["s"], F.lit(".output."), e["k"]).alias("key"), e["v"].alias("value")), F.struct(F.concat(e["s"], F.lit("."), e["k"]).alias("key"), e["v"].alias("value")))))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    short = F.transform(last, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))
    return F.map_from_entries(F.concat(long, short))


def field(reference: str, outputs: Column) -> Column:
    """What a field reference stands for: quoted text, a JSON number, boolean or null, else ``stage[.output].key`` of the outputs; null if it isn't there."""
    import json

    ref = reference.strip()
    if len(ref) > 1 and ref[0] == ref[-1] and ref[0] in "\"'":
        return F.lit(ref[1:-1])
    try:
        value = json.loads(ref)
        return F.lit(value if value is None or isinstance(value, str) else json.dumps(value))
    except ValueError:
        stage, _, rest = ref.partition(".")
        key = rest.removeprefix("output.")
        stage_output = F.try_element_at(outputs, F.lit(stage))
        return F.try_element_at(stage_output, F.lit(key)) if key else F.to_json(stage_output)


#: Metrics where less is better. Fixed values.
LOWER_IS_BETTER = ("latency_p50", "latency_p95", "cost_per_decision")


def violations(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``(metric, value, threshold, bound)`` of metrics that miss their threshold: above it where less is better, else below it. Metrics without a threshold and null values don't count."""
    limit = F.coalesce(*[F.when(F.col("metric") == k, F.lit(float(v))) for k, v in thresholds.items()], F.lit(None).cast("double"))
    less = F.col("metric").isin(*LOWER_IS_BETTER)
    x = metrics.withColumn("threshold", limit)
    return x.where(F.when(less, F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))).select("metric", "value", "threshold", F.when(less, "max").otherwise("min").alias("bound"))


def accepted(samples: DataFrame, status: str = "status") -> DataFrame:
    """Samples that were accepted, at once or after a revision."""
    return samples.where(F.col(status).isin("accepted", "revised_accepted"))


def side_by_side(df: DataFrame, key: str, *lists: str) -> DataFrame:
    """``(key, place, lists...)``: elements of several lists at the same place, as far as the shortest goes."""
    n = F.least(*[F.size(c) for c in lists]) if len(lists) > 1 else F.size(lists[0])
    return df.select(key, *lists, F.explode(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n)).alias("place")).select(key, "place", *[F.get(c, "place").alias(c) for c in lists])
