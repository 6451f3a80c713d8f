"""Queries of audit logs, events, states and messages as training rows, and of the graph of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import audit as A
from velarium.operators import graph as G
from velarium.operators import rewards as R
from velarium.operators import shaping as S
from velarium.operators import windows as W
from velarium.plans.registry import query, read
from velarium.plans.shaping import _STEP

#: Steps as the lines of an audit log.
_LOG = """(SELECT step_id AS line, trajectory_id AS pipeline_id, lower(replace(trim(action_name, ' '), '-', '_')) AS stage_id, CASE WHEN is_tool_step THEN 'tool_call' WHEN is_terminal THEN NULL ELSE 'llm_judge' END AS stage_type, step_number AS iteration,
 action_args_json AS input, observation AS output, thought AS human_output, reward AS score, CASE WHEN reward < 0.3 THEN 'rejected' WHEN reward >= 0.3 THEN 'approved' END AS human_feedback FROM steps)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("is_tool_step"), "tool_call").when(F.col("is_terminal"), None).otherwise("llm_judge")
    return read(spark, d, "steps").select(
        F.col("step_id").alias("line"), F.col("trajectory_id").alias("pipeline_id"), F.lower(F.replace(F.trim("action_name"), F.lit("-"), F.lit("_"))).alias("stage_id"), kind.alias("stage_type"), F.col("step_number").alias("iteration"), F.col("action_args_json").alias("input"),
        F.col("observation").alias("output"), F.col("observation").alias("model_output"), F.col("thought").alias("human_output"), F.col("reward").alias("score"), F.when(F.col("reward") < 0.3, "rejected").when(F.col("reward") >= 0.3, "approved").alias("human_feedback"), F.col("thought").alias("human_explanation"),
    )


@query(f"SELECT input AS prompt, human_output AS chosen_output, output AS rejected_output FROM {_LOG} WHERE stage_id = 'search_corpus' AND human_feedback = 'rejected'")
def prj25_rejected_pairs(spark: SparkSession, d: str) -> DataFrame:
    return A.rejected_pairs(_log(spark, d), "search_corpus").drop("reason")


_VERDICT = "CASE WHEN reward >= 0.7 THEN 'approve' WHEN reward >= 0.4 THEN 'Review' WHEN reward >= 0.1 THEN 'deny' ELSE 'skip' END"


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("reward") >= 0.7, "approve").when(F.col("reward") >= 0.4, "Review").when(F.col("reward") >= 0.1, "deny").otherwise("skip")
    t = read(spark, d, "trajectories").select(F.col("trajectory_id").alias("pipeline_id"), F.col("question").alias("input"), F.col("final_answer").alias("output"), verdict.alias("verdict"), (F.col("reward") * 12).alias("score"), F.lit(None).cast("double").alias("confidence"))
    return t.distinct().withColumn("stage_id", F.lit("output"))


@query(f"SELECT DISTINCT trajectory_id AS pipeline_id, coalesce(question, '') AS input, CASE WHEN reward >= 0.7 THEN 1 ELSE 0 END AS label, upper({_VERDICT}) AS verdict_label, CAST(0.5 AS DOUBLE) AS confidence FROM trajectories WHERE reward >= 0.1")
def prj26_verdict_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.verdict_labels(_episodes(spark, d), "output").distinct()


@query(f"""
WITH l AS (SELECT * FROM {_LOG} WHERE stage_type IS NOT NULL), n AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY line) = 1 OR lag(pipeline_id) OVER (ORDER BY line) IS DISTINCT FROM pipeline_id THEN 1 ELSE 0 END AS new FROM l), i AS (SELECT *, sum(new) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT CAST(island AS BIGINT) AS island, pipeline_id, count(*) AS n_steps, round(coalesce(arg_max(coalesce(score, 0.5), line) FILTER (stage_type = 'llm_judge') / 10.0, 0.0), 6) AS reward, string_agg(CAST(iteration AS VARCHAR), ',' ORDER BY line) AS iterations FROM i WHERE stage_id = 'search_corpus' AND pipeline_id IS NOT NULL GROUP BY 1, 2""")
def prj27_audit_trajectories(spark: SparkSession, d: str) -> DataFrame:
    t = A.audit_trajectories(_log(spark, d), "search_corpus")
    return t.select("island", "pipeline_id", "n_steps", F.round("reward", 6).alias("reward"), F.array_join(F.transform("steps.step_number", lambda x: x.cast("string")), ",").alias("iterations"))


@query(f"""
WITH t AS (SELECT trajectory_id, unnest(arg_min(struct_pack(question, final_answer, v := {_VERDICT}, reward), (question IS NOT NULL, question, final_answer IS NOT NULL, final_answer, {_VERDICT}, reward))) FROM trajectories WHERE trajectory_id IS NOT NULL GROUP BY 1), e AS (SELECT trajectory_id AS pipeline_id, final_answer AS output, v AS verdict, reward * 12 AS score FROM t)
SELECT pipeline_id, CASE WHEN verdict = 'approve' THEN 1 ELSE 0 END AS label, CASE WHEN verdict = 'approve' THEN output END AS chosen_output, CASE WHEN verdict <> 'approve' THEN output END AS rejected_output, round(CASE WHEN score IS NOT NULL THEN greatest(0.0, least(1.0, score / 10.0)) ELSE 0.0 END, 6) AS reward FROM e""")
def prj28_episode_records(spark: SparkSession, d: str) -> DataFrame:
    e = _episodes(spark, d).groupBy("pipeline_id").agg(F.min(F.struct("input", "output", "verdict", "score")).alias("r")).select("pipeline_id", "r.*")
    b, p, g = A.episode_records(e, "bco").select("pipeline_id", "label"), A.episode_records(e, "dpo").select("pipeline_id", "chosen_output", "rejected_output"), A.episode_records(e, "grpo").select("pipeline_id", "reward")
    return b.join(p, "pipeline_id").join(g, "pipeline_id").withColumn("reward", F.round("reward", 6))


@query(f"""
WITH s AS {_STEP}, h AS (SELECT trajectory_id, list(action_name ORDER BY step_number) AS h, list(observation ORDER BY step_number) AS o FROM s WHERE is_tool_step AND action_name IS NOT NULL GROUP BY 1), t AS (SELECT trajectory_id, min(question) AS q, min(final_answer) AS a, min(reward) AS r FROM trajectories WHERE trajectory_id IS NOT NULL GROUP BY 1),
x AS (SELECT trajectory_id, q, a, r, coalesce(h, []) AS h FROM t LEFT JOIN h USING (trajectory_id))
SELECT trajectory_id AS pipeline_id, CAST(0 AS BIGINT) AS seq, 'observation' AS kind FROM x UNION ALL SELECT trajectory_id, i * 2 + 1, 'tool_call' FROM (SELECT trajectory_id, unnest(range(0, len(h))) AS i FROM x) UNION ALL SELECT trajectory_id, i * 2 + 2, 'tool_result' FROM (SELECT trajectory_id, unnest(range(0, len(h))) AS i FROM x)
UNION ALL SELECT trajectory_id, len(h) * 2 + 1, 'text' FROM x UNION ALL SELECT trajectory_id, len(h) * 2 + 2, 'reward' FROM x WHERE r IS NOT NULL""")
def prj16_state_events(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "steps").where("trajectory_id is not null and step_number is not null").groupBy("trajectory_id", "step_number").agg(F.min_by(F.struct("is_tool_step", "action_name"), "step_id").alias("x"))
    h = s.where("x.is_tool_step and x.action_name is not null").groupBy("trajectory_id").agg(F.sort_array(F.collect_list(F.struct("step_number", "x.action_name")))["action_name"].alias("step_history"))
    t = read(spark, d, "trajectories").where("trajectory_id is not null").groupBy("trajectory_id").agg(F.min("question").alias("input_text"), F.min("final_answer").alias("reason"), F.min("reward").alias("confidence"))
    states = t.join(h, "trajectory_id", "left").withColumn("stage_outputs", F.lit(None).cast("map<string,string>")).withColumnRenamed("trajectory_id", "pipeline_id")
    return A.state_events(states).select("pipeline_id", "seq", "kind")


@query("""
SELECT trajectory_id, list(query ORDER BY step_number, tool_call_id) FILTER (query IS NOT NULL) AS tool_calls, CAST(count(*) AS INT) AS n_outputs FROM tool_calls WHERE trajectory_id IS NOT NULL GROUP BY 1 HAVING count(query) > 0""")
def prj17_eval_rows(spark: SparkSession, d: str) -> DataFrame:
    """Calls and results to events and back."""
    c = read(spark, d, "tool_calls").where("trajectory_id is not null").groupBy("trajectory_id").agg(F.sort_array(F.collect_list(F.struct("step_number", "tool_call_id", "query", "result"))).alias("a"))
    back = A.eval_rows(A.eval_events(c.select("trajectory_id", F.col("a.query").alias("tool_calls"), F.col("a.result").alias("tool_outputs")), "trajectory_id"), "trajectory_id")
    return back.where(F.size("tool_calls") > 0).select("trajectory_id", "tool_calls", F.size("tool_outputs").alias("n_outputs"))


@query(f"""
WITH s AS {_STEP}
SELECT trajectory_id, string_agg(CASE WHEN length(action_name) > 0 THEN 'assistant:' || coalesce(thought, '') || '|tool:' || coalesce(observation, '-') ELSE 'assistant:' || coalesce(observation, '-') END, '|' ORDER BY step_number) AS chat FROM s GROUP BY 1""")
def prj14_chat_messages(spark: SparkSession, d: str) -> DataFrame:
    m = S.chat_messages(read(spark, d, "steps"))
    return m.select("trajectory_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["content"], F.lit("-")))), "|").alias("chat"))


@query(f"""
WITH s AS {_STEP}, g AS (SELECT trajectory_id, count(*) AS n, string_agg(step_number || '=' || coalesce(action_name, '-') || coalesce(action_args_json, '-'), '|' ORDER BY step_number) AS steps FROM s GROUP BY 1), t AS (SELECT trajectory_id, arg_min(struct_pack(q := question, a := final_answer, r := reward), (question IS NOT NULL, question, final_answer IS NOT NULL, final_answer, reward IS NOT NULL, reward)) AS x FROM trajectories WHERE trajectory_id IS NOT NULL GROUP BY 1)
SELECT trajectory_id, x.q AS task, coalesce(x.a, '') AS final_response, coalesce(x.r, 0) AS reward, coalesce(n, 0) AS n_steps, coalesce(steps, '') AS steps FROM t LEFT JOIN g USING (trajectory_id)""")
def prj13_portable_records(spark: SparkSession, d: str) -> DataFrame:
    r = S.portable_records(read(spark, d, "trajectories"), read(spark, d, "steps"))
    line = F.transform("steps", lambda x: F.concat(x["step_number"].cast("string"), F.lit("="), F.coalesce(x["name"], F.lit("-")), F.coalesce(x["arguments"], F.lit("-"))))
    return r.select("trajectory_id", "task", "final_response", "reward", F.size("steps").cast("bigint").alias("n_steps"), F.array_join(line, "|").alias("steps"))


@query("""
WITH g AS (SELECT doc_id, list(DISTINCT chunk_id ORDER BY chunk_id) AS ids FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1), p AS (SELECT chunk_id, min(text) AS text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1), x AS (SELECT doc_id, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) AS i FROM g),
y AS (SELECT doc_id, string_agg(text, '|' ORDER BY i) AS passages, count(*) AS n FROM x JOIN p USING (chunk_id) GROUP BY 1)
SELECT doc_id, '["' || array_to_string(ids, '","') || '"]' AS gold_path, coalesce(passages, '') AS passages, coalesce(n, 0) AS n FROM g LEFT JOIN y USING (doc_id)""")
def prj23_gold_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a sample whose gold path are all its chunks."""
    c = read(spark, d, "chunks")
    samples = c.where("doc_id is not null and chunk_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("gold_chunk_ids"))
    return S.gold_rows(samples, c, "doc_id").select("doc_id", "gold_path", F.array_join("passages.text", "|").alias("passages"), F.size("passages").cast("bigint").alias("n"))


@query("SELECT DISTINCT trajectory_id, CASE WHEN question IS NULL THEN '' ELSE trim(question, ' ' || chr(9) || chr(10) || chr(13)) END AS asked FROM trajectories")
def prj8_marked_question(spark: SparkSession, d: str) -> DataFrame:
    """Questions put between the marks come out again."""
    t = read(spark, d, "trajectories").select("trajectory_id", "question").distinct()
    marked = F.concat(F.lit("Some context\nQ: "), "question", F.lit("\nA: an answer"))
    return t.select("trajectory_id", F.coalesce(S.marked_question(marked), S.marked_question(F.lit("")))[0]["content"].alias("asked")).distinct()


@query("SELECT DISTINCT doc_id, 'Complete the following Python function:' || chr(10) || chr(10) || trim(title, ' ') || chr(10) || chr(10) || 'Provide only the function implementation in Python.' AS prompt, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS reference_code FROM corpus_docs WHERE title IS NOT NULL AND text IS NOT NULL")
def prj9_code_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as programming tasks, titles as their texts."""
    c = read(spark, d, "corpus_docs").where("title is not null and text is not null").select(F.col("doc_id").alias("task_id"), F.col("title").alias("text"), F.col("text").alias("code"), F.lit(None).cast("array<string>").alias("test_list")).distinct()
    return S.code_rows(c).select(F.col("task_id").alias("doc_id"), "prompt", "reference_code")


@query("SELECT DISTINCT doc_id, trim(title, ' ') AS prompt, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS reference_code, doc_id AS entry_point FROM corpus_docs WHERE title IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
def prj10_function_rows(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "corpus_docs").where("title is not null and text is not null and doc_id is not null").select(F.col("doc_id").alias("task_id"), F.col("title").alias("prompt"), F.lit(None).cast("string").alias("test"), F.col("text").alias("canonical_solution"), F.col("doc_id").alias("entry_point")).distinct()
    return S.function_rows(c).select(F.col("task_id").alias("doc_id"), "prompt", "reference_code", "entry_point")


@query("SELECT DISTINCT trajectory_id, trim(coalesce(question, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS prompt, trim(coalesce(final_answer, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS chosen, trim(coalesce(gold_answer, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rejected FROM trajectories")
def prj7_trimmed_preference(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories")
    p = S.trimmed_preference(t.select(F.col("question").alias("prompt"), F.col("final_answer").alias("chosen"), F.col("gold_answer").alias("rejected")))
    key = t.select("trajectory_id", S.text.strip(F.coalesce("question", F.lit(""))).alias("prompt"), S.text.strip(F.coalesce("final_answer", F.lit(""))).alias("chosen"), S.text.strip(F.coalesce("gold_answer", F.lit(""))).alias("rejected")).distinct()
    return key.join(p.distinct(), ["prompt", "chosen", "rejected"], "left_semi").select("trajectory_id", "prompt", "chosen", "rejected")


@query(f"""
WITH s AS {_STEP}
SELECT trajectory_id, step_number, 'search.output.score' AS key, CAST(reward AS VARCHAR) AS value FROM s WHERE reward IS NOT NULL UNION ALL SELECT trajectory_id, step_number, 'search.score', CAST(reward AS VARCHAR) FROM s WHERE reward IS NOT NULL UNION ALL SELECT trajectory_id, step_number, 'judge.output.score', action_name FROM s WHERE reward IS NOT NULL
UNION ALL SELECT trajectory_id, step_number, 'judge.score', action_name FROM s WHERE reward IS NOT NULL UNION ALL SELECT trajectory_id, step_number, 'score', action_name FROM s WHERE reward IS NOT NULL UNION ALL SELECT trajectory_id, step_number, 'ref', action_name FROM s WHERE reward IS NOT NULL""")
def flt6_flt8_stage_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Two stages' outputs flattened, and a reference to one of them."""
    s = read(spark, d, "steps").where("trajectory_id is not null and step_number is not null").groupBy("trajectory_id", "step_number").agg(F.min_by(F.struct("reward", "action_name"), "step_id").alias("x")).where("x.reward is not null")
    outputs = F.create_map(F.lit("search"), F.create_map(F.lit("score"), F.col("x.reward").cast("string")), F.lit("judge"), F.create_map(F.lit("score"), F.col("x.action_name")))
    flat = s.select("trajectory_id", "step_number", F.explode(A.flat_outputs(outputs)))
    return flat.unionByName(s.select("trajectory_id", "step_number", F.lit("ref").alias("key"), A.field("judge.output.score", outputs).alias("value")))


@query("""
WITH m AS (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY 1) SELECT metric, round(value, 6) AS value, 50.0::DOUBLE AS threshold, 'min' AS bound FROM m WHERE metric IN ('click', 'view', 'purchase') AND value < 50.0""")
def agg12_violations(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return A.violations(m, {"click": 50.0, "view": 50.0, "purchase": 50.0, "unknown": 1.0}).withColumn("value", F.round("value", 6))


@query("SELECT DISTINCT trajectory_id FROM (SELECT trajectory_id, CASE WHEN reward >= 0.8 THEN 'accepted' WHEN reward >= 0.6 THEN 'revised_accepted' ELSE 'rejected' END AS status FROM trajectories) WHERE status IN ('accepted', 'revised_accepted')")
def flt14_accepted(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("reward") >= 0.8, "accepted").when(F.col("reward") >= 0.6, "revised_accepted").otherwise("rejected")
    return A.accepted(read(spark, d, "trajectories").select("trajectory_id", s.alias("status"))).select("trajectory_id").distinct()


@query("""
WITH c AS (SELECT DISTINCT chunk_id, entities AS e, keyphrases AS k FROM chunks WHERE chunk_id IS NOT NULL AND entities IS NOT NULL AND keyphrases IS NOT NULL), i AS (SELECT chunk_id, e, k, unnest(range(0, least(len(e), len(k)))) AS i FROM c)
SELECT chunk_id, CAST(i AS INT) AS place, e[i + 1] AS entities, k[i + 1] AS keyphrases FROM i""")
def jon10_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "chunks").where("chunk_id is not null and entities is not null and keyphrases is not null").select("chunk_id", "entities", "keyphrases").distinct()
    return A.side_by_side(c, "chunk_id", "entities", "keyphrases")


@query(f"""
WITH s AS {_STEP}, a AS (SELECT trajectory_id, step_number, coalesce(action_name, '') || ' ' || coalesce(action_args_json, '') AS action FROM s WHERE is_tool_step), r AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id, action ORDER BY step_number) AS visit FROM a)
SELECT trajectory_id, step_number, visit FROM r WHERE visit % 3 = 0""")
def win20_repeated_actions(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "steps").where("trajectory_id is not null and step_number is not null").groupBy("trajectory_id", "step_number").agg(F.min_by(F.struct("is_tool_step", "action_name", "action_args_json"), "step_id").alias("x")).where("x.is_tool_step")
    a = s.select("trajectory_id", "step_number", F.concat_ws(" ", F.coalesce("x.action_name", F.lit("")), F.coalesce("x.action_args_json", F.lit(""))).alias("action"))
    return W.revisits(a, ["trajectory_id"], "action", ["step_number"], 2).drop("action")


@query("""
SELECT DISTINCT trajectory_id, CASE WHEN regexp_matches(final_answer, '(?is)<answer>.{3,}?</answer>') THEN 0.1 ELSE 0.0 END::DOUBLE AS filled, CASE WHEN n = 0 THEN 0.0 WHEN n = 1 THEN 0.2 ELSE 0.3 END::DOUBLE AS grounded, CASE WHEN contains(lower(final_answer), 'calculator') THEN 0.2 ELSE 0.0 END::DOUBLE AS calculated
FROM (SELECT trajectory_id, final_answer, len(regexp_extract_all(final_answer, '(?i)agreement')) AS n FROM trajectories WHERE final_answer IS NOT NULL)""")
def rwd15_table_answers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("final_answer")
    return read(spark, d, "trajectories").where("final_answer is not null").select("trajectory_id", R.filled_answer(c).alias("filled"), R.table_grounding(c, "agreement").alias("grounded"), R.calculator_grounding(c).alias("calculated")).distinct()


@query(None)
def rwd15_amounts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("final_answer is not null and gold_answer is not null").select("trajectory_id", "final_answer", "gold_answer").distinct()
    p, g = F.col("final_answer"), F.col("gold_answer")
    return t.select("trajectory_id", R.amount_coverage(p, g).alias("coverage"), R.amount_correctness(p, g).alias("correctness"))


@query("""
SELECT trajectory_id, CASE WHEN n >= 2 THEN 0.3 WHEN n = 1 THEN 0.2 ELSE 0.0 END::DOUBLE AS computation, round((CASE WHEN contains(a, 'search_corpus') THEN 1 ELSE 0 END + CASE WHEN contains(a, 'calculator') THEN 1 ELSE 0 END) * 0.1, 6)::DOUBLE AS chain
FROM (SELECT trajectory_id, count(*) FILTER (tool_name = 'calculator') AS n, string_agg(coalesce(tool_name, '-'), ',' ORDER BY step_number, tool_call_id) AS a FROM tool_calls WHERE trajectory_id IS NOT NULL GROUP BY 1)""")
def rwd12_computation_chain(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "tool_calls").where("trajectory_id is not null").groupBy("trajectory_id").agg(F.count_if(F.col("tool_name") == "calculator").alias("n"), F.array_join(F.collect_list(F.coalesce("tool_name", F.lit("-"))), ",").alias("a"))
    return g.select("trajectory_id", R.computation(F.col("n")).alias("computation"), R.tool_chain(F.col("a"), ("search_corpus", "calculator")).alias("chain"))


@query("""
WITH t AS (SELECT DISTINCT trajectory_id, CASE WHEN regexp_matches(final_answer, '(?is)<answer>.*?</answer>') THEN 0.1 ELSE 0.0 END AS f, CASE WHEN regexp_matches(final_answer, '(?is)<answer>.*?</answer>') THEN 1.0 WHEN n_tool_calls <= 2 THEN 0.0 ELSE greatest(-1.0, -0.25 * (n_tool_calls - 2)) END AS t, reward AS c, CASE WHEN reward >= 0.5 THEN greatest(0.0, 1 - n_tool_calls / 10.0) ELSE 0.0 END AS n,
 CASE WHEN n_tool_calls = 3 THEN 1.2 WHEN n_tool_calls < 3 THEN 0.5 * n_tool_calls / 3 ELSE greatest(0.0, 1 - ln(1 + n_tool_calls - 3) / ln(11)) END AS g FROM trajectories WHERE final_answer IS NOT NULL AND n_tool_calls IS NOT NULL AND reward IS NOT NULL)
SELECT trajectory_id, round((f * 0.1 + c * 0.5 + n * 0.2 + g * 0.2) / 1.0, 6) AS t3, round(f * 0.1 + t * 0.3 + c * 0.4 + n * 0.1 + g * 0.1, 6) AS combined, round((f * 0.1 + t * 0.3 + c * 0.4 + n * 0.1 + g * 0.1 + 0.2 * 0.05) / 1.05, 6) AS m2 FROM t""")
def rwd20_reward_stacks(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("final_answer is not null and n_tool_calls is not null and reward is not null")
    a, n, ok = F.col("final_answer"), F.col("n_tool_calls"), F.col("reward") >= 0.5
    parts = {"format": R.answer_format(a), "termination": R.termination(a, n), "correctness": F.col("reward"), "necessity": R.necessity(ok, n, 10), "frugality": R.frugality(n, F.lit(3), 10), "decision": R.decision_token(F.concat(a, F.lit("<decision:drop:answer-now>")))}
    return t.select("trajectory_id", *[F.round(R.stacked(k, parts), 6).alias(k) for k in ("t3", "combined", "m2")]).distinct()


@query("""
WITH q AS (SELECT question, avg(CASE WHEN reward >= 0.5 THEN 1.0 ELSE 0.0 END) AS r FROM trajectories WHERE question IS NOT NULL GROUP BY 1) SELECT question, round(r, 6) AS solve_rate, CASE WHEN r >= 0.5 THEN 'easy' ELSE 'hard' END AS label FROM q""")
def solver_labels(spark: SparkSession, d: str) -> DataFrame:
    from velarium.operators import metrics

    return metrics.labelled_by_solver(read(spark, d, "trajectories").where("question is not null"), F.col("reward") >= 0.5, ["question"])


@query("""
WITH p AS (SELECT DISTINCT trajectory_id, run_id, final_answer AS p, gold_answer AS g FROM trajectories WHERE final_answer IS NOT NULL AND gold_answer IS NOT NULL)
SELECT run_id, round(avg(CASE WHEN trim(p, ' ') = trim(g, ' ') THEN 1.0 ELSE 0.0 END), 6) AS same, round(avg(least(length(p), length(g)) / greatest(length(p), length(g))), 6) AS length_ratio, count(*) AS n FROM p GROUP BY 1""")
def custom_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a user's own; the second fails, and so scores 0, where both texts are empty."""
    from velarium.operators import metrics

    for name, f in (("same", lambda p, g: p.strip(" ") == g.strip(" ")), ("length_ratio", lambda p, g: min(len(p), len(g)) / max(len(p), len(g)))):
        metrics.METRICS[name] = metrics.custom(f)
    t = read(spark, d, "trajectories").where("final_answer is not null and gold_answer is not null").select("trajectory_id", "run_id", "final_answer", "gold_answer").distinct()
    return metrics.evaluated(t, ("same", "length_ratio"), "final_answer", "gold_answer", ("run_id",))


@query("""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL), s AS (SELECT chunk_id, list_filter(string_split(text, '. '), lambda x: contains(x, ' is ')) AS s FROM c), i AS (SELECT chunk_id, s, unnest(range(0, len(s))) AS i FROM s)
SELECT chunk_id, CAST(i AS INT) AS place, 'What is ' || string_split(s[i + 1], ' is ')[1] || '?' AS question, s[i + 1] AS answer FROM i""")
def generated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A generator that asks what each sentence with "is" says."""
    from velarium.operators import metrics

    def make(text: str):
        for s in text.split(". "):
            if " is " in s:
                yield f"What is {s.split(' is ')[0]}?", s

    return metrics.generated(read(spark, d, "chunks").where("chunk_id is not null and text is not null").select("chunk_id", "text").distinct(), make, "chunk_id", "text")


def chunk_links(spark: SparkSession, d: str, least: int = 2) -> DataFrame:
    """``(src, dst)``: chunks of one document that share ``least`` entities."""
    from velarium.operators.joins import sharing

    e = read(spark, d, "chunks").where("doc_id is not null and chunk_id is not null").select("doc_id", "chunk_id", F.explode("entities").alias("e")).where("e is not null").select("doc_id", "chunk_id", F.lower("e").alias("e"))
    return sharing(e.groupBy("doc_id", "chunk_id").agg(F.collect_set("e").alias("items")), "chunk_id", F.col("items"), least, "doc_id").select("src", "dst")


_LINKS = "(SELECT a.chunk_id AS src, b.chunk_id AS dst FROM (SELECT DISTINCT doc_id, chunk_id, lower(e) AS e FROM (SELECT doc_id, chunk_id, unnest(entities) AS e FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL) WHERE e IS NOT NULL) a JOIN (SELECT DISTINCT doc_id, chunk_id, lower(e) AS e FROM (SELECT doc_id, chunk_id, unnest(entities) AS e FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL) WHERE e IS NOT NULL) b ON a.doc_id = b.doc_id AND a.e = b.e AND a.chunk_id < b.chunk_id GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"""
WITH e AS {_LINKS}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
p1 AS (SELECT src, dst, [src, dst] AS path FROM s),
""" + ",\n".join(f"q{n} AS (SELECT p.src, b.dst, list_append(path, b.dst) AS path FROM p{n - 1} p JOIN s b ON p.dst = b.src WHERE NOT list_contains(path, b.dst)), p{n} AS (SELECT src, dst, path FROM q{n} QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY path) <= 3)" for n in range(2, 6)) + """,
u AS (""" + " UNION ALL ".join(f"SELECT src, dst, path, {n} AS n_hops FROM p{n} WHERE src < dst" for n in range(2, 6)) + """)
SELECT src, dst, array_to_string(path, '>') AS path, n_hops FROM u QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY n_hops, path) <= 3""")
def set15_simple_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of two to five links between chunks, three for each pair of ends."""
    return G.simple_paths(chunk_links(spark, d), 5, per_pair=3).withColumn("path", F.array_join("path", ">"))


@query(f"""
WITH e AS {_LINKS}, a AS (SELECT src AS seed, dst AS node, 1 AS depth FROM e), b AS (SELECT a.seed, e.dst AS node, 2 AS depth FROM a JOIN e ON a.node = e.src WHERE e.dst <> a.seed)
SELECT seed, node, min(depth) AS depth FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def set17_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    e = chunk_links(spark, d)
    return G.neighbourhood(e, e.select(F.col("src").alias("node")).distinct(), 2)


@query(f"""
WITH e AS {_LINKS}, k AS (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND length(text) >= 200) SELECT src, dst FROM e WHERE src IN (SELECT chunk_id FROM k) AND dst IN (SELECT chunk_id FROM k)""")
def set19_forget(spark: SparkSession, d: str) -> DataFrame:
    """Links left when short chunks are forgotten."""
    nodes = read(spark, d, "chunks").where("chunk_id is not null").groupBy(F.col("chunk_id").alias("id")).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    return G.forget(nodes, chunk_links(spark, d), F.col("n") >= 200)[1]


@query(f"""
WITH e AS {_LINKS}, i AS (SELECT chunk_id AS id, max(text) AS content, max(start_pos) AS ts FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1), s AS (SELECT id FROM i WHERE contains(lower(content), 'the ')),
f AS (SELECT e.dst AS id, s.id AS seed FROM s JOIN e ON e.src = s.id), g AS (SELECT e.dst AS id, f.seed FROM f JOIN e ON e.src = f.id WHERE e.dst <> f.seed)
SELECT id, ts FROM i WHERE id IN (SELECT id FROM f UNION SELECT id FROM g) ORDER BY ts DESC NULLS LAST, id LIMIT 50""")
def set18_linked_recall(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as memories, read by a word; 50 is the read's size."""
    items = read(spark, d, "chunks").where("chunk_id is not null").groupBy(F.col("chunk_id").alias("id")).agg(F.max("text").alias("content"), F.max("start_pos").alias("ts")).withColumn("scope", F.lit("all"))
    return G.recall_linked(items, chunk_links(spark, d), "the ", 50, hops=2)
