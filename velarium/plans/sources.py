"""Queries of scans, parsers, rules and catalog functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.functions import jsonx, parsers, rules
from velarium.plans.registry import query, read
from velarium.sources import loaders


@query("SELECT run_id, run_type, model FROM runs")
def src2_parquet_scan(spark: SparkSession, d: str) -> DataFrame:
    return loaders.load(spark, f"{d}/runs.parquet").select("run_id", "run_type", "model")


@query("SELECT doc_id FROM (SELECT DISTINCT doc_id FROM corpus_docs WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT 30 OFFSET 10")
def src7_slice(spark: SparkSession, d: str) -> DataFrame:
    return loaders.sliced(read(spark, d, "corpus_docs").where("doc_id is not null").select("doc_id").distinct(), "[10:40]", "doc_id").select("doc_id")


@query("SELECT lower(recipient_type) AS recipient_type, count(DISTINCT (email_id, recipient_address)) AS n FROM recipients WHERE trim(recipient_address, ' ') <> '' AND lower(recipient_type) IN ('to', 'cc', 'bcc') AND email_id IS NOT NULL GROUP BY 1")
def src21_mail_recipients(spark: SparkSession, d: str) -> DataFrame:
    """Mails with their addresses as a mail program has them, taken apart into the two tables again."""
    kinds = [F.collect_list(F.when(F.lower("recipient_type") == k, F.col("recipient_address"))).alias(k) for k in ("to", "cc", "bcc")]
    raw = read(spark, d, "recipients").where("email_id is not null").groupBy(F.col("email_id").alias("message_id")).agg(*kinds)
    return loaders.mail_tables(raw)[1].groupBy("recipient_type").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def src24_ingestion_truth(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "orders").count()
    return loaders.ingestion_truth(loaders.ingestion_corpus(spark, n))


@query("""
SELECT trajectory_id, CASE WHEN reward > 0.8 AND n_tool_calls <= 5 THEN 'fast' WHEN NOT (reward > 0.5) AND reward IS NOT NULL OR condition = 'plain' AND reward IS NOT NULL AND NOT (reward > 0.5) THEN 'check' ELSE 'default' END AS route FROM (SELECT DISTINCT trajectory_id, reward, n_tool_calls, condition FROM trajectories)""")
def flt3_flt5_rules(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").select("trajectory_id", "reward", "n_tool_calls", "condition").distinct()
    c = {k: F.col(k) for k in ("reward", "n_tool_calls", "condition")}
    fast, check = rules.compile_rule("reward > 0.8 and n_tool_calls <= 5", c), rules.compile_rule("not (reward > 0.5) or (condition == 'plain' and not (reward > 0.5))", c)
    return t.select("trajectory_id", rules.first_match([(fast, "fast"), (check, "check")], "default").alias("route"))


@query("SELECT DISTINCT run_id, 'run ' || run_id || ' of ' || coalesce(model, '') || ' {other} ' AS line FROM runs")
def flt7_interpolation(spark: SparkSession, d: str) -> DataFrame:
    t = rules.interpolate("run {run_id} of {model} {other} {a.b}", {"run_id": F.col("run_id"), "model": F.col("model")})
    return read(spark, d, "runs").select("run_id", t.alias("line")).distinct()


@query(r"""SELECT trajectory_id, coalesce(TRY_CAST(metadata_json AS JSON), TRY_CAST(nullif(regexp_extract(metadata_json, '(?s)(\{.*\})', 1), '') AS JSON), TRY_CAST(nullif(regexp_extract(metadata_json, '(?s)(\[.*\])', 1), '') AS JSON)) IS NOT NULL AS parses FROM (SELECT DISTINCT trajectory_id, metadata_json FROM trajectories WHERE metadata_json IS NOT NULL AND trim(metadata_json, ' ') <> '')""")
def jsn1_tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("metadata_json is not null and trim(metadata_json) <> ''").select("trajectory_id", "metadata_json").distinct()
    return t.select("trajectory_id", jsonx.tolerant(F.col("metadata_json")).isNotNull().alias("parses"))


@query("""SELECT DISTINCT trajectory_id, '{' || array_to_string(list_transform(list_sort(map_keys(reward_components)), lambda k: '"' || k || '":' || coalesce(CAST(CAST(round(reward_components[k] * 1000) AS BIGINT) AS VARCHAR), 'null')), ',') || '}' AS j FROM trajectories WHERE reward_components IS NOT NULL""")
def jsn5_canonical_json(spark: SparkSession, d: str) -> DataFrame:
    m = F.transform_values("reward_components", lambda k, v: F.round(v * 1000).cast("bigint"))
    t = read(spark, d, "trajectories").where("reward_components is not null")
    return t.select("trajectory_id", jsonx.canonical_map(m).alias("j")).distinct()


@query(None)
def stx1_chunking(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "corpus_docs").where("doc_id is not null").select("doc_id", "text").distinct()
    p = c.select("doc_id", F.posexplode(parsers.chunks(F.col("text")))).select("doc_id", "pos", "col.*")
    return p.select(F.concat_ws("::", "doc_id", F.col("pos").cast("string")).alias("chunk_id"), "doc_id", F.col("pos").alias("chunk_index"), "text", "start", "end")


@query(None)
def stx16_stx17_rouge_bleu(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("final_answer is not null and gold_answer is not null").select("trajectory_id", "final_answer", "gold_answer").distinct()
    return t.select("trajectory_id", parsers.overlap_scores("final_answer", "gold_answer").alias("s")).select("trajectory_id", "s.*")


@query(None)
def stx31_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "steps").where("is_tool_step and action_name is not null")
    text = F.concat(F.lit('<tool_call>{"name": "'), "action_name", F.lit('", "arguments": '), F.coalesce("action_args_json", F.lit("{}")), F.lit("}</tool_call>"))
    return s.select("step_id", parsers.tool_calls(text).alias("calls"))


@query(None)
def num9_math_answers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "trajectories").where("final_answer is not null").select("trajectory_id", parsers.math_answers("final_answer").alias("answer")).distinct()


@query(None)
def num10_calculator(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "steps").where("action_name = 'calculator'").select("step_id", F.try_variant_get(F.try_parse_json("action_args_json"), "$.expression", "string").alias("expression"))
    return s.select("step_id", "expression", parsers.calculated("expression").alias("value"))


@query(None)
def win8_argument_validity(spark: SparkSession, d: str) -> DataFrame:
    schemas = {"search_corpus": {"properties": {"query": {"type": "string"}, "top_k": {"type": "integer"}}, "required": ["query"]}, "read_document": {"properties": {"doc_id": {"type": "string"}, "page": {"type": "integer"}}, "required": ["doc_id"]}}
    s = read(spark, d, "steps").where("is_tool_step and action_name is not null")
    v = s.select("trajectory_id", parsers.argument_validity(F.col("action_name"), F.coalesce("action_args_json", F.lit("{}")), schemas).alias("ok"))
    return v.groupBy("trajectory_id").agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("tac"))


@query("""
WITH s AS (SELECT trajectory_id, list(action_name ORDER BY step_number, step_id) AS a FROM steps WHERE action_name IS NOT NULL GROUP BY 1), p AS (SELECT trajectory_id, a, len(a) AS n, coalesce(list_position(a, 'search_corpus'), 0) AS i FROM s)
SELECT trajectory_id, CAST(CASE WHEN n = 1 THEN CASE WHEN a[1] IN ('search_corpus', 'read_document') THEN 1 ELSE 2 END
 ELSE n - CASE WHEN i > 0 AND coalesce(list_position(a[i + 1:], 'read_document'), 0) > 0 THEN 2 WHEN (i > 0 AND i < n) OR coalesce(list_position(a[2:], 'read_document'), 0) > 0 THEN 1 ELSE 0 END END AS INT) AS distance FROM p""")
def win10_sequence_distance(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "steps").where("action_name is not null").groupBy("trajectory_id").agg(F.sort_array(F.collect_list(F.struct("step_number", "step_id", "action_name")))["action_name"].alias("names"))
    return s.select("trajectory_id", parsers.sequence_distance("names", F.array(F.lit("search_corpus"), F.lit("read_document"))).alias("distance"))


@query("SELECT n.n_name, r.r_name, count(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2")
def sql_facade(spark: SparkSession, d: str) -> DataFrame:
    from velarium.session import query as ask

    for t in ("nation", "region", "customer"):
        read(spark, d, t).createOrReplaceTempView(t)
    return ask(spark, "SELECT n.n_name, r.r_name, count(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2")
