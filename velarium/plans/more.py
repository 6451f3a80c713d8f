"""Queries of the remaining operators: evaluation scores, dates, arrays, maps, memory and synthesis rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velarium.functions import jsonx, parsers, rules
from velarium.functions import numbers as N
from velarium.functions import text as T
from velarium.functions.text import text_dates
from velarium.operators import evaluation as E
from velarium.operators import rewards as R
from velarium.operators import shaping as S
from velarium.plans.registry import query, read
from velarium.plans.scoring import _PAIRS, _answer, _distinct, _numbers, _pairs, _squad


@query("""
WITH t AS (SELECT DISTINCT trajectory_id, model, reward AS p, reward * 0.8 AS r FROM trajectories WHERE reward IS NOT NULL)
SELECT model, round(avg(ln((p + 0.01) / (r + 0.01))), 6) AS log_ratio_mean, round(stddev_pop(ln((p + 0.01) / (r + 0.01))), 6) AS log_ratio_std, round(avg(0.1 * (p - r)), 6) AS implicit_reward FROM t GROUP BY 1""")
def agg28_log_ratios(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("reward is not null").select("trajectory_id", "model", F.col("reward").alias("p"), (F.col("reward") * 0.8).alias("r")).distinct()
    ratio = F.ln((F.col("p") + 0.01) / (F.col("r") + 0.01))
    return t.groupBy("model").agg(F.round(F.avg(ratio), 6).alias("log_ratio_mean"), F.round(F.stddev_pop(ratio), 6).alias("log_ratio_std"), F.round(F.avg(0.1 * (F.col("p") - F.col("r"))), 6).alias("implicit_reward"))


@query("SELECT event_type, round(coalesce(CASE WHEN isinf(avg(value)) THEN 1e9 ELSE avg(value) END, 'nan'::DOUBLE), 6) AS perplexity, count(value) AS n FROM events GROUP BY 1")
def agg32_mean_of_supplied(spark: SparkSession, d: str) -> DataFrame:
    return E.supplied_mean(read(spark, d, "events"), ["event_type"], "value").select("event_type", F.col("mean").alias("perplexity"), "n")


@query("SELECT round(avg(CASE WHEN trim(final_answer, ' ') = trim(gold_answer, ' ') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM trajectories WHERE final_answer IS NOT NULL AND gold_answer IS NOT NULL")
def agg33_exact_accuracy(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("final_answer is not null and gold_answer is not null")
    return t.agg(F.round(F.avg((F.trim("final_answer") == F.trim("gold_answer")).cast("double")), 6).alias("accuracy"))


@query("""
WITH c AS (SELECT trajectory_id, 1 - count(DISTINCT (tool_name, query)) / count(*) AS arr, count(*) AS n FROM tool_calls GROUP BY 1), t AS (SELECT trajectory_id, max(reward) AS r FROM trajectories GROUP BY 1)
SELECT trajectory_id, round(greatest(0.0, least(1.0, (coalesce(r, 0) + 1 + 1 + 1 + 1) / 5 - 0.2 * arr - 0.1 * CASE WHEN n > 20 THEN 1 ELSE 0 END)), 6) AS composite FROM c JOIN t USING (trajectory_id)""")
def agg34_composite_score(spark: SparkSession, d: str) -> DataFrame:
    call = F.struct(F.coalesce("tool_name", F.lit("\u0000")), F.coalesce("query", F.lit("\u0000")))
    c = read(spark, d, "tool_calls").groupBy("trajectory_id").agg((1 - F.count_distinct(call) / F.count(F.lit(1))).alias("arr"), F.count(F.lit(1)).alias("n"))
    t = read(spark, d, "trajectories").groupBy("trajectory_id").agg(F.max("reward").alias("r"))
    one = F.lit(1.0)
    return c.join(t, "trajectory_id").select("trajectory_id", F.round(R.composite_trajectory(F.coalesce("r", F.lit(0.0)), one, one, one, one, F.col("arr"), (F.col("n") > 20).cast("int")), 6).alias("composite"))


@query("""
WITH m AS (SELECT model, avg(reward) AS a, count(reward) AS n FROM trajectories WHERE model IS NOT NULL GROUP BY 1) SELECT x.model AS a_model, y.model AS b_model, round(y.a - x.a, 6) AS delta, y.a >= x.a - 0.05 AS keeps FROM m x JOIN m y ON x.model < y.model""")
def agg35_compare_models(spark: SparkSession, d: str) -> DataFrame:
    return E.compare(read(spark, d, "trajectories"), "model", "reward", 0.05)


@query("""
WITH j AS (SELECT run_id, condition, avg(coalesce(reward, 0.5)) AS m, min(coalesce(reward, 0.5)) AS lo, max(coalesce(reward, 0.5)) AS hi FROM trajectories GROUP BY 1, 2)
SELECT run_id, round(avg(m), 6) AS mean, round(min(lo), 6) AS least, round(max(hi), 6) AS greatest FROM j GROUP BY 1""")
def agg37_judges(spark: SparkSession, d: str) -> DataFrame:
    return E.judges(read(spark, d, "trajectories"), "run_id", "condition", "reward")


@query("""
WITH c AS (SELECT trajectory_id, count(*) AS n, count(DISTINCT (tool_name, query)) AS u FROM tool_calls GROUP BY 1), t AS (SELECT DISTINCT trajectory_id, run_id FROM trajectories)
SELECT run_id, round(avg(n), 6) AS mean_calls, round(avg(1 - u / n), 6) AS mean_arr FROM c JOIN t USING (trajectory_id) GROUP BY 1""")
def agg39_mean_metrics(spark: SparkSession, d: str) -> DataFrame:
    call = F.struct(F.coalesce("tool_name", F.lit("\u0000")), F.coalesce("query", F.lit("\u0000")))
    c = read(spark, d, "tool_calls").groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(call).alias("u"))
    return c.join(read(spark, d, "trajectories").select("trajectory_id", "run_id").distinct(), "trajectory_id").groupBy("run_id").agg(F.round(F.avg("n"), 6).alias("mean_calls"), F.round(F.avg(1 - F.col("u") / F.col("n")), 6).alias("mean_arr"))


_STOP = "(" + ", ".join(f"'{w}'" for w in E.STOP) + ")"
_CODE = "[" + ", ".join(f"'{w}'" for w in E.CODE) + "]"


def _content(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]+'), lambda x: length(x) > 1 AND x NOT IN {_STOP})"


_F1 = "CASE WHEN len(b) = 0 THEN 1.0 ELSE round(CASE WHEN coalesce(c, 0) = 0 THEN 0.0 ELSE 2.0 * c / (len(a) + len(b)) END, 4) END"
_COMMON = "list_sum(list_transform(list_intersect(a, b), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x)))))"


@query(f"""
WITH t AS (SELECT trajectory_id, {_content(_answer('p'))} AS a, {_content('g')} AS b FROM {_PAIRS}), o AS (SELECT trajectory_id, a, b, {_COMMON} AS c FROM t)
SELECT trajectory_id, {_F1} AS f1 FROM o""")
def stx7_eval_f1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("trajectory_id", E.eval_f1(T.answer(F.col("p")), F.col("g")).alias("f1"))


@query(f"""
WITH t AS (SELECT trajectory_id, {_content(_answer('p'))} AS a, {_content('g')} AS b, {_numbers(_answer('p'))} AS pn, {_distinct('g')} AS gn, list_distinct(list_filter(regexp_split_to_array(lower({_answer('p')}), '\\s+'), lambda x: list_contains({_CODE}, x))) AS pk, list_distinct(list_filter(regexp_split_to_array(lower(g), '\\s+'), lambda x: list_contains({_CODE}, x))) AS gk FROM {_PAIRS}),
o AS (SELECT *, {_COMMON} AS c FROM t), f AS (SELECT *, {_F1} AS f1 FROM o),
x AS (SELECT trajectory_id, f1, CASE WHEN len(gn) > 0 THEN round(len(list_filter(gn, lambda x: len(list_filter(pn, lambda y: abs(y - x) / abs(x) <= 0.02)) > 0)) / len(gn), 4) END AS n, CASE WHEN len(gk) >= 3 THEN round((len(list_intersect(gk, pk)) / len(gk) + f1) / 2, 4) END AS k FROM f)
SELECT trajectory_id, round((f1 + coalesce(n, 0) * 1.5 + coalesce(k, 0) * 1.2) / (1 + CASE WHEN n IS NULL THEN 0 ELSE 1.5 END + CASE WHEN k IS NULL THEN 0 ELSE 1.2 END), 4) AS score FROM x""")
def stx8_universal_score(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("trajectory_id", E.universal(F.col("p"), F.col("g")).alias("score"))


@query("""
SELECT trajectory_id, round(count(DISTINCT tool_name) FILTER (tool_name IN ('search_corpus', 'read_document', 'calculator')) / 3.0, 6) AS share, CASE WHEN count(*) >= 5 THEN 1.0 WHEN count(*) >= 2 THEN 0.5 ELSE 0.2 END::DOUBLE AS tier FROM tool_calls GROUP BY 1""")
def stx15_tool_tiers(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    named = F.count_distinct(F.when(F.col("tool_name").isin("search_corpus", "read_document", "calculator"), F.col("tool_name")))
    return read(spark, d, "tool_calls").groupBy("trajectory_id").agg(F.round(named / 3.0, 6).alias("share"), F.when(n >= 5, 1.0).when(n >= 2, 0.5).otherwise(0.2).alias("tier"))


@query("""
WITH r AS (SELECT trajectory_id, coalesce(result, '') AS result, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_number, tool_call_id) AS i FROM tool_calls), f AS (SELECT trajectory_id, result FROM r WHERE i = 1), t AS (SELECT DISTINCT trajectory_id, gold_answer AS g FROM trajectories WHERE gold_answer IS NOT NULL),
x AS (SELECT trajectory_id, list_distinct(regexp_extract_all(lower(g), '[a-z0-9]+')) AS g, regexp_extract_all(lower(result), '[a-z0-9]+') AS r FROM t JOIN f USING (trajectory_id))
SELECT trajectory_id, CAST(len(g) >= 2 AND len(list_intersect(g, r)) / len(g) >= 0.6 AS INT) AS leak FROM x""")
def stx21_one_shot_leak(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "tool_calls").groupBy("trajectory_id").agg(F.min_by(F.coalesce("result", F.lit("")), F.struct("step_number", "tool_call_id")).alias("result"))
    t = read(spark, d, "trajectories").where("gold_answer is not null").select("trajectory_id", "gold_answer").distinct()
    g, r = F.array_distinct(T.words(F.col("gold_answer"))), T.words(F.col("result"))
    return t.join(first, "trajectory_id").select("trajectory_id", ((F.size(g) >= 2) & (F.size(F.array_intersect(g, r)) / F.size(g) >= 0.6)).cast("int").alias("leak"))


@query(r"SELECT tool_call_id, substr(CASE WHEN regexp_matches(result, '[.!?](\s|\z)') THEN regexp_extract(result, '(?s)^(.*?[.!?])(\s|\z)', 1) ELSE result END, 1, 300) AS brief FROM tool_calls WHERE result IS NOT NULL")
def stx25_first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "tool_calls").where("result is not null").select("tool_call_id", E.first_sentence(F.col("result"), 300).alias("brief"))


@query(None)
def stx25_evidence_notes(spark: SparkSession, d: str) -> DataFrame:
    """The whole of STX25 over every result, of several lines too."""
    return read(spark, d, "tool_calls").where("result is not null").select("tool_call_id", E.compressed(F.col("result")).alias("notes"))


@query(rf"""
WITH n AS (SELECT trajectory_id, TRY_CAST(replace(regexp_extract(p, '(-?\d[\d,]*\.?\d*)', 1), ',', '') AS DOUBLE) AS x, TRY_CAST(replace(regexp_extract(g, '(-?\d[\d,]*\.?\d*)', 1), ',', '') AS DOUBLE) AS y FROM {_PAIRS})
SELECT trajectory_id, CASE WHEN y = 0 THEN x = 0 ELSE abs(x - y) / abs(y) <= 0.02 END AS close_2pct, CASE WHEN y = 0 THEN x = 0 ELSE abs(x - y) / abs(y) <= 0.01 END AS close_1pct FROM n WHERE x IS NOT NULL AND y IS NOT NULL""")
def num6_num8_closeness(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.get(N.numbers_in(F.col("p")), 0), F.get(N.numbers_in(F.col("g")), 0)
    n = _pairs(spark, d).select("trajectory_id", x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    return n.select("trajectory_id", N.close(F.col("x"), F.col("y")).alias("close_2pct"), N.close(F.col("x"), F.col("y"), 0.01).alias("close_1pct"))


_SCALED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(gold_answer, '(?i)(\\d)\\s*thousands?\\b', '\\1K', 'g'), '(?i)(\\d)\\s*millions?\\b', '\\1M', 'g'), '(?i)(\\d)\\s*billions?\\b', '\\1B', 'g'), '(?i)(\\d)\\s*trillions?\\b', '\\1T', 'g')"


@query(f"""
WITH t AS (SELECT DISTINCT trajectory_id, regexp_replace({_SCALED}, '^\\s+|\\s+$', '', 'g') AS t FROM trajectories WHERE gold_answer IS NOT NULL),
n AS (SELECT trajectory_id, starts_with(t, '(') AND ends_with(t, ')') AS neg, regexp_replace(CASE WHEN starts_with(t, '(') AND ends_with(t, ')') THEN t[2:-2] ELSE t END, '^(-?)[$€£]+', '\\1') AS t FROM t), c AS (SELECT trajectory_id, neg, ends_with(t, '%') AS pct, regexp_replace(t, '%$', '') AS t FROM n),
u AS (SELECT trajectory_id, neg, pct, lower(regexp_extract(t, '([KkMmBbTt])$', 1)) AS unit, regexp_replace(t, '[KkMmBbTt]$', '') AS t FROM c)
SELECT DISTINCT trajectory_id, CASE WHEN regexp_matches(t, '^[+-]?\\d*(,\\d{{3}})*(\\.\\d*)?([eE][+-]?\\d+)?$') AND regexp_matches(t, '\\d') THEN TRY_CAST(replace(t, ',', '') AS DOUBLE) * CASE unit WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 't' THEN 1e12 ELSE 1.0 END / CASE WHEN pct THEN 100.0 ELSE 1.0 END * CASE WHEN neg THEN -1 ELSE 1 END END AS value FROM u""")
def num4_num5_parse_number(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("gold_answer is not null").select("trajectory_id", "gold_answer").distinct()
    return t.select("trajectory_id", N.parse_number(E.scale_words(F.col("gold_answer"))).alias("value")).distinct()


@query("SELECT event_id, round(1 / (1 + exp(-value / 100.0)), 6) AS sigmoid FROM events WHERE value IS NOT NULL")
def num11_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("value is not null").select("event_id", F.round(N.sigmoid(F.col("value") / 100.0), 6).alias("sigmoid"))


@query(r"""
SELECT DISTINCT trajectory_id, greatest(0.0, least(1.0, coalesce(TRY_CAST(json_extract_string(TRY_CAST(final_answer AS JSON), '$.score') AS DOUBLE), TRY_CAST(nullif(regexp_extract(final_answer, '\b([01](?:\.\d+)?)\b', 1), '') AS DOUBLE), 0.0)))::DOUBLE AS score FROM trajectories""")
def num13_judge_score(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "trajectories").select("trajectory_id", jsonx.judge_score(F.coalesce("final_answer", F.lit(""))).alias("score")).distinct()


@query("SELECT DISTINCT id FROM emails WHERE date >= '2000-06-01 00:00:00' AND date < '2001-06-01 00:00:00'")
def dat1_date_range(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "emails").where(text_dates(F.col("date"), "2000-06-01", "2001-06-01")).select("id").distinct()


@query("SELECT chunk_id, list_sort(list_distinct(list_filter(entities, lambda x: x IS NOT NULL AND list_contains(keyphrases, x)))) AS both, CAST(len(list_distinct(list_filter(list_concat(entities, keyphrases), lambda x: x IS NOT NULL))) AS INT) AS either FROM chunks WHERE entities IS NOT NULL AND keyphrases IS NOT NULL")
def arr1_arr2_set_functions(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "chunks").where("entities is not null and keyphrases is not null")
    known = lambda a: F.filter(a, lambda x: x.isNotNull())
    return c.select("chunk_id", F.sort_array(F.array_intersect(known("entities"), known("keyphrases"))).alias("both"), F.size(F.array_union(known("entities"), known("keyphrases"))).alias("either"))


@query(f"""
WITH t AS (SELECT trajectory_id, regexp_extract_all(lower(p), '[a-z0-9]+') AS a, regexp_extract_all(lower(g), '[a-z0-9]+') AS b FROM {_PAIRS})
SELECT trajectory_id, CAST(coalesce(list_sum(list_transform(list_intersect(a, b), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS INT) AS overlap FROM t""")
def map2_multiset_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("trajectory_id", T.multiset_overlap(T.words(F.col("p")), T.words(F.col("g"))).alias("overlap"))


@query(r"""
WITH t AS (SELECT step_id, action_args_json AS x, coalesce(TRY_CAST(action_args_json AS JSON), TRY_CAST(nullif(regexp_extract(action_args_json, '(?s)(\{.*\})', 1), '') AS JSON), TRY_CAST(nullif(regexp_extract(action_args_json, '(?s)(\[.*\])', 1), '') AS JSON)) AS j FROM steps WHERE action_args_json IS NOT NULL)
SELECT step_id, list_filter([CASE WHEN json_extract_string(j, '$.query') IS NULL THEN 'query' END, CASE WHEN json_extract_string(j, '$.top_k') IS NULL THEN 'top_k' END], lambda x: x IS NOT NULL) AS missing, CAST(len(regexp_extract_all(x, '\{[^{}]*\}')) AS INT) AS n_objects FROM t""")
def jsn2_jsn3_required_fields(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "steps").where("action_args_json is not null")
    v = jsonx.tolerant(F.col("action_args_json"))
    return s.select("step_id", jsonx.missing_fields(v, ("query", "top_k")).alias("missing"), F.size(jsonx.objects_in(F.col("action_args_json"))).alias("n_objects"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive FROM embeddings")
def jsn6_list_columns(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("j"))
    return j.select("vec_id", F.size(F.filter(F.from_json("j", "array<float>"), lambda x: x > 0)).alias("positive"))


@query(rf"""
WITH n AS (SELECT trajectory_id, list_transform(regexp_extract_all(p, '(-?\d[\d,]*\.?\d*)', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)) AS p, TRY_CAST(replace(regexp_extract(g, '(-?\d[\d,]*\.?\d*)', 1), ',', '') AS DOUBLE) AS g, {_squad(_answer('p'))} AS ps, {_squad('g')} AS gs FROM {_PAIRS})
SELECT trajectory_id, CASE WHEN g IS NOT NULL THEN CASE WHEN len(list_filter(p, lambda x: abs(x - g) < 1e-3)) > 0 THEN 1.5 WHEN len(list_filter(p, lambda x: CASE WHEN g = 0 THEN x = 0 ELSE abs(x - g) / abs(g) <= 0.01 END)) > 0 THEN 0.5 ELSE 0.0 END WHEN ps = gs THEN 1.5 ELSE 0.0 END::DOUBLE AS reward FROM n""")
def rwd5_correct_answer(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("trajectory_id", R.correct_answer(F.col("p"), F.col("g")).alias("reward"))


@query("""
SELECT DISTINCT trajectory_id, round(CASE WHEN reward >= 0.5 THEN greatest(0.0, 1 - n_tool_calls / 10.0) ELSE 0.0 END, 6) AS necessity, round(CASE WHEN n_tool_calls > 2 THEN CASE WHEN reward >= 0.5 THEN greatest(0.0, 1 - n_tool_calls / 10.0) ELSE 0.0 END WHEN reward >= 0.5 AND n_tool_calls = 0 THEN 1.0 ELSE 0.0 END, 6) AS regime FROM trajectories WHERE reward IS NOT NULL AND n_tool_calls IS NOT NULL""")
def rwd19_necessity(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("reward is not null and n_tool_calls is not null")
    ok, n = F.col("reward") >= 0.5, F.col("n_tool_calls")
    return t.select("trajectory_id", F.round(R.necessity(ok, n, 10), 6).alias("necessity"), F.round(R.necessity(ok, n, 10, n > 2), 6).alias("regime")).distinct()


@query("SELECT step_id, trim(action_name, ' ') AS name, coalesce(action_args_json, '{}') AS args FROM steps WHERE is_tool_step AND trim(action_name, ' ') <> ''")
def prj19_unwrapped_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls put into the usual wrapping come out again, arguments as they were written."""
    s = read(spark, d, "steps").where("is_tool_step and action_name is not null")
    wrapped = F.to_json(F.struct(F.struct(F.col("action_name").alias("name"), F.coalesce("action_args_json", F.lit("{}")).alias("arguments")).alias("function")))
    return s.select("step_id", F.explode(parsers.tool_calls(wrapped)).alias("c")).select("step_id", "c.*")


@query("""
WITH t AS (SELECT DISTINCT trajectory_id, question, final_answer, reward FROM trajectories WHERE question IS NOT NULL AND reward IS NOT NULL AND final_answer IS NOT NULL), g AS (SELECT question, arg_max(final_answer, (reward, -ord)) AS chosen, arg_min(final_answer, (reward, ord)) AS rejected, max(reward) AS hi, min(reward) AS lo FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY trajectory_id) AS ord FROM t) GROUP BY 1)
SELECT question, chosen, rejected FROM g WHERE hi <> lo""")
def prj29_preference_rows(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("question is not null and reward is not null and final_answer is not null").select("trajectory_id", "question", "final_answer", "reward").distinct()
    both = t.groupBy("question").agg(F.max("reward").alias("hi"), F.min("reward").alias("lo"))
    return S.best_worst(t, "question", "trajectory_id", "reward", "final_answer").join(both.where("hi <> lo").select("question"), "question").select("question", "chosen", "rejected")


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT label AS ql, arg_min(e, vec_id) AS q FROM e GROUP BY 1), s AS (SELECT vec_id, label, list_cosine_similarity(e, q) AS s FROM e JOIN q ON e.label = q.ql), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS i FROM s)
SELECT label, vec_id, round(s, 5) AS score FROM r WHERE i <= 4""")
def top4_top5_memory_recall(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    s = e.join(q, "label").select("label", "vec_id", N.cosine(F.col("embedding"), F.col("q")).alias("s"))
    r = s.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id")))
    return r.where("i <= 4").select("label", "vec_id", F.round("s", 5).alias("score"))


@query("SELECT run_id, CASE WHEN n_train < 2 OR n_val < 1 THEN 'degenerate' ELSE 'ok' END AS guard, n_train, n_val FROM (SELECT run_id, count(*) FILTER (s = 'train') AS n_train, count(*) FILTER (s = 'val') AS n_val FROM (SELECT DISTINCT run_id, trajectory_id, CASE WHEN CAST('0x' || substr(sha1('4:' || trajectory_id), 1, 8) AS BIGINT) / 4294967295.0 < 0.2 THEN 'val' ELSE 'train' END AS s FROM trajectories) GROUP BY 1)")
def set14_split_guard(spark: SparkSession, d: str) -> DataFrame:
    from velarium.operators.sets import hash_split

    s = hash_split(read(spark, d, "trajectories").select("run_id", "trajectory_id").distinct(), "trajectory_id", 4, 0.2)
    g = s.groupBy("run_id").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    return g.select("run_id", F.when((F.col("n_train") < 2) | (F.col("n_val") < 1), "degenerate").otherwise("ok").alias("guard"), "n_train", "n_val")


@query("SELECT DISTINCT trajectory_id, reward FROM (SELECT DISTINCT trajectory_id, reward FROM trajectories WHERE reward IS NOT NULL) ORDER BY reward, trajectory_id LIMIT 25")
def flt17_worst_samples(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "trajectories").where("reward is not null").select("trajectory_id", "reward").distinct().orderBy("reward", "trajectory_id").limit(25)  # the report's k


#: Entities too general to link chunks. Fixed values of the reference.
_GENERIC = "agreement|party|parties|company|companies|product|products|affiliate|affiliates|recipient|provider|contractor|vendor|customer|customers|service|services|8-k|10-k|10-q|s-1|exhibit|securities_and_exchange_commission|sec|inc|llc|ltd|corp|corporation".replace("_", " ").split("|")


_STRIPPED = "list_transform(list_filter(coalesce({0}, []), lambda x: x IS NOT NULL), lambda x: regexp_replace(lower(x), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


@query("SELECT DISTINCT chunk_id, list_filter(" + _STRIPPED.format("entities") + ", lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{g}'" for g in _GENERIC) + "))[1:12] AS kept, (" + _STRIPPED.format("keyphrases") + ")[1:6] AS keyphrases FROM chunks WHERE chunk_id IS NOT NULL")
def flt12_entities_and_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    """At most 12 entities off the stop-list and 6 keyphrases of every chunk, in order."""
    strip = lambda a: F.transform(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.regexp_replace(F.lower(x), r"(?U)^\s+|\s+\z", ""))
    kept = F.filter(strip(F.col("entities")), lambda x: (x != "") & ~x.isin(_GENERIC))
    return read(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", F.slice(kept, 1, 12).alias("kept"), F.slice(strip(F.col("keyphrases")), 1, 6).alias("keyphrases")).distinct()


@query("SELECT DISTINCT trajectory_id, CASE WHEN coalesce(n_tool_calls > 10, false) THEN 'calls' WHEN NOT coalesce(reward >= 0.2, false) THEN 'reward' ELSE 'passed' END AS first_failure FROM trajectories")
def flt4_rule_list(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").select("trajectory_id", "n_tool_calls", "reward").distinct()
    c = {k: F.col(k) for k in ("n_tool_calls", "reward")}
    failing = [(rules.compile_rule("n_tool_calls > 10", c), "calls"), (~rules.compile_rule("reward >= 0.2", c), "reward")]
    return t.select("trajectory_id", rules.first_match(failing, "passed").alias("first_failure")).distinct()


@query("SELECT DISTINCT id, CASE WHEN message_id IS NULL THEN 1.0 ELSE round(CASE WHEN contains(lower(coalesce(body, '') || ' ' || coalesce(subject, '')), lower(message_id)) THEN 1.0 ELSE 0.0 END, 4) END::DOUBLE AS recall FROM emails WHERE id IS NOT NULL")
def stx11_message_recall(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.coalesce("body", F.lit("")), F.lit(" "), F.coalesce("subject", F.lit("")))
    return read(spark, d, "emails").where("id is not null").select("id", E.message_recall(said, F.array("message_id")).alias("recall")).distinct()


@query("""
WITH a AS (SELECT trajectory_id, list(query ORDER BY step_number, tool_call_id) AS a FROM tool_calls WHERE query IS NOT NULL GROUP BY 1), g AS (SELECT trajectory_id, min(question) AS q FROM trajectories GROUP BY 1)
SELECT trajectory_id, CAST(coalesce(list_position(a, a[len(a)]), 0) AS BIGINT) - 1 AS last_rank, CAST(coalesce(list_position(a, q), 0) AS BIGINT) - 1 AS question_rank FROM a JOIN g USING (trajectory_id)""")
def stx22_anchor_rank(spark: SparkSession, d: str) -> DataFrame:
    """Where the last query was first asked, and the question itself."""
    a = read(spark, d, "tool_calls").where("query is not null").groupBy("trajectory_id").agg(F.sort_array(F.collect_list(F.struct("step_number", "tool_call_id", "query")))["query"].alias("a"))
    g = read(spark, d, "trajectories").groupBy("trajectory_id").agg(F.min("question").alias("q"))
    return a.join(g, "trajectory_id").select("trajectory_id", E.anchor_rank(F.col("a"), F.element_at("a", -1)).alias("last_rank"), E.anchor_rank(F.col("a"), F.col("q")).alias("question_rank"))


@query("""
WITH t AS (SELECT DISTINCT trajectory_id, question, final_answer, coalesce(has_answer_tag, false) AS g, coalesce(n_tool_calls >= 2, false) AS l, coalesce(reward >= 0.5, false) AS c FROM trajectories), r AS (SELECT *, coalesce(length(question), 0) = 0 OR coalesce(length(final_answer), 0) = 0 AS e FROM t)
SELECT DISTINCT trajectory_id, CASE WHEN e THEN 'rejected' WHEN g AND l AND c THEN 'accepted' WHEN l AND c THEN 'revised_accepted' ELSE 'rejected' END AS status, CASE WHEN e OR (g AND l AND c) THEN 0 ELSE 1 END AS revision_count,
 CASE WHEN e THEN 'empty_qa' WHEN l AND c THEN NULL ELSE array_to_string(list_filter([CASE WHEN NOT l THEN 'retrieval_leak' END, CASE WHEN NOT c THEN 'answerable_from_last_passage' END], lambda x: x IS NOT NULL), '+') END AS discard_reason FROM r""")
def stx23_verify_gates(spark: SparkSession, d: str) -> DataFrame:
    """A tag, two calls and a reward as gates; the revision has the tag."""
    gates = {"grounded": F.col("has_answer_tag"), "no_leak": F.col("n_tool_calls") >= 2, "chained": F.col("reward") >= 0.5}
    v = E.verified(F.col("question"), F.col("final_answer"), gates, gates | {"grounded": F.lit(True)})
    return read(spark, d, "trajectories").select("trajectory_id", v.alias("v")).select("trajectory_id", "v.*").distinct()


@query("SELECT trajectory_id, step_id, CASE WHEN is_terminal THEN 'drop' WHEN is_tool_step THEN 'keep' ELSE 'compress' END AS memory, CASE WHEN is_terminal THEN 'answer-now' WHEN is_tool_step THEN 'search-again' END AS action FROM steps")
def prj37_memory_decision(spark: SparkSession, d: str) -> DataFrame:
    """Thoughts with a decision token behind them, closing and tool steps with one that is known."""
    token = F.when(F.col("is_terminal"), "<decision:drop:answer-now>").when(F.col("is_tool_step"), "<decision:keep:search-again>").otherwise("<decision:keep:never>")
    return read(spark, d, "steps").select("trajectory_id", "step_id", S.memory_decision(F.concat(F.coalesce("thought", F.lit("")), token)).alias("m")).select("trajectory_id", "step_id", "m.*")


@query("""
WITH t AS (SELECT DISTINCT trajectory_id, question, final_answer, metadata_json, coalesce(reward >= 0.3, false) AS made FROM trajectories), s AS (SELECT *, regexp_replace(coalesce(question, ''), '^[ \\t\\r\\n\\x0b\\f]+|[ \\t\\r\\n\\x0b\\f]+$', '', 'g') AS q, regexp_replace(coalesce(final_answer, ''), '^[ \\t\\r\\n\\x0b\\f]+|[ \\t\\r\\n\\x0b\\f]+$', '', 'g') AS a FROM t)
SELECT DISTINCT trajectory_id, CASE WHEN made THEN q ELSE '' END AS question, CASE WHEN made AND q <> '' AND a <> '' THEN NULL WHEN made THEN 'empty_qa' WHEN json_type(TRY_CAST(metadata_json AS JSON)) = 'OBJECT' THEN 'empty_qa' ELSE 'generate_parse_failure' END AS discard_reason FROM s""".replace("\\\\", "\\"))
def prj40_generated_samples(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers as a model would write them, and other JSON text, some of it broken."""
    made = F.to_json(F.struct("question", F.col("final_answer").alias("answer")))
    t = read(spark, d, "trajectories").select("trajectory_id", F.when(F.col("reward") >= 0.3, made).otherwise(F.col("metadata_json")).alias("t")).distinct()
    return S.generated_samples(t, "t", "trajectory_id").select("trajectory_id", "question", "discard_reason").distinct()


@query(None)
def flt15_sql_checks(spark: SparkSession, d: str) -> DataFrame:
    from velarium.operators import sqlrewards

    s = read(spark, d, "steps").select("step_id", F.try_variant_get(F.try_parse_json("action_args_json"), "$.sql", "string").alias("sql")).where("sql is not null")
    return s.select("step_id", "sql", sqlrewards.checked(F.col("sql")).alias("c")).select("step_id", "sql", "c.*")


@query("""
WITH c AS (SELECT chunk_id, any_value(doc_id) AS doc_id, any_value(embedding::DOUBLE[]) AS e FROM (SELECT DISTINCT chunk_id, doc_id, embedding FROM chunks WHERE chunk_id IS NOT NULL AND doc_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(entities, lambda x: x IS NOT NULL)) > 0) GROUP BY 1 HAVING count(*) = 1),
n AS (SELECT DISTINCT doc_id, chunk_id, lower(e) AS e FROM (SELECT doc_id, chunk_id, unnest(entities) AS e FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL) WHERE e IS NOT NULL)
SELECT a.chunk_id AS src, b.chunk_id AS dst FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.chunk_id < b.chunk_id WHERE list_cosine_similarity(a.e, b.e) >= 0.1 AND NOT EXISTS (SELECT 1 FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.e = y.e WHERE x.chunk_id = a.chunk_id AND y.chunk_id = b.chunk_id) ORDER BY 1, 2 LIMIT 60""")
def jon8_alias_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of one document with entities, none of them shared, whose vectors are near; 60 is the operator's budget of pairs."""
    from velarium.operators.joins import similar
    from velarium.plans.training import chunk_links

    c = read(spark, d, "chunks").where("chunk_id is not null and doc_id is not null and embedding is not null").where(F.size(F.filter("entities", lambda x: x.isNotNull())) > 0).select("chunk_id", "doc_id", "embedding").distinct()
    one = c.join(c.groupBy("chunk_id").count().where("count = 1").select("chunk_id"), "chunk_id", "left_semi")
    return similar(one, "chunk_id", "embedding", "doc_id", 0.1).select("src", "dst").join(chunk_links(spark, d, 1), ["src", "dst"], "left_anti").orderBy("src", "dst").limit(60)


@query("""
SELECT lower(replace(trim(action_name, ' '), '-', '_')) AS tool, count(*) AS n, round(avg(CASE WHEN NOT contains(lower(coalesce(observation, 'error')), 'error') THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(coalesce(reward, 0)), 6) AS mean_seconds, CAST(0 AS BIGINT) AS syntax_errors,
 count(*) FILTER (contains(lower(coalesce(observation, 'error')), 'error') AND regexp_matches(lower(observation), 'timeout|time out')) AS timeouts, count(*) FILTER (contains(lower(coalesce(observation, 'error')), 'error') AND NOT coalesce(regexp_matches(lower(observation), 'timeout|time out'), false)) AS runtime_errors FROM steps WHERE is_tool_step GROUP BY 1""")
def agg31_execution_stats(spark: SparkSession, d: str) -> DataFrame:
    """Tool steps as runs: one with an error in its result, or without a result, failed."""
    s = read(spark, d, "steps").where("is_tool_step").select(F.lower(F.replace(F.trim("action_name"), F.lit("-"), F.lit("_"))).alias("tool"), (~F.lower(F.coalesce("observation", F.lit("error"))).contains("error")).alias("success"), F.col("observation").alias("error"), F.col("reward").alias("seconds"))
    return E.execution_stats(s, ["tool"])
