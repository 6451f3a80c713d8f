"""Queries of text, number and reward functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.functions import numbers as N
from velarium.functions import text as T
from velarium.operators import evaluation as E
from velarium.operators import rewards as R
from velarium.operators.retrieval import bm25, fuse
from velarium.plans.registry import query, read

# DuckDB spellings of the normalisers.
_PUNCT = "[!-/:-@\\[-`{-~]"


def _squad(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '{_PUNCT}', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


def _tok(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda x: x <> '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\r\\n\\x0b\\f]+|[ \\t\\r\\n\\x0b\\f]+$', '', 'g')"


def _answer(x: str) -> str:
    return _strip(f"CASE WHEN regexp_matches({x}, '(?is)<answer>(.*?)</answer>') THEN regexp_extract({x}, '(?is)<answer>(.*?)</answer>', 1) ELSE {x} END")


def _relaxed(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), '^(the|a|an) ', ''), '(^|\\W)(inc|llc|ltd|corp|corporation|co|company|gmbh|plc)$', ''), ' ')"


_PAIRS = "(SELECT DISTINCT trajectory_id, final_answer AS p, gold_answer AS g FROM trajectories WHERE final_answer IS NOT NULL AND gold_answer IS NOT NULL)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "trajectories").where("final_answer is not null and gold_answer is not null").select("trajectory_id", F.col("final_answer").alias("p"), F.col("gold_answer").alias("g")).distinct()


@query("SELECT doc_id || '::' || chunk_index AS made, chunk_id FROM chunks WHERE doc_id IS NOT NULL AND chunk_index IS NOT NULL")
def stx3_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").where("doc_id is not null and chunk_index is not null").select(F.concat_ws("::", "doc_id", F.col("chunk_index").cast("string")).alias("made"), "chunk_id")


@query(f"""
WITH t AS (SELECT trajectory_id, {_tok(_squad(_answer('p')))} AS a, {_tok(_squad('g'))} AS b FROM {_PAIRS}),
o AS (SELECT trajectory_id, a, b, list_sum(list_transform(list_intersect(a, b), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS c FROM t)
SELECT trajectory_id, CAST(array_to_string(a, ' ') = array_to_string(b, ' ') AS INT) AS em, round(CASE WHEN len(a) = 0 OR len(b) = 0 OR coalesce(c, 0) = 0 THEN 0.0 ELSE 2.0 * c / (len(a) + len(b)) END, 6) AS f1 FROM o""")
def stx4_stx5_token_f1(spark: SparkSession, d: str) -> DataFrame:
    a, b = T.answer(F.col("p")), F.col("g")
    return _pairs(spark, d).select("trajectory_id", T.exact(a, b).cast("int").alias("em"), F.round(T.token_f1(a, b), 6).alias("f1"))



@query(f"""
WITH t AS (SELECT trajectory_id, {_tok(_relaxed('p'))} AS a, {_tok(_relaxed('g'))} AS b FROM {_PAIRS})
SELECT trajectory_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 OR len(list_intersect(a, b)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM t""")
def stx6_relaxed_f1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("trajectory_id", F.round(T.relaxed_f1(F.col("p"), F.col("g")), 6).alias("f1"))


def _bare(x: str) -> str:
    return f"regexp_replace(regexp_replace({_strip(f'lower({x})')}, '[.,;:]+$', ''), '[$,%\\s]', '', 'g')"


@query(f"""
SELECT trajectory_id, CAST({_bare(_answer('p'))} = {_bare('g')} AS INT) AS bare_match,
 CAST(length({_squad('g')}) > 4 AND contains({_squad('p')}, {_squad('g')}) AS INT) AS contains_gold FROM {_PAIRS}""")
def stx9_stx10_match(spark: SparkSession, d: str) -> DataFrame:
    p, g = F.col("p"), F.col("g")
    return _pairs(spark, d).select("trajectory_id", (T.bare(T.answer(p)) == T.bare(g)).cast("int").alias("bare_match"), ((F.length(T.squad(g)) > 4) & T.squad(p).contains(T.squad(g))).cast("int").alias("contains_gold"))


@query(f"SELECT trajectory_id, {_answer('p')} AS answer, CAST(regexp_matches(p, '(?is)<answer>.*?</answer>') AS INT) AS tagged FROM {_PAIRS}")
def stx12_answer_tag(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("trajectory_id", T.answer(F.col("p")).alias("answer"), F.col("p").rlike(r"(?is)<answer>.*?</answer>").cast("int").alias("tagged"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?m)^#{1,6} +(.{1,25})')) AS headers, CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\s*\|.*\|\s*$'))) AS INT) AS table_rows FROM corpus_docs WHERE text IS NOT NULL")
def stx13_stx14_structure(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "corpus_docs").where("text is not null").select(
        "doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6} +(.{1,25})"), F.lit(1))).cast("bigint").alias("headers"), F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$"))).alias("table_rows")
    )


@query(r"""
WITH t AS (SELECT DISTINCT trajectory_id, coalesce(final_answer, '') AS p FROM trajectories), w AS (SELECT trajectory_id, p, list_filter(list_transform(string_split(p, '.'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS parts FROM t)
SELECT trajectory_id, CAST(len(list_filter(string_split(trim(regexp_replace(p, '\s+', ' ', 'g'), ' '), ' '), lambda x: x <> '')) AS INT) AS n_words,
 round(CASE WHEN len(parts) > 1 THEN least(1.0, list_sum(list_transform(parts, lambda x: len(string_split(x, ' ')))) / len(parts) / 20.0) END, 6) AS coherence FROM w""")
def stx19_response_stats(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").select("trajectory_id", F.coalesce("final_answer", F.lit("")).alias("p")).distinct()
    return t.select("trajectory_id", F.size(T.tokens(T.squeeze(F.col("p")))).alias("n_words"), F.round(T.coherence(F.col("p")), 6).alias("coherence"))


def _spaced(x: str) -> str:
    return _tok(f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')")


@query(f"""
WITH t AS (SELECT DISTINCT chunk_id, {_strip('lower(summary)')} AS a, {_spaced('summary')} AS w, {_spaced('text')} AS p FROM chunks WHERE chunk_id IS NOT NULL AND summary IS NOT NULL AND text IS NOT NULL)
SELECT chunk_id, a IN ('yes', 'no', 'n/a', 'na', 'none', 'not specified', 'unspecified', 'unlimited', 'not applicable') OR (len(w) > 0 AND len(p) > 0 AND len(list_filter(w, lambda x: list_contains(p, x))) / len(w) >= 0.6) AS grounded FROM t""")
def stx20_span_grounding(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "chunks").where("chunk_id is not null and summary is not null and text is not null").select("chunk_id", "summary", "text").distinct()
    return c.select("chunk_id", E.span_grounded(F.col("summary"), F.col("text")).alias("grounded"))


@query(r"SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', ' ', 'g')), '[a-z0-9]+') AS toks FROM corpus_docs WHERE text IS NOT NULL")
def stx24_window_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "corpus_docs").where("text is not null").select("doc_id", T.words(F.regexp_replace("text", r"<[^>]*>", " ")).alias("toks"))


@query(r"SELECT DISTINCT trajectory_id, trim(regexp_replace(regexp_replace(final_answer, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', ''), ' ') AS rest FROM trajectories WHERE final_answer IS NOT NULL")
def stx26_stx32_without_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "trajectories").where("final_answer is not null").select("trajectory_id", T.without_reasoning(F.col("final_answer")).alias("rest")).distinct()


@query("SELECT tool_call_id, printf('%.3f', length(coalesce(result, '')) / 7.0) || ' ' || CASE WHEN length(result) > 40 THEN substr(result, 1, 40) || '...' ELSE coalesce(result, '') END AS shown FROM tool_calls")
def stx27_search_format(spark: SparkSession, d: str) -> DataFrame:
    r = F.coalesce("result", F.lit(""))
    return read(spark, d, "tool_calls").select("tool_call_id", F.concat(F.format_string("%.3f", F.length(r) / 7.0), F.lit(" "), F.when(F.length("result") > 40, F.concat(F.substring("result", 1, 40), F.lit("..."))).otherwise(r)).alias("shown"))


@query("SELECT doc_id, string_agg(text, chr(10) ORDER BY chunk_index, text) AS text FROM (SELECT DISTINCT doc_id, chunk_index, text FROM chunks WHERE doc_id IS NOT NULL AND chunk_index IS NOT NULL AND text IS NOT NULL) GROUP BY 1")
def stx28_full_document(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "chunks").where("doc_id is not null and chunk_index is not null and text is not null").select("doc_id", "chunk_index", "text").distinct()
    return c.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("chunk_index", "text")))["text"], "\n").alias("text"))


@query("""
WITH a AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a FROM chunks WHERE text IS NOT NULL)
SELECT chunk_id, CAST(list_contains(a, 'warehouse') AND list_contains(a, 'approval') AS INT) AS all_terms, CAST(list_contains(a, 'warehouse') OR list_contains(a, 'approval') AS INT) AS any_term FROM a""")
def stx29_full_text_match(spark: SparkSession, d: str) -> DataFrame:
    a = T.words(F.col("text"))
    one, two = F.array_contains(a, "warehouse"), F.array_contains(a, "approval")
    return read(spark, d, "chunks").where("text is not null").select("chunk_id", (one & two).cast("int").alias("all_terms"), (one | two).cast("int").alias("any_term"))


@query("SELECT trajectory_id, string_agg(action_name, '->' ORDER BY step_number, step_id) AS sig FROM steps WHERE action_name IS NOT NULL GROUP BY 1")
def stx30_signature(spark: SparkSession, d: str) -> DataFrame:
    from velarium.operators.windows import signatures

    return signatures(read(spark, d, "steps"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def num1_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return e.select(F.col("vec_id").alias("a"), "embedding").join(b, "a").select("a", "b", F.round(N.cosine(F.col("embedding"), F.col("v")), 5).alias("cosine"))


@query("""
WITH p AS (SELECT vec_id, label, list_filter(list_transform(embedding::DOUBLE[], lambda x: abs(x)), lambda x: x > 0) AS v FROM embeddings), m AS (SELECT vec_id, label, CASE WHEN len(v) = 0 THEN 0.0 ELSE pow(list_sum(list_transform(v, lambda x: pow(x, -3))) / len(v), -1.0 / 3) END AS m FROM p)
SELECT vec_id, round(greatest(0, least(1, 1 - m)), 5) AS difficulty, label || 'hop_' || CASE WHEN greatest(0, least(1, 1 - m)) < 0.5 THEN 'easy' ELSE 'hard' END AS cell FROM m""")
def num2_num3_difficulty(spark: SparkSession, d: str) -> DataFrame:
    m = N.power_mean(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    diff = N.clamp(1 - m)
    return read(spark, d, "embeddings").select("vec_id", F.round(diff, 5).alias("difficulty"), F.concat(F.col("label").cast("string"), F.lit("hop_"), F.when(diff < 0.5, "easy").otherwise("hard")).alias("cell"))


@query(r"""
WITH n AS (SELECT chunk_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '(-?\d[\d,]*\.?\d*)', 1), lambda x: round(TRY_CAST(replace(x, ',', '') AS DOUBLE), 4)), lambda x: x IS NOT NULL AND x <> 0)) AS n FROM chunks WHERE text IS NOT NULL)
SELECT chunk_id, list_sort(n) AS numbers FROM n""")
def set4_distinct_numbers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").where("text is not null").select("chunk_id", F.sort_array(N.distinct_numbers(F.col("text"))).alias("numbers"))


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all(translate({x}, '$%', ''), '(-?\\d[\\d,]*\\.?\\d*)', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))"


def _distinct(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({_numbers(x)}, lambda x: round(x, 4)), lambda x: x IS NOT NULL AND x <> 0))"


@query(f"""
WITH n AS (SELECT trajectory_id, {_numbers('p')} AS p, {_distinct('g')} AS g FROM {_PAIRS})
SELECT trajectory_id, CASE WHEN len(g) > 0 THEN round(len(list_filter(g, lambda x: len(list_filter(p, lambda y: abs(y - x) / abs(x) <= 0.02)) > 0)) / len(g), 4) ELSE 1.0 END AS recall FROM n""")
def num7_number_recall(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("trajectory_id", N.number_recall(F.col("p"), F.col("g")).alias("recall"))


@query("SELECT step_id, round(greatest(0.0, 1.0 - (step_number - 1) / 10.0), 6) AS penalty, CASE WHEN reward IS NOT NULL THEN round(least(1.0, greatest(0.0, reward / 10.0)), 6) END AS judge FROM steps")
def num12_stage_scores(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "steps").select("step_id", F.round(N.iteration_penalty(F.col("step_number"), 10), 6).alias("penalty"), F.round(N.clamp(F.col("reward") / 10.0), 6).alias("judge"))


@query(r"SELECT DISTINCT trajectory_id, CASE WHEN regexp_matches(final_answer, '(?is)<answer>.*?</answer>') THEN 0.1 ELSE 0.0 END::DOUBLE AS format, CASE WHEN regexp_matches(final_answer, '(?is)<answer>.{10,}?</answer>') THEN 0.1 ELSE 0.0 END::DOUBLE AS long FROM trajectories WHERE final_answer IS NOT NULL")
def rwd8_format_rewards(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("final_answer")
    return read(spark, d, "trajectories").where("final_answer is not null").select("trajectory_id", R.answer_format(c).alias("format"), R.long_answer(c).alias("long")).distinct()


@query(r"SELECT DISTINCT id, CASE WHEN regexp_matches(body, '(?i)<[^>]+@[^>]+>|\b[\w.+\-]+@[\w.\-]+\b|\bmessage[_\-]?id\b') THEN 0.2 ELSE 0.0 END::DOUBLE AS citation FROM emails WHERE id IS NOT NULL AND body IS NOT NULL")
def rwd8_citation(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "emails").where("id is not null and body is not null").select("id", R.citation(F.col("body")).alias("citation")).distinct()


@query(f"""
WITH n AS (SELECT trajectory_id, lower({_answer('p')}) AS p, regexp_extract_all(g, '[$]?[-]?\\d+[.,]?\\d*[BMK%]?') AS w FROM {_PAIRS}), c AS (SELECT trajectory_id, len(w) AS n, len(list_filter(w, lambda x: contains(p, regexp_replace(lower(x), '[%bm]+$', '')))) / len(w) AS share FROM n)
SELECT trajectory_id, CASE WHEN n = 0 THEN 0.0 WHEN share >= 0.8 THEN 1.0 WHEN share >= 0.5 THEN 0.5 WHEN share >= 0.2 THEN 0.2 ELSE 0.0 END::DOUBLE AS coverage FROM c""")
def rwd10_placeholder_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("trajectory_id", R.placeholder_coverage(F.col("p"), F.col("g")).alias("coverage"))


@query(rf"""
WITH t AS (SELECT DISTINCT trajectory_id, lower({_answer('p')}) AS p, regexp_extract_all('**' || q || '** and **' || g || '**', '\\*\\*([^*]{{10,}})\\*\\*', 1)[1:5] AS h FROM (SELECT DISTINCT trajectory_id, final_answer AS p, gold_answer AS g, question AS q FROM trajectories WHERE final_answer IS NOT NULL AND gold_answer IS NOT NULL AND question IS NOT NULL))
SELECT trajectory_id, CASE WHEN len(h) = 0 THEN 0.1 ELSE round(0.3 * len(list_filter(h, lambda x: contains(p, lower(substr(x, 1, 20))))) / len(h), 6) END::DOUBLE AS structure FROM t""".replace("\\\\", "\\"))
def rwd11_template_structure(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("final_answer is not null and gold_answer is not null and question is not null").select("trajectory_id", "final_answer", "gold_answer", "question").distinct()
    template = F.concat(F.lit("**"), "question", F.lit("** and **"), "gold_answer", F.lit("**"))
    return t.select("trajectory_id", F.round(R.template_structure(F.col("final_answer"), template), 6).alias("structure"))


@query("""
SELECT DISTINCT trajectory_id, CASE WHEN n_tool_calls > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS used, CASE WHEN n_tool_calls <= 0 THEN 0.0 WHEN n_tool_calls = 1 THEN 0.2 ELSE 0.3 END::DOUBLE AS grounding, CASE WHEN n_tool_calls <= 0 THEN 0.0 WHEN n_tool_calls = 1 THEN 0.1 ELSE 0.2 END::DOUBLE AS exploration FROM trajectories WHERE n_tool_calls IS NOT NULL""")
def rwd6_rwd7_tool_rewards(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_tool_calls")
    return read(spark, d, "trajectories").where("n_tool_calls is not null").select("trajectory_id", R.tool_used(n).alias("used"), R.search_grounding(n).alias("grounding"), R.exploration(n).alias("exploration")).distinct()


@query(rf"""
WITH n AS (SELECT trajectory_id, CASE WHEN regexp_matches(p, '(?is)<answer>(.*?)</answer>') THEN {_strip("lower(regexp_extract(p, '(?is)<answer>(.*?)</answer>', 1))")} ELSE lower(p) END AS p, {_strip('lower(g)')} AS g, TRY_CAST(replace(regexp_extract(p, '(-?\d[\d,]*\.?\d*)', 1), ',', '') AS DOUBLE) AS x, TRY_CAST(replace(regexp_extract(g, '(-?\d[\d,]*\.?\d*)', 1), ',', '') AS DOUBLE) AS y FROM {_PAIRS})
SELECT trajectory_id, CASE WHEN p = g THEN 1.0 WHEN contains(g, p) OR contains(p, g) THEN 0.5 ELSE 0.0 END::DOUBLE AS correctness, CASE WHEN x IS NULL OR y IS NULL THEN 0.0 WHEN abs(x - y) < 1e-9 THEN 1.0 WHEN (y = 0 AND x = 0) OR (y <> 0 AND abs(x - y) / abs(y) <= 0.05) THEN 0.5 ELSE 0.0 END::DOUBLE AS numeric FROM n""")
def rwd9_rwd13_correctness(spark: SparkSession, d: str) -> DataFrame:
    p, g = F.col("p"), F.col("g")
    return _pairs(spark, d).select("trajectory_id", R.answer_correctness(p, g).alias("correctness"), R.numerical_match(p, g).alias("numeric"))


@query("""
SELECT DISTINCT trajectory_id, round(CASE WHEN regexp_matches(final_answer, '(?is)<answer>.*?</answer>') THEN 1.0 WHEN n_tool_calls <= 2 THEN 0.0 ELSE greatest(-1.0, -0.25 * (n_tool_calls - 2)) END::DOUBLE, 6) AS termination,
 round(CASE WHEN n_tool_calls = 3 THEN 1.2 WHEN n_tool_calls < 3 THEN 0.5 * n_tool_calls / 3 ELSE greatest(0.0, 1 - ln(1 + n_tool_calls - 3) / ln(11)) END::DOUBLE, 6) AS frugality, round(greatest(0.0, least(1.0, 1 - (length(final_answer) - 280) / 920.0)), 6) AS conciseness
FROM trajectories WHERE final_answer IS NOT NULL AND n_tool_calls IS NOT NULL""")
def rwd18_rwd21_search_rewards(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("final_answer is not null and n_tool_calls is not null")
    c, n = F.col("final_answer"), F.col("n_tool_calls")
    return t.select("trajectory_id", F.round(R.termination(c, n), 6).alias("termination"), F.round(R.frugality(n, F.lit(3), 10), 6).alias("frugality"), F.round(R.conciseness(c), 6).alias("conciseness")).distinct()


@query("""
WITH c AS (SELECT trajectory_id, 1 - count(DISTINCT (tool_name, query)) / count(*) AS arr, count(*) AS n FROM tool_calls GROUP BY 1)
SELECT trajectory_id, round(greatest(0.0, least(1.0, 1.0 - 0.2 * arr - 0.1 * CASE WHEN n > 20 THEN 1 ELSE 0 END)), 6) AS prm FROM c""")
def rwd16_process_reward(spark: SparkSession, d: str) -> DataFrame:
    call = F.struct(F.coalesce("tool_name", F.lit("\u0000")), F.coalesce("query", F.lit("\u0000")))
    c = read(spark, d, "tool_calls").groupBy("trajectory_id").agg((1 - F.count_distinct(call) / F.count(F.lit(1))).alias("arr"), F.count(F.lit(1)).alias("n"))
    return c.select("trajectory_id", F.round(R.process_reward(F.lit(1.0), F.col("arr"), (F.col("n") > 20).cast("int")), 6).alias("prm"))


_BM25 = r"""
d AS (SELECT DISTINCT doc_id AS doc, regexp_extract_all(lower(text), '[a-z0-9]+') AS a FROM corpus_docs WHERE text IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(a) AS len, unnest(a) AS term FROM d) GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term FROM corpus_docs WHERE title IS NOT NULL AND doc_id IS NOT NULL AND hash_id % 50 = 0),
n AS (SELECT count(*) AS n, avg(len(a)) AS al FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY 1, 2)"""
#: Which documents' titles are queries: every one whose id ends in a number divisible by 50.
_HASHED = "WITH corpus_docs AS (SELECT *, TRY_CAST(regexp_extract(doc_id, '(\\d+)$', 1) AS BIGINT) AS hash_id FROM main.corpus_docs),"


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, d, "corpus_docs").where("doc_id is not null")
    q = c.where("title is not null").where(F.regexp_extract("doc_id", r"(\d+)$", 1).try_cast("bigint") % 50 == 0)
    return c.where("text is not null").select("doc_id", "text").distinct(), q.select(F.col("doc_id").alias("query_id"), F.col("title").alias("text")).distinct()


@query(_HASHED + _BM25 + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM s) SELECT query_id, doc, rank, round(score, 5) AS score FROM r WHERE rank <= 10")
def top1_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs, q = _titles(spark, d)
    return bm25(docs, q, 10).select("query_id", "doc", "rank", F.round("score", 5).alias("score"))


@query("""
WITH a AS (SELECT user_id AS query_id, event_type AS doc, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1, 2), b AS (SELECT user_id AS query_id, event_type AS doc, row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, event_type) AS rank FROM events GROUP BY 1, 2),
u AS (SELECT *, 0 AS list FROM a UNION ALL SELECT *, 1 FROM b), s AS (SELECT query_id, doc, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, doc) AS rank FROM s)
SELECT query_id, doc, rank, round(score, 9) AS score FROM r WHERE rank <= 3""")
def top3_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    g = read(spark, d, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("doc")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    w = Window.partitionBy("query_id")
    a = g.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "doc")))
    b = g.withColumn("rank", F.row_number().over(w.orderBy(F.desc("v"), "doc")))
    return fuse(a, b, k=3)
