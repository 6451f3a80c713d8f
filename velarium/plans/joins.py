"""Queries of joins, filters and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import joins as J
from velarium.operators import lookups as K
from velarium.plans.registry import query, read


@query("SELECT trajectory_id, reward, condition FROM (SELECT DISTINCT trajectory_id, reward, condition FROM trajectories) WHERE reward BETWEEN 0.4 AND 0.9 AND condition = 'plain' ORDER BY reward DESC, trajectory_id LIMIT 50")
def flt1_reward_range(spark: SparkSession, d: str) -> DataFrame:
    return K.reward_between(read(spark, d, "trajectories"), 0.4, 0.9, "plain", 50)


@query("SELECT trajectory_id, step_number, action_name FROM steps WHERE trajectory_id IN (SELECT trajectory_id FROM trajectories WHERE run_id = (SELECT min(run_id) FROM runs))")
def flt2_lookup(spark: SparkSession, d: str) -> DataFrame:
    run = read(spark, d, "runs").agg(F.min("run_id").alias("run_id"))
    t = read(spark, d, "trajectories").join(F.broadcast(run), "run_id")
    return K.children_of(read(spark, d, "steps").select("trajectory_id", "step_number", "action_name"), t, "trajectory_id")


@query("SELECT trajectory_id, round(1 - coalesce(reward, 0), 6) AS difficulty FROM (SELECT DISTINCT trajectory_id, reward FROM trajectories) WHERE 1 - coalesce(reward, 0) BETWEEN 0.25 AND 0.75")
def flt9_difficulty_range(spark: SparkSession, d: str) -> DataFrame:
    return K.difficulty_between(read(spark, d, "trajectories"), 0.25, 0.75)


@query("""
WITH p AS (SELECT question, avg(CASE WHEN reward >= 0.5 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM trajectories WHERE question IS NOT NULL GROUP BY 1)
SELECT question, round(pass_rate, 6) AS pass_rate, pass_rate < 0.5 AS requires_search FROM p WHERE pass_rate < 0.9""")
def flt10_flt11_pass_gate(spark: SparkSession, d: str) -> DataFrame:
    return K.pass_gate(read(spark, d, "trajectories"))


@query("""
WITH e AS (SELECT DISTINCT doc_id, chunk_id, lower(trim(e, ' ')) AS entity FROM (SELECT doc_id, chunk_id, unnest(entities) AS e FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL)),
n AS (SELECT doc_id, count(DISTINCT chunk_id) AS n FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1), f AS (SELECT doc_id, entity, count(*) AS c FROM e GROUP BY 1, 2)
SELECT doc_id, entity, c FROM f JOIN n USING (doc_id) WHERE NOT (c / n > 0.3 AND c >= 5) AND entity <> ''""")
def flt13_common_entities(spark: SparkSession, d: str) -> DataFrame:
    return K.uncommon_entities(read(spark, d, "chunks"))


@query("""SELECT chunk_id, EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{6,}')) AS w) WHERE contains(lower(title), w)) AS grounded FROM chunks WHERE text IS NOT NULL AND title IS NOT NULL""")
def flt16_grounding(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").where("text is not null and title is not null").select("chunk_id", K.grounded_title(F.col("text"), F.col("title")).alias("grounded"))


@query("SELECT t.trajectory_id, t.run_id, r.run_type FROM (SELECT DISTINCT trajectory_id, run_id FROM trajectories) t JOIN (SELECT DISTINCT run_id, run_type FROM runs) r USING (run_id)")
def jon1_inner_join(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").select("trajectory_id", "run_id").distinct()
    return t.join(read(spark, d, "runs").select("run_id", "run_type").distinct(), "run_id").select("trajectory_id", "run_id", "run_type")


@query("SELECT DISTINCT id, message_id FROM emails e WHERE EXISTS (SELECT 1 FROM recipients r WHERE r.email_id = e.message_id AND lower(r.recipient_type) = 'cc' AND r.recipient_address IS NOT NULL)")
def jon2_semi_search(spark: SparkSession, d: str) -> DataFrame:
    return K.mails_with_recipient(read(spark, d, "emails"), read(spark, d, "recipients"), "cc")


@query("""
WITH s AS (SELECT trajectory_id, count(*) AS n_steps, string_agg(coalesce(action_name, '-'), ',' ORDER BY step_number, step_id) AS actions FROM steps GROUP BY 1), c AS (SELECT trajectory_id, count(*) AS n_calls FROM tool_calls GROUP BY 1)
SELECT t.trajectory_id, coalesce(n_steps, 0) AS n_steps, coalesce(n_calls, 0) AS n_calls, coalesce(actions, '') AS actions FROM (SELECT DISTINCT trajectory_id FROM trajectories) t LEFT JOIN s USING (trajectory_id) LEFT JOIN c USING (trajectory_id)""")
def jon3_assembly(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").select("trajectory_id").distinct()
    whole = J.with_children(t, "trajectory_id", steps=(read(spark, d, "steps").select("trajectory_id", "step_number", "step_id", F.coalesce("action_name", F.lit("-")).alias("a")), ["step_number", "step_id"]), calls=(read(spark, d, "tool_calls").select("trajectory_id", "step_number", "tool_call_id"), ["step_number", "tool_call_id"]))
    return whole.select("trajectory_id", F.size("steps").cast("bigint").alias("n_steps"), F.size("calls").cast("bigint").alias("n_calls"), F.array_join("steps.a", ",").alias("actions"))


@query("""
WITH g AS (SELECT doc_id, unnest([0, 2, 99]) AS i FROM (SELECT DISTINCT doc_id FROM corpus_docs WHERE doc_id IS NOT NULL))
SELECT DISTINCT g.doc_id || '::' || i AS chunk_id, c.title FROM g JOIN chunks c ON c.chunk_id = g.doc_id || '::' || i""")
def jon4_gold_lookup(spark: SparkSession, d: str) -> DataFrame:
    return K.chunks_at(read(spark, d, "corpus_docs"), read(spark, d, "chunks"), [0, 2, 99])


@query("""
WITH s AS (SELECT DISTINCT doc_id, chunk_id, start_pos, end_pos FROM chunks WHERE doc_id IS NOT NULL AND start_pos IS NOT NULL AND end_pos > start_pos)
SELECT DISTINCT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.start_pos < b.end_pos AND a.end_pos > b.start_pos AND a.chunk_id < b.chunk_id""")
def jon5_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "chunks").where("doc_id is not null and start_pos is not null and end_pos is not null").select("doc_id", "chunk_id", "start_pos", "end_pos").distinct()
    return J.interval_overlap(s, s, "doc_id", "start_pos", "end_pos").where("chunk_id < chunk_id_r").select(F.col("chunk_id").alias("chunk_a"), F.col("chunk_id_r").alias("chunk_b")).distinct()


@query("""
WITH e AS (SELECT DISTINCT doc_id, chunk_id, lower(e) AS e FROM (SELECT doc_id, chunk_id, unnest(entities) AS e FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL) WHERE e IS NOT NULL)
SELECT a.chunk_id AS src, b.chunk_id AS dst, CAST(count(*) AS INT) AS n_shared FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.e = b.e AND a.chunk_id < b.chunk_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def jon6_shared_entities(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "chunks").where("doc_id is not null and chunk_id is not null").select("doc_id", "chunk_id", F.explode("entities").alias("e")).where("e is not null").select("doc_id", "chunk_id", F.lower("e").alias("e"))
    sets = e.groupBy("doc_id", "chunk_id").agg(F.collect_set("e").alias("items"))
    return J.sharing(sets, "chunk_id", F.col("items"), 2, "doc_id")


@query("""
SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS weight FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def jon7_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return J.similar(read(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.3).withColumn("weight", F.round("weight", 5))


@query(r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS a FROM corpus_docs WHERE text IS NOT NULL AND doc_id IS NOT NULL), c AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS a FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(a[i:i+24], ' ') AS w FROM (SELECT doc_id, a, unnest(range(1, len(a) - 23, 25)) AS i FROM d WHERE len(a) >= 25)), cw AS (SELECT DISTINCT chunk_id, array_to_string(a[i:i+24], ' ') AS w FROM (SELECT chunk_id, a, unnest(range(1, len(a) - 23)) AS i FROM c WHERE len(a) >= 25))
SELECT chunk_id AS probe_id, doc_id, count(*) AS n FROM cw JOIN dw USING (w) GROUP BY 1, 2""")
def jon9_window_match(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "corpus_docs").where("text is not null and doc_id is not null").select("doc_id", "text").distinct()
    probes = read(spark, d, "chunks").where("text is not null and chunk_id is not null").select(F.col("chunk_id").alias("probe_id"), "text").distinct()
    return J.window_votes(docs, probes)


@query("""
SELECT DISTINCT lower(trim(question, ' ')) AS q FROM trajectories WHERE question IS NOT NULL AND lower(trim(question, ' ')) NOT IN (SELECT lower(trim(question, ' ')) FROM trajectories WHERE reward >= 0.5 AND question IS NOT NULL)""")
def jon11_anti_dedup(spark: SparkSession, d: str) -> DataFrame:
    return K.unanswered_questions(read(spark, d, "trajectories"))


@query("""
WITH c AS (SELECT DISTINCT chunk_id, doc_id, text FROM chunks), x AS (SELECT DISTINCT doc_id, text FROM corpus_docs WHERE doc_id IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (x.doc_id IS NULL) AS missing, count(*) FILTER (x.text IS NOT NULL AND c.text IS NOT NULL AND NOT contains(lower(regexp_replace(x.text, '\\s+', ' ', 'g')), lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'), ' ')))) AS differing FROM c LEFT JOIN x USING (doc_id)""".replace("\\\\", "\\"))
def jon12_alignment(spark: SparkSession, d: str) -> DataFrame:
    return K.alignment(read(spark, d, "chunks"), read(spark, d, "corpus_docs"))


@query("""
WITH n AS (SELECT doc_id, max(chunk_index) + 1 AS n FROM chunks WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT doc_id, doc_id || '::' || i AS chunk_id FROM (SELECT doc_id, unnest(range(0, n)) AS i FROM n)""")
def jon13_gold_chunks(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_series(read(spark, d, "chunks"))


@query("""
WITH s AS (SELECT trajectory_id, arg_min(thought, (step_number, step_id)) AS first_thought, count(*) AS n FROM steps WHERE thought IS NOT NULL GROUP BY 1), c AS (SELECT trajectory_id, arg_max(thought, (step_number, step_id)) AS last_thought FROM steps WHERE is_terminal AND thought IS NOT NULL GROUP BY 1)
SELECT trajectory_id, first_thought, last_thought FROM s JOIN c USING (trajectory_id)""")
def jon14_stage_completion(spark: SparkSession, d: str) -> DataFrame:
    return K.first_and_final_thought(read(spark, d, "steps"))


@query("SELECT t.trajectory_id, coalesce(round(avg(s.reward), 6), -1) AS judge FROM (SELECT DISTINCT trajectory_id FROM trajectories) t LEFT JOIN steps s USING (trajectory_id) GROUP BY 1")
def jon15_judge_score(spark: SparkSession, d: str) -> DataFrame:
    return K.mean_child_score(read(spark, d, "trajectories"), read(spark, d, "steps"), "trajectory_id", "reward")


@query("""
WITH r AS (SELECT run_id, min(created_at) AS c FROM runs GROUP BY 1), m AS (SELECT run_id, avg(reward) AS a, avg(n_tool_calls) AS b FROM trajectories GROUP BY 1), x AS (SELECT run_id, a, b FROM r JOIN m USING (run_id))
SELECT count(*) AS pairs, count(*) FILTER ((p.a > q.a) = (p.b > q.b)) AS agree FROM x p JOIN x q ON p.run_id < q.run_id WHERE p.a <> q.a AND p.b <> q.b""")
def jon16_pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    return K.pairwise_agreement(read(spark, d, "trajectories"), read(spark, d, "runs"))


@query("SELECT run_id, created_at FROM (SELECT DISTINCT run_id, created_at FROM runs) ORDER BY created_at DESC, run_id LIMIT 10")
def top6_latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return K.latest(read(spark, d, "runs"), "run_id", "created_at", 10)


@query("""
SELECT DISTINCT id, date, subject FROM emails e WHERE contains(lower(coalesce(body, '')), 'warehouse') AND contains(lower(coalesce(subject, '')), 'notice') AND date >= '2000-06-01' AND date < '2002-01-01' ORDER BY date DESC, id LIMIT 10""")
def top7_email_search(spark: SparkSession, d: str) -> DataFrame:
    return K.search_mails(read(spark, d, "emails"), {"subject": "notice", "body": "warehouse"}, "2000-06-01", "2002-01-01")


@query("SELECT trajectory_id, CASE WHEN reward >= 0.7 THEN 'easy' WHEN reward >= 0.4 THEN 'medium' WHEN reward IS NOT NULL THEN 'hard' END AS difficulty, row_number() OVER (ORDER BY CASE WHEN reward >= 0.7 THEN 0 WHEN reward >= 0.4 THEN 1 WHEN reward IS NOT NULL THEN 2 ELSE 3 END, trajectory_id) - 1 AS rank0 FROM (SELECT DISTINCT trajectory_id, reward FROM trajectories)")
def top8_easy_to_hard(spark: SparkSession, d: str) -> DataFrame:
    return K.easy_to_hard(read(spark, d, "trajectories"))


@query("""
WITH t AS (SELECT DISTINCT trajectory_id, CASE WHEN reward >= 0.5 THEN 'easy' ELSE 'hard' END AS k FROM trajectories WHERE reward IS NOT NULL), n AS (SELECT least(count(*) FILTER (k = 'easy'), floor(count(*) FILTER (k = 'hard') / 2)) AS u FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY trajectory_id) AS i FROM t)
SELECT trajectory_id, k FROM r, n WHERE i <= u * CASE WHEN k = 'easy' THEN 1 ELSE 2 END""")
def top9_balance(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("reward is not null").select("trajectory_id", F.when(F.col("reward") >= 0.5, "easy").otherwise("hard").alias("k")).distinct()
    return K.balanced(t, "trajectory_id", "k", {"easy": 1, "hard": 2})


@query("SELECT doc_id, title FROM (SELECT DISTINCT doc_id, title FROM corpus_docs WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT 100")
def top10_max_samples(spark: SparkSession, d: str) -> DataFrame:
    return K.first_rows(read(spark, d, "corpus_docs").where("doc_id is not null").select("doc_id", "title"), "doc_id", 100)


@query("""
WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, b.vec_id, list_cosine_similarity(q.e, b.embedding::DOUBLE[]) AS score FROM q JOIN embeddings b ON b.vec_id <> q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT q, vec_id, rank, round(score, 5) AS score FROM r WHERE rank <= 5""")
def top2_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    from velarium.operators.retrieval import dense_topk

    e = read(spark, d, "embeddings")
    return dense_topk(e, e.where("vec_id % 50 = 0"), 5)
