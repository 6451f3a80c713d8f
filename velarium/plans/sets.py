"""Queries of set operations, splits and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import graph as G
from velarium.operators import sets as S
from velarium.plans.registry import query, read


@query("SELECT doc_id AS id, 'doc' AS kind FROM corpus_docs UNION ALL SELECT chunk_id, 'chunk' FROM chunks")
def set1_concatenate(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "corpus_docs").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"))
    return a.unionByName(read(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind")))


@query("SELECT title, min(doc_id) AS doc_id FROM corpus_docs WHERE title IS NOT NULL GROUP BY 1")
def set2_dedup_title(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "corpus_docs").where("title is not null and doc_id is not null").select("title", "doc_id")
    return S.first_per_key(c, F.col("title"), ["doc_id"])


@query(r"""
WITH k AS (SELECT doc_id, text, substr(sha1(trim(lower(regexp_replace(text, '[\s\x0b]+', ' ', 'g')), ' ')), 1, 16) AS k FROM documents WHERE text IS NOT NULL)
SELECT k, min(doc_id) AS doc_id, count(*) AS n FROM k GROUP BY 1""")
def set3_dedup_text(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").where("text is not null").select("doc_id", S.text_key(F.col("text")).alias("k"))
    return t.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT doc_id, CASE WHEN CAST('0x' || substr(sha1('11:' || doc_id), 1, 8) AS BIGINT) / 4294967295.0 < 0.2 THEN 'val' ELSE 'train' END AS split FROM documents)
SELECT doc_id, split FROM s""")
def set7_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return S.hash_split(read(spark, d, "documents").select("doc_id"), "doc_id", 11, 0.2)


@query("""
WITH s AS (SELECT DISTINCT question, CASE WHEN CAST('0x' || substr(sha1('3:' || question), 1, 8) AS BIGINT) / 4294967295.0 < 0.25 THEN 'val' ELSE 'train' END AS split FROM trajectories WHERE question IS NOT NULL)
SELECT count(*) AS n_common FROM (SELECT question FROM s WHERE split = 'train' INTERSECT SELECT question FROM s WHERE split = 'val')""")
def set5_set8_split_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = S.hash_split(read(spark, d, "trajectories").select("question").where("question is not null"), "question", 3, 0.25)
    return S.overlap(s.where("split = 'train'"), s.where("split = 'val'"), "question")


@query("SELECT count(*) AS n_missing FROM (SELECT trajectory_id, step_number FROM steps WHERE is_tool_step EXCEPT SELECT trajectory_id, step_number FROM tool_calls)")
def set6_except(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "steps").where("is_tool_step").select("trajectory_id", "step_number")
    return a.subtract(read(spark, d, "tool_calls").select("trajectory_id", "step_number")).agg(F.count(F.lit(1)).alias("n_missing"))


@query("""
WITH n AS (SELECT ticker, count(*) AS n, sha1('5:' || ticker) AS h FROM documents WHERE ticker IS NOT NULL GROUP BY 1), b AS (SELECT ticker, coalesce(sum(n) OVER (ORDER BY h, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM n)
SELECT doc_id, CASE WHEN b.b < 0.2 * b.t THEN 'val' ELSE 'train' END AS split FROM documents LEFT JOIN b USING (ticker)""")
def set9_group_split(spark: SparkSession, d: str) -> DataFrame:
    return S.group_split(read(spark, d, "documents").select("doc_id", "ticker"), "ticker", 5, 0.2).select("doc_id", "split")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 't' || trajectory_id AS a, 'q' || coalesce(question, '') AS b FROM trajectories WHERE question IS NOT NULL), c AS (SELECT b, min(a) AS m FROM e GROUP BY 1)
SELECT e.a AS node, least(c.m, 'q') || CASE WHEN c.m < 'q' THEN '' ELSE substr(e.b, 2) END AS component FROM e JOIN c USING (b)""")
def set12_components(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("question is not null").select(F.concat(F.lit("t"), "trajectory_id").alias("a"), F.concat(F.lit("q"), "question").alias("b")).distinct()
    return G.components(t, "a", "b").where(F.col("node").startswith("t"))


@query("""
WITH g AS (SELECT question AS component, count(DISTINCT trajectory_id) AS n FROM trajectories WHERE question IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS t FROM g), s AS (SELECT component, n, t FROM g, t WHERE n <= 2 * 0.2 * t),
b AS (SELECT component, n, t, coalesce(sum(n) OVER (ORDER BY n DESC, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
SELECT g.component, g.n, CASE WHEN b.component IS NOT NULL AND abs(b.b + b.n - 0.2 * b.t) <= abs(b.b - 0.2 * b.t) THEN 'val' ELSE 'train' END AS split FROM g LEFT JOIN b USING (component)""")
def set13_pack_components(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "trajectories").where("question is not null").groupBy(F.col("question").alias("component")).agg(F.count_distinct("trajectory_id").alias("n"))
    return G.pack(n, 0.2)


@query("""
WITH n AS (SELECT DISTINCT run_id, upper(run_type) AS run_type FROM runs WHERE run_type LIKE 'train%'), o AS (SELECT DISTINCT run_id, run_type FROM runs)
SELECT run_id, run_type FROM o WHERE run_id NOT IN (SELECT run_id FROM n) UNION ALL SELECT run_id, run_type FROM n""")
def set20_upsert(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "runs").select("run_id", "run_type").distinct()
    return S.upsert(r, r.where("run_type like 'train%'").withColumn("run_type", F.upper("run_type")), "run_id")


@query("SELECT CASE WHEN reward >= 0.7 THEN 'bridge/specific' WHEN reward >= 0.4 THEN 'compositional/abstract' ELSE 'compositional/specific' END AS kind, count(*) AS n FROM trajectories WHERE reward IS NOT NULL GROUP BY 1")
def set16_path_type(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trajectories").where("reward is not null")
    types = F.when(F.col("reward") >= 0.7, F.array(F.lit("exact"), F.lit("exact"))).when(F.col("reward") >= 0.4, F.array(F.lit("exact"), F.lit("similar"))).otherwise(F.array(F.lit("alias"), F.lit("exact")))
    return t.groupBy(G.path_type(types).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
