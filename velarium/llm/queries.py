"""Queries of this subpackage by name, each over its whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.llm import conversations, language, mailtext, mixing, overlap, pairs, pii, runs, splitting, tokens
from velarium.llm.common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    x = overlap.overlaps(table(spark, d, "trajectories"), table(spark, d, "runs"))
    return x.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "trajectories"), table(spark, d, "runs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rejected conversations but for those whose times contradict each other, for which the table of defects has no name."""
    return conversations.defects(table(spark, d, "trajectories"), table(spark, d, "steps")).where("defect <> 'infeasible'")


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "trajectories"), table(spark, d, "steps"))


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return p2_conversations(spark, d).select("trajectory_id", "turn", "role", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse(table(spark, d, "steps"), least=2).select("trajectory_id", "first_step", "last_step")


def p3_events(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse(table(spark, d, "steps"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return splitting.project_items(table(spark, d, "corpus_docs"), table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(_items(spark, d)).where("chunk_index = 0").select("item_kind", "item_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(_items(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of the problem's statement; accounts and cards, which the operator finds too, are none of them."""
    return pii.find(table(spark, d, "emails")).where(F.col("pii_kind").isin(*pii.KINDS))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "emails"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "trajectories"), language.fit_on(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mailtext.blocks(table(spark, d, "emails"))


def p7_new_text(spark: SparkSession, d: str) -> DataFrame:
    return mailtext.reduced(table(spark, d, "emails")).select("id", "subject", "new_text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.issues(language.detect(table(spark, d, "documents")))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.detect(table(spark, d, "documents"))


#: White space as DuckDB's regular expressions write it.
_SP = "[\\s\\x{00a0}\\x{200b}\\x{200c}\\x{200d}\\x{2060}\\x{feff}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]"

SQL = {
    "p2_found": f"""
WITH s AS (SELECT trajectory_id, step_number, count(DISTINCT (thought, action_name, action_args_json, observation)) AS v,
    max(CASE WHEN length(regexp_replace(coalesce(thought,'') || coalesce(observation,''), '{_SP}', '', 'g')) > 0 THEN 1 ELSE 0 END) AS spoken,
    max(CASE WHEN is_tool_step AND length(regexp_replace(coalesce(observation,''), '{_SP}', '', 'g')) = 0 THEN 1 ELSE 0 END) AS unanswered
  FROM steps WHERE trajectory_id IS NOT NULL AND step_number IS NOT NULL GROUP BY 1, 2),
p AS (SELECT trajectory_id, count(*) AS n, min(step_number) AS lo, max(step_number) AS hi, max(v) AS v, max(spoken) AS spoken, max(unanswered) AS unanswered FROM s GROUP BY 1),
t AS (SELECT DISTINCT trajectory_id FROM trajectories WHERE trajectory_id IS NOT NULL)
SELECT t.trajectory_id, 'empty' AS defect FROM t LEFT JOIN p USING (trajectory_id) WHERE coalesce(spoken, 0) = 0
UNION ALL SELECT t.trajectory_id, 'broken' FROM t JOIN p USING (trajectory_id) WHERE n < hi - lo + 1 OR lo > 1 OR v > 1
UNION ALL SELECT t.trajectory_id, 'missing_reply' FROM t JOIN p USING (trajectory_id) WHERE unanswered = 1""",
    # Times and clocks are left out of this one; where a clock is off, turns stay the same and rejected conversations are too few to tell.
    "p2_turns": f"""
WITH s AS (SELECT trajectory_id, step_number, count(DISTINCT (thought, action_name, action_args_json, observation)) AS v, arg_min(struct_pack(thought := thought, observation := observation), step_id) AS r,
    max(CASE WHEN length(regexp_replace(coalesce(thought,'') || coalesce(observation,''), '{_SP}', '', 'g')) > 0 THEN 1 ELSE 0 END) AS spoken,
    max(CASE WHEN is_tool_step AND length(regexp_replace(coalesce(observation,''), '{_SP}', '', 'g')) = 0 THEN 1 ELSE 0 END) AS unanswered
  FROM steps WHERE trajectory_id IS NOT NULL AND step_number IS NOT NULL GROUP BY 1, 2),
p AS (SELECT trajectory_id, count(*) AS n, min(step_number) AS lo, max(step_number) AS hi, max(v) AS v, max(spoken) AS spoken, max(unanswered) AS unanswered FROM s GROUP BY 1),
k AS (SELECT t.trajectory_id, lo, question FROM (SELECT trajectory_id, arg_min(question, question IS NOT NULL) AS question FROM (SELECT trajectory_id, min(question) AS question FROM trajectories WHERE trajectory_id IS NOT NULL GROUP BY 1) GROUP BY 1) t JOIN p USING (trajectory_id) WHERE spoken = 1 AND unanswered = 0 AND v = 1 AND lo <= 1 AND n = hi - lo + 1),
x AS (SELECT trajectory_id, 0 AS turn, 'user' AS role, question AS text FROM k UNION ALL SELECT trajectory_id, 2 * (step_number - lo) + 1, 'assistant', s.r.thought FROM k JOIN s USING (trajectory_id) UNION ALL SELECT trajectory_id, 2 * (step_number - lo) + 2, 'tool', s.r.observation FROM k JOIN s USING (trajectory_id))
SELECT trajectory_id, CAST(turn AS INT) AS turn, role, text FROM x WHERE length(regexp_replace(coalesce(text, ''), '{_SP}', '', 'g')) > 0""",
    "p4_found": """
SELECT DISTINCT 'corpus_doc' AS item_kind, doc_id AS item_id FROM corpus_docs WHERE doc_id IS NOT NULL AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 512
UNION ALL SELECT DISTINCT 'chunk', chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 512""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the subpackage."""
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL that gives the same rows, for the queries that SQL can express."""
    return dict(SQL)
