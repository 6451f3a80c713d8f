"""Filters, look-ups and ranked listings over trajectories, chunks and mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reward_between(trajectories: DataFrame, low: float, high: float, condition: str | None = None, most: int = 50) -> DataFrame:
    """``(trajectory_id, reward, condition)`` with a reward from ``low`` to ``high``, best first, at most ``most``: the store's listing. Null rewards are left out."""
    t = trajectories.select("trajectory_id", "reward", "condition").distinct().where(F.col("reward").between(low, high))
    return (t.where(F.col("condition") == condition) if condition else t).orderBy(F.desc("reward"), "trajectory_id").limit(most)


def children_of(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is among ``parents``; repeated parents don't repeat rows."""
    return children.join(parents.select(key), key, "left_semi")


def difficulty_between(trajectories: DataFrame, low: float, high: float) -> DataFrame:
    """``(trajectory_id, difficulty)`` with one minus the reward (missing counts 0) from ``low`` to ``high``."""
    v = 1 - F.coalesce("reward", F.lit(0.0))
    return trajectories.select("trajectory_id", "reward").distinct().where(v.between(low, high)).select("trajectory_id", F.round(v, 6).alias("difficulty"))


def pass_gate(trajectories: DataFrame, passes: float = 0.5, below: float = 0.9, search_below: float = 0.5) -> DataFrame:
    """``(question, pass_rate, requires_search)`` of questions not passed too often to teach anything; a missing reward is no pass."""
    ok = F.coalesce(F.col("reward") >= passes, F.lit(False)).cast("double")
    p = trajectories.where("question is not null").groupBy("question").agg(F.avg(ok).alias("p"))
    return p.where(F.col("p") < below).select("question", F.round("p", 6).alias("pass_rate"), (F.col("p") < search_below).alias("requires_search"))


def uncommon_entities(chunks: DataFrame, share: float = 0.3, least: int = 5) -> DataFrame:
    """``(doc_id, entity, c)``: entities of a document, in lower case, with the chunks they are in, but for those in more than ``share`` of its chunks and at least ``least``."""
    c = chunks.where("doc_id is not null and chunk_id is not null")
    e = c.select("doc_id", "chunk_id", F.explode("entities").alias("e")).select("doc_id", "chunk_id", F.lower(F.trim("e")).alias("entity")).distinct()
    n = c.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("n"))
    f = e.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("c"))
    return f.join(n, "doc_id").where(~((F.col("c") / F.col("n") > share) & (F.col("c") >= least)) & (F.col("entity") != "")).select("doc_id", "entity", "c")


def grounded_title(text: Column, title: Column, letters: int = 6) -> Column:
    """Whether the title has a word of ``letters`` or more of the text."""
    w = F.regexp_extract_all(F.lower(text), F.lit(f"([a-z0-9]{{{letters},}})"), F.lit(1))
    return F.exists(w, lambda x: F.lower(title).contains(x))


def mails_with_recipient(mails: DataFrame, recipients: DataFrame, kind: str) -> DataFrame:
    """``(id, message_id)`` of mails that have a recipient of a kind (in any case) with an address."""
    r = recipients.where((F.lower("recipient_type") == kind) & F.col("recipient_address").isNotNull()).select(F.col("email_id").alias("message_id"))
    return mails.select("id", "message_id").join(r, "message_id", "left_semi").distinct()


def chunk_id(doc: Column, index: Column) -> Column:
    """Id of a chunk from its document and place."""
    return F.concat_ws("::", doc, index.cast("string"))


def chunks_at(docs: DataFrame, chunks: DataFrame, places: list[int]) -> DataFrame:
    """``(chunk_id, title)`` of the chunks at some places of each document; places without a chunk give nothing."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().select(F.explode(F.transform(F.array(*[F.lit(i) for i in places]), lambda i: chunk_id(F.col("doc_id"), i))).alias("chunk_id"))
    return ids.join(chunks.select("chunk_id", "title"), "chunk_id").distinct()


def unanswered_questions(trajectories: DataFrame, passes: float = 0.5) -> DataFrame:
    """``(q)``: questions, trimmed and in lower case, that no trajectory with a reward of ``passes`` has answered."""
    t = trajectories.where("question is not null").select(F.lower(F.trim("question")).alias("q"), "reward")
    return t.select("q").distinct().join(t.where(F.col("reward") >= passes).select("q"), "q", "left_anti")


def alignment(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``(n, missing, differing)``: chunks, those without their document, and those whose text isn't in it but for case and white space."""
    c = chunks.select("chunk_id", "doc_id", F.col("text").alias("ct")).distinct()
    x = docs.where("doc_id is not null").select("doc_id", "text", F.lit(1).alias("there")).distinct()
    w = lambda e: F.lower(F.regexp_replace(e, r"\s+", " "))
    bad = F.col("text").isNotNull() & F.col("ct").isNotNull() & ~w("text").contains(F.trim(w("ct")))
    return c.join(x, "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(bad).alias("differing"))


def chunk_series(chunks: DataFrame) -> DataFrame:
    """``(doc_id, chunk_id)``: the ids of all chunks a document should have, up to its last place."""
    n = chunks.where("doc_id is not null").groupBy("doc_id").agg((F.max("chunk_index") + 1).alias("n")).where("n > 0")
    return n.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("doc_id", chunk_id(F.col("doc_id"), F.col("i")).alias("chunk_id"))


def first_and_final_thought(steps: DataFrame) -> DataFrame:
    """``(trajectory_id, first_thought, last_thought)``: the first thought and that of the last closing step; trajectories without a closing thought are left out."""
    o = F.struct("step_number", "step_id")
    s = steps.where("thought is not null").groupBy("trajectory_id")
    return s.agg(F.min_by("thought", o).alias("first_thought"), F.max_by(F.when(F.col("is_terminal"), F.col("thought")), F.when(F.col("is_terminal"), o)).alias("last_thought")).where("last_thought is not null")


def mean_child_score(parents: DataFrame, children: DataFrame, key: str, score: str, missing: float = -1.0) -> DataFrame:
    """``(key, judge)``: mean score of each parent's children, ``missing`` where there is none."""
    s = children.groupBy(key).agg(F.avg(score).alias("r"))
    return parents.select(key).distinct().join(s, key, "left").select(key, F.coalesce(F.round("r", 6), F.lit(missing)).alias("judge"))


def pairwise_agreement(trajectories: DataFrame, runs: DataFrame) -> DataFrame:
    """``(pairs, agree)``: pairs of runs that differ in mean reward and in mean calls, and those where both differ the same way. One row a run is compared."""
    m = trajectories.groupBy("run_id").agg(F.avg("reward").alias("a"), F.avg("n_tool_calls").alias("b"))
    x = m.join(runs.select("run_id").distinct(), "run_id")
    y = x.select(F.col("run_id").alias("run_id2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    p = x.join(y, F.col("run_id") < F.col("run_id2")).where("a <> a2 and b <> b2")
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.count_if((F.col("a") > F.col("a2")) == (F.col("b") > F.col("b2"))).alias("agree"))


def latest(df: DataFrame, key: str, time: str, most: int) -> DataFrame:
    """``(key, time)`` of the newest rows, at most ``most``: a report."""
    return df.select(key, time).distinct().orderBy(F.desc(time), key).limit(most)


def search_mails(mails: DataFrame, phrases: dict[str, str], after: str | None = None, before: str | None = None, most: int = 10) -> DataFrame:
    """``(id, date, subject)`` of mails that hold each phrase (in any case) in its column, within text dates, newest first, at most ``most``: the tool's cap."""
    e = mails
    if after:
        e = e.where(F.col("date") >= after)
    if before:
        e = e.where(F.col("date") < before)
    for column, phrase in phrases.items():
        e = e.where(F.lower(column).contains(phrase.lower()))
    return e.select("id", "date", "subject").distinct().orderBy(F.desc("date"), "id").limit(most)


def easy_to_hard(trajectories: DataFrame, easy: float = 0.7, medium: float = 0.4) -> DataFrame:
    """``(trajectory_id, difficulty, rank0)``: easy, medium, hard by reward, rows without one last."""
    from velarium.operators.windows import order_position

    level = F.when(F.col("reward") >= easy, 0).when(F.col("reward") >= medium, 1).when(F.col("reward").isNotNull(), 2).otherwise(3)
    t = trajectories.select("trajectory_id", "reward").distinct().withColumn("level", level)
    name = F.when(F.col("level") == 0, "easy").when(F.col("level") == 1, "medium").when(F.col("level") == 2, "hard")
    return order_position(t, F.col("level").cast("double"), "trajectory_id").select("trajectory_id", name.alias("difficulty"), "rank0")


def balanced(rows: DataFrame, key: str, kind: str, shares: dict[str, int]) -> DataFrame:
    """``(key, kind)``: rows of each kind in the proportions of ``shares``, as many as the scarcest kind allows, the first by ``key``; none if a kind is missing."""
    counts = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    n = counts.agg(F.min(F.floor(F.coalesce(*[F.when(F.col(kind) == k, F.col("n") / v) for k, v in shares.items()], F.lit(None).cast("double")))).alias("u"), F.count_if(F.col(kind).isin(*shares)).alias("c"))
    r = rows.where(F.col(kind).isin(*shares)).withColumn("i", F.row_number().over(Window.partitionBy(kind).orderBy(key)))
    most = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in shares.items()]) * F.when(F.col("c") == len(shares), F.col("u")).otherwise(0)
    return r.crossJoin(F.broadcast(n)).where(F.col("i") <= most).select(key, kind)


def first_rows(df: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows by ``order``, at most ``most``: the operator's ``max_samples``."""
    return df.distinct().orderBy(order).limit(most)
