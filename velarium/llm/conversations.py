"""Conversations put together again from message rows.

Each step is written by a sender, the assistant or one of the tools, with a clock of its own. Steps that
follow each other give constraints "a reply is not before what it answers"; the senders' clock offsets
are their least-squares solution, moved no further than the constraints allow. A conversation whose
constraints no offsets meet is rejected. Times are corrected by the offsets, so that the turns of all
senders merge into one order, which is that of the step numbers. Constraints are summed up by pair of
senders before a conversation meets in one task, and turns are placed by their step number, so no task
ever holds a whole conversation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import has_text, one_row_per

CONTENT = ("thought", "action_name", "action_args_json", "observation")
#: The sender of steps that are no tool's.
ASSISTANT = ""
#: Step numbers of a conversation that one task places.
BLOCK = 4096


def _steps(steps: DataFrame, *texts: str) -> DataFrame:
    """One row for each step number of a trajectory: its first row's sender, time and ``texts``, and what its rows together show."""
    print_ = F.xxhash64(*[F.coalesce(F.col(c), F.lit("\u0000null")) for c in CONTENT])
    tool = F.coalesce("is_tool_step", F.lit(False))
    sender = F.when(tool, F.lower(F.regexp_replace(F.coalesce(F.trim("action_name"), F.lit("tool")), r"[\s\-_]+", "_"))).otherwise(ASSISTANT)
    first = F.struct("step_id", *texts, sender.alias("sender"), F.unix_micros(F.col("started_at").cast("timestamp")).alias("t"))
    return (
        steps.where(F.col("trajectory_id").isNotNull() & F.col("step_number").isNotNull())
        .groupBy("trajectory_id", "step_number")
        .agg(
            F.min(first).alias("r"),
            (F.min(print_) != F.max(print_)).alias("differs"),
            F.max(has_text(F.col("thought")) | has_text(F.col("observation"))).alias("spoken"),
            F.max(tool & ~has_text(F.col("observation"))).alias("unanswered"),
        )
        .select("trajectory_id", F.col("step_number").cast("bigint").alias("step_number"), *[f"r.{c}" for c in (*texts, "sender", "t")], "differs", "spoken", "unanswered")
    )


def offsets(pairs: list[tuple[str, str, int, float, float]]) -> dict[str, float] | None:
    """Clock offset of each sender from ``(sender, next sender, gaps, mean gap, least gap)``; None if no offsets meet all constraints.

    With ``d`` the offsets, each gap must be at least ``d(sender) - d(next)``. Least squares make all
    mean gaps alike; if that breaks a constraint, the solution is moved towards one that breaks none,
    no further than needed. The assistant's clock, or else the first sender's, is right.
    """
    names = sorted({s for p in pairs for s in p[:2]})
    if not names or any(a == b and least < 0 for a, b, _, _, least in pairs):
        return None if names else {}
    at = {s: i for i, s in enumerate(names)}
    # Shortest paths over the constraints give offsets that meet them; a round too many means there are none.
    low = np.zeros(len(names))
    for _ in names:
        before = low.copy()
        for a, b, _, _, least in pairs:
            low[at[a]] = min(low[at[a]], low[at[b]] + least)
        if np.array_equal(low, before):
            break
    else:
        if any(low[at[a]] > low[at[b]] + least + 1e-9 for a, b, _, _, least in pairs):
            return None
    rows = [(a, b, n, mean) for a, b, n, mean, _ in pairs if a != b]
    left = np.zeros((len(rows), len(names) + 1))
    right = np.zeros(len(rows))
    for i, (a, b, n, mean) in enumerate(rows):
        left[i, [at[b], at[a], -1]] = np.sqrt(n) * np.array([1, -1, -1])
        right[i] = -np.sqrt(n) * mean
    best = np.linalg.lstsq(left, right, rcond=None)[0][:-1] if rows else low
    low, best = low - low[0], best - best[0]
    step = 1.0
    for a, b, _, _, least in pairs:
        have, want = least - (low[at[a]] - low[at[b]]), least - (best[at[a]] - best[at[b]])
        if want < 0:
            step = min(step, max(0.0, have) / max(1e-12, have - want))
    return {s: float(x) for s, x in zip(names, low + step * (best - low))}


def _clock(pairs: Column) -> Column:
    """State and offsets in seconds of senders whose gaps are ``pairs``; null for null."""

    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for r in rows:
            d = offsets([(x["a"], x["b"], x["n"], x["mean"], x["least"]) for x in r]) if r is not None else {}
            out.append(("infeasible" if d is None else "corrected", [{"sender": k, "seconds": v} for k, v in (d or {}).items()]))
        return pd.DataFrame(out, columns=["clock", "offsets"])

    return F.pandas_udf(run, "struct<clock: string, offsets: array<struct<sender: string, seconds: double>>>")(pairs)


def examined(steps: DataFrame) -> DataFrame:
    """``(trajectory_id, n, lo, hi, differs, spoken, unanswered, clock, offsets)`` of each trajectory with steps.

    ``clock`` is ``consistent`` (no reply is before what it answers), ``corrected`` with the senders'
    ``offsets`` in seconds, or ``infeasible``. Null times give no constraints.
    """
    s = _steps(steps)
    own = F.struct(F.col("step_number").alias("k"), F.lit(1).alias("own"), "sender", "t", "differs", "spoken", "unanswered")
    after = F.struct((F.col("step_number") - 1).alias("k"), F.lit(0).alias("own"), "sender", "t", F.lit(False).alias("differs"), F.lit(False).alias("spoken"), F.lit(False).alias("unanswered"))
    mine, next_ = lambda c: F.max(F.when(F.col("own") == 1, F.col(c))), lambda c: F.max(F.when(F.col("own") == 0, F.col(c)))
    met = (
        s.select("trajectory_id", F.explode(F.array(own, after)).alias("x")).select("trajectory_id", "x.*").groupBy("trajectory_id", "k")
        .agg(F.max("own").alias("own"), mine("sender").alias("a"), mine("t").alias("t"), next_("sender").alias("b"), next_("t").alias("t2"), *[F.max(c).alias(c) for c in ("differs", "spoken", "unanswered")])
        .withColumn("x", (F.col("t2") - F.col("t")) / 1e6)
    )
    there = F.when(F.col("own") == 1, F.col("k"))
    flags = ("differs", "spoken", "unanswered")
    by_pair = met.groupBy("trajectory_id", "a", "b").agg(F.sum("own").alias("n"), F.min(there).alias("lo"), F.max(there).alias("hi"), *[F.max(c).alias(c) for c in flags], F.count("x").alias("gaps"), F.avg("x").alias("mean"), F.min("x").alias("least"))
    pair = F.when(F.col("gaps") > 0, F.struct("a", "b", F.col("gaps").alias("n"), "mean", "least"))
    per = by_pair.groupBy("trajectory_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.max(c).alias(c) for c in flags], F.min("least").alias("least"), F.collect_list(pair).alias("pairs"))
    late = F.coalesce(F.col("least") < 0, F.lit(False))
    solved = per.withColumn("late", late).withColumn("fit", _clock(F.when(late, F.col("pairs"))))
    return solved.select("trajectory_id", "n", "lo", "hi", *flags, F.when(F.col("late"), F.col("fit.clock")).otherwise("consistent").alias("clock"), F.when(F.col("late"), F.col("fit.offsets")).alias("offsets"))


def _kinds() -> Column:
    """Defects of an examined trajectory; one without steps has nulls and is empty."""
    broken = (F.col("n") < F.col("hi") - F.col("lo") + 1) | (F.col("lo") > 1) | F.col("differs")
    return F.array_compact(
        F.array(
            F.when(~F.coalesce("spoken", F.lit(False)), "empty"),
            F.when(F.coalesce(broken, F.lit(False)), "broken"),
            F.when(F.coalesce("unanswered", F.lit(False)), "missing_reply"),
            F.when(F.coalesce(F.col("clock") == "infeasible", F.lit(False)), "infeasible"),
        )
    )


def defects(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """``(trajectory_id, defect)`` for trajectories to leave out: empty, broken, missing_reply or infeasible.

    Repeated trajectories count once and repeated step rows as one step; a trajectory may have
    several defects. Rows with a null id or step number are no steps. Empty tables give an empty
    result (without steps every trajectory is ``empty``).
    """
    ids = trajectories.where(F.col("trajectory_id").isNotNull()).select("trajectory_id").distinct()
    return ids.join(examined(steps), "trajectory_id", "left").select("trajectory_id", F.explode(_kinds()).alias("defect"))


def conversations(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """Turns of sound conversations: ``(trajectory_id, turn, role, text, step_number, at, clock)``.

    Roles are user (question), assistant (thought) and tool (observation); turns without text are
    left out, ``turn`` orders the rest: the question is 0, step ``n`` gives ``2 (n - first) + 1`` for
    its thought and the next for its observation. Trajectories with a defect give no rows. ``at`` is
    the step's time with its sender's offset. An empty table of trajectories gives no rows.
    """
    asked = one_row_per(trajectories.select("trajectory_id", "question"), "trajectory_id")
    sound = asked.join(examined(steps), "trajectory_id").where(F.size(_kinds()) == 0)
    # A sound conversation has no gaps, so it has as many blocks as its steps fill.
    block = lambda c: F.floor(F.col(c) / BLOCK)
    placed = sound.select("trajectory_id", "lo", "clock", "offsets", F.explode(F.sequence(block("lo"), block("hi"))).alias("block"))
    base = 2 * (F.col("step_number") - F.col("lo"))
    shift = F.get(F.filter("offsets", lambda o: o["sender"] == F.col("sender")), 0)["seconds"]
    spoken = (
        _steps(steps, "thought", "observation").withColumn("block", block("step_number")).join(placed, ["trajectory_id", "block"])
        .withColumn("at", F.timestamp_micros((F.col("t") + F.coalesce(F.round(shift * 1e6), F.lit(0))).cast("bigint")))
        .select("trajectory_id", "step_number", "clock", "at", F.explode(F.array(F.struct((base + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("thought").alias("text")), F.struct((base + 2).alias("turn"), F.lit("tool").alias("role"), F.col("observation").alias("text")))).alias("m"))
        .select("trajectory_id", F.col("m.turn").cast("int").alias("turn"), "m.role", "m.text", F.col("step_number").cast("int").alias("step_number"), "at", "clock")
    )
    first = sound.select("trajectory_id", F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text"), F.lit(None).cast("int").alias("step_number"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("clock"))
    return first.unionByName(spoken).where(has_text(F.col("text")))
