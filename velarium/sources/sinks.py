"""Writers: tables, training rows, logs, and fan-out of streams to several of them."""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.session import names_in

Sink = Callable[[DataFrame, int], None]


def dump(df: DataFrame, path: str) -> None:
    """A table as Parquet and as CSV, read once; nested columns are JSON text in the CSV."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    flat = df.sparkSession.read.parquet(f"{path}.parquet")
    flat = flat.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in flat.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def append_jsonl(df: DataFrame, path: str, keep_reward: bool = True) -> None:
    """Rows added to a folder of JSON lines; rewards nulled unless kept."""
    out = df if keep_reward or "reward" not in df.columns else df.withColumn("reward", F.lit(None).cast("double"))
    out.write.mode("append").option("ignoreNullFields", False).json(path)


def export_trajectories(trajectories: DataFrame, steps: DataFrame, calls: DataFrame, path: str, run_id: str | None = None, condition: str | None = None) -> None:
    """Trajectories with their steps and calls as JSON lines: those of a run, else of a condition, else all."""
    from velarium.operators.joins import with_children
    from velarium.operators.sets import first_per_key

    t = trajectories.where(F.col("run_id") == run_id) if run_id else trajectories.where(F.col("condition") == condition) if condition else trajectories
    one = first_per_key(t.where(F.col("trajectory_id").isNotNull()), F.col("trajectory_id"), [c for c, k in t.dtypes if c != "trajectory_id" and not k.startswith("map")])
    whole = with_children(one, "trajectory_id", steps=(steps, ["step_number", "step_id"]), tool_calls=(calls, ["step_number", "tool_call_id"]))
    whole.repartitionByRange("timestamp").sortWithinPartitions("timestamp", "trajectory_id").write.mode("overwrite").json(path)


def jdbc_sink(url: str, table: str, properties: dict[str, str]) -> Sink:
    """Rows inserted into a table of a database, nested columns as JSON text."""

    def write(df: DataFrame, _batch: int) -> None:
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        flat.write.jdbc(url, table, mode="append", properties=properties)

    return write


def webhook_sink(send: Callable[[str], None]) -> Sink:
    """Each row as JSON given to ``send``, which every task calls for its own rows."""

    def write(df: DataFrame, _batch: int) -> None:
        rows = df.select(F.to_json(F.struct("*")).alias("j"))
        rows.foreachPartition(lambda part: [send(r.j) for r in part] and None)

    return write


def jsonl_sink(path: str) -> Sink:
    return lambda df, _batch: append_jsonl(df, path)


def fan_out(*sinks: Sink) -> Sink:
    """One batch to several sinks, computed once."""

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for s in sinks:
                s(df, batch)
        finally:
            df.unpersist()

    return write


def resumable(todo: DataFrame, done_path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of ``work`` over the rows not yet in ``done_path``, added there; all results so far.

    A run that ends midway leaves whole files only, so the next one goes on with what is missing.
    """
    spark = todo.sparkSession
    there = any(n.endswith(".parquet") for n in names_in(spark, done_path))
    rest = todo.join(spark.read.parquet(done_path).select(key), key, "left_anti") if there else todo
    work(rest).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def provenance(path: str, **facts: object) -> dict:
    """Facts about an output written beside it, with those of its parent inside."""
    parent = facts.get("parent")
    if isinstance(parent, str) and os.path.exists(f"{parent}.provenance.json"):
        with open(f"{parent}.provenance.json") as f:
            facts["parent_provenance"] = json.load(f)
    facts["written_at"] = datetime.datetime.now(datetime.timezone.utc).isoformat()
    with open(f"{path}.provenance.json", "w") as f:
        json.dump(facts, f, default=str)
    return facts
