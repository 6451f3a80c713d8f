"""All queries of the reference operators by name, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.plans import registry

#: Modules whose functions are queries.
MODULES = ("aggregates", "windows", "joins", "scoring", "shaping", "sets", "sources", "streams", "more", "training")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token F1 of answers against gold answers, reward and calls, by run."""
    from velarium.functions import text

    t = registry.read(spark, sf_dir, "trajectories").where("trajectory_id is not null").groupBy("trajectory_id").agg(F.min(F.struct("run_id", "final_answer", "gold_answer", "reward", "n_tool_calls")).alias("r")).select("r.*")
    f1 = text.token_f1(text.answer(F.coalesce("final_answer", F.lit(""))), F.coalesce("gold_answer", F.lit("")))
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(f1), 6).alias("mean_f1"), F.round(F.avg("reward"), 6).alias("mean_reward"), F.round(F.avg("n_tool_calls"), 6).alias("mean_calls"))


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"velarium.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
