"""Streams of decision and step logs: validation, loops, crashes, drift, diversity and windows.

State is kept by key in the state store and lives across batches; files are read once each by the
checkpoint. Each operator is a DataFrame in, DataFrame out, so batch tables work too where no state
is needed.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from velarium.session import names_in

LOG = "trajectory_id string, stage_name string, stage_type string, status string, score double, ts timestamp, state_snapshot string"


def tail(spark: SparkSession, folder: str, schema: str = LOG, per_batch: int = 100) -> DataFrame:
    """JSON lines as they arrive in a folder; the checkpoint knows which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)


def valid(log: DataFrame) -> DataFrame:
    """Records with a trajectory, a stage and an object for a snapshot."""
    return log.where(F.col("trajectory_id").isNotNull() & F.col("stage_name").isNotNull() & F.coalesce(F.schema_of_variant(F.try_parse_json("state_snapshot")).startswith("OBJECT"), F.lit(False)))


def crashes(log: DataFrame) -> DataFrame:
    """Tool calls that ended in an error."""
    return log.where((F.col("stage_type") == "tool_call") & (F.col("status") == "error")).select("trajectory_id", "stage_name", F.lit("tool_crash").alias("failure"))


def low_scores(log: DataFrame, least: float = 0.6) -> DataFrame:
    """Judge results below ``least``; a missing result is no score."""
    return log.where((F.col("stage_type") == "llm_judge") & (F.col("score") < least)).select("trajectory_id", "stage_name", F.lit("low_score").alias("failure"))


def loops(log: DataFrame, most: int = 3) -> DataFrame:
    """``(trajectory_id, stage_name, failure, visits)`` each time a stage was visited once more than ``most`` times; the count then starts anew and is kept between batches."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        fired = 0
        for b in batches:
            fired, n = fired + (n + len(b)) // (most + 1), (n + len(b)) % (most + 1)
        state.update((n,))
        if fired:
            yield pd.DataFrame([(*key, "loop", most + 1)] * fired, columns=["trajectory_id", "stage_name", "failure", "visits"])

    return log.groupBy("trajectory_id", "stage_name").applyInPandasWithState(count, "trajectory_id string, stage_name string, failure string, visits int", "n int", "append", GroupStateTimeout.NoTimeout)


def drifts(log: DataFrame, base: int = 50, sigmas: float = 1.5) -> DataFrame:
    """``(stage_name, n, mu, sigma, recent, drifted)`` after each batch: the first ``base`` scores of a stage against its last ``base``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, [], [])
        first, last = list(first), list(last)
        early: list[tuple] = []
        late: list[tuple] = []
        for b in batches:  # several frames, in no order: the earliest and the latest of all of them
            new = [(t, float(x)) for t, x in zip(b["ts"], b["score"]) if x == x and x is not None]
            n += len(new)
            early, late = heapq.nsmallest(base - len(first), early + new), heapq.nlargest(base, late + new)
        first += [x for _, x in early]
        last = (last + [x for _, x in reversed(late)])[-base:]
        state.update((n, first, last))
        if n >= base:
            mu = sum(first) / base
            sigma = (sum((x - mu) ** 2 for x in first) / base) ** 0.5
            recent = sum(last) / len(last)
            yield pd.DataFrame([(*key, n, mu, sigma, recent, recent < (mu if sigma == 0 else mu - sigmas * sigma))], columns=["stage_name", "n", "mu", "sigma", "recent", "drifted"])

    return log.where(F.col("score").isNotNull()).groupBy("stage_name").applyInPandasWithState(run, "stage_name string, n long, mu double, sigma double, recent double, drifted boolean", "n long, first array<double>, last array<double>", "append", GroupStateTimeout.NoTimeout)


def diversity(log: DataFrame, window: int = 100, least: int = 10) -> DataFrame:
    """``(stage_type, n, ratio)``: different stage names among the last ``window`` of a type, once there are ``least``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        late: list[tuple] = []
        for b in batches:  # several frames, in no order
            late = heapq.nlargest(window, late + [(t, x) for t, x in zip(b["ts"], b["stage_name"]) if x is not None])
        seen = (seen + [x for _, x in reversed(late)])[-window:]
        state.update((seen,))
        if len(seen) >= least:
            yield pd.DataFrame([(*key, len(seen), len(set(seen)) / len(seen))], columns=["stage_type", "n", "ratio"])

    return log.where(F.col("stage_type").isNotNull()).groupBy("stage_type").applyInPandasWithState(run, "stage_type string, n int, ratio double", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def windowed(log: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and mean score by stage and event-time window; rows later than ``late`` behind the newest are left out of closed windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return log.withWatermark("ts", late).groupBy(w, "stage_name").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "stage_name", "n", "mean_score")


def sessions(log: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each trajectory: stretches without a pause of ``gap``."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "trajectory_id").agg(F.count(F.lit(1)).alias("n")).select("trajectory_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drain(stream: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> Any:
    """Run a stream over all that is there, to a Parquet folder or a sink, and wait for its end."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if sink else w.format("parquet").start(path)
    q.awaitTermination()
    return q


class Buffer:
    """Newest failures in a folder of any file system, oldest dropped first, at most ``capacity`` of them.

    ``sink`` adds a micro-batch, and adds nothing when that batch is repeated; ``drain`` takes all out
    and remembers their kinds, so that ``novel`` tells kinds never drained before.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str = "failure", capacity: int = 500):
        self.spark, self.folder, self.kind, self.capacity = spark, folder, kind, capacity

    def _read(self, name: str) -> DataFrame | None:
        there = any(n.endswith(".parquet") for n in names_in(self.spark, f"{self.folder}/{name}"))
        return self.spark.read.parquet(f"{self.folder}/{name}") if there else None

    def sink(self, batch: DataFrame, number: int) -> None:
        new = batch.withColumn("batch", F.lit(number)).withColumn("at", F.monotonically_increasing_id())
        have = self._read("now")
        both = new if have is None else have.where(F.col("batch") != number).unionByName(new)
        both.orderBy(F.desc("batch"), F.desc("at")).limit(self.capacity).write.mode("overwrite").parquet(f"{self.folder}/next")  # the buffer's size
        self.spark.read.parquet(f"{self.folder}/next").write.mode("overwrite").parquet(f"{self.folder}/now")

    def rows(self) -> DataFrame | None:
        """What the buffer holds; None before the first batch."""
        return self._read("now")

    def type_counts(self) -> dict[str, int]:
        """How many of each kind are in the buffer, which is bounded."""
        have = self._read("now")
        return {r[0]: r[1] for r in have.groupBy(self.kind).count().collect()} if have is not None else {}

    def novel(self) -> set[str]:
        """Kinds in the buffer that were never drained before."""
        seen = self._read("seen")
        return set(self.type_counts()) - ({r[0] for r in seen.select(self.kind).distinct().collect()} if seen is not None else set())

    def drain(self) -> list[dict]:
        """All rows of the buffer, oldest first, which is then empty."""
        have = self._read("now")
        if have is None:
            return []
        out = [r.asDict() for r in have.orderBy("batch", "at").collect()]  # at most the buffer's size
        if out:
            have.select(self.kind).distinct().write.mode("append").parquet(f"{self.folder}/seen")
            have.limit(0).write.mode("overwrite").parquet(f"{self.folder}/next")
            self.spark.read.schema(have.schema).parquet(f"{self.folder}/next").write.mode("overwrite").parquet(f"{self.folder}/now")
        return out


def buffered(folder: str, capacity: int = 500) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest ``capacity`` failures in a Parquet folder, oldest dropped first; see ``Buffer``."""
    return lambda batch, number: Buffer(batch.sparkSession, folder, capacity=capacity).sink(batch, number)
