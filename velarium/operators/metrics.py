"""Metrics of a user's own beside the built-in ones, a registry of them, and rows from generators and solvers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Builders of metrics by name: a function of prediction and gold columns that gives a double.
METRICS: dict[str, Callable[[Column, Column], Column]] = {}


def register(name: str, build: Callable[[Column, Column], Column]) -> None:
    """Add a metric; a name that is taken is refused."""
    if name in METRICS:
        raise ValueError(f"metric {name!r} is there already")
    METRICS[name] = build


def metric(name: str) -> Callable[[Column, Column], Column]:
    """A metric by name; an unknown name lists those there are."""
    if name not in METRICS:
        raise ValueError(f"no metric {name!r} among {sorted(METRICS)}")
    return METRICS[name]


def custom(score: Callable[[str | None, str | None], float]) -> Callable[[Column, Column], Column]:
    """A metric from a function of two texts, in Arrow batches; a row on which it fails scores 0."""

    def build(prediction: Column, gold: Column) -> Column:
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([_safe(score, x, y) for x, y in zip(a, b)], dtype="float64")

        return F.pandas_udf(run, "double")(prediction, gold)

    return build


def _safe(score: Callable[..., float], *args: str | None) -> float:
    try:
        return float(score(*args))
    except Exception:  # noqa: BLE001 - a metric that fails scores 0
        return 0.0


def evaluated(df: DataFrame, names: Iterable[str], prediction: str, gold: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, means of the metrics, n)``: each named metric's mean over the rows."""
    means = [F.round(F.avg(metric(n)(F.col(prediction), F.col(gold))), 6).alias(n) for n in names]
    return df.groupBy(*keys).agg(*means, F.count(F.lit(1)).alias("n"))


def keyed_means(df: DataFrame, scores: Callable[[str | None, str | None, str | None], dict[str, float]], prediction: str, reference: str, instruction: str, most: int | None = None) -> DataFrame:
    """``(key, mean, n)`` of a function that gives several named scores a row; rows on which it fails are left out. ``most`` rows, the first by their texts, if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                try:
                    out += [(str(k), float(v)) for k, v in scores(*row).items()]
                except Exception:  # noqa: BLE001, S112 - a row that fails has no scores
                    continue
            yield pd.DataFrame(out, columns=["key", "value"]).astype({"value": "float64"})

    rows = df.select(prediction, reference, instruction)
    rows = rows.orderBy(*rows.columns).limit(most) if most else rows
    return rows.mapInPandas(run, "key string, value double").groupBy("key").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def generated(df: DataFrame, make: Callable[[str], Iterable[tuple[str, str]]], key: str, text: str) -> DataFrame:
    """``(key, place, question, answer)``: pairs that a generator makes of each text; null texts and texts on which it fails give none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                try:
                    out += [(k, i, q, a) for i, (q, a) in enumerate(make(t) if t is not None else ())]
                except Exception:  # noqa: BLE001, S112 - a text that fails gives no pairs
                    continue
            yield pd.DataFrame(out, columns=[key, "place", "question", "answer"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, place int, question string, answer string")


def labelled_by_solver(df: DataFrame, solved: Column, keys: list[str], easy: float = 0.5) -> DataFrame:
    """``(keys, solve_rate, label)``: easy where a solver's tries succeed in ``easy`` of all or more, else hard; a null try failed."""
    rate = F.avg(F.coalesce(solved, F.lit(False)).cast("double"))
    return df.groupBy(*keys).agg(F.round(rate, 6).alias("solve_rate"), F.when(rate >= easy, "easy").otherwise("hard").alias("label"))


def _built_in() -> None:
    from velarium.functions import numbers, text
    from velarium.operators import evaluation

    register("token_f1", text.token_f1)
    register("exact", lambda p, g: text.exact(p, g).cast("double"))
    register("relaxed_f1", text.relaxed_f1)
    register("eval_f1", evaluation.eval_f1)
    register("universal", evaluation.universal)
    register("number_recall", numbers.number_recall)


_built_in()
