"""Runs of the same event within ordered sequences, collapsed into one event each.

A sequence becomes a string with one code point for each event: events that mean the same have the
same code point wherever they stand, and one regular expression with a back-reference finds the runs.
Sequences are cut into blocks of ``BLOCK`` step numbers that separate tasks work on, so the longest
sequence never meets in one task; a second pass joins the runs that touch block borders and sees at
most two rows of each block.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import kept, tasks

#: Step numbers in a block.
BLOCK = 4096
#: Arguments that only track a request; ids of what a call is about (message, job, run, event) are none. Fixed values.
TRACKING = re.compile(
    r"(?i)^_?(?:(?:request|req|call|tool_call|trace|span|correlation|idempotency|x_request)_?(?:id|key|no|nr|number|uuid|token)|trace|traceparent|nonce|uuid|guid|"
    r"(?:retry|retries|attempt|attempts|try|tries)(?:_?(?:no|nr|number|count|id))?|(?:sent|requested|called|queued)_?(?:at|on|ts|time)|timestamp|ts)$"
)
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[^\w\s]|_")


def close(a: str, b: str, most: int) -> bool:
    """Whether two words differ by at most ``most`` letters added, lost, changed or swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return False
    return row[-1] <= most


def _value(x) -> list:
    """Tokens of a value; numbers alike whether written as text, integer or with a point."""
    if isinstance(x, bool) or x is None:
        return [str(x).lower()]
    if isinstance(x, (int, float)):
        return [("%.12g" % x)]
    if isinstance(x, str):
        t = unicodedata.normalize("NFKC", x).strip()
        if re.fullmatch(r"[+-]?\d+(\.\d+)?", t) and len(t) < 16:
            return ["%.12g" % float(t)]
        return [("%.12g" % float(m)) if m[0].isdigit() and m.count(".") < 2 and "," not in m and len(m) < 16 and (m[0] != "0" or "." in m) else m for m in _TOKEN.findall(t)]
    if isinstance(x, list):
        # The order of words, as of key words, says nothing; that of numbers and objects does.
        parts = [_value(v) for v in x]
        if all(isinstance(v, str) and v.strip()[:1].isalpha() for v in x):
            parts.sort(key=str)
        return ["["] + [t for v in parts for t in [*v, ";"]] + ["]"]
    return ["{"] + [t for k in sorted(x) if not TRACKING.match(k) for t in [k.lower(), ":", *_value(x[k]), ";"]] + ["}"]


def name_of(action: str | None) -> str:
    """Canonical name of a tool: snake case without blanks, hyphens and case."""
    x = unicodedata.normalize("NFKC", action or "").strip()
    x = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", x)
    return re.sub(r"[\s\-_.]+", "_", x).strip("_").casefold()


@lru_cache(maxsize=50_000)
def canonical(action: str | None, args: str | None) -> tuple[str, tuple[str, ...]]:
    """``(name, tokens of the arguments)``; text that isn't JSON is taken as text."""
    name = name_of(action)
    text = (args or "").strip()
    try:
        x = json.loads(text) if text else {}
        while isinstance(x, str) and x.strip()[:1] in ("{", "["):
            x = json.loads(x)
    except (ValueError, RecursionError):
        x = None
    if x is None and text.lower() not in ("null", "none"):
        return name, ("cut", *_TOKEN.findall(unicodedata.normalize("NFKC", text)))
    return name, tuple(_value(x if x is not None else {}))


def same_call(a: tuple[str, tuple[str, ...]], b: tuple[str, tuple[str, ...]]) -> bool:
    """Whether two canonical calls mean the same apart from case and slips of letters in words.

    A word of four letters or more may have one slip, of seven or more two; two words at most. A
    word written with a capital is a name, and names must be alike.
    """
    if a == b:
        return True
    if a[0] != b[0] and not (min(len(a[0]), len(b[0])) > 8 and a[0][0] == b[0][0] and close(a[0], b[0], 1)):
        return False
    if len(a[1]) != len(b[1]):
        return False
    slips = 0
    for x, y in zip(a[1], b[1]):
        if x == y or (u := x.casefold()) == (v := y.casefold()):
            continue
        if not (u.isalpha() and v.isalpha()) or min(len(u), len(v)) < 3 or max(len(u), len(v)) < 4:
            return False
        if x[0].isupper() and not x.isupper() and y[0].isupper() and not y.isupper():
            return False
        slips += 1
        if slips > 2 or not close(u, v, 2 if min(len(u), len(v)) >= 7 and u[:3] == v[:3] else 1):
            return False
    return True


def symbols(calls: Iterable[tuple[str | None, str | None]]) -> str:
    """One code point for each call; calls that mean the same share one, a call without a name has its own.

    Words may differ by slips, so a form is compared with the more frequent ones that have the same
    number of tokens and the same tokens that aren't words; slips thus go with the right spelling.
    """
    forms = [canonical(action, args) if action and action.strip() else None for action, args in calls]
    codes = (chr(k) for k in range(0x100, 0x110000) if not 0xD800 <= k < 0xE000)
    known: dict[tuple, str] = {}
    near: dict[tuple, list[tuple]] = {}
    for form, _ in Counter(f for f in forms if f is not None).most_common():
        alike = near.setdefault(tuple(t if not t.isalpha() else "" for t in form[1]), [])
        twin = next((x for x in alike if same_call(x, form)), None)
        if twin is None:
            alike.append(form)
        known[form] = known[twin] if twin else next(codes)
    return "".join(known[f] if f is not None else next(codes) for f in forms)


def spans(calls: Iterable[tuple[str | None, str | None]]) -> list[tuple[int, int]]:
    """``[start, end)`` of each run of one or more calls; calls without a name stand alone."""
    text, out, at = symbols(calls), [], 0
    for m in _RUN.finditer(text):
        out += [(k, k + 1) for k in range(at, m.start())] + [m.span()]
        at = m.end()
    return out + [(k, k + 1) for k in range(at, len(text))]


_EDGE = "trajectory_id string, block bigint, at_start boolean, at_end boolean, first_step bigint, last_step bigint, n bigint, t0 timestamp, t1 timestamp, action_name string, args0 string, a1 string, args1 string"


def _rows_of(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of successive rows with one key, over batch borders."""
    now, rows = None, []
    for b in batches:
        for r in b.itertuples(index=False, name=None):
            k = r[: len(key)]
            if k != now:
                if rows:
                    yield now, rows
                now, rows = k, []
            rows.append(r[len(key) :])
    if rows:
        yield now, rows


def _least(values):
    return min((v for v in values if v is not pd.NaT and v is not None and v == v), default=None)


def _most(values):
    return max((v for v in values if v is not pd.NaT and v is not None and v == v), default=None)


def collapse(steps: DataFrame, least: int = 1) -> DataFrame:
    """Events of each trajectory: ``(trajectory_id, first_step, last_step, n_steps, action_name, started_at, ended_at, duration_s)``.

    Rows with one step number are one step (the first by ``step_id``). Steps follow each other by
    number, whether or not numbers are missing between them. A step without a name ends a run and
    is an event by itself. ``least`` leaves out shorter runs. Null ids or numbers are left out;
    null times give null durations; cut-off arguments are compared as text; an empty table gives
    an empty one.
    """
    spark = steps.sparkSession
    rows = (
        steps.where(F.col("trajectory_id").isNotNull() & F.col("step_number").isNotNull())
        .select("trajectory_id", F.expr(f"cast(floor(step_number / {BLOCK}) as bigint)").alias("block"), F.col("step_number").cast("bigint").alias("n"), "step_id", "action_name", "action_args_json", F.col("started_at").cast("timestamp").alias("t"))
        .repartition(tasks(spark), "trajectory_id", "block")
        .sortWithinPartitions("trajectory_id", "block", "n", "step_id")
    )

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for (traj, block), group in _rows_of(batches, ["trajectory_id", "block"]):
            one = [g for k, g in enumerate(group) if k == 0 or g[0] != group[k - 1][0]]
            found = spans((g[2], g[3]) for g in one)
            for a, b in found:
                part = one[a:b]
                out.append((traj, block, a == 0, b == len(one), part[0][0], part[-1][0], b - a, _least(p[4] for p in part), _most(p[4] for p in part), part[0][2], part[0][3], part[-1][2], part[-1][3]))
            if len(out) > 5000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    def _frame(out: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(out, columns=[c.split()[0] for c in _EDGE.split(", ")])
        return f.astype({"t0": "datetime64[us]", "t1": "datetime64[us]"})

    parts = kept(rows.mapInPandas(runs, _EDGE))  # read twice below
    # A block of a trajectory that has no other needs no joining; most have one block only.
    inner = (~F.col("at_start") & ~F.col("at_end"))
    cut = parts.withColumn("inner", inner)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now = [], None
        cols = [c.split()[0] for c in _EDGE.split(", ")]
        for b in batches:
            for r in b[cols].itertuples(index=False, name=None):
                if now and now[0] == r[0] and now[1] != r[1] and now[3] and r[2] and now[11] and r[9] and now[11].strip() and r[9].strip() and same_call(canonical(now[11], now[12]), canonical(r[9], r[10])):
                    now = (*now[:3], r[3], now[4], r[5], now[6] + r[6], _least((now[7], r[7])), _most((now[8], r[8])), *now[9:11], *r[11:13])
                    now = (now[0], r[1], *now[2:])
                    continue
                if now:
                    out.append(now)
                now = r
            if len(out) > 5000:
                yield _frame(out)
                out = []
        if now:
            out.append(now)
        if out:
            yield _frame(out)

    edges = cut.where(~F.col("inner")).drop("inner").repartition(tasks(spark), "trajectory_id").sortWithinPartitions("trajectory_id", "block", "first_step").mapInPandas(join, _EDGE)
    events = cut.where("inner").drop("inner").unionByName(edges).where(F.col("n") >= least)
    return events.select(
        "trajectory_id", F.col("first_step").cast("int").alias("first_step"), F.col("last_step").cast("int").alias("last_step"), F.col("n").alias("n_steps"), "action_name",
        F.col("t0").alias("started_at"), F.col("t1").alias("ended_at"), (F.col("t1").cast("double") - F.col("t0").cast("double")).alias("duration_s"),
    )
