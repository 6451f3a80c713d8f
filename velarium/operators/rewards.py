"""Rewards of completions as column expressions, and a registry of them by name.

Each takes the columns it needs and gives a double; ``composed`` adds them up with normalised
weights. Scores that a model would give come in as columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from velarium.functions import numbers, text

Reward = Callable[..., Column]
REWARDS: dict[str, Reward] = {}


def reward(f: Reward) -> Reward:
    REWARDS[f.__name__] = f
    return f


@reward
def answer_format(completion: Column) -> Column:
    """0.1 for an answer tag."""
    return F.when(completion.rlike(r"(?is)<answer>.*?</answer>"), 0.1).otherwise(0.0)


@reward
def long_answer(completion: Column, least: int = 10) -> Column:
    """0.1 for an answer tag with at least ``least`` characters."""
    return F.when(completion.rlike(rf"(?is)<answer>.{{{least},}}?</answer>"), 0.1).otherwise(0.0)


#: Evidence from mail: an address, or the words for a message's id. Fixed values.
CITED = r"(?i)<[^>]+@[^>]+>|\b[\w.+\-]+@[\w.\-]+\b|\bmessage[_\-]?id\b"


@reward
def citation(completion: Column) -> Column:
    """0.2 for an e-mail address or the mention of a message id."""
    return F.when(completion.rlike(CITED), 0.2).otherwise(0.0)


@reward
def tool_used(calls: Column) -> Column:
    """1 if any tool was called."""
    return F.when(calls > 0, 1.0).otherwise(0.0)


@reward
def concise(completion: Column, most: int = 80) -> Column:
    """0.3 for at most ``most`` words."""
    return F.when(F.size(text.tokens(text.squeeze(completion))) <= most, 0.3).otherwise(0.0)


@reward
def search_grounding(calls: Column) -> Column:
    """0, 0.2 and 0.3 for no, one and more searches."""
    return F.when(calls <= 0, 0.0).when(calls == 1, 0.2).otherwise(0.3)


@reward
def exploration(calls: Column) -> Column:
    """0, 0.1 and 0.2 for no, one and more calls."""
    return F.when(calls <= 0, 0.0).when(calls == 1, 0.1).otherwise(0.2)


@reward
def answer_correctness(prediction: Column, gold: Column) -> Column:
    """1 for the same text in lower case, 0.5 if one holds the other, else 0; an empty prediction is held by anything."""
    tag = r"(?is)<answer>(.*?)</answer>"
    p = F.when(prediction.rlike(tag), text.strip(F.lower(F.regexp_extract(prediction, tag, 1)))).otherwise(F.lower(prediction))
    g = text.strip(F.lower(gold))
    return F.when(p == g, 1.0).when(g.contains(p) | p.contains(g), 0.5).otherwise(0.0)


@reward
def numerical_match(prediction: Column, gold: Column) -> Column:
    """First numbers: equal 1, within 5 percent 0.5, else 0."""
    p, g = F.get(numbers.numbers_in(prediction), 0), F.get(numbers.numbers_in(gold), 0)
    return F.when(p.isNull() | g.isNull(), 0.0).when(F.abs(p - g) < 1e-9, 1.0).when(numbers.close(p, g, 0.05), 0.5).otherwise(0.0)


@reward
def correct_answer(prediction: Column, gold: Column) -> Column:
    """Any number within 0.001 of gold's 1.5, within 1 percent 0.5; without numbers 1.5 for the same text."""
    p, g = numbers.numbers_in(prediction), F.get(numbers.numbers_in(gold), 0)
    by_number = F.when(F.exists(p, lambda x: F.abs(x - g) < 1e-3), 1.5).when(F.exists(p, lambda x: numbers.close(x, g, 0.01)), 0.5).otherwise(0.0)
    return F.when(g.isNotNull(), by_number).otherwise(F.when(text.squad(text.answer(prediction)) == text.squad(gold), 1.5).otherwise(0.0))


@reward
def yes_no(completion: Column, gold: Column) -> Column:
    """Starred yes or no: none -0.5, right 0.6, wrong -1."""
    said = F.lower(F.regexp_extract(completion, r"(?i)\*+\s*(yes|no)\s*\*+", 1))
    return F.when(said == "", -0.5).when(said == F.lower(F.trim(gold)), 0.6).otherwise(-1.0)


def _tier(share: Column) -> Column:
    return F.when(share >= 0.8, 1.0).when(share >= 0.5, 0.5).when(share >= 0.2, 0.2).otherwise(0.0)


@reward
def placeholder_coverage(prediction: Column, gold: Column) -> Column:
    """Share of gold's numbers, as written but for percent and scale letters, in the prediction, in tiers: 0.8 gives 1, 0.5 gives 0.5, 0.2 gives 0.2."""
    wanted = F.regexp_extract_all(gold, F.lit(r"[$]?[-]?\d+[.,]?\d*[BMK%]?"), F.lit(0))
    said = F.lower(text.answer(prediction))
    hits = F.filter(wanted, lambda n: said.contains(F.regexp_replace(F.lower(n), "[%bm]+$", "")))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(_tier(F.size(hits) / F.size(wanted)))


@reward
def template_structure(prediction: Column, template: Column, most: int = 5) -> Column:
    """0.3 times the share of the template's first ``most`` starred headers whose first 20 characters the prediction holds; 0.1 without headers."""
    headers = F.slice(F.regexp_extract_all(template, F.lit(r"\*\*([^*]{10,})\*\*"), F.lit(1)), 1, most)
    said = F.lower(text.answer(prediction))
    hits = F.filter(headers, lambda h: said.contains(F.lower(F.substring(h, 1, 20))))
    return F.when(F.size(headers) == 0, 0.1).otherwise(0.3 * F.size(hits) / F.size(headers))


@reward
def termination(completion: Column, searches: Column, free: int = 2) -> Column:
    """1 for an answer tag; without one 0 up to ``free`` searches, then -0.25 each, at least -1."""
    tag = completion.rlike(r"(?is)<answer>.*?</answer>")
    return F.when(tag, 1.0).when(searches <= free, 0.0).otherwise(F.greatest(F.lit(-1.0), -0.25 * (searches - free)))


@reward
def necessity(exact: Column, searches: Column, most: int, requires_search: Column | None = None) -> Column:
    """Exact answers earn 1 - n/N; where no search is needed only answers without one earn 1."""
    n = exact.cast("double") * F.greatest(F.lit(0.0), 1.0 - searches / F.lit(float(most)))
    return n if requires_search is None else F.when(requires_search, n).otherwise(F.when(exact & (searches == 0), 1.0).otherwise(0.0))


@reward
def frugality(searches: Column, optimal: Column, most: int) -> Column:
    """1.2 at the optimal number of searches, 0.5 n/optimal below, 1 - ln(1 + over)/ln(1 + N) above."""
    over = searches - optimal
    return F.when(over == 0, 1.2).when(over < 0, 0.5 * searches / optimal).otherwise(F.greatest(F.lit(0.0), 1.0 - F.log1p(over) / F.log1p(F.lit(float(most)))))


@reward
def conciseness(completion: Column, full: int = 280, none: int = 1200) -> Column:
    """1 up to ``full`` characters, falling to 0 at ``none``."""
    return numbers.clamp(1.0 - (F.length(completion) - full) / F.lit(float(none - full)))


@reward
def decision_token(completion: Column) -> Column:
    """0.1 for a decision token of a memory operation and an action, and 0.1 more for answering now; null text has none."""
    said = F.regexp_extract(F.coalesce(completion, F.lit("")), r"<decision:(?:keep|drop|compress):(search-again|answer-now)>", 1)
    return F.when(said == "", 0.0).when(said == "answer-now", 0.2).otherwise(0.1)


@reward
def process_reward(tac: Column, arr: Column, lcf: Column, judge: Column | None = None) -> Column:
    """tac - 0.2 arr - 0.1 lcf, averaged with a judge's score if there is one, between 0 and 1."""
    base = tac - 0.2 * arr - 0.1 * lcf
    return numbers.clamp(base if judge is None else F.coalesce((base + judge) / 2, base))


@reward
def composite_trajectory(base: Column, tac: Column, scsr: Column, iasa: Column, egs: Column, arr: Column, lcf: Column) -> Column:
    """Mean of five scores less penalties for redundant calls and loops, between 0 and 1."""
    return numbers.clamp((base + tac + scsr + iasa + egs) / 5 - 0.2 * arr - 0.1 * lcf)


#: Tools of an ingestion task, in the order of their use. Fixed values.
CHAIN = ("list_dir", "read_file", "run_python", "write_file")


@reward
def computation(calls: Column) -> Column:
    """0, 0.2 and 0.3 for no, one and more runs of code."""
    return F.when(calls >= 2, 0.3).when(calls == 1, 0.2).otherwise(0.0)


@reward
def tool_chain(completion: Column, tools: tuple[str, ...] = CHAIN) -> Column:
    """0.1 for each of the tools that the completion names."""
    return F.round(sum((F.when(completion.contains(t), 0.1).otherwise(0.0) for t in tools), F.lit(0.0)), 6)


def mentions(completion: Column, name: str) -> Column:
    """How often a completion names a tool, in any case."""
    return F.size(F.regexp_extract_all(completion, F.lit(f"(?i){name}"), F.lit(0)))


@reward
def table_grounding(completion: Column, tool: str = "query_finqa_tables") -> Column:
    """0, 0.2 and 0.3 for no, one and more mentions of the tool that reads tables."""
    return search_grounding(mentions(completion, tool))


@reward
def calculator_grounding(completion: Column) -> Column:
    """0.2 if the completion names the calculator."""
    return F.when(mentions(completion, "calculator") > 0, 0.2).otherwise(0.0)


@reward
def filled_answer(completion: Column, least: int = 3) -> Column:
    """0.1 for an answer tag with at least ``least`` characters."""
    return long_answer(completion, least)


@reward
def amount_coverage(prediction: Column, gold: Column) -> Column:
    """Share of gold's amounts within 2 percent in the answer, in tiers 0.4, 0.2, 0.1; without amounts in gold 0.1 for any answer."""
    said = text.answer(prediction)
    g, p = numbers.amounts_in(gold), numbers.amounts_in(said)
    share = F.size(F.filter(g, lambda x: F.exists(p, lambda y: numbers.close(y, x)))) / F.size(g)
    tiers = F.when(share >= 0.8, 0.4).when(share >= 0.5, 0.2).when(share >= 0.2, 0.1).otherwise(0.0)
    return F.when(F.size(g) == 0, F.when(said != "", 0.1).otherwise(0.0)).otherwise(tiers)


@reward
def amount_correctness(prediction: Column, gold: Column) -> Column:
    """1 if any amount of the answer is within 2 percent of any of gold's, 0.5 within 10; without amounts in gold 1 for the same text, 0.5 if one holds the other, 0 for empty gold."""
    said = text.answer(prediction)
    g, p = numbers.amounts_in(gold), numbers.amounts_in(said)
    near = lambda t: F.exists(g, lambda x: F.exists(p, lambda y: numbers.close(y, x, t)))
    a, b = F.lower(said), text.strip(F.lower(gold))
    words = F.when(b == "", 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.5).otherwise(0.0)
    return F.when(F.size(g) == 0, words).when(near(0.02), 1.0).when(near(0.1), 0.5).otherwise(0.0)


def composed(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted sum of rewards with weights that sum to 1; null parts count 0."""
    total = sum(w for _, w in parts.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    out = F.lit(0.0)
    for c, w in parts.values():
        out = out + F.coalesce(c, F.lit(0.0)) * (w / total)
    return out


#: Weights of the named stacks of rewards. Fixed values.
STACKS = {
    "t3": {"format": 0.1, "correctness": 0.5, "necessity": 0.2, "frugality": 0.2},
    "t3_training": {"format": 0.1, "termination": 0.2, "correctness": 0.4, "necessity": 0.15, "frugality": 0.15},
    "combined": {"format": 0.1, "termination": 0.3, "correctness": 0.4, "necessity": 0.1, "frugality": 0.1},
    "m2": {"format": 0.1, "termination": 0.3, "correctness": 0.4, "necessity": 0.1, "frugality": 0.1, "decision": 0.05},
}


def stacked(name: str, parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """A named stack of rewards from its parts, with some weights replaced; weights are made to sum to 1, a null part counts 0."""
    w = STACKS[name] | (weights or {})
    return composed({k: (parts[k], w[k]) for k in STACKS[name]})
