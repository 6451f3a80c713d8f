"""Evaluation scores and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.functions import numbers, text

#: Words left out of the evaluation's token score. Fixed values.
STOP = "a an the is was were be been being have has had do does did will would could should may might and or but of in on at to for with by from that this it its i you he she we they not no as if so there their our".split()
#: Words that show code in an answer, between blanks. Fixed values.
CODE = "def class return import for while if else elif try except with lambda yield assert raise pass break continue print function const let var => async await struct fn #include public private void int float bool".split()
#: Answers that are a judgment, which no passage need hold. Fixed values.
JUDGMENTS = ["yes", "no", "n/a", "na", "none", "not specified", "unspecified", "unlimited", "not applicable"]


def content(c: Column) -> Column:
    """Words of two characters or more that are no stop words."""
    w = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_]+)"), F.lit(1))
    return F.filter(w, lambda x: (F.length(x) > 1) & ~x.isin(*STOP))


def eval_f1(prediction: Column, gold: Column) -> Column:
    """Token F1 over content words as multisets, to four places; 1 if gold has none."""
    a, b = content(prediction), content(gold)
    return F.when(F.size(b) == 0, 1.0).otherwise(F.round(text.f1(text.multiset_overlap(a, b), F.size(a), F.size(b)), 4))


def universal(prediction: Column, gold: Column) -> Column:
    """Weighted mean of token F1 (1), number recall (1.5, if gold has a number) and code words with F1 (1.2, if gold has three)."""
    said = text.answer(prediction)
    words = lambda c: F.array_intersect(F.split(F.lower(c), r"\s+"), F.array(*[F.lit(x) for x in CODE]))
    f1, g = eval_f1(said, gold), words(gold)
    code = F.when(F.size(g) >= 3, F.round((F.size(F.array_intersect(words(said), g)) / F.size(g) + f1) / 2, 4))
    number = F.when(F.size(numbers.distinct_numbers(F.translate(gold, "$%", ""))) > 0, numbers.number_recall(said, gold))
    parts = [(f1, 1.0), (number, 1.5), (code, 1.2)]
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.round(total / weight, 4)


def span_grounded(answer: Column, passage: Column, least: float = 0.6) -> Column:
    """Whether the passage has at least ``least`` of the answer's words, repeats counted; judgments always, empty answers and passages never."""
    a = text.strip(F.lower(answer))
    words = lambda c: text.tokens(text.squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " ")))
    w, p = words(a), words(passage)
    share = F.size(F.filter(w, lambda x: F.array_contains(p, x))) / F.size(w)
    return F.when(a.isin(*JUDGMENTS), True).when((F.size(w) > 0) & (F.size(p) > 0), share >= least).otherwise(False)


def scale_words(c: Column) -> Column:
    """Scale words after numbers as letters: '3.2 million' to '3.2M'."""
    for word, letter in (("thousand", "K"), ("million", "M"), ("billion", "B"), ("trillion", "T")):
        c = F.regexp_replace(c, rf"(?i)(\d)\s*{word}s?\b", f"$1{letter}")
    return c


def supplied_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of supplied values, not exponentiated; infinite means count 1e9, no values give NaN."""
    m = F.avg(value)
    return df.groupBy(*keys).agg(F.round(F.coalesce(F.when(F.abs(m) == float("inf"), 1e9).otherwise(m), F.lit(float("nan"))), 6).alias("mean"), F.count(value).alias("n"))


def compare(df: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Means of each pair of groups, and whether the second keeps the first's within ``tolerance``. One row a group is compared."""
    m = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("m"))
    a, b = m.select(F.col(key).alias(f"a_{key}"), F.col("m").alias("x")), m.select(F.col(key).alias(f"b_{key}"), F.col("m").alias("y"))
    return a.join(b, F.col(f"a_{key}") < F.col(f"b_{key}")).select(f"a_{key}", f"b_{key}", F.round(F.col("y") - F.col("x"), 6).alias("delta"), (F.col("y") >= F.col("x") - tolerance).alias("keeps"))


def judges(df: DataFrame, key: str, judge: str, score: str) -> DataFrame:
    """Mean over judges of their means, with the least and greatest score; a missing score counts 0.5."""
    s = F.coalesce(score, F.lit(0.5))
    j = df.groupBy(key, judge).agg(F.avg(s).alias("m"), F.min(s).alias("lo"), F.max(s).alias("hi"))
    return j.groupBy(key).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.min("lo"), 6).alias("least"), F.round(F.max("hi"), 6).alias("greatest"))


#: Gates of a generated question and what a failure of each is called, in the order of the reasons. Fixed values.
GATES = {"grounded": "answer_not_grounded", "no_leak": "retrieval_leak", "chained": "answerable_from_last_passage"}


def verified(question: Column, answer: Column, first: dict[str, Column], revised: dict[str, Column]) -> Column:
    """``(status, revision_count, discard_reason)`` of a generated question: accepted by the ``first`` gates, else once more by those of its revision.

    Without a question or an answer it is rejected at once. Null gates fail.
    """
    ok = lambda g: F.coalesce(g["grounded"] & g["no_leak"] & g["chained"], F.lit(False))
    empty = (F.coalesce(F.length(question), F.lit(0)) == 0) | (F.coalesce(F.length(answer), F.lit(0)) == 0)
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(revised[k], F.lit(False)), F.lit(v)) for k, v in GATES.items()])), "+")
    out = lambda status, n, why: F.struct(F.lit(status).alias("status"), F.lit(n).alias("revision_count"), why.cast("string").alias("discard_reason"))
    return F.when(empty, out("rejected", 0, F.lit("empty_qa"))).when(ok(first), out("accepted", 0, F.lit(None))).when(ok(revised), out("revised_accepted", 1, F.lit(None))).otherwise(out("rejected", 1, failed))


def message_recall(prediction: Column, ids: Column) -> Column:
    """Share of message ids that a text names, in any case; 1 without ids."""
    known = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x.isNotNull())
    said = F.lower(F.coalesce(prediction, F.lit("")))
    return F.when(F.size(known) == 0, 1.0).otherwise(F.round(F.size(F.filter(known, lambda x: said.contains(F.lower(x)))) / F.size(known), 4))


def anchor_rank(found: Column, anchor: Column) -> Column:
    """Place of the anchor among found ids, from 0; -1 if it isn't there."""
    return F.coalesce(F.array_position(found, anchor), F.lit(0)) - 1


def execution_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n, success_rate, mean_seconds, syntax_errors, timeouts, runtime_errors)`` of runs ``(success, error, seconds)``; a failure is of the first kind that fits."""
    bad = ~F.coalesce("success", F.lit(False))
    syntax, late = F.coalesce(F.col("error").contains("Syntax error"), F.lit(False)), F.coalesce(F.lower("error").rlike("timeout|time out"), F.lit(False))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((~bad).cast("double")), 6).alias("success_rate"), F.round(F.avg(F.coalesce("seconds", F.lit(0.0))), 6).alias("mean_seconds"),
        F.count_if(bad & syntax).alias("syntax_errors"), F.count_if(bad & ~syntax & late).alias("timeouts"), F.count_if(bad & ~syntax & ~late).alias("runtime_errors"),
    )


def gate_verdict(gates: dict[str, Column]) -> Column:
    """'accepted', or 'discarded:' with the names of the gates that failed, joined by '+'."""
    failed = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in gates.items()])), "+")
    return F.when(failed == "", "accepted").otherwise(F.concat(F.lit("discarded:"), failed))


def first_sentence(c: Column, most: int) -> Column:
    """The first sentence, cut to ``most`` characters; the whole text without an end of a sentence."""
    return F.substring(F.when(c.rlike(r"[.!?](\s|\z)"), F.regexp_extract(c, r"(?s)^(.*?[.!?])(\s|\z)", 1)).otherwise(c), 1, most)


_HEADER = r"(?U)\[chunk_id=(\S+)\s+doc_id=(\S+)\s+score=([\d.]+)\]"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _capped(c: Column, most: int) -> Column:
    """A text over ``most`` characters cut there, without its last piece of a word."""
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most), r"(?s) [^ ]*\z", ""), F.lit("…"))).otherwise(c)


def compressed(c: Column, chunks: int = 5, most: int = 300) -> Column:
    """Tool output as evidence notes: the first ``chunks`` passages under a header, each by its first sentence or line; text without headers is only cut."""
    found = F.regexp_extract_all(c, F.lit(rf"(?s){_HEADER}.*?(?={_HEADER}|\z)"), F.lit(0))

    def note(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x, _HEADER, i)
        body = _stripped(F.regexp_replace(x, "^" + _HEADER, ""))
        first = _stripped(F.split(body, r"(?U)(?<=[.!?])\s|\n", 2)[0])
        return F.concat(F.lit("evidence[chunk_id="), part(1), F.lit(" doc_id="), part(2), F.lit(" score="), part(3), F.lit("]: "), _capped(first, most))

    none = F.split(c, _HEADER, 2)[0].contains("No results found")
    return F.when(none, "No results found.").when(F.size(found) > 0, F.array_join(F.transform(F.slice(found, 1, chunks), note), "\n")).otherwise(_capped(_stripped(c), chunks * most))
