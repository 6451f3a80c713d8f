"""Text functions as column expressions; the few that need Python are Arrow-batched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, as a character class. Fixed value.
PUNCT = r"[!-/:-@\[-`{-~]"


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip(c: Column) -> Column:
    """No ASCII white space at the ends."""
    return F.regexp_replace(c, r"^[ \t\r\n\x0b\f]+|[ \t\r\n\x0b\f]+\z", "")


def squad(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), PUNCT, ""), r"\b(a|an|the)\b", " "))


def tokens(c: Column) -> Column:
    """Words between single blanks; an empty array for empty text."""
    return F.filter(F.split(c, " "), lambda x: x != "")


#: Legal forms of firms that an answer may leave off. Fixed values.
FORMS = "inc llc ltd corp corporation co company gmbh plc".split()


def relaxed(c: Column) -> Column:
    """Punctuation to blanks, leading article and trailing legal form of a firm removed."""
    t = squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "))
    t = F.regexp_replace(t, r"^(the|a|an) ", "")
    return F.trim(F.regexp_replace(t, rf"(^|\W)({'|'.join(FORMS)})$", ""))


def counts(a: Column) -> Column:
    """How often each element of an array occurs, as a map."""
    d = F.array_distinct(a)
    return F.map_from_arrays(d, F.transform(d, lambda x: F.size(F.filter(a, lambda y: y == x))))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the common part of two arrays as multisets."""
    d = F.array_intersect(a, b)
    least = F.transform(d, lambda x: F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.aggregate(least, F.lit(0), lambda s, x: s + x)


def f1(common: Column, n: Column, m: Column) -> Column:
    """F1 of ``common`` shared tokens out of ``n`` and ``m``; 0 when nothing is shared."""
    return F.when((common == 0) | (n == 0) | (m == 0), F.lit(0.0)).otherwise(2.0 * common / (n + m))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 over normalised tokens as multisets; 0 if either is empty."""
    a, b = tokens(squad(prediction)), tokens(squad(gold))
    return f1(multiset_overlap(a, b), F.size(a), F.size(b))


def relaxed_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the set overlap over list lengths, after the relaxed normalisation."""
    a, b = tokens(relaxed(prediction)), tokens(relaxed(gold))
    return f1(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def exact(prediction: Column, gold: Column) -> Column:
    """Whether two texts are the same after normalisation."""
    return squad(prediction) == squad(gold)


def bare(c: Column) -> Column:
    """Lower case without closing stops and commas, then without dollar and percent signs, commas and blanks."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"[.,;:]+\z", ""), r"[$,%\s]", "")


def answer(c: Column) -> Column:
    """What the answer tag holds, else the whole text."""
    p = r"(?is)<answer>(.*?)</answer>"
    return strip(F.when(c.rlike(p), F.regexp_extract(c, p, 1)).otherwise(c))


def without_reasoning(c: Column) -> Column:
    """Reasoning blocks removed, closed or not."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def words(c: Column) -> Column:
    """Letter and digit runs in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1))


def ngrams(a: Column, n: int) -> Column:
    """All runs of ``n`` elements of an array, as joined strings."""
    # Shifted copies side by side: the array is evaluated once a copy, not once an element.
    m = F.greatest(F.size(a) - (n - 1), F.lit(0))
    shifted = [F.slice(a, i + 1, m) for i in range(n)]
    return F.transform(F.arrays_zip(*[x.alias(f"w{i}") for i, x in enumerate(shifted)]), lambda z: F.concat_ws(" ", *[z[f"w{i}"] for i in range(n)]))


def coherence(c: Column) -> Column:
    """Mean words of the parts between full stops over 20, at most 1; null for a single part."""
    parts = F.filter(F.transform(F.split(c, r"\."), squeeze), lambda x: x != "")
    total = F.aggregate(parts, F.lit(0), lambda s, x: s + F.size(F.split(x, " ")))
    return F.when(F.size(parts) > 1, F.least(F.lit(1.0), total / F.size(parts) / 20.0))


def doc_of(chunk_id: Column) -> Column:
    """The document of a chunk id: all before the last '::'."""
    return F.regexp_replace(chunk_id, r"::[^:]*$", "")


def signature(names: Column) -> Column:
    """Names joined as 'a->b->c'."""
    return F.array_join(names, "->")


def text_dates(c: Column, after: str | None = None, before: str | None = None) -> Column:
    """Dates kept as text from the day ``after`` on and before the day ``before``, compared as text, as the store keeps one spelling."""
    ok = c.isNotNull()
    if after:
        ok = ok & (c >= f"{after} 00:00:00")
    return ok & (c < f"{before} 00:00:00") if before else ok
