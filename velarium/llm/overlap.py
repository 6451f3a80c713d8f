"""Questions that occur, the same or nearly so, in more than one split.

What words of a question weigh is counted over all questions: words that many questions have in lower
case or at their beginning only phrase it, words that many have with a capital mark one thing of many
(a section, a letter), the rest, with numbers, name what it is about. Each question gets a 128-bit
similarity hash over its words with these weights, names by their letter triples; words a slip away
from a frequent one count as that one. Texts are read to their end; only statements said with many
questions, such as how to answer, are told apart by counting and left out. The code is cut into twelve blocks, so two codes within a Hamming
distance of eleven share one: candidates come from an equi-join on (block number, block, numbers) and are
verified on the words. Questions with the same words are one row in it, however many texts and
trajectories they stand for; these are kept apart and joined to the links at the end.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import kept, spread
from velarium.llm.runs import close

#: Legal forms and the like that may be left off a firm's name. Fixed values.
FORMS = set("gmbh ag kg se ltd limited llc inc incorporated corp corporation co company plc sarl sa sas bv nv spa srl group holdings holding partners logistics".split())
#: A word is known if more than one in so many questions has it, and frequent if more than one in so many; bounds what is shared with the tasks to as many words a word of the mean question.
KNOWN, FREQUENT = 5000, 200
#: Questions that must have a frequent word at least, so that a few copies of one question don't make its words frequent.
LEAST = 12
#: What a word of each class weighs in the hash.
NAME, MARK, PLAIN = 1.0, 0.3, 0.06
#: Ordinary words that weigh in full; more share this weight, so that a long text doesn't outweigh its names.
MANY = 20
#: Share of the weight of the ordinary words of the shorter question that the other must have.
FACT = 0.5
BITS, RADIUS = 128, 11
#: Bits of each block: one more than the radius, so two codes within it have one in common.
WIDTHS = (11, 11, 11, 11, 11, 11, 11, 11, 10, 10, 10, 10)
#: Parts that the trajectories of one question are spread over when links are expanded.
SALTS = 16
_TOKEN = re.compile(r"[^\W_]+|[.!?]+|[^\w\s]")
_CODE = re.compile(r"(?i)\b([a-z]{2,3})[\s\-‐-―/]*(\d{5,6})\b")


def tokens(question: str) -> tuple[list[tuple[str, bool]], bool, list[tuple[slice, bool]]]:
    """All words with whether each begins a sentence, whether the question is written in mixed case, and its sentences with whether each asks.

    Codes of letters and digits are one word however they are written.
    """
    t = re.sub(r"[​-‍﻿]", "", unicodedata.normalize("NFKC", question))
    t = _CODE.sub(lambda m: f" {m[1].lower()}{m[2]} ", re.sub(r"(?<=\w)['’]s\b", " ", t))
    out, first, sentences, begin = [], True, [], 0
    for w in [*_TOKEN.findall(t), "."]:
        if w[0].isalnum():
            out.append((w, first))
            first = False
        elif w[0] in ".!?:-‐–—¿)":
            first = True
            if w[0] in ".!?":
                if begin < len(out):
                    sentences.append((slice(begin, len(out)), "?" in w))
                begin = len(out)
    inner = [w for w, start in out if not start and w.isalpha() and len(w) > 1]
    return out, sum(w.islower() for w in inner) >= 3 and any(w[0].isupper() and not w.isupper() for w in inner), sentences


class Words:
    """The known words of all questions: how many questions have each, and how often it has a capital, none, or begins a sentence; and the statements that many have."""

    def __init__(self, n: int, rows: dict[str, tuple[int, int, int, int]], framing: set[str]):
        self.n, self.rows, self.framing = n, rows, framing
        self._build()

    def __getstate__(self):
        return self.n, self.rows, self.framing

    def __setstate__(self, x):
        self.n, self.rows, self.framing = x
        self._build()

    def _build(self):
        self.plain = {w for w, (df, cap, low, first) in self.rows.items() if low + first > cap}
        self.frequent = {w for w, r in self.rows.items() if r[0] > max(self.n / FREQUENT, LEAST)}
        self.capital = {w for w in self.frequent if self.rows[w][1] > self.rows[w][2]}
        #: Frequent words written both ways, which text of one case doesn't tell.
        self.either = {w for w in self.frequent if min(self.rows[w][1:3]) > 0.05 * max(self.rows[w][1:3])}
        self.near: dict[str, list[str]] = {}
        for w in sorted(self.plain | self.frequent):
            if len(w) > 3 and w.isalpha() and self.rows[w][0] * 4 > max(self.n / FREQUENT, LEAST):
                for x in _shorter(w, 2 if len(w) > 6 else 1):
                    self.near.setdefault(x, []).append(w)
        self.spelled: dict[str, str | None] = {}

    def weight(self, w: str) -> float:
        """What an ordinary word counts when two questions are compared: the rarer the more."""
        return min(5.0, math.log1p(self.n / self.rows[w][0] if w in self.rows else self.n))

    def right(self, w: str) -> str | None:
        """The frequent word that a word is a slip (from seven letters on two) away from."""
        if w not in self.spelled:
            if len(self.spelled) > 100_000:
                self.spelled.clear()
            most = 2 if len(w) > 6 else 1
            found = {v for x in _shorter(w, most) for v in self.near.get(x, ())} if len(w) > 3 and w.isalpha() else ()
            found = [v for v in found if close(w, v, 2 if min(len(w), len(v)) > 6 else 1)]
            self.spelled[w] = min(found, key=lambda v: (not close(w, v, 1), -self.rows[v][0], v), default=None)
        return self.spelled[w]


def _shorter(w: str, most: int) -> set[str]:
    """A word with up to ``most`` letters left out."""
    out = {w}
    for _ in range(most):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


#: Classes of the words of a question.
CLASSES = ("numbers", "names", "marks", "plain")


def _framing(sentences: list[tuple[slice, bool]]) -> list[slice]:
    """Sentences that may only say how to answer: those without a question mark in a text that has one."""
    return [x for x, asks in sentences if not asks] if any(asks for _, asks in sentences) else []


def parse(question: str, known: Words) -> dict[str, frozenset | bool]:
    """Words of a question by class: numbers and codes, names, marks of one thing among many, and ordinary words; ordinary words of each sentence that asks or names something; and whether its case is mixed.

    In mixed case a capital within a sentence tells names and marks from ordinary words; elsewhere
    the known words do, and what isn't among them is a name. Ordinary words of a statement that goes
    with many questions only frame this one and are in no class.
    """
    found, mixed, sentences = tokens(question)
    words: list[tuple[str, str]] = []
    for w, first in found:
        u = w.lower()
        if any(c.isdigit() for c in u):
            words.append(("numbers", u))
        elif u in FORMS:
            words.append(("", u))
        elif mixed and not first and w[0].islower():
            words.append(("plain", u if u in known.rows else known.right(u) or u))
        elif mixed and not first and u in known.frequent:
            words.append(("marks", u))
        else:
            v = u if u in known.plain or u in known.frequent else known.right(u)
            if v in known.capital and (mixed or v not in known.either):
                words.append(("marks", v))
            elif v and (not (mixed and not first) or u in known.plain):  # a capital within a sentence is no slip of an ordinary word
                words.append(("plain", v))
            else:
                words.append(("names", u))
    for x in _framing(sentences):
        if all(c in ("plain", "") for c, _ in words[x]) and " ".join(w for _, w in words[x]) in known.framing:
            words[x] = [("", w) for _, w in words[x]]
    told = [frozenset(w for c, w in words[x] if c == "plain") for x, asks in sentences if asks or any(c in ("numbers", "names", "marks") for c, _ in words[x])]
    return {c: frozenset(w for k, w in words if k == c) for c in CLASSES} | {"told": frozenset(x for x in told if x), "mixed": mixed}


def features(p: dict) -> list[tuple[str, float]]:
    """Weighted features of a question's words; names and numbers have the same weight together however many parts they have, ordinary words at most that of ``MANY``."""
    plain = PLAIN * min(1.0, (MANY / max(1, len(p["plain"]))) ** 0.5)
    out = [("=" + w, MARK) for w in p["marks"]] + [("~" + w, plain) for w in p["plain"]]
    for w in p["names"] | p["numbers"]:
        x = f"^{w}$"
        parts = [x[i : i + 3] for i in range(len(x) - 2)] if w.isalpha() and len(w) > 3 else [f"{w}#{i}" for i in range(6)]
        out += [(y, NAME / len(parts) ** 0.5) for y in parts]
    return out


@lru_cache(maxsize=100_000)
def _signs(feature: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(xxhash.xxh3_128_digest(feature), dtype=np.uint8)).astype(np.float32) * 2 - 1


def simhash(feats: list[tuple[str, float]]) -> str:
    """128-bit similarity hash in hex; that of no features is 0."""
    feats = sorted(feats)
    if not feats:
        return "0" * 32
    sums = np.array([w for _, w in feats], dtype=np.float32) @ np.stack([_signs(x) for x, _ in feats])
    return np.packbits(sums > 1e-6).tobytes().hex()


def same_question(p: dict, q: dict, known: Words) -> bool:
    """Whether two parsed questions ask for the same fact about the same names, things and years.

    Numbers, names and marks must be the same; a word that is written both ways may be a mark in one
    question only if the other, or it, is of one case. Ordinary words must agree by their weight, over
    the whole texts and sentence by sentence: all sentences of one that ask or name something must have
    their like in the other.
    """
    if p["numbers"] != q["numbers"] or p["names"] != q["names"]:
        return False
    differ = p["marks"] ^ q["marks"]
    if differ - (set() if p["mixed"] and q["mixed"] else known.either):
        return False
    total = lambda s: sum(known.weight(w) for w in s)
    agree = lambda a, b: total(a & b) >= FACT * min(total(a), total(b))
    within = lambda a, b: all(x in b or any(agree(x, y) for y in b) for x in a)
    return agree(p["plain"], q["plain"]) and (within(p["told"], q["told"]) or within(q["told"], p["told"]))


def questions_by_split(trajectories: DataFrame, runs: DataFrame) -> DataFrame:
    """``(trajectory_id, run_id, split, question)`` with split train or eval; ids once each.

    A run type that begins with "train" in any case is training, any other evaluation. Trajectories
    whose run is unknown or has no type, and null or blank questions, are left out.
    """
    kind = F.lower(F.trim("run_type"))
    r = runs.where(F.col("run_id").isNotNull() & (F.length(kind) > 0)).groupBy("run_id").agg(F.min(kind).alias("kind"))
    t = trajectories.where(F.col("trajectory_id").isNotNull() & (F.length(F.trim("question")) > 0)).groupBy("trajectory_id").agg(F.min_by(F.struct("run_id", "question"), F.struct("question", "run_id")).alias("r")).select("trajectory_id", "r.*")
    return t.join(r, "run_id").select("trajectory_id", "run_id", F.when(F.col("kind").startswith("train"), "train").otherwise("eval").alias("split"), "question")


def known_words(questions: DataFrame) -> Words:
    """The known words and framing statements, counted over all different questions; only these, a bounded number, come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["question"]:
                found, mixed, sentences = tokens(text)
                seen: dict[str, list[int]] = {}
                for w, first in found:
                    c = seen.setdefault(w.lower(), [0, 0, 0])
                    if mixed:
                        c[2 if first else 0 if w[0].isupper() else 1] += 1
                out += [(w, False, *c) for w, c in seen.items()]
                out += [(w, True, 0, 0, 0) for w in {" ".join(w.lower() for w, _ in found[x]) for x in _framing(sentences)}]
            yield pd.DataFrame(out, columns=["w", "stated", "cap", "low", "first"]).astype({"stated": "bool", "cap": "int64", "low": "int64", "first": "int64"})

    texts = kept(spread(questions.select("question").distinct(), "question"))
    n = texts.count()
    rows = texts.mapInPandas(count, "w string, stated boolean, cap bigint, low bigint, first bigint").groupBy("w", "stated").agg(F.count(F.lit(1)).alias("df"), *[F.sum(c).alias(c) for c in ("cap", "low", "first")])
    word = (F.col("low") + F.col("first") > F.col("cap")) | (F.col("df") > max(n / FREQUENT, LEAST))
    few = rows.where(F.col("df") * KNOWN > n).where(F.when(F.col("stated"), F.col("df") > LEAST).otherwise(word)).collect()
    return Words(n, {r["w"]: (r["df"], r["cap"], r["low"], r["first"]) for r in few if not r["stated"]}, {r["w"] for r in few if r["stated"]})


#: Columns of a parsed question; sentences are lines.
_COLUMNS = (*CLASSES, "told")
_PARSED = "sid string, code string, mixed boolean, " + ", ".join(f"{c} string" for c in _COLUMNS)


def parsed_questions(questions: DataFrame, known: Words) -> DataFrame:
    """Each row of ``(trajectory_id, run_id, split, question)`` with the words of its question, their key ``sid`` and the code."""
    shared = questions.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, done = shared.value, {}
        for b in batches:
            out = []
            for text in b["question"]:
                if len(done) > 50_000:
                    done.clear()
                if text not in done:
                    p = parse(text, words)
                    classes = [" ".join(sorted(p[c])) for c in CLASSES] + ["\n".join(sorted(" ".join(sorted(x)) for x in p["told"]))]
                    sid = xxhash.xxh3_128_hexdigest("\n\n".join([str(p["mixed"]), *classes]))
                    done[text] = (sid, simhash(features(p)), p["mixed"], *classes)
                out.append(done[text])
            rows = pd.DataFrame(out, columns=["sid", "code", "mixed", *_COLUMNS], index=b.index)
            yield pd.concat([b[["trajectory_id", "run_id", "split"]], rows], axis=1)

    return kept(spread(questions, "trajectory_id").mapInPandas(run, "trajectory_id string, run_id string, split string, " + _PARSED))


def _blocks(codes: DataFrame) -> DataFrame:
    """Codes once for each block of bits."""
    bits = F.concat(*[F.lpad(F.conv(F.substring("code", 8 * k + 1, 8), 16, 2), 32, "0") for k in range(4)])
    ends = [sum(WIDTHS[:k]) for k in range(len(WIDTHS) + 1)]
    parts = [F.struct(F.lit(k).alias("k"), F.substring("_bits", a + 1, b - a).alias("block")) for k, (a, b) in enumerate(pairwise(ends))]
    return codes.withColumn("_bits", bits).select("*", F.explode(F.array(*parts)).alias("b")).select("*", "b.k", "b.block").drop("b", "_bits")


def links(parsed: DataFrame, known: Words) -> DataFrame:
    """``(sid_a, sid_b)``: word sets of training and evaluation that ask the same, each with itself if it is in both."""
    at = lambda s: F.max((F.col("split") == s).cast("int"))
    sets = kept(parsed.groupBy("sid", "code", "mixed", *_COLUMNS).agg(at("train").alias("in_train"), at("eval").alias("in_eval")))
    b = _blocks(sets.select("sid", "code", "numbers", "in_train", "in_eval"))
    left = b.where("in_train = 1").select("k", "block", "numbers", F.col("sid").alias("sid_a"), F.col("code").alias("code_a"))
    right = b.where("in_eval = 1").select("k", "block", "numbers", F.col("sid").alias("sid_b"), F.col("code").alias("code_b"))
    word = lambda c, k: F.conv(F.substring(c, 8 * k + 1, 8), 16, 10).cast("bigint")
    far = sum(F.bit_count(word("code_a", k).bitwiseXOR(word("code_b", k))) for k in range(4))
    near = left.join(right, ["k", "block", "numbers"]).where(far <= RADIUS).select("sid_a", "sid_b").distinct()
    side = lambda s: sets.select(F.col("sid").alias(f"sid_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in (*_COLUMNS, "mixed")])
    pairs = near.join(side("a"), "sid_a").join(side("b"), "sid_b")
    shared = parsed.sparkSession.sparkContext.broadcast(known)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        for x in batches:
            p, q = ([{c: frozenset(r[i].split()) for i, c in enumerate(CLASSES)} | {"told": frozenset(frozenset(t.split()) for t in r[-2].splitlines()), "mixed": r[-1]} for r in x[[*[f"{c}_{s}" for c in _COLUMNS], f"mixed_{s}"]].itertuples(index=False, name=None)] for s in "ab")
            yield x.loc[[same_question(a, b, words) for a, b in zip(p, q)], ["sid_a", "sid_b"]]

    return pairs.mapInPandas(verify, "sid_a string, sid_b string")


def overlaps(trajectories: DataFrame, runs: DataFrame) -> DataFrame:
    """``(id_train, run_train, id_eval, run_eval)`` of each trajectory pair over the splits that asks the same.

    Empty tables, or only one split, give an empty result; repeated rows count once; other columns
    are ignored. Words are counted and texts hashed when this is called.
    """
    q = questions_by_split(trajectories, runs)
    known = known_words(q)
    parsed = parsed_questions(q, known)
    found = kept(links(parsed, known))
    # The trajectories of one question go to several tasks, its links to all of those.
    salt = F.pmod(F.xxhash64("trajectory_id"), F.lit(SALTS)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    a = parsed.where("split = 'train'").select(F.col("trajectory_id").alias("id_train"), F.col("run_id").alias("run_train"), F.col("sid").alias("sid_a"), salt)
    b = parsed.where("split = 'eval'").select(F.col("trajectory_id").alias("id_eval"), F.col("run_id").alias("run_eval"), F.col("sid").alias("sid_b"), salt)
    with_a = found.select("sid_a", "sid_b", every).join(a, ["sid_a", "salt"]).drop("salt", "sid_a")
    return with_a.select("id_train", "run_train", "sid_b", every).join(b, ["sid_b", "salt"]).select("id_train", "run_train", "id_eval", "run_eval")


def overlap_report(trajectories: DataFrame, runs: DataFrame) -> DataFrame:
    """``(split, run_id, n_trajectories, n_overlapping)``: how many of a run's trajectories also occur in the other split.

    Counts are made by question first and come from its links, without pairs of trajectories.
    """
    q = questions_by_split(trajectories, runs)
    known = known_words(q)
    parsed = parsed_questions(q, known)
    found = kept(links(parsed, known))
    hit = found.select(F.lit("train").alias("split"), F.col("sid_a").alias("sid")).unionByName(found.select(F.lit("eval").alias("split"), F.col("sid_b").alias("sid"))).distinct().withColumn("hit", F.lit(1))
    counts = parsed.groupBy("split", "run_id", "sid").agg(F.count(F.lit(1)).alias("n"))
    hits = counts.join(hit, ["split", "sid"], "left")
    return hits.groupBy("split", "run_id").agg(F.sum("n").alias("n_trajectories"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("n_overlapping"))
