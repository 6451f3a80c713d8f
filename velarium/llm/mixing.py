"""Sources combined to target shares of all tokens, by balanced sampling.

Every document of a source is used ``floor(e)`` times, where ``e`` is the use its source needs, and
once more with probability ``e - floor(e)``. Which ones get the further use is drawn by the cube
method: fractional probabilities move along directions that change neither the expected number of
documents nor the expected number of tokens until they are 0 or 1. Blocks of each source do that in
parallel; the two or so documents of a block that stay fractional and a small reserve go on to the next round, until one
block of each source is left and a landing rounds it with the least error in tokens.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import kept, tasks
from velarium.llm.tokens import TOKENIZER, with_token_counts

#: Documents of a source that one round of the cube method takes together.
BLOCK = 2048
#: One in so many documents of a block is left to the next round, besides those still open, so that the last one has a choice in landing.
RESERVE = 32
EPS = 1e-9


def source_key(col):
    """Source names that differ in case, blanks, hyphens or underscores are one; '' for null and blank ones."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(col)), r"[\s\-_]+", "_"), F.lit(""))


def flight(sizes: list[float], probs: list[float], draws: list[float]) -> list[float]:
    """Cube method, flight phase: move probabilities to 0 or 1 while their sum and the expected total size stay.

    Three documents with fractional probabilities allow one direction that keeps both; moving along
    it as far as possible settles at least one of them, and the next takes its place.
    """
    p, held, k = list(probs), [], 0
    for i, x in enumerate(p):
        if not EPS < x < 1 - EPS:
            p[i] = float(round(x))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[j]) / d if d > 0 else p[j] / -d for j, d in zip(held, u) if d)
            down = min(p[j] / d if d > 0 else (1 - p[j]) / -d for j, d in zip(held, u) if d)
            step = up if draws[k % len(draws)] * (up + down) < down else -down
            k += 1
            for j, d in zip(held, u):
                p[j] += step * d
            free = [j for j in held if EPS < p[j] < 1 - EPS]
            for j in held:
                if j not in free:
                    p[j] = float(round(p[j]))
            if len(free) == 3:  # rounding kept all three: settle the one nearest to an end
                j = min(free, key=lambda j: min(p[j], 1 - p[j]))
                p[j] = float(round(p[j]))
                free.remove(j)
            held = free
    return p


def landing(sizes: list[float], probs: list[float], draws: list[float], before: list[float] | None = None) -> list[float]:
    """What the flight leaves fractional, rounded to the least error in tokens, then in documents.

    All roundings of the last three open documents are tried; should more be open, the largest are
    rounded first, each against the error so far. What error is left is mended by exchanging drawn
    documents for others, of those that were fractional ``before`` the flight; this keeps their number.
    """
    p = list(probs)
    open_ = sorted((i for i, x in enumerate(p) if EPS < x < 1 - EPS), key=lambda i: (-sizes[i], draws[i % len(draws)]))
    tokens = docs = 0.0
    for i in open_[:-3]:
        up, down = tokens + (1 - p[i]) * sizes[i], tokens - p[i] * sizes[i]
        tokens, docs, p[i] = (up, docs + 1 - p[i], 1.0) if abs(up) < abs(down) else (down, docs - p[i], 0.0)
    rest = open_[-3:]
    if rest:
        moves = [(tokens + sum((x - p[i]) * sizes[i] for x, i in zip(t, rest)), docs + sum(x - p[i] for x, i in zip(t, rest)), t) for t in itertools.product((0.0, 1.0), repeat=len(rest))]
        # Exchanges mend tokens but not the number of documents, so that comes first where they are possible.
        tokens, docs, best = min(moves, key=lambda m: (abs(m[1]) >= 1 if before else False, abs(m[0]), abs(m[1])))
        for x, i in zip(best, rest):
            p[i] = x
    if not before:
        return p
    loose = [i for i, x in enumerate(before) if EPS < x < 1 - EPS]
    while abs(tokens) >= 0.5:
        drawn, others = [i for i in loose if p[i] == 1], sorted((i for i in loose if p[i] == 0), key=lambda i: sizes[i])
        if not drawn or not others:
            break
        have, size = np.array([sizes[i] for i in drawn]), np.array([sizes[i] for i in others])
        up = np.clip(np.searchsorted(size, have - tokens), 0, len(size) - 1)
        down = np.maximum(up - 1, 0)
        pick = np.where(np.abs(size[down] - have + tokens) <= np.abs(size[up] - have + tokens), down, up)
        left = tokens + size[pick] - have
        k = int(np.abs(left).argmin())
        if abs(left[k]) >= abs(tokens):
            break
        tokens, p[drawn[k]], p[others[int(pick[k])]] = float(left[k]), 0.0, 1.0
    return p


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, n_docs, n_tokens, use)`` of each target source.

    ``use`` is how often each of its documents is to be used on average. The mixture is the largest
    at which no source needs more than ``max_repeats`` uses; the shares of sources without tokens
    can't be met and are left out of it, in proportion. Source spellings are unified.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("source <> ''")
    t = t.groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    s = t.join(sizes, "source", "left").fillna({"n_docs": 0, "n_tokens": 0})
    room = F.when((F.col("n_tokens") > 0) & (F.col("target_share") > 0), F.col("n_tokens") * F.col("max_repeats") / F.col("target_share"))
    total = s.agg(F.min(room).alias("total"))  # one row
    use = F.when((F.col("n_tokens") > 0) & (F.col("target_share") > 0), F.least(F.col("target_share") * F.col("total") / F.col("n_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return s.crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", "n_docs", "n_tokens", F.coalesce(use, F.lit(0.0)).alias("use"))


def sized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)``, each id once; documents without tokens or source are left out."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", source_key(F.col("source")).alias("source"), "text")
    rows = with_token_counts(rows.repartition(tasks(docs.sparkSession), "doc_id"), tokenizer=tokenizer).select("doc_id", "source", "n_tokens")
    return rows.where("n_tokens > 0 and source <> ''").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("r")).select("doc_id", "r.source", "r.n_tokens")


def _draws(key: str, n: int) -> list[float]:
    import random

    r = random.Random(key)  # the same for a repeated task
    return [r.random() for _ in range(n)]


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0) -> DataFrame:
    """Documents of the mixture with their uses: ``(doc_id, source, n_tokens, uses)``, uses at least 1.

    Each source with documents gets its target share of all tokens (see ``plan`` for sources
    without), no document more than its source's ``max_repeats`` uses. Documents whose source has
    no target, and null and empty texts, are left out. The draw depends on ids, sizes and ``seed``
    only. Empty tables give an empty mixture.
    """
    spark = docs.sparkSession
    size = kept(sized(docs, tokenizer))
    per = size.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    goal = plan(per, targets)
    rows = size.join(F.broadcast(goal.select("source", "use", F.col("n_docs"))), "source")  # one row a source with a target
    rows = rows.withColumn("whole", F.floor(F.col("use") + EPS)).withColumn("p", F.greatest(F.col("use") - F.col("whole"), F.lit(0.0))).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    rows = rows.withColumn("p", F.when(F.col("p") < EPS, 0.0).otherwise(F.col("p")))
    settled = rows.where("p = 0").select("doc_id", "source", "n_tokens", F.col("whole").cast("int").alias("uses"))
    open_ = rows.where("p > 0").select("doc_id", "source", "n_tokens", "whole", "p", "h", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK)).cast("bigint").alias("blocks"))
    schema = "doc_id bigint, source string, n_tokens int, whole bigint, p double, h bigint, blocks bigint, final boolean"

    def fly(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["h", "doc_id"])
        last = int(g["blocks"].iloc[0]) == 1
        sizes, probs = g["n_tokens"].astype(float).tolist(), g["p"].tolist()
        draws = _draws(f"{seed} {g['source'].iloc[0]} {g['h'].iloc[0]}", len(g))
        fly_now = len(g) if last else len(g) - min(len(g), BLOCK // RESERVE)
        p = flight(sizes[:fly_now], probs[:fly_now], draws) + probs[fly_now:]
        if last:
            p = landing(sizes, p, draws, probs)
        g = g.assign(p=p)
        g["final"] = (g["p"] < EPS) | (g["p"] > 1 - EPS)
        # Two documents of each block and the reserve go on; so many blocks are needed for those.
        g["blocks"] = max(1, -(-int(g["blocks"].iloc[0]) * (BLOCK // RESERVE + 3) // BLOCK))
        return g

    done = []
    most = goal.agg(F.max("n_docs")).head()[0] or 0
    rounds, n = 1, -(-most // BLOCK)
    while n > 1:
        n, rounds = max(1, -(-n * (BLOCK // RESERVE + 3) // BLOCK)), rounds + 1
    for _ in range(rounds):
        out = kept(open_.withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks"))).groupBy("source", "block").applyInPandas(lambda g: fly(g.drop(columns="block")), schema))
        done.append(out.where("final"))
        open_ = out.where("not final").drop("final")
    drawn = done[0]
    for d in done[1:]:
        drawn = drawn.unionByName(d)
    drawn = drawn.select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("p")).cast("int").alias("uses"))
    return settled.unionByName(drawn).where("uses > 0")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, n_docs, n_uses, n_tokens, reached_share, most_uses)`` of each target source."""
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source <> ''").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    m = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("uses").alias("n_uses"), F.sum(F.col("uses").cast("bigint") * F.col("n_tokens")).alias("n_tokens"), F.max("uses").alias("most_uses"))
    total = m.agg(F.sum("n_tokens").alias("total"))
    return (
        t.join(m, "source", "left")
        .crossJoin(F.broadcast(total))
        .select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_uses", "n_tokens", "most_uses")], F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"))
    )
