"""Oversized texts cut into overlapping pieces at natural boundaries.

Dynamic programming over the boundary positions of a text finds the cuts with the least sum of cut
penalties and size imbalance such that no piece, with its overlap, is longer than the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import spread

LIMIT, OVERLAP = 512, 64
#: What a cut costs, by the kind of boundary it falls on; a piece itself costs 1.
PENALTY = {"paragraph": 0.0, "line": 0.15, "sentence": 0.3, "clause": 0.8, "word": 1.5, "none": 6.0}
_KINDS = [
    ("word", re.compile(r"\s+|(?<=[-/|　-〿一-鿿])")),
    ("clause", re.compile(r"(?<=[,;:，；：、])\s*")),
    ("sentence", re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])")),
    ("line", re.compile(r"\r\n|\r|\n| ")),
    ("paragraph", re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*| ")),
]
_EDGE = "[ \\t\\r\\n]"


def boundaries(text: str, gap: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, with their penalties; stretches without any get one each ``gap`` characters."""
    n = len(text)
    cost = np.full(n + 1, np.inf)
    for kind, pattern in _KINDS:  # from dear to cheap, so that the cheapest kind of a position stays
        ends = [m.end() for m in pattern.finditer(text)]
        cost[ends] = PENALTY[kind]
    cost[0] = cost[n] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    for i in np.flatnonzero(np.diff(at) > gap + 1):
        for k in range(int(at[i]) + gap, int(at[i + 1]) - 1, gap):
            while k < at[i + 1] and unicodedata.combining(text[k]):
                k += 1
            if k < at[i + 1]:
                cost[k] = PENALTY["none"]
    pos = np.flatnonzero(np.isfinite(cost))
    return pos, cost[pos]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``[start, end)`` of each piece of a text; one piece if the text keeps the limit."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    pos, cost = boundaries(text, max(1, min(100, (limit - overlap) // 2)))
    n = len(pos)
    natural = pos[cost < PENALTY["none"]]
    # Where the piece after a cut begins: the first natural boundary within the overlap, else the overlap itself.
    first = natural[np.minimum(np.searchsorted(natural, pos - overlap), len(natural) - 1)]
    start = np.where((first < pos) & (first >= pos - overlap), first, pos - overlap)
    start[0] = 0
    start = np.maximum.accumulate(np.maximum(start, 0))
    # best[i] + (1 - (pos[j] - start[i]) / limit)^2, with the part that i gives taken out: one product and one sum for each j.
    lines, slope = np.full(n, np.inf), start / limit
    lines[0] = slope[0] * slope[0]
    back = np.zeros(n, dtype=np.int64)
    low, steps, price = np.searchsorted(start, pos - limit).tolist(), (1 - pos / limit).tolist(), (1 + cost).tolist()
    for j in range(1, n):
        a = low[j]
        if a >= j:
            continue
        total = lines[a:j] + (2 * steps[j]) * slope[a:j]
        k = int(total.argmin())
        best = total[k] + steps[j] * steps[j] + price[j]
        lines[j], back[j] = best + slope[j] * slope[j], a + k
    ends, j = [], n - 1
    while j > 0:
        ends.append(j)
        j = int(back[j])
    ends.reverse()
    return [(int(start[i]), int(pos[j])) for i, j in zip([0, *ends], ends)]


def oversized(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(item_kind, item_id, text)`` of items whose text, without outer blanks, is longer than the limit.

    Each id comes once however often its row is repeated (the longest text, should they differ);
    null ids, null, empty and blank texts are left out.
    """
    t = F.regexp_replace("text", f"^{_EDGE}+|{_EDGE}+$", "")
    long = items.where(F.col("item_id").isNotNull()).withColumn("text", t).where(F.length("text") > limit)
    return long.groupBy("item_kind", "item_id").agg(F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"))


def split(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of oversized items: ``(item_kind, item_id, chunk_index, n_chunks, start_pos, end_pos, text)``.

    Positions count code points of the text without outer blanks. Every piece has at most ``limit``
    code points; each after the first begins with the last ``overlap`` of the one before, or with
    fewer, from the nearest boundary. An item within the limit gives no rows.
    """
    rows = spread(oversized(items, limit), "item_kind", "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, key, text in zip(b["item_kind"], b["item_id"], b["text"]):
                found = cuts(text, limit, overlap)
                out += [(kind, key, i, len(found), a, e, text[a:e]) for i, (a, e) in enumerate(found)]
            yield pd.DataFrame(out, columns=["item_kind", "item_id", "chunk_index", "n_chunks", "start_pos", "end_pos", "text"])

    return rows.mapInPandas(run, "item_kind string, item_id string, chunk_index int, n_chunks int, start_pos int, end_pos int, text string")


def project_items(corpus_docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The project's items: corpus documents and stored chunks."""
    return corpus_docs.select(F.lit("corpus_doc").alias("item_kind"), F.col("doc_id").alias("item_id"), "text").unionByName(chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text"))
