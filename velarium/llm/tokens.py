"""Encoding of whole corpora with a public tokenizer, and token counts.

A text is split by the tokenizer's pattern and each part is encoded by itself, so two encodings of
neighbouring pieces can be joined exactly. Long texts become pieces that are encoded in parallel,
then joined pairwise up a tree: text around the join is split again in a growing window until a
split of the window falls on a split of the right piece. The pattern only looks ahead, so from a
common split on both agree to the end; that makes the join exact, not likely.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import spread

#: Where the vocabulary lies unless a path is given.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the byte-level vocabularies. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points above which a text is cut into pieces of that size.
PIECE = 200_000
#: A split is sure only if this many code points follow it; the pattern looks ahead one.
MARGIN = 2
#: Before white space that follows something else there is always a split.
_PARTED = re.compile(r"\S(?=[ \t\n])")


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file; kept in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def _ends(text: str) -> list[int]:
    return [m.end() for m in _pattern().finditer(text)]


def _parts(enc, text: str, end: int) -> list[int]:
    """Ids of the splits of ``text`` up to ``end``; each by itself, as a split depends on what follows."""
    return [i for m in _pattern().finditer(text) if m.end() <= end for i in enc.encode_ordinary(m.group())]


def _last_start(text: str, window: int = 256) -> int:
    """The last position of a text, but for its end, where every split pattern of this kind parts it; 0 if there is none.

    White space only begins a split, so text is always parted before white space that follows
    something else. Only the end of the text is read, in windows that double.
    """
    end = len(text) - MARGIN
    while True:
        a = max(0, end - window)
        found = [m.start() + 1 for m in _PARTED.finditer(text, a, max(end, 0) + 1)]
        if found:
            return found[-1]
        if a == 0:
            return 0
        window *= 2


def join_encoded(path: str, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
    """Ids of ``left + right`` from the ids of both, encoding only a window around the join again."""
    if not left or not right:
        return [*left_ids, *right_ids]
    tail_ids, own, skipped = _join(path, left, right)
    return [*left_ids[: len(left_ids) - tail_ids], *own, *right_ids[skipped:]]


def _join(path: str, left: str, right: str) -> tuple[int, list[int], int]:
    """How many ids the left text loses at its end, the ids that come there, and how many the right one loses at its start."""
    enc = encoding(path)
    tail, size = left[_last_start(left) :], 64
    while True:
        head = right[:size]
        sure = len(head) if len(head) == len(right) else len(head) - MARGIN
        own = {e for e in _ends(head) if e <= sure}
        cut = next((e for x in _ends(tail + head) if (e := x - len(tail)) in own), 0)
        if cut:
            return len(enc.encode_ordinary(tail)), _parts(enc, tail + head, len(tail) + cut), len(_parts(enc, head, cut))
        size *= 2


def encode_tree(path: str, text: str, piece: int = PIECE) -> list[int]:
    """Ids of a text by encoding halves and joining them; equal to encoding it whole."""
    if len(text) <= piece:
        return encoding(path).encode_ordinary(text)
    half = len(text) // 2
    return join_encoded(path, text[:half], encode_tree(path, text[:half], piece), text[half:], encode_tree(path, text[half:], piece))


def _join_all(path: str, parts: list[tuple[str, list[int]]]) -> list[int]:
    while len(parts) > 1:
        paired = [(a[0] + b[0], join_encoded(path, a[0], a[1], b[0], b[1])) for a, b in zip(parts[::2], parts[1::2])]
        parts = paired + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0][1] if parts else []


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, piece: int = PIECE) -> DataFrame:
    """``(id, ids array<int>)`` for every row of ``docs``.

    Null and empty texts have an empty list; a text of white space has the ids of that white space.
    Repeated ids give repeated rows, null ids are kept, other columns are ignored. Texts of more than
    ``piece`` code points are cut into pieces that separate tasks encode, then joined per row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    short = spread(rows.where(F.length("_text") <= piece), "_id", "_text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "ids": [enc.encode_ordinary(t) for t in b["_text"]]})

    whole = short.mapInPandas(encode, f"_id {id_type}, ids array<int>")
    pieces = (
        rows.where(F.length("_text") > piece)
        .withColumn("_row", F.xxhash64("_id", "_text", F.monotonically_increasing_id()))
        .withColumn("_n", F.expr(f"cast(ceil(length(_text) / {piece}) as int)"))
        .select("_id", "_row", F.explode(F.expr("sequence(0, _n - 1)")).alias("_k"), "_text")
        .select("_id", "_row", "_k", F.expr(f"substring(_text, _k * {piece} + 1, {piece})").alias("_text"))
    )
    pieces = spread(pieces, "_row", "_k")

    def encode_piece(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield b.assign(ids=[enc.encode_ordinary(t) for t in b["_text"]])

    def join_row(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("_k")
        return pd.DataFrame({"_id": [g["_id"].iloc[0]], "ids": [_join_all(tokenizer, [(t, list(i)) for t, i in zip(g["_text"], g["ids"])])]})

    long = pieces.mapInPandas(encode_piece, f"_id {id_type}, _row bigint, _k int, _text string, ids array<int>").groupBy("_row").applyInPandas(join_row, f"_id {id_type}, ids array<int>")
    return whole.unionByName(long).withColumnRenamed("_id", id_col)


def with_token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text; null texts have 0."""

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(tokenizer)
        for s in texts:
            yield s.map(lambda t: len(encode_tree(tokenizer, t)) if t else 0).astype("int32")

    return docs.withColumn(out, count(F.col(text_col)))
