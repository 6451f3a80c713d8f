"""Lexical and dense ranking over a corpus, and their fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velarium.functions import text

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, term, tf, len)``: term counts of each text; tokens are runs of letters and digits in lower case."""
    t = docs.select(F.col(id_col).alias("doc"), text.words(F.col(text_col)).alias("a"))
    return t.select("doc", F.size("a").alias("len"), F.explode("a").alias("term")).groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(query_id, doc, score, rank)``: the best ``k`` documents for each query by BM25 (any term may match).

    Idf is ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Only terms that occur in queries reach the
    scoring join; document frequencies and lengths come from all documents.
    """
    p = postings(docs, id_col, text_col)
    q = queries.select("query_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(text.words(F.col(text_col)))).alias("mean_len"))  # one row
    hit = p.join(q.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(1e-6), F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    w = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    weights = hit.join(df, "term").crossJoin(F.broadcast(stats)).select("doc", "term", w.alias("w"))
    s = q.join(weights, "term").groupBy("query_id", "doc").agg(F.sum("w").alias("score"))
    return _best(s, k)


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query; Spark keeps only k rows a query and task before the shuffle."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return scores.withColumn("rank", r).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, rows: int = 16_384, asks: int = 2_048) -> DataFrame:
    """``(q, vec_id, rank, score)``: nearest vectors of each query by cosine, exactly; a query isn't its own neighbour.

    A stated query set against all rows, in blocks: each task multiplies about ``rows`` vectors with
    about ``asks`` queries as matrices and keeps ``k`` for each query, so what is joined are blocks and
    what is ranked are the few best of each. Null vectors are left out; a zero vector has cosine 0.
    """
    size = lambda df, n: max(1, -(-df.where("embedding is not null").count() // n))
    n_rows, n_asks = size(vectors, rows), size(queries, asks)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = ("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = vectors.where("embedding is not null").select(*own, block(n_rows).cast("int").alias("b"), every(n_asks).alias("c"))
    q = queries.where("embedding is not null").select(*own, block(n_asks).cast("int").alias("c"), every(n_rows).alias("b"))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def unit(x: pd.Series) -> np.ndarray:
        m = np.stack(x.to_numpy())
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "vec_id": [], "score": []})
        left = left.sort_values("vec_id")
        ids, asked, score = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), unit(right["v"]) @ unit(left["v"]).T
        score[asked[:, None] == ids[None, :]] = -np.inf
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"q": np.repeat(asked, top.shape[1]), "vec_id": ids[top.ravel()], "score": np.take_along_axis(score, top, axis=1).ravel()})
        return out[out["score"] > -np.inf]

    s = v.groupBy("b", "c").cogroup(q.groupBy("b", "c")).applyInPandas(best, f"q {kind}, vec_id {kind}, score double")
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return s.withColumn("rank", r).where(F.col("rank") <= k).select("q", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 5).alias("score"))


def fuse(*ranked: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ``(query_id, doc, rank)`` lists; of equal scores the earlier list's best rank goes first."""
    parts = [r.select("query_id", "doc", "rank", F.lit(i).alias("list")) for i, r in enumerate(ranked)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    s = every.groupBy("query_id", "doc").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first", "doc"))
    return s.withColumn("rank", r).where(F.col("rank") <= k).select("query_id", "doc", F.col("rank").cast("bigint").alias("rank"), F.round("score", 9).alias("score"))
