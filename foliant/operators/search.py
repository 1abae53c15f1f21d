"""Lexical, vector and hybrid retrieval and its metrics."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import normalize_text
from foliant.tables import arrow_map

#: Share of the question's tokens that a text must hold, and likeness from which a token counts as held.
SHARE, LIKE = 0.6, 0.84


def exact_score(text: Column, tokens: list[str]) -> Column:
    """0.6 coverage + 0.2 phrase + 0.1 order + 0.1 compactness over a text in normalize_text() form, tokens taken as they are."""
    n = len(tokens)

    def score(words: Column) -> Column:
        at = F.filter(F.array(*[F.nullif(F.array_position(words, F.lit(t)), F.lit(0)) for t in tokens]), lambda x: x.isNotNull())
        found = F.size(at)
        phrase = F.contains(F.array_join(words, " "), F.lit(" ".join(tokens))).cast("double")
        order = F.when(found < 2, 0.0).when(at == F.array_sort(at), 1.0).otherwise(0.35)
        span = F.array_max(at) - F.array_min(at) + 1
        tight = F.when(found < 2, 0.0).otherwise(1 - F.least(span, F.lit(40)) / 40)
        return F.when(found >= math.ceil(SHARE * n), F.round(0.6 * found / n + 0.2 * phrase + 0.1 * order + 0.1 * tight, 4)).otherwise(0.0)

    # the words are bound once, as the element of an array of one
    return F.transform(F.array(F.split(F.coalesce(text, F.lit("")), " ")), score)[0]


@lru_cache(maxsize=200_000)
def likeness(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; 0 for lengths more than two apart."""
    if a == b:
        return 1.0
    if abs(len(a) - len(b)) > 2 or not set(a) & set(b):
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


def fuzzy_score(tokens: list[str], words: list[str]) -> float:
    """exact_score with tokens that are alike in place of equal ones."""
    best = []
    for t in tokens:
        top, where = 0.0, -1
        for i, w in enumerate(words):
            s = likeness(t, w)
            if s > top:
                top, where = s, i
                if s >= 0.999:
                    break
        if top >= LIKE:
            best.append((top, where))
    if len(best) < math.ceil(SHARE * len(tokens)):
        return 0.0
    at = [w for _, w in best]
    order = 0.0 if len(at) < 2 else 1.0 if at == sorted(at) else 0.35
    tight = 0.0 if len(at) < 2 else 1 - min(max(at) - min(at) + 1, 40) / 40
    phrase = float(" ".join(tokens) in " ".join(words))
    return round(0.6 * sum(s for s, _ in best) / len(tokens) + 0.2 * phrase + 0.1 * order + 0.1 * tight, 4)


def fuzzy_search(texts: DataFrame, ident: str, text: str, question: str, n: int = 50) -> DataFrame:
    """(ident, score): the n texts most like `question`; null and empty texts score 0 and are left out."""
    tokens = question.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fuzzy_score(tokens, t.split()) for t in b.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    rows = texts.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), normalize_text(F.col(text)).alias("t"))
    hits = arrow_map(rows, run, f"id {dict(texts.dtypes)[ident]}, score double").where("score > 0")
    return hits.orderBy(F.desc("score"), "id").limit(n).withColumnRenamed("id", ident)


def vector_search(vectors: DataFrame, queries: DataFrame, ident: str, vector: str, k: int = 10, block: int = 2048) -> DataFrame:
    """(query, neighbour, score, rank): the k vectors nearest to each query by cosine, exact, the query itself left out.

    Vectors and queries are parted into blocks of about `block` rows by a hash of their ids; each pair of blocks is one
    matrix product whose k best per query go on, so no pair of rows is ever a row of Spark's. Null vectors and
    those of length 0 have no neighbours.
    """
    counts = vectors.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    nv, nq = (max(1, math.ceil(c / block)) for c in counts)
    part = lambda df, n, name: df.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(ident), F.lit(n)).cast("int").alias(name))
    a = part(vectors, nv, "bv").withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    b = part(queries, nq, "bq").withColumn("bv", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))

    def near(x, y):  # noqa: ANN001, ANN202
        import pandas as pd  # here, as it takes 46 MB of a driver that may not need it

        empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if x.empty or y.empty:
            return empty
        mx, my = np.array(x.v.tolist(), dtype=np.float64), np.array(y.v.tolist(), dtype=np.float64)
        lx, ly = np.linalg.norm(mx, axis=1), np.linalg.norm(my, axis=1)
        s = np.round((my @ mx.T) / np.maximum(np.outer(ly, lx), 1e-300), 6)
        s[np.outer(ly, lx) == 0] = -2
        ids, out = x.id.to_numpy(), []
        for row, q in zip(s, y.id):
            best = np.lexsort((ids, -row))[: k + 1]
            out += [(q, ids[j], row[j]) for j in best if ids[j] != q and row[j] > -2]
        return pd.DataFrame(out, columns=["query", "neighbour", "score"]) if out else empty

    found = a.groupBy("bv", "bq").cogroup(b.groupBy("bv", "bq")).applyInPandas(near, "query bigint, neighbour bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def fused(a: Column, b: Column) -> Column:
    """One score of two, the better one helped by the other."""
    x, y = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    both = F.least(F.lit(1.0), F.greatest(x, y) + 0.12 * F.least(x, y) + 0.05)
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.greatest(x, y))


def ranking_metrics(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query, hit, recall, rr, ndcg) at k. results: (query, doc, rank); relevant: (query, doc); queries without results score 0."""
    rel = relevant.select("query", "doc").distinct()
    n = rel.groupBy("query").agg(F.count("*").alias("n"))
    got = results.where(F.col("rank") <= k).join(rel, ["query", "doc"], "left_semi")
    m = got.groupBy("query").agg(F.count_distinct("doc").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    r = n.join(m, "query", "left")
    return r.select(
        "query", F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"), F.round(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
    )
