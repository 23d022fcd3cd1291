"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of queries and of a block of candidates, which bound what a task holds and how often a row is copied
#: for it; and how many of the queries are scored at once: the dense array of scores has that many rows.
QUERY_BLOCK, CANDIDATE_BLOCK, AT_ONCE = 8192, 4096, 512
OUT = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Terms by rows; components that a shorter vector doesn't have are 0."""
    out = np.zeros((width, len(vectors)), np.int64)
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def best_of_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of this block for each query of this block, some queries at once."""
    parts = [_best(queries[i : i + AT_ONCE], candidates, k) for i in range(0, len(queries), AT_ONCE)]
    return pd.concat(parts) if parts else _best(queries, candidates, k)


def _best(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of this block for each query of this block.

    Each term in turn adds, for the queries that have it, their weight times the term's postings to dense arrays of
    scores. A term in most candidates is added as a whole column, a rarer one is scattered to the candidates that
    have it. The k best are then picked by partition, not by a full sort: score and place, in one number, make ties
    go to the smaller id.
    """
    if queries.empty or candidates.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    candidates = candidates.sort_values("vec_id", kind="stable")
    width = max(map(len, [*queries.vector, *candidates.vector]))
    weights, postings = _matrix(queries.vector, width), _matrix(candidates.vector, width)
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for weight, posting in zip(weights, postings):
        asking, having = np.flatnonzero(weight), np.flatnonzero(posting)
        if len(having) * 2 > len(posting):
            if len(asking) * 2 > len(weight):
                scores += weight[:, None] * posting
            else:
                scores[asking] += weight[asking, None] * posting
        elif len(having) and len(asking):
            scores[np.ix_(asking, having)] += weight[asking, None] * posting[having]
    ids = candidates.vec_id.to_numpy()
    places = np.arange(len(ids))
    least = int(np.abs(scores).max())
    own = queries.query_id.to_numpy()[:, None] == ids[None, :]
    n = len(ids)
    if least < (1 << 62) // (n + 1):
        order = scores * n + (n - 1 - places)
        order[own] = np.iinfo(np.int64).min
        take = min(k, n)
        picked = np.argpartition(order, n - take, axis=1)[:, n - take :]
    else:
        picked = np.stack([np.lexsort((places, -s.astype(object), o))[:k] for s, o in zip(scores, own)])
    rows = np.arange(len(queries))[:, None]
    keep = ~own[rows, picked]
    out = {"query_id": np.broadcast_to(queries.query_id.to_numpy()[:, None], picked.shape)[keep], "vec_id": ids[picked][keep], "score": scores[rows, picked][keep]}
    return pd.DataFrame(out)


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates with the highest inner products, for every query.

    queries: query_id, vector (array of long, sparse as zeros); candidates: vec_id, vector. A candidate with the
    query's own id is left out; ties go to the smaller id. Every query is scored against every candidate, in blocks
    of bounded size: a task has one block of each, and what blocks find is merged by rank. Nothing is sampled.
    Repeated rows of a vec_id are candidates of their own; of those of a query_id each is searched for.

    Null ids or vectors take no part; with fewer candidates than k all are returned; scores beyond 64 bits wrap.
    """
    queries = queries.where("query_id is not null and vector is not null")
    candidates = candidates.where("vec_id is not null and vector is not null")
    n_q = max(1, -(-queries.count() // query_block))
    n_c = max(1, -(-candidates.count() // candidate_block))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "vector", deal("query_id", n_q).alias("q"), every(n_c).alias("c"))
    right = candidates.select("vec_id", "vector", deal("vec_id", n_c).alias("c"), every(n_q).alias("q"))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(lambda a, b: best_of_block(a, b, k), OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
