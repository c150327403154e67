"""Exact top-k search by inner product: the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into shards and queries into blocks, both of bounded size and by hash, so no vector value can make a
large group. Inside a task, every dimension of a shard is a list sorted by value. A query reads all its lists in parallel,
from the end that its sign prefers, scores what it has not seen, and stops when even a row with the last value read
in each list could not reach its kth score. A first pass over one shard gives every query a floor, which lets the other
shards stop early and send back only what can still be in the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloneflow.session import materialize

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
FIRST_DEPTH = 32
EXACT_FLOAT, LARGEST = 2**53, 2**63 - 1
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, scale: float = 64.0) -> DataFrame:
    """`vec_id, vec`: floor(scale * x) of each component. Rows with a null id, vector or component, or one that is not
    finite, take no part. A vec_id with several vectors keeps the least of them."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    fine &= F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    vectors = rows.where(fine).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("vec"))
    return vectors.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _matrix(vectors: pd.Series, dim: int, kind: type) -> np.ndarray:
    made = np.zeros((len(vectors), dim), dtype=kind)
    for i, v in enumerate(vectors):
        made[i, : len(v)] = v
    return made


def _tables(queries: pd.Series, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Both as matrices of the narrowest type in which inner products are exact. Missing components are 0."""
    dim = max([1, *map(len, queries), *map(len, vectors)])
    most = lambda s: max([0, *(max(abs(int(min(v))), abs(int(max(v)))) for v in s if len(v))])
    bound = most(queries) * most(vectors) * dim
    kind = np.float64 if bound < EXACT_FLOAT else np.int64 if bound <= LARGEST else object
    return _matrix(queries, dim, kind), _matrix(vectors, dim, kind)


def threshold_top(q: np.ndarray, own: int, vectors: np.ndarray, ids: np.ndarray, order: np.ndarray, k: int, floor) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best rows for `q` (ties to the smaller id), of those that reach `floor`.

    `order[:, d]` sorts the rows by dimension d. `own` is the query's id, which takes no part.
    """
    n, used = len(ids), np.flatnonzero(q)
    up, down = used[q[used] > 0], used[q[used] < 0]
    seen = ids == own
    left = n - int(seen.sum())
    rows, scores = np.empty(0, np.int64), np.empty(0, vectors.dtype)
    read, depth = 0, FIRST_DEPTH if len(used) else n
    while left:
        upto = min(n, read + depth)
        fresh = np.zeros(n, bool)
        if len(used):
            fresh[order[n - upto : n - read, up].ravel()] = True
            fresh[order[read:upto, down].ravel()] = True
            fresh &= ~seen
        else:
            fresh = ~seen
        new = np.flatnonzero(fresh)
        seen |= fresh
        left -= len(new)
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, vectors[new] @ q])
        if floor is not None:
            rows, scores = rows[scores >= floor], scores[scores >= floor]
        if len(rows) > k:
            best = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
        # The best score that a row not seen yet can have. At a tie it might still win by its id.
        bound = vectors[order[n - upto, up], up] @ q[up] + vectors[order[upto - 1, down], down] @ q[down]
        reached = [x for x in (floor, scores.min() if len(rows) == k else None) if x is not None]
        if reached and bound < max(reached):
            break
        read, depth = upto, depth * 2
    return rows, scores


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, x = _tables(queries["query"], vectors.vec)
        ids, order = vectors.vec_id.to_numpy(np.int64), np.argsort(x, axis=0, kind="stable")
        found = []
        for own, vec, floor in zip(queries.query_id, q, queries.floor, strict=True):
            rows, scores = threshold_top(vec, own, x, ids, order, k, None if pd.isna(floor) else int(floor))
            capped = [max(-LARGEST - 1, min(LARGEST, int(s))) for s in scores]
            found.append(pd.DataFrame({"query_id": np.full(len(rows), own, np.int64), "vec_id": ids[rows], "score": np.array(capped, np.int64)}))
        return pd.concat(found)

    return run


def _meet(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Every query of a block against every row of a shard, for each (block, shard) that both sides have."""
    left, right = queries.groupBy("block", "shard"), vectors.groupBy("block", "shard")
    return left.cogroup(right).applyInPandas(_search(k), FOUND)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k rows with the highest inner product for each row that `is_query` holds for.

    `vectors` is `vec_id, vec` (whole numbers, unique ids). The query's own row takes no part; fewer than k rows give fewer. Scores
    beyond 64 bits are held at the largest value. No vectors or no queries: no rows.
    """
    stored = materialize(vectors, "vectors")
    rows, asked = stored.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-asked // block_queries))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Names of their own: both sides come from the same table.
    queries = stored.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), block.alias("block"))
    dealt = stored.select("vec_id", "vec", shard.alias("shard")).withColumn("block", every(blocks))
    no_floor = queries.withColumns({"floor": F.lit(None).cast("bigint"), "shard": F.lit(0)})
    first = materialize(_meet(no_floor, dealt.where(F.col("shard") == 0), k), "first_shard")
    if shards > 1:
        floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        rest = queries.join(floors, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))
        first = first.unionByName(_meet(rest, dealt.where(F.col("shard") > 0), k))
    # At most k rows per query and shard, and from the second shard on only those that reach the floor.
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
