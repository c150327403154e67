import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneflow.llm import topk


def brute(vectors, k, divisor):
    rows = []
    for q, x in vectors.items():
        if q % divisor == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in vectors.items() if i != q)
            rows += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(rows)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("vec", F.lit("mine"))


@pytest.mark.parametrize("shard,block", [(8192, 4096), (40, 7), (3, 1)])
def test_against_brute_force(spark, shard, block):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], 0) for i in range(130)]
    rows += [(200 + i, rows[3][1], 1) for i in range(30)] + [(300 + i, [0.0] * 6, 1) for i in range(25)] + [(-20, [1.0, -1.0, 0.5], 2), (-40, [], 2)]
    rows += [rows[4], (5, [9.0] * 6, 0)]
    odd = [(1000, None, 0), (1001, [None] * 6, 0), (1002, [math.nan] * 6, 0), (1003, [1.0, math.inf, 0.0], 0), (None, [1.0] * 6, 0)]
    vectors = {}
    for i, e, _ in rows:
        v = [math.floor(64 * x) for x in e]
        vectors[i] = min(vectors.get(i, v), v)
    got = topk.top_k(topk.integer_vectors(table(spark, rows + odd)), F.col("vec_id") % 20 == 0, 20, shard, block)
    assert sorted(map(tuple, got.collect())) == brute(vectors, 20, 20)


def test_few_or_no_rows(spark):
    search = lambda rows: sorted(map(tuple, topk.top_k(topk.integer_vectors(table(spark, rows)), F.col("vec_id") % 20 == 0, 20).collect()))
    assert search([]) == [] and search([(20, [1.0], 0)]) == [] and search([(1, [1.0], 0), (2, [1.0], 0)]) == []
    assert search([(20, [1.0], 0), (40, [0.5], 0)]) == [(20, 1, 40, 2048), (40, 1, 20, 2048)]


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(2**40 + i), -float(2**30 * i)], 0) for i in range(8)] + [(20, [float(2**50), 3.0], 0)]
    vectors = {i: [math.floor(64 * x) for x in e] for i, e, _ in rows}
    got = topk.top_k(topk.integer_vectors(table(spark, rows)), F.col("vec_id") % 20 == 0, 20)
    cap = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert [(r.query_id, r.score) for r in got.orderBy("query_id", "rank").collect()] == [(q, cap(s)) for q, _, _, s in brute(vectors, 20, 20)]


def test_the_search_stops_early():
    """On lists that fall steeply, a small part of the rows is scored."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.exponential(1.0, (5000, 4)) ** 3).astype(float)
    order, ids = np.argsort(x, axis=0, kind="stable"), np.arange(5000)

    class Counting(np.ndarray):
        scored = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.ndim == 1:
                Counting.scored += len(key)
            return np.asarray(self)[key]

    q = np.array([1.0, 2.0, 0.0, 1.0])
    rows, scores = topk.threshold_top(q, -1, x.view(Counting), ids, order, 10, None)
    want = sorted(zip(-(x @ q), ids, strict=True))[:10]
    assert sorted((-s, i) for s, i in zip(scores, ids[rows], strict=True)) == want
    assert Counting.scored < 2000
