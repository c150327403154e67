"""Connected components by alternating stars, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneflow.operators.joins import join_unique
from cloneflow.session import materialize

MAX_ROUNDS = 200


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of the links `a, b` (in either direction, repeats and loops allowed).

    The large star links a node's larger neighbours to its least neighbour, the small star its smaller ones; both keep what is
    connected, and at the end every component is a star around its least node. A node with very many links is salted
    by the join, and its least neighbour is found with partial aggregation.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "stars")
    before = _state(now)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = join_unique(both, _least(both), ["u"], ["v"]).where(F.col("v") > F.col("u"))
        large = materialize(larger.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "stars")
        down = large.groupBy("u").agg(F.min("v").alias("least"))
        small = join_unique(large, down, ["u"], ["v"])
        hung = small.select("v", "least").union(small.select("u", "least")).toDF("u", "v").where(F.col("u") != F.col("v"))
        now = materialize(hung.distinct(), "stars")
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        if before[0]:
            raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
