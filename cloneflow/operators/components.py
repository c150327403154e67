"""Connected components by alternating stars, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneflow.operators.joins import join_unique
from cloneflow.session import discard, materialize

MAX_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """`node, root` for every node of the links `a, b`: the root is the least node that a chain of links reaches.

    Every round hangs a node's larger neighbours on its least one, then its smaller ones, which keeps what is connected; at the
    end each component is a star. Joins split hot nodes, least neighbours are found with partial aggregation.
    """
    nodes = materialize(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    now = materialize(_ordered(links.select("a", "b")), "stars")
    known = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        known = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        larger = join_unique(both, least, ["a"], ["b"]).where(F.col("b") > F.col("a"))
        hung = materialize(_ordered(larger.select(F.col("b").alias("a"), F.col("least").alias("b"))), "stars")
        lower = hung.groupBy("a").agg(F.min("b").alias("least"))
        smaller = join_unique(hung, lower, ["a"], ["b"])
        done = materialize(_ordered(smaller.select("b", "least").union(smaller.select("a", "least")).toDF("a", "b")), "stars")
        discard(now)
        discard(hung)
        now = done
    raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller, without loops."""
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
