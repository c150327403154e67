"""Near copies in a whole corpus by MinHash bands, with pairs inside a bucket only where it holds several classes.

Documents with equal sets of shingles are one from the start. Of the rest, each is linked, in every bucket of equal bands, to the bucket's
least document if their exact Jaccard similarity allows it; those whose link fails meet the least document among themselves next. After some such
rounds the pairs of a bucket that are still in different classes are compared, each with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneflow.functions import similarity as sim
from cloneflow.functions import text as tx
from cloneflow.operators.components import components
from cloneflow.operators.joins import fits, join_unique
from cloneflow.operators.measures import MINHASH_PRIME, MINHASH_SEEDS
from cloneflow.session import materialize, spread

SHINGLE, SIMILARITY, BAND, ROUNDS = 5, 0.8, 4, 3
# Documents of one bucket on either side that meet in one group on average.
BLOCK_ROWS = 4096


def shingle_sets(table: DataFrame, k: int = SHINGLE, text: str = "text") -> DataFrame:
    """`doc_id, grams`: the distinct hashes of each document's runs of k tokens, sorted. The hashes are 60 bits wide and portable."""
    grams = F.array_sort(F.array_distinct(tx.ordered_gram_hashes(tx.tokens(F.col(text)), k)))
    return table.select("doc_id", grams.alias("grams"))


def merge_equal(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`doc_id, first` for every document with grams, the least id of the same set, and the sets of these ids."""
    content = [F.xxhash64(F.lit(i), "grams").alias(f"content_{i}") for i in range(2)]
    named = materialize(sets.where(F.size("grams") > 0).select("doc_id", *content), "contents")
    key = ["content_0", "content_1"]
    firsts = materialize(named.groupBy(*key).agg(F.min("doc_id").alias("first")), "firsts")
    members = materialize(join_unique(named, firsts, key, ["doc_id"]).select("doc_id", "first"), "members")
    copies = materialize(members.where(F.col("doc_id") != F.col("first")).select("doc_id"), "copies")
    return members, sets.where(F.size("grams") > 0).join(F.broadcast(copies) if fits(copies) else copies, "doc_id", "left_anti")


def signatures(sets: DataFrame) -> DataFrame:
    """`doc_id, sig`: the minima of 64 permutations of each set's hashes, made inside the row; none for an empty set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sig in sim.minhash_arrays(MINHASH_SEEDS, MINHASH_PRIME)(iter([batch.column(1)])):
                yield pa.RecordBatch.from_arrays([batch.column(0), sig], names=["doc_id", "sig"])

    # No Python column: Spark makes none of an argument with lambdas inside, as sets that are not written yet have.
    kind = sets.schema["doc_id"].dataType.simpleString()
    return sets.where(F.size("grams") > 0).select("doc_id", "grams").mapInArrow(made, f"doc_id {kind}, sig array<bigint>")


def bands(sig: DataFrame, rows: int = BAND) -> DataFrame:
    """`doc_id, band, key`: the parts of each signature as one 128-bit key each."""
    parts = [
        F.struct(F.lit(i // rows).alias("band"), F.md5(F.array_join(F.slice("sig", i + 1, rows).cast("array<string>"), ",")).alias("key"))
        for i in range(0, len(MINHASH_SEEDS), rows)
    ]
    return sig.select("doc_id", F.inline(F.array(*parts)))


def scored_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """`pairs` (a, b) with their exact similarity."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("grams").alias(f"{c}_grams"))
    pairs = pairs.select(F.col("a").alias("one"), F.col("b").alias("other"))
    near = join_unique(join_unique(pairs, side("one"), ["one"], ["other"]), side("other"), ["other"], ["one"])
    kind = sets.schema["doc_id"].dataType.simpleString()
    return near.select("one", "other", "one_grams", "other_grams").mapInArrow(_jaccards, f"a {kind}, b {kind}, similarity double")


def _jaccards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The similarity of two sorted sets: what is equal to its neighbour in both together is shared."""
    for batch in batches:
        one, other = batch.columns[2:]
        scores = np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            both = np.concatenate([one[i].values.to_numpy(), other[i].values.to_numpy()])
            both.sort()
            shared = np.count_nonzero(both[1:] == both[:-1])
            scores[i] = shared / max(len(both) - shared, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["a", "b", "similarity"])


def minhash_links(sets: DataFrame, threshold: float = SIMILARITY, rows: int = BAND, rounds: int = ROUNDS) -> DataFrame:
    """`a, b, similarity`: verified links of documents that share a band, b the lesser, whose classes are those of all pairs in all buckets.

    In each bucket every document meets the least one, those whose link fails the least of themselves next, `rounds` times: one link per document and round makes one
    class of a large group of near copies. Where a bucket then holds several classes, every pair of different ones is compared.
    """
    every = materialize(bands(signatures(sets), rows), "bands")
    left, tried = every, None
    for _ in range(rounds):
        heads = left.groupBy("band", "key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
        met = materialize(join_unique(left, materialize(heads, "buckets"), ["band", "key"], ["doc_id"]).where(F.col("doc_id") != F.col("head")), "met")
        pairs = met.select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
        scored = materialize(scored_pairs(pairs, sets), "scored")
        tried = scored if tried is None else tried.unionByName(scored)
        missed = scored.where(F.col("similarity") < threshold).select(F.col("a").alias("doc_id"), F.col("b").alias("head"))
        if not missed.head(1):
            break
        left = materialize(met.join(missed, ["doc_id", "head"]).select("doc_id", "band", "key"), "bands")
    found = tried.where(F.col("similarity") >= threshold)
    rest = materialize(unmet_pairs(every, sets, found, tried, threshold), "unmet")
    more = scored_pairs(spread(rest, "a", "b"), sets).where(F.col("similarity") >= threshold)
    return found.unionByName(more).distinct()


def unmet_pairs(buckets: DataFrame, sets: DataFrame, found: DataFrame, tried: DataFrame, threshold: float, block: int = BLOCK_ROWS) -> DataFrame:
    """`a, b`, a the larger: the pairs of a bucket `doc_id, band, key` that no chain of the links `found` connects, not among `tried`, and whose sizes allow the threshold.

    A bucket is dealt into blocks of about `block` documents, of which every two meet in a group of their own.
    """
    roots = materialize(components(found.select("a", "b")).select(F.col("node").alias("doc_id"), "root"), "roots")
    facts = sets.select("doc_id", F.size("grams").alias("size")).distinct()
    facts = materialize(facts.join(roots, "doc_id", "left").select("doc_id", "size", F.coalesce("root", "doc_id").alias("root")), "rooted")
    placed = materialize(join_unique(buckets, facts, ["doc_id"], ["band", "key"]), "placed")
    classes = placed.groupBy("band", "key").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("cuts"))
    several = materialize(classes.where(F.col("one") != F.col("other")).select("band", "key", "cuts"), "open_buckets")
    dealt = materialize(join_unique(placed, several, ["band", "key"], ["doc_id"]), "open")
    own, every = F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    side = lambda c, this, that: dealt.select("band", "key", *[F.col(f).alias(f"{c}{g}") for f, g in (("doc_id", ""), ("size", "_size"), ("root", "_root"))], own.alias(this), every.alias(that))
    met = side("a", "x", "y").join(side("b", "y", "x"), ["band", "key", "x", "y"])
    # The smaller set over the larger one is the most that their similarity can be.
    least, most = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    near = met.where((F.col("a") > F.col("b")) & (F.col("a_root") != F.col("b_root")) & (least / most >= F.lit(threshold)))
    return near.select("a", "b").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")


def minhash_classes(table: DataFrame, k: int = SHINGLE, threshold: float = SIMILARITY, rows: int = BAND, rounds: int = ROUNDS) -> DataFrame:
    """`doc_id, class_id, n_links`: each document's class of near copies, named by its least id, and its number of verified links to others.

    Every document has a row. Equal sets are one document to the bands and count one link, to the least of them. Documents of fewer than `k` tokens
    have no shingles and are classes of their own.
    """
    sets = materialize(shingle_sets(table, k), "shingles")
    members, distinct = merge_equal(sets)
    links = materialize(minhash_links(distinct, threshold, rows, rounds), "links")
    roots = components(links.select("a", "b")).select(F.col("node").alias("first"), "root")
    degree = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    classed = join_unique(members, materialize(roots, "roots"), ["first"], ["doc_id"], "left").select("doc_id", "first", F.coalesce("root", "first").alias("class_id"))
    counted = classed.join(degree, "doc_id", "left")
    copy = F.when(F.col("doc_id") != F.col("first"), 1).otherwise(0)
    linked = counted.select("doc_id", "class_id", (F.coalesce("n", F.lit(0)) + copy).cast("bigint").alias("n_links"))
    alone = sets.where(F.size("grams") == 0).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(alone)
