"""Exact similarity join of a whole corpus from an inverted index over rare k-grams.

Put all grams in one order. Two sets whose Jaccard similarity reaches t have a gram in common among the first |x| - ceil(t |x|) + 1 of
both, so only these are indexed, and with the rarest first their lists are short. Sizes that differ by more than a factor t never meet, nor do
sets whose grams behind the shared one are too few. No gram is left out for being frequent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneflow.functions.words import SPLIT_BYTES, slices, split_words, text_slices
from cloneflow.operators.candidates import SHINGLE, SIMILARITY, merge_equal, scored_pairs
from cloneflow.operators.components import components
from cloneflow.operators.joins import join_unique
from cloneflow.session import materialize, spread

# Rows of one gram and level on either side that meet in one group at most; longer lists are dealt into blocks.
BLOCK_ROWS = 4096
# Grams that are dealt at once, and grams of one bucket on average.
AT_ONCE, BUCKET_GRAMS = 1 << 21, 1 << 20
# Odd, without pattern in its bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
# Keeps a product that is a whole number in exact arithmetic from being rounded up past it.
SLACK = 1e-9


def _needed(size: Column, share: float) -> Column:
    return F.ceil(size * F.lit(share) - F.lit(SLACK))


def _gram_lists(texts: pa.Array, k: int) -> pa.Array:
    """The distinct hashes, sorted, of the runs of k words of each text."""
    words, number, text = split_words(texts)
    hashes = np.array([int.from_bytes(blake2b(w, digest_size=8).digest()) for w in words.cast(pa.binary()).to_pylist()], np.uint64)[number]
    runs = max(len(hashes) - k + 1, 0)
    h = hashes[:runs].copy()
    for i in range(1, k):
        h ^= h >> np.uint64(29)
        h *= MIX
        h += hashes[i : i + runs]
    h ^= h >> np.uint64(32)
    h *= MIX
    inside = text[:runs] == text[k - 1 : k - 1 + runs]
    h, text = h[inside].view(np.int64), text[:runs][inside]
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    for start, stop in zip(ends, ends[1:]):
        h[start:stop].sort()
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new)])[ends], pa.int32()), pa.array(h[new]))


def gram_sets(table: DataFrame, k: int = SHINGLE) -> DataFrame:
    """`doc_id, grams`: the distinct 64-bit hashes of each document's runs of k tokens, sorted; none for a null text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(1), SPLIT_BYTES):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), _gram_lists(part.column(1), k)], names=["doc_id", "grams"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.select("doc_id", F.make_valid_utf8("text")).mapInArrow(made, f"doc_id {kind}, grams array<bigint>")


def _dealt(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`doc_id, grams` to one row per bucket of grams: `bucket, h, doc_id, size`, the last three lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for start, stop in slices(lengths, AT_ONCE):
                h = batch.column(1).slice(start, stop - start).flatten().to_numpy(zero_copy_only=False)
                bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
                order, n = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)
                owner = np.repeat(np.arange(start, stop), lengths[start:stop])[order]
                filled = np.flatnonzero(n)
                ends = pa.array(np.concatenate([[0], np.cumsum(n[filled])]), pa.int32())
                columns = [pa.array(h[order]), batch.column(0).take(pa.array(owner)), pa.array(lengths[owner].astype(np.int32))]
                lists = [pa.ListArray.from_arrays(ends, c) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), *lists], names=["bucket", "h", "doc_id", "size"])

    return run


def _shared(bucket: pa.Table) -> pa.Table:
    """The rows of the grams of a bucket that more than one set holds, with the number of sets."""
    h, docs, size = (pc.list_flatten(bucket[c]).combine_chunks() for c in ("h", "doc_id", "size"))
    h = h.to_numpy(zero_copy_only=False)
    order = np.argsort(h)
    h = h[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.append(heads, len(h)))
    n = np.repeat(n, n)
    keep = n > 1
    rows = pa.array(order[keep])
    return pa.table({"doc_id": docs.take(rows), "size": size.take(rows), "h": h[keep], "n": n[keep]})


def shared_grams(sets: DataFrame, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """`doc_id, size, h, n`: the grams that n > 1 sets hold, once for each of them.

    Grams are dealt into buckets by their value and counted there: each is moved once, packed, whether the shared ones are few or many. A set holds a gram
    once, so a frequent gram adds at most one entry per set to its bucket.
    """
    total = sets.agg(F.sum(F.size("grams"))).first()[0] or 0
    kind = sets.schema["doc_id"].dataType.simpleString()
    packed = sets.select("doc_id", "grams").mapInArrow(_dealt(-(-total // bucket_grams) or 1), f"bucket int, h array<bigint>, doc_id array<{kind}>, size array<int>")
    return packed.groupBy("bucket").applyInArrow(_shared, f"doc_id {kind}, size int, h bigint, n bigint")


def rare_prefixes(sets: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """`doc_id, size, pos, h, prev`: the indexed grams of each set with their place in the order of rarity.

    A gram that only one set holds can meet nothing: such grams come first in the order and take up their places, without being in it. `prev` is
    the indexed gram before this one.
    """
    ordered = shared_grams(sets).groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("grams"))
    alone = F.col("size") - F.size("grams")
    length = F.greatest(F.col("size") - _needed(F.col("size"), threshold) + 1 - alone, F.lit(0)).cast("int")
    first = ordered.select("doc_id", "size", alone.alias("alone"), F.slice("grams", 1, length).alias("grams"))
    indexed = first.select("doc_id", "size", "alone", "grams", F.posexplode("grams").alias("i", "gram"))
    return indexed.select("doc_id", "size", (F.col("alone") + F.col("i")).alias("pos"), F.col("gram.h").alias("h"), F.get("grams", F.col("i") - 1)["h"].alias("prev"))


def candidate_pairs(prefixes: DataFrame, threshold: float = SIMILARITY, block: int = BLOCK_ROWS) -> DataFrame:
    """`a, b`: the pairs of sets, a the larger (or, of one size, of the larger id), that an indexed gram brings together.

    Levels of sizes, each wider than a factor 1 / threshold, keep out most sizes that do not go together: the smaller set is of the larger one's level or the one below.
    """
    width = math.log(1 / threshold) * (1 + SLACK)
    listed = materialize(prefixes.withColumn("level", F.floor(F.log("size") / F.lit(width)).cast("int")), "index")
    smaller = listed.withColumn("level", F.explode(F.array("level", F.col("level") + 1)))
    rows = lambda side, name: side.groupBy("h", "level").agg(F.count(F.lit(1)).alias(name))
    # Every list meets itself, so a key without larger sets has no row here.
    met = materialize(rows(listed, "n_large").join(rows(smaller, "n_small"), ["h", "level"]).where(F.col("n_small") > 1), "lists")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    cuts = met.select("h", "level", blocks("n_large").alias("large"), blocks("n_small").alias("small"))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def dealt(side: DataFrame, n: str, this: str, other: str, names: dict[str, str]) -> DataFrame:
        cut = join_unique(side, cuts, ["h", "level"], ["doc_id"], counts=met.select("h", "level", F.col(n).alias("n")))
        placed = cut.withColumn(f"_{this}", own(this)).withColumn(f"_{other}", all_of(other)).drop("large", "small")
        return placed.withColumnsRenamed(names)

    fields = ["doc_id", "size", "pos", "prev"]
    a = dealt(listed, "n_large", "large", "small", {f: f"a_{f}" for f in fields})
    b = dealt(smaller, "n_small", "small", "large", {f: f"b_{f}" for f in fields})
    col = F.col
    in_order = (col("b_size") < col("a_size")) | ((col("b_size") == col("a_size")) & (col("b_doc_id") < col("a_doc_id")))
    behind = F.least(col("a_size") - col("a_pos"), col("b_size") - col("b_pos"))
    enough = behind >= _needed(col("a_size") + col("b_size"), threshold / (1 + threshold))
    # Where the grams before are shared as well, an earlier one has brought the pair together.
    new = F.coalesce(col("a_prev") != col("b_prev"), F.lit(True))
    joined = a.join(b, ["h", "level", "_large", "_small"]).where(in_order & (col("b_size") >= _needed(col("a_size"), threshold)) & enough & new)
    return joined.select(col("a_doc_id").alias("a"), col("b_doc_id").alias("b")).distinct()


def similar_sets(sets: DataFrame, threshold: float = SIMILARITY, block: int = BLOCK_ROWS) -> DataFrame:
    """`a, b, similarity`: all pairs of `doc_id, grams` (sets that differ, one row each) whose Jaccard similarity reaches `threshold`, a > b. Exact."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    pairs = materialize(candidate_pairs(rare_prefixes(sets, threshold), threshold, block), "candidates")
    # Most sets are in no pair: only the others are moved.
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    met = materialize(join_unique(sets, ends, ["doc_id"], ["doc_id"]), "met_sets")
    good = scored_pairs(spread(pairs, "a", "b"), met).where(F.col("similarity") >= threshold)
    return good.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "similarity")


def similar_texts(table: DataFrame, k: int = SHINGLE, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """`doc_id, first` and `a, b, similarity`: each document's representative, the least id with the same set of k-grams, and all similar pairs of
    representatives.

    Null, empty and short texts (fewer than k tokens) have no grams: a null representative and no pair.
    """
    sets = materialize(gram_sets(table, k), "shingles")
    members, distinct = merge_equal(sets)
    links = materialize(similar_sets(distinct, threshold), "links")
    return sets.select("doc_id").join(members, "doc_id", "left"), links


def kgram_join(table: DataFrame, k: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """`doc_id, class_id, n_links`: how many other documents each one is similar to, copies counted but not expanded, and the least id that a
    chain of them reaches. Every document has a row."""
    members, links = similar_texts(table, k, threshold)
    members = materialize(members, "members")
    sizes = materialize(members.where(F.col("first").isNotNull()).groupBy("first").agg(F.count(F.lit(1)).alias("copies")), "copies")
    roots = components(links.select("a", "b")).select(F.col("node").alias("first"), "root")
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("first"), F.col("b").alias("other")), F.struct(F.col("b").alias("first"), F.col("a").alias("other")))))
    reached = join_unique(ends, sizes.withColumnRenamed("first", "other"), ["other"], ["first"]).groupBy("first").agg(F.sum("copies").alias("more"))
    groups = sizes.join(reached, "first", "left").join(roots, "first", "left")
    facts = groups.select("first", F.coalesce("root", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    found = join_unique(members, materialize(facts, "groups"), ["first"], ["doc_id"], "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
