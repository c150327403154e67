"""Similarity of two representation columns; `a` belongs to the original, `b` to the suspect."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloneflow.functions.edit import block_length, edit_distance
from cloneflow.functions.text import let

# Hashes that are permuted at once.
HASHED = 1 << 19


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole, with a value for whole = 0. Division is null-safe under ANSI mode."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(empty)


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays without repeats."""
    return let(
        common(a, b),
        lambda c: ratio(c, F.size(a) + F.size(b) - c, empty),
    )


def containment(a: Column, b: Column) -> Column:
    """Shared entries over the smaller of two arrays without repeats."""
    return ratio(common(a, b), F.least(F.size(a), F.size(b)))


def share_of(a: Column, b: Column) -> Column:
    """Share of a's entries that b has too; both without repeats."""
    return ratio(common(a, b), F.size(a))


def positional_jaccard(nodes_a: Column, nodes_b: Column, n: Column) -> Column:
    """Macro Jaccard of two node lists compared position by position, after padding both to n nodes.

    Every label scores equal positions over positions that hold it on either side. A label occurs at
    most once per list and the padding labels are named by position, so the mean has a closed form:
    equal positions (padding included) over the number of labels.
    """
    same = F.size(F.filter(F.zip_with(nodes_a, nodes_b, lambda x, y: x == y), lambda hit: hit))
    longer = F.greatest(F.size(nodes_a), F.size(nodes_b))
    shorter = F.least(F.size(nodes_a), F.size(nodes_b))
    union = F.size(nodes_a) + F.size(nodes_b) - common(nodes_a, nodes_b)
    return F.when(n > 0, (same + n - longer).cast("double") / (union + n - shorter).cast("double"))


def _total(entries: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + term(e))


def token_overlap(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Tokens of a (with repeats) that b has, over all tokens minus those. Not symmetric."""
    return let(_total(shared, lambda s: s["ca"]), lambda c: ratio(c, size_a + size_b - c))


def bag_ratio(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Twice the shared token count over all tokens: the upper bound of the block-matching ratio."""
    return ratio(2 * _total(shared, lambda s: F.least(s["ca"], s["cb"])), size_a + size_b, 1.0)


def bag_cosine(shared: Column, bag_a: Column, bag_b: Column) -> Column:
    """Cosine of two term-count vectors."""
    length = lambda bag: F.sqrt(_total(bag, lambda e: e["cnt"] * e["cnt"]).cast("double"))
    return let(
        length(bag_a) * length(bag_b),
        lambda lengths: ratio(_total(shared, lambda s: s["ca"] * s["cb"]), lengths),
    )


def edit_similarity(a: Column, b: Column) -> Column:
    """1 − Levenshtein distance over the longer length, on whole strings."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer > 0, 1 - edit_distance(a, b).cast("double") / longer).otherwise(1.0)


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the longest common block over all tokens; two empty lists score 1."""
    return ratio(2 * block_length(a, b), F.size(a) + F.size(b), 1.0)


def profile_similarity(a: Column, b: Column) -> Column:
    """Mean over the metrics of smaller / larger; two zeros count as equal."""
    parts = F.zip_with(a, b, lambda x, y: F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(1.0))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def graph_edit_similarity(nodes_a: Column, edges_a: Column, nodes_b: Column, edges_b: Column) -> Column:
    """1 − (nodes and edges on one side only) / nodes of both, nodes aligned by name. May be negative."""
    edits = (
        F.size(nodes_a) + F.size(nodes_b) - 2 * common(nodes_a, nodes_b)
        + F.size(edges_a) + F.size(edges_b) - 2 * common(edges_a, edges_b)
    )
    nodes = F.size(nodes_a) + F.size(nodes_b)
    return F.when(nodes > 0, 1 - edits.cast("double") / nodes).otherwise(0.0)


def minhash_arrays(seeds: list[tuple[int, int]], prime: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Lists of hashes to signatures: per (multiplier, offset) the smallest permuted hash. No hashes give an empty signature."""

    def minima(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            parts = []
            lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
            # Rows of about HASHED hashes at a time.
            cuts = np.searchsorted(np.cumsum(lengths), np.arange(HASHED, lengths.sum() + HASHED, HASHED), "right")
            for start, stop in zip(starts := np.unique([0, *np.minimum(cuts + 1, len(array))]), starts[1:]):
                some = lengths[start:stop][lengths[start:stop] > 0]
                h = array.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False) % prime
                heads = np.cumsum(some) - some
                parts.append(np.stack([np.minimum.reduceat((a * h + b) % prime, heads) for a, b in seeds], axis=1).ravel() if len(some) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum((lengths > 0) * len(seeds))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))

    return minima


def minhash(hashes: Column, seeds: list[tuple[int, int]], prime: int) -> Column:
    """Signature: per (multiplier, offset) the smallest permuted hash. No hashes give an empty signature."""
    return F.arrow_udf(minhash_arrays(seeds, prime), "array<bigint>")(hashes)
