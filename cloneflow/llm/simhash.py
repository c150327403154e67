"""SimHash near-dedup by pigeonhole blocks.

Two fingerprints that differ in at most d bits agree on at least b - d of b blocks, so each fingerprint is dealt once per choice of
b - d blocks and compared only within these buckets. Equal fingerprints are one row from the start. A bucket beyond MAX_BUCKET
fingerprints is dealt again by blocks of the bits it does not yet agree on, so no task ever holds a large bucket and no
link is lost. A bucket sends back a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneflow.llm.common import free_name, whole_text, word_lists
from cloneflow.llm.components import connected_components
from cloneflow.operators.joins import fits, join_unique
from cloneflow.session import materialize

SHINGLE, SEED, BITS, DISTANCE = 4, 42, 64, 4
MAX_BUCKET = 4096
SMALL_GROUP = 16
# Blocks by the number of fingerprints, so that a bucket of random ones holds few: more blocks mean more, but narrower buckets.
BLOCKS = [(1 << 24, 6), (1 << 30, 7), (1 << 62, 8)]

# A-Z to a-z; the six ASCII white space characters part words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The SimHash of a whole text as a signed 64-bit number. No words: 0."""
    ones, n, tail = np.zeros(BITS, np.int64), 0, []
    hashed = xxhash.xxh64_intdigest

    def add(hashes: list[int]) -> None:
        nonlocal n
        raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones[:] += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)

    for words in word_lists(text, TABLE):
        words = tail + words
        tail = words[-(size - 1) :] if size > 1 else []
        if len(words) >= size:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
            add([hashed(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)])
    if not n and tail:
        add([hashed(b" ".join(tail), SEED)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in arrays:
        yield pa.array([fingerprint(text.as_py()) for text in array], pa.int64())


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id, row, fp`; `row` is a hash of the text, which with doc_id names a row where ids repeat."""
    made = F.arrow_udf(_fingerprints, "bigint")
    return docs.select("doc_id", F.xxhash64(whole_text()).alias("row"), made(whole_text()).alias("fp"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal keys of different origin would only add comparisons."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _masks(agreed: int, blocks: int, distance: int) -> list[int]:
    """For each choice of blocks - distance of the blocks of the bits outside `agreed`: these blocks' bits."""
    parts = np.array_split([b for b in range(BITS) if not agreed >> b & 1], blocks)
    sets = [sum(1 << int(b) for b in p) for p in parts]
    return [sum(chosen) for chosen in combinations(sets, blocks - distance)]


def _dealer(blocks: int, distance: int):
    """Rows `key, agreed, fp` to the rows of the next level; `agreed` marks the bits that a bucket has in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, agreed, fp = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            for mask in np.unique(agreed):
                here = agreed == mask
                for i, more in enumerate(_masks(int(mask), blocks, distance)):
                    bits = fp[here] & np.uint64(more)
                    made = _mix(_mix(key[here] + np.uint64(i + 1)) ^ bits)
                    both = np.full(len(bits), int(mask) | more, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (made, both, fp[here])], names=["key", "agreed", "fp"])

    return run


def _forest(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one bucket: at most len(fps) - 1."""
    left = np.arange(1, len(fps))
    front = [0]
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
            continue
        at = front.pop()
        near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
        if near.any():
            found = left[near]
            yield np.full(len(found), fps[at]), fps[found]
            front += found.tolist()
            left = left[~near]


def _links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The links within each run of equal keys."""
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(heads, len(key)))
    a, b = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes)
    skey, sfp = key[small], fp[small]
    for d in range(1, min(SMALL_GROUP, len(skey))):
        pair = np.flatnonzero((skey[d:] == skey[:-d]) & (np.bitwise_count(sfp[d:] ^ sfp[:-d]) <= distance))
        a.append(sfp[pair])
        b.append(sfp[pair + d])
    for head, size in zip(heads[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
        for x, y in _forest(fp[head : head + size], distance):
            a.append(x)
            b.append(y)
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _linker(distance: int):
    """Rows sorted by key to links. The last key of a batch may go on in the next and waits for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.empty(0, np.uint64)

        def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _links(k, f, distance) if len(k) else (k, f)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            more = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            key, fp = np.concatenate([key, more[0]]), np.concatenate([fp, more[1]])
            if not len(key):
                continue
            cut = int(np.argmax(key == key[-1]))
            yield links(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
        yield links(key, fp)

    return run


def links(distinct: DataFrame, n: int, distance: int = DISTANCE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """`a, b`: links that connect all fingerprints (column fp, `n` of them, no repeats) within `distance` bits of each other."""
    schema = "key long, agreed long, fp long"
    blocks = next(b for most, b in BLOCKS if n <= most) + (distance - DISTANCE)
    rows = distinct.select(F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("agreed"), "fp")
    found = None
    while True:
        rows = rows.mapInArrow(_dealer(blocks, distance), schema)
        large = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket).select("key"), "large_buckets")
        some = large.head(1)
        fine = rows.join(F.broadcast(large) if fits(large) else large, "key", "left_anti") if some else rows
        # Buckets of bounded size, side by side in a task.
        made = fine.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_linker(distance), "a long, b long")
        found = made if found is None else found.unionByName(made)
        if not some:
            return found.distinct()
        # Large buckets go on, dealt by their next blocks: never by the key they share.
        rows = materialize(rows.join(F.broadcast(large) if fits(large) else large, "key", "left_semi"), "next_level")
        blocks = distance + 2


def near_classes(docs: DataFrame, distance: int = DISTANCE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """`doc_id, row, fp, component_id`: the smallest doc_id that a chain of links reaches.

    A null or wordless text has fingerprint 0 and links like any other. A null doc_id is never a component's name unless all
    ids of the component are null; rows that repeat keep their number. Empty input gives no rows.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    edges = materialize(links(firsts.select("fp"), firsts.count(), distance, max_bucket), "links")
    members = connected_components(edges)
    tops = members.join(firsts, members.node == firsts.fp).groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(join_unique(members, tops, ["root"], ["node"]).select(F.col("node").alias("fp"), "component_id"), "components")
    every = firsts.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return join_unique(rows, materialize(every, "classes"), ["fp"], ["row", "doc_id"])


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the one that names it. Rows whose group has only null ids all stay."""
    classes = near_classes(docs.select("doc_id", "text"))
    named = classes.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    unnamed = classes.where(F.col("component_id").isNull()).select("doc_id", "row", F.lit(1).cast("bigint").alias("n")).distinct()
    stay = materialize(named.unionByName(unnamed), "survivors")
    key, row, n = (free_name(docs, c) for c in ("_stay_id", "_stay_row", "_stay_n"))
    text = free_name(docs, "_row")
    marked = docs.withColumn(text, F.xxhash64(whole_text()))
    on = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(text) == F.col(row))
    kept = marked.join(stay.toDF(key, row, n), on)
    # Rows with one id and one text: only where ids repeat is there anything to drop.
    repeated = stay.where(F.col("n") > 1).head(1)
    kept = kept.dropDuplicates(["doc_id", text]) if repeated else kept
    return kept.drop(key, row, n, text)
