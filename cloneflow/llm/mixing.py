"""Mixing sources to target weights by systematic sampling.

Within a source, the expected copies of its documents are added up in order of size, one random offset is added, and a document
is taken once for every whole number that its step crosses. All documents of a source expect the same number of copies,
its target over its size, but for the few that are large against the target: they come first, and each one expects
what the target still lacks over what the source still has, so that a long document that is taken, or left, is made up for by the
shorter ones behind it; one that is longer than what is lacking is left, for nothing could make up for it. What a source takes then differs from its target by no more than a document that is not large.

Sums are whole numbers of 2^-26 copies, so neither the order of summing nor the number of tasks changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneflow.llm.common import free_name, whole_text
from cloneflow.llm.ordering import with_totals
from cloneflow.operators.joins import join_unique
from cloneflow.session import materialize

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 42
FRACTION = 26
# A document is large if it holds more than this part of its source's target.
LARGE = 1 / 200

GROUP = ["key", "size", "named", "id", "row"]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """The number of words of each text: bytes that are no white space behind a byte that is, or at a text's start."""
    counts = np.zeros(len(texts), np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset :][: len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return counts
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    space = IS_SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    some = offsets[1:] > offsets[:-1]
    heads = offsets[:-1][some] - offsets[0]
    starts[heads] = ~space[heads]
    counts[some] = np.add.reduceat(starts, heads, dtype=np.int64)
    return counts


def _sizes(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in arrays:
        yield pa.array(word_counts(array))


def _key(source: Column) -> Column:
    """Sources as keys that sort by code point, null last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`key, source_size, target` from `key, source_size`: the words that each source gives to the mix.

    The keys in order have the `weights`, repeating, and share the sum of all sizes. A target stops at `most` times its source's size, and the
    others share the rest by weight until none is above. Each round is one aggregation over the sources.
    """
    ranked = with_totals(sizes.withColumn("one", F.lit(1).cast("bigint")), ["key"], "one", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    now = materialize(ranked.select("key", "source_size", weight.alias("weight")), "sources")
    total = now.agg(F.sum("source_size")).first()[0] or 0
    share, known = 0.0, None
    while True:
        stopped = F.col("weight") * share > F.col("source_size") * most
        full, free, n = now.agg(
            F.sum(F.when(stopped, F.col("source_size"))), F.sum(F.when(~stopped, F.col("weight"))), F.count(F.when(stopped, 1))
        ).first()
        if n == known:
            break
        share, known = (total - most * (full or 0)) / free if free else 0.0, n
    target = F.when(stopped, (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * share)
    return now.select("key", "source_size", target.alias("target"))


def _offset(key: Column, seed: int) -> Column:
    """A source's random offset below one copy, in units of 2^-FRACTION: from a digest of seed and source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.substring(key, 2, 2**31 - 1)))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint") * 2 ** (FRACTION - 24)


def step(target: float, size: int, most: int) -> int:
    """Expected copies of each document where `size` words are to give `target`."""
    return min(most << FRACTION, int(max(0.0, target) / size * 2.0**FRACTION)) if size > 0 else 0


def _large(most: int):
    """The large documents of one source, longest first: each one's place and step, and a last row with those that the rest begins with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "named", "id", "row"], ascending=[False, True, True, True]).reset_index(drop=True)
        target, left, at, offset = float(rows["target"][0]), int(rows["source_size"][0]), 0, int(rows["offset"][0])
        places, steps = [], []
        for size, n in zip(rows["size"].tolist(), rows["n"].tolist(), strict=True):
            move = min(step(target, left, most), int(max(0.0, target) / size) << FRACTION)
            places.append(at)
            steps.append(move)
            target -= (((at + n * move + offset) >> FRACTION) - ((at + offset) >> FRACTION)) * size
            left -= n * size
            at += n * move
        made = rows[GROUP].assign(place=places, step=steps, large=True)
        rest = made.tail(1).assign(place=at, step=step(target, left, most), large=False)
        return pd.concat([made, rest])

    return run


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """`key, size, named, id, row, n, source_size, target, place, step, offset`: every distinct document's place in its source's sum.

    `named` and `id` stand for a doc_id that may be null, `row` is a hash of the text and `n` the number of rows that agree in id, source and text. Copy number j of `n` is taken as often as
    whole numbers lie between place + j * step and place + (j + 1) * step, offset added (`copies`).
    """
    measure = F.arrow_udf(_sizes, "bigint")
    id_ = F.col("doc_id").cast("bigint")
    named = docs.select(
        _key(F.col("source")).alias("key"),
        measure(whole_text()).alias("size"),
        id_.isNotNull().alias("named"),
        F.coalesce(id_, F.lit(0)).alias("id"),
        F.xxhash64(whole_text()).alias("row"),
    )
    sized = materialize(named.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = source_targets(sized.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    targets = materialize(targets.withColumn("offset", _offset(F.col("key"), seed)), "targets")
    aimed = join_unique(sized, targets, ["key"], ["id", "row"])
    is_large = (F.col("size") > F.col("target") * LARGE) & (F.col("target") > 0)
    # A source has at most its size over LARGE times its target such documents, whatever its number of documents.
    made = "key string, size long, named boolean, id long, row long, place long, step long, large boolean"
    taken = materialize(aimed.where(is_large).groupBy("key").applyInPandas(_large(most), made), "large_documents")
    large = aimed.where(is_large).join(taken.where("large").drop("large"), GROUP)
    rest = with_totals(aimed.where(~is_large), ["key", F.desc("size"), "named", "id", "row"], "n")
    heads = rest.groupBy("key").agg(F.min("before").alias("head"))
    plain = F.least(F.lit(most << FRACTION), F.floor(F.col("target") / F.col("source_size") * F.lit(2.0**FRACTION)))
    begun = taken.where(~F.col("large")).select("key", "place", "step")
    starts = heads.join(targets, "key").join(begun, "key", "left").select(
        "key", "head", F.coalesce("place", F.lit(0)).alias("start"), F.coalesce("step", F.when(F.col("source_size") > 0, plain), F.lit(0)).cast("bigint").alias("step")
    )
    rest = join_unique(rest, materialize(starts, "starts"), ["key"], ["id", "row"])
    rest = rest.withColumn("place", F.col("start") + (F.col("before") - F.col("head")) * F.col("step"))
    return large.unionByName(rest.select(large.columns))


def copies(first: Column, many: Column | None = None) -> Column:
    """How often the rows from number `first` on, `many` of them (1), of a document of the plan are taken."""
    many = F.lit(1) if many is None else many
    reach = lambda j: F.shiftright(F.col("place") + j * F.col("step") + F.col("offset"), FRACTION)
    return reach(first + many) - reach(first)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns. Rows that agree in id, source and text
    stand for one of them."""
    key, row, id_, times = (free_name(docs, c) for c in ("_mix_key", "_mix_row", "_mix_id", "_mix_times"))
    plan = plan_mix(docs.select("doc_id", "source", "text"), weights, most, seed)
    wanted = materialize(plan.select(F.col("key").alias(key), F.col("row").alias(row), _doc_id().alias(id_), copies(F.lit(0), F.col("n")).cast("int").alias(times), "n"), "copies")
    marked = docs.withColumns({key: _key(F.col("source")), row: F.xxhash64(whole_text()), id_: F.col("doc_id").cast("bigint")})
    if wanted.where(F.col("n") > 1).head(1):
        marked = marked.dropDuplicates([id_, key, row])
    marked, wanted = marked.alias("d"), wanted.where(F.col(times) > 0).alias("w")
    same = (F.col(f"d.{key}") == F.col(f"w.{key}")) & (F.col(f"d.{row}") == F.col(f"w.{row}")) & F.col(f"d.{id_}").eqNullSafe(F.col(f"w.{id_}"))
    found = marked.join(wanted, same).select(*[F.col(f"d.`{c}`") for c in docs.columns], times)
    return found.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).drop(times)


def _doc_id() -> Column:
    return F.when(F.col("named"), F.col("id"))


def mix_report(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: its size in words, its source's size and target, and the words that the mix takes from it.

    Null texts have no words and give none. A null source is one source, the last in order. A null id sorts first; rows that repeat are
    dealt with one by one. Very long texts are counted in place. Without rows, no rows; a source without words has target 0.
    """
    plan = plan_mix(docs.select("doc_id", "source", "text"), weights, most, seed)
    each = plan.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return each.select(_doc_id().alias("doc_id"), "size", "source_size", "target", (copies(F.col("j")) * F.col("size")).alias("taken"))
