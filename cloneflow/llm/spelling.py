"""Spelling variants by a dictionary of pairs of trie nodes.

The nodes of the trie of all words, and of the trie of all words reversed, are numbered. A word cut at a place is a pair of numbers, the
node of what stands before it and the node of what stands behind; equal pairs are equal strings. A word with one position skipped
has the pair around it: words that share such a pair differ by that one code point, and a word that has the pair itself, with nothing
skipped, is the one without it. So all exact neighbours meet as rows with two equal integers, in groups no larger
than the alphabet, and strings are not compared.

Nodes are numbered from sorted words: what a word adds to the trie are the prefixes that go beyond what it shares with the word before
it. Ranges of the sorted words are numbered by themselves; the numbers are shifted by those of the ranges before, and the
nodes that a range's first word shares with the last word before the range take that word's numbers.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneflow.llm.common import whole_text
from cloneflow.operators.joins import join_unique
from cloneflow.session import materialize

MIN_LENGTH, MIN_COUNT, FACTOR, SLIP = 5, 3, 2, 97
MAX_COUNTED = 200_000
ROWS_OUT = 20_000
PIECE_CHARS = 1 << 20

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def slipped(run: str, h: int, every: int = SLIP) -> str:
    """A lower-cased run with the code point that its hash names deleted, if the hash is one of `every`."""
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that end between runs."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        stop = start + PIECE_CHARS
        inside = RUN.match(text, stop) if RUN.match(text[stop - 1]) else None
        stop = inside.end() if inside else stop
        yield text[start:stop]
        start = stop
    yield text[start:]


def document_words(doc_id: int | None, text: str, words: Counter, least: int, every: int = SLIP) -> None:
    """Adds the words of a text, of at least `least` code points, to `words`."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    runs: Counter[str] = Counter()
    for piece in _pieces(text):
        runs.update(RUN.findall(piece.encode("utf-8", "replace").translate(LOWER).decode()))
    for run, n in runs.items():
        if len(run) >= least:
            h = zlib.crc32(run.encode(), head)
            word = run if h % every else slipped(run, h, every)
            if len(word) >= least:
                words[word] += n


def _counter(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            listed = list(words.items())
            words.clear()
            for i in range(0, len(listed), ROWS_OUT):
                some = listed[i : i + ROWS_OUT]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                document_words(doc_id, text.as_py(), words, least, every)
                if len(words) > MAX_COUNTED:
                    yield from out()
        yield from out()

    return run


def vocabulary(docs: DataFrame, least: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = SLIP) -> DataFrame:
    """`word, n`: the distinct words of all texts, counted within tasks first."""
    local = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(_counter(least, every), "word string, n long")
    return local.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def shared_prefix(a: str, b: str) -> int:
    """How many code points both begin with."""
    if a[: len(b)] == b or b[: len(a)] == a:
        return min(len(a), len(b))
    return next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)


def _numberer(word: str, nodes: str):
    """Adds to sorted rows the numbers of their words' prefixes, of length 1 on, counted within the range. A last row has `_first`, the
    first word of the range, and repeats the last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, before, stack, made, schema = TaskContext.get().partitionId(), None, "", [], 0, None
        for batch in batches:
            found = []
            for text in batch.column(word):
                text = text.as_py()
                keep = shared_prefix(before, text)
                stack = stack[:keep] + list(range(made, made + len(text) - keep))
                made += len(text) - keep
                found.append(stack)
                before, first = text, text if first is None else first
            added = [pa.array(np.full(len(found), part), pa.int32()), pa.nulls(len(found), pa.string()), pa.array(found, pa.list_(pa.int64()))]
            batch = pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "_range", "_first", nodes])
            schema = pa.schema([f.with_nullable(True) for f in batch.schema])
            yield batch.cast(schema)
        if first is not None:
            last = {word: before, "_range": part, "_first": first, nodes: stack}
            yield pa.RecordBatch.from_pylist([last], schema=schema)

    return run


def carried(ends: list[tuple[int, str, str, list[int]]]) -> list[tuple[int, int, list[int]]]:
    """For each range, in order: the shift of its numbers, and the true numbers of the nodes that its first word shares with what came before.

    `ends` has a range's number, first word, last word and the last word's numbers.
    """
    found, shift, before, numbers = [], 1, "", []
    for part, first, last, nodes in sorted(ends):
        shared = numbers[: shared_prefix(before, first)]
        found.append((part, shift, shared))
        before, numbers = last, [shared[n] if n < len(shared) else shift + n for n in nodes]
        # The last row of a range need not hold its largest number; a bound on it is enough to keep ranges apart.
        shift += 1 << RANGE_BITS
    return found


# Numbers that each range has to itself: fewer than 2^40 letters of words, and at most 2^23 ranges.
RANGE_BITS = 40


def number_nodes(rows: DataFrame, word: str, nodes: str) -> DataFrame:
    """`rows` with the numbers of the trie nodes of all prefixes of `word` (no repeats), shortest first. The root is 0."""
    added = [T.StructField("_range", T.IntegerType()), T.StructField("_first", T.StringType()), T.StructField(nodes, T.ArrayType(T.LongType()))]
    kinds = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema], *added])
    made = materialize(rows.repartitionByRange(word).sortWithinPartitions(word).mapInArrow(_numberer(word, nodes), kinds), "trie")
    # Two words for each range.
    ends = [tuple(r) for r in made.where(F.col("_first").isNotNull()).select("_range", "_first", word, nodes).collect()]
    moved = rows.sparkSession.createDataFrame(carried(ends), "_range int, _shift long, _shared array<long>")
    true = F.transform(nodes, lambda n: F.when(n < F.size("_shared"), F.get("_shared", n.cast("int"))).otherwise(n + F.col("_shift")))
    return made.where(F.col("_first").isNull()).join(F.broadcast(moved), "_range").select(*rows.columns, true.alias(nodes))


def node_pairs(words: DataFrame) -> DataFrame:
    """`word, n, id, before, behind` from `word, n`: a word's number and the nodes of its prefixes and of its suffixes, by length."""
    forward = number_nodes(words, "word", "before")
    turned = forward.select("word", "n", "before", F.reverse("word").alias("turned"))
    both = number_nodes(turned, "turned", "behind").drop("turned")
    root = F.array(F.lit(0).cast("bigint"))
    return both.select("word", "n", F.element_at("before", -1).alias("id"), F.concat(root, "before").alias("before"), F.concat(root, "behind").alias("behind"))


def near_words(pairs: DataFrame) -> DataFrame:
    """`id, n_near, best`: for every word that has neighbours their number, and `best` is the most frequent one, `n` and `id`, the
    smallest at a tie (numbers follow the words' order)."""
    size = F.size("before") - 1
    # The word with position i skipped, and the word cut at i. A deletion within a run of equal letters counts once, at its end.
    letters = F.split("word", "")
    skip = F.transform(
        F.arrays_zip(F.slice(letters, 1, size).alias("here"), F.slice(letters, 2, size).alias("next")),
        lambda z, i: F.struct(
            F.get("before", i).alias("p"), F.get("behind", size - 1 - i).alias("s"), F.lit(True).alias("skipped"), (~z["here"].eqNullSafe(z["next"])).alias("counts")
        ),
    )
    cut = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(F.get("before", i).alias("p"), F.get("behind", size - i).alias("s"), F.lit(False).alias("skipped"), F.lit(False).alias("counts")),
    )
    rows = pairs.select("id", "n", F.explode(F.concat(skip, cut)).alias("at")).select("at.*", "id", "n")
    # A group has one word cut there at most, and of skipped ones one for each letter of the alphabet.
    group = W.partitionBy("p", "s")
    order = group.orderBy(F.desc("n"), "id")
    met = rows.select(
        "id",
        "skipped",
        "counts",
        F.count(F.lit(1)).over(group).alias("together"),
        F.sum(F.col("skipped").cast("int")).over(group).alias("others"),
        F.sum(F.col("counts").cast("int")).over(group).alias("longer"),
        F.first(F.struct("n", "id")).over(order).alias("top"),
        F.lead(F.struct("n", "id")).over(order).alias("next"),
    ).where(F.col("together") > 1)
    whole = F.col("together") - F.col("others")
    near = F.when(F.col("skipped"), F.col("others") - 1 + F.when(F.col("counts"), whole).otherwise(0)).otherwise(F.col("longer"))
    best = F.when(F.col("top.id") != F.col("id"), F.col("top")).otherwise(F.col("next"))
    best = F.max(F.struct(best["n"].alias("n"), (-best["id"]).alias("id")))
    found = met.groupBy("id").agg(F.sum(near).alias("n_near"), best.alias("best"))
    return found.select("id", "n_near", F.struct(F.col("best.n").alias("n"), (-F.col("best.id")).alias("id")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """`id, root` from `id, form`: the end of each chain of forms, found by doubling the steps.

    A form is more frequent than its word by a factor, so chains do not close and are short: the rounds are the logarithm of their length.
    """
    now = materialize(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        made = materialize(join_unique(now, further, ["root"], ["id"], "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not made.where("moved").head(1):
            return made.select("id", "root")
        now = made.select("id", "root")


def group_spellings(docs: DataFrame, least: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR, every: int = SLIP) -> DataFrame:
    """A row per word: `word, form, root, n, n_near, form_n`.

    Words are the runs of letters of whole texts, A-Z lower-cased, some with one code point left out (`slipped`), of at least `least` code
    points and `min_count` occurrences. Near words differ by one inserted, deleted or replaced code point; `form` is the most frequent
    near word (the smallest at a tie) if it has at least `factor` times the word's count, and `root` where following forms ends.
    Null and empty texts have no words; a null id is written as an empty string before the hash; rows that repeat count each; very long texts and runs are
    read in parts and cost linear time. Without words there are no rows.
    """
    words = materialize(vocabulary(docs, least, min_count, every), "vocabulary")
    pairs = materialize(node_pairs(words), "node_pairs")
    near = materialize(near_words(pairs), "near_words")
    known = pairs.select("id", "word", "n")
    best = known.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "best")
    better = F.col("best.n") >= factor * F.col("n")
    made = materialize(best.select("id", "word", "n", "n_near", F.when(better, F.col("best.id")).alias("form"), F.when(better, F.col("best.n")).alias("form_n")), "forms")
    words_of = known.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    ends_of = known.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    varied = made.where(F.col("form").isNotNull())
    varied = varied.join(roots(varied.select("id", "form")), "id")
    varied = materialize(join_unique(varied, words_of, ["form"], ["id"]), "variants")
    varied = join_unique(varied, ends_of, ["root"], ["id"]).select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = made.where(F.col("form").isNull())
    return varied.unionByName(alone.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n"))
