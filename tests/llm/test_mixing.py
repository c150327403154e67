"""The mix against plain loops, and its words against its targets."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloneflow.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by handing the excess on until nothing is above."""
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [k for k in keys if k not in stopped]
        rest = total - sum(most * sizes[k] for k in stopped)
        target = {k: most * sizes[k] if k in stopped else rest * weight[k] / sum(weight[f] for f in free) for k in keys}
        above = {k for k in free if target[k] > most * sizes[k] * (1 + 1e-12)}
        if not above:
            return target
        stopped |= above


def test_word_counts():
    texts = ["", "a", " a  b ", "\n\t", "é漢\x0bx\x1cy", "", "a\xa0b c"]
    for array in (pa.array(texts), pa.array(["pad", *texts])[1:], pa.array([], pa.string())):
        assert mixing.word_counts(array).tolist() == [len(WORD.findall(t)) for t in array.to_pylist()]


@pytest.fixture
def rows():
    made = [(i, " ".join(["w"] * (i * i % 37 + 1)), f"s{i % 7}" if i % 5 else "hot") for i in range(900)]
    made += [(1000, "x " * 4000, "s1"), (1001, "x " * 9000, "hot"), (1002, None, "s2"), (1003, "", "empty"), (1004, "a b", None), (None, "a b c", None), (None, "a b", "é")]
    return made + [(1005, "same words here", "s3")] * 5 + [(1005, "other words here", "s3")] + [(2**60 + 1, "big id", None)]


def frame(spark, rows, parts=3):
    made = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    return made.withColumns({"key": F.lit(1), "size": F.lit("mine"), "n": F.lit(2), "_mix_key": F.lit(3)})


def test_targets_and_sums(spark, rows):
    made = mixing.mix_report(frame(spark, rows)).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = plain_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in made) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    source_of = {(i, len(WORD.findall(t or ""))): s for i, t, s in rows}
    taken, longest = Counter(), Counter()
    for r in made:
        source = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size and (r.taken % r.size if r.size else r.taken) == 0
        taken[source] += r.taken
        if r.size <= want[source] * mixing.LARGE:
            longest[source] = max(longest[source], r.size)
    for source in sizes:
        # Off by no more than a document that is not large, or the smallest where all are.
        smallest = min(len(WORD.findall(t or "")) for _, t, s in rows if s == source)
        assert abs(taken[source] - want[source]) <= 1 + max(longest[source], 3 * smallest), source


def test_reruns_agree_and_the_mix_holds_what_the_report_says(spark, rows):
    first = mixing.mix_report(frame(spark, rows)).collect()
    again = mixing.mix_report(frame(spark, rows[::-1], 8)).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    docs = frame(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    want = Counter()
    for r in first:
        want[r.doc_id] += r.taken
    assert +words == +want


def test_offset_moves_the_choice_but_not_the_sum(spark):
    rows = [(i, "two words", "a" if i < 300 else "b") for i in range(1000)]
    one, two = ({r.doc_id: r.taken for r in mixing.mix_report(frame(spark, rows), seed=s).collect()} for s in (1, 2))
    assert one != two
    assert abs(sum(one.values()) - sum(two.values())) <= 4 and abs(sum(one.values()) - 2000) <= 4


def test_without_rows_or_words(spark):
    assert mixing.mix_report(frame(spark, [])).count() == 0 == mixing.mix(frame(spark, [])).count()
    made = mixing.mix_report(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in made) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
