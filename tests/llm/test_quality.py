import random
import zlib

import numpy as np
import pytest

from cloneflow.llm import quality

WORDS = ["river", "stone", "under", "quiet", "letter", "winter", "garden", "morning", "there", "was", "and", "of"]


def made_up(n, seed=1):
    """Plain sentences, and junk of shouting, signs and repeated words."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 60))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + rng.choice(["%%%", "###"]) for w in words] if kind == 1 else [words[0]] * (len(words) + 4)
        rows.append((i, " ".join(words).capitalize() if good else " ".join(words), int(good)))
    return rows


def learnt(spark, docs_of, rows, labels=None, **options):
    docs = docs_of([t for _, t, _ in rows], [i for i, _, _ in rows])
    labels = [(i, y, 0) for i, _, y in rows] if labels is None else labels
    made, name = quality.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options)
    assert made.columns == [*docs.columns, name]
    return {r.doc_id: r[name] for r in made.collect()}


def test_held_out_accuracy(spark, docs_of):
    rows = made_up(600)
    scores = learnt(spark, docs_of, rows)
    held = [(scores[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(0 <= s <= 1 for s, _ in held)
    assert sum((s >= 0.7) == bool(y) for s, y in held) / len(held) > 0.95


def test_held_out_labels_and_other_columns_play_no_part(spark, docs_of):
    rows = made_up(200)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, 1) for i, _, y in rows]
    assert learnt(spark, docs_of, rows) == learnt(spark, docs_of, rows, turned)


def test_odd_rows(spark, docs_of):
    rows = made_up(120)
    rows += [(500, None, 1), (501, "", 0), (502, " \n", 1), (None, "who am I", 1), (7, rows[7][1], rows[7][2]), (503, "x" * 300_000, 1)]
    labels = [(i, y, 0) for i, _, y in rows] + [(3, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 0), (99999, 1, 0)]
    scores = learnt(spark, docs_of, rows, labels)
    assert len(scores) == 125 and all(0 <= s <= 1 for s in scores.values()) and scores[500] == scores[501]


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0), (3, 1, 0)]])
def test_one_class_or_none(spark, docs_of, labels):
    scores = learnt(spark, docs_of, made_up(5), labels)
    assert len(set(scores.values())) == 1 and (next(iter(scores.values())) == 0.5) == (not labels)


def test_sample_is_bounded(spark, docs_of):
    rows = made_up(100)
    docs = docs_of([t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    assert quality.training_rows(docs, labels, max_rows=30).count() == 30


def test_pieces_give_the_same_grams(monkeypatch):
    rng, seen = random.Random(2), np.zeros(1 << quality.BITS, bool)
    text = " ".join(rng.choice(["word", "word", "Ünd", "A1", "end.", "x" * 40, "\n\n"]) for _ in range(500)).encode()
    want = quality.grams(text, seen).tolist()
    for size in (1, 10, 100, 1000):
        monkeypatch.setattr(quality, "PIECE", size)
        assert quality.grams(text, seen).tolist() == want and not seen.any()


def test_dual_descent_reaches_the_optimum():
    """At the optimum no single multiplier can gain, and w is the weighted sum of rows."""
    rng = np.random.default_rng(5)
    ratios = rng.normal(size=40)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    labels = (rng.random(60) < 0.5).astype(int)
    w = quality.dual_descent(rows, labels, ratios, epochs=3000)
    sign = np.where(labels > 0, 1, -1)

    def primal(v):
        margins = np.array([v[r] @ quality.scaled(r, ratios) + v[-1] for r in rows]) * sign
        return v @ v / 2 + np.maximum(0, 1 - margins).sum()

    best = primal(w)
    for _ in range(300):
        assert primal(w + rng.normal(size=41) * 10 ** rng.uniform(-4, 0)) >= best - 1e-6
