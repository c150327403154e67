import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloneflow.functions import vector as vf
from cloneflow.operators import embed, joins
from cloneflow.operators.measures import term_counts
from cloneflow.sources import vectors as vs


def test_cosine(spark):
    rows = [([0.0, 0.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [-2.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<float>, b array<float>")
    got = [r.c for r in df.select("i", vf.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]
    assert got == [0.0, 0.0, 1.0, -1.0, None]


def test_pad_normalise_and_guard(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],)], "v array<double>")
    v = F.col("v")
    r = df.select(vf.pad_truncate(v, 5).alias("p"), vf.pad_truncate(v, 2).alias("t"), vf.l2_normalize(v).alias("n"),
                  vf.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), vf.finite(F.lit(math.nan)).alias("f")).first()
    assert (r.p, r.t, r.z, r.f) == ([1, 2, 2, 0, 0], [1, 2], [0, 0], 0)
    assert r.n == pytest.approx([1 / 3, 2 / 3, 2 / 3])


def test_vector_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", [0.1, 0.2]), ("b", [1.0, -3.5])], "key string, embedding array<double>")
    vs.write_vectors(df, str(tmp_path / "p"), "20240101_000000")
    vs.write_vectors(df.where("key = 'a'"), str(tmp_path / "p"), "20240102_000000")
    assert sorted((str(r.run_id), r.key, r.embedding) for r in vs.read_vectors(spark, str(tmp_path / "p")).collect()) == [
        ("20240101_000000", "a", [0.1, 0.2]), ("20240101_000000", "b", [1.0, -3.5]), ("20240102_000000", "a", [0.1, 0.2]),
    ]
    vs.write_vectors(df, str(tmp_path / "j"), "r1", as_json=True)
    spark.createDataFrame([("c\t[1.0, 2.0,",), ("d\tnothing",)], "value string").write.text(str(tmp_path / "j" / "run_id=r2"))
    got = {(r.run_id, r.key): r.embedding for r in vs.read_vectors(spark, str(tmp_path / "j"), as_json=True).collect()}
    assert got == {("r1", "a"): [0.1, 0.2], ("r1", "b"): [1.0, -3.5], ("r2", "c"): None, ("r2", "d"): None}


def test_word_vector_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\nhello 0.5 -1 2e-3\nworld 1 2 3\n")
    got = {r.word: r.vec for r in vs.read_word_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert got == {"hello": pytest.approx([0.5, -1, 0.002]), "world": [1, 2, 3]}


def test_backfill_computes_only_missing(spark):
    needed = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, text string")
    stored = spark.createDataFrame([(1, [1.0]), (9, [9.0])], "k int, embedding array<double>")
    asked = []

    def compute(missing):
        asked.extend(r.k for r in missing.collect())
        return missing.select("k", F.array(F.lit(0.0)).alias("embedding"))

    got = sorted((r.k, r.embedding, r.origin) for r in vs.backfill(needed, stored, "k", compute).collect())
    assert got == [(1, [1.0], "stored"), (2, [0.0], "computed"), (3, [0.0], "computed")]
    assert sorted(asked) == [2, 3]


def test_pools(spark):
    rows = [("a", 2, [1.0, 2.0], 1), ("a", 1, [3.0, 6.0], 3), ("b", 5, [4.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "k string, pos int, vec array<double>, w int")
    assert {r.k: r.vec for r in embed.mean_pool(df, ["k"], 2).collect()} == {"a": [2, 4], "b": [4, 0]}
    assert {r.k: r.vec for r in embed.mean_pool(df, ["k"], 2, weight="w").collect()} == {"a": [2.5, 5], "b": [4, 0]}
    assert {r.k: r.vec for r in embed.first_pool(df, "k", "pos").collect()} == {"a": [3, 6], "b": [4, 0]}


def test_lookup_doc_vectors(spark):
    docs = spark.createDataFrame([("c", 1, "l", "x x y"), ("c", 2, "l", "nothing known"), ("c", 3, "l", "")], "case_id string, doc_id long, label string, text string")
    lookup = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 3.0]), ("other", [9.0, 9.0])], "tok string, vec array<float>")
    got = {r.doc_id: r.vec for r in embed.lookup_doc_vectors(term_counts(docs), lookup, docs, 2).collect()}
    assert got == {1: pytest.approx([2 / 3, 1.0]), 2: [0, 0], 3: [0, 0]}


def test_lookup_in_two_tiers(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words, size=rng.integers(0, 60), p=np.arange(200, 0, -1) / 20100)) for _ in range(60)] + [None, "", "nothing known"]
    docs = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "doc_id long, case_id string, text string")
    # "w0" is the most frequent word of all and has no vector.
    vectors = {w: rng.normal(size=3) for w in words[1:]}
    lookup = spark.createDataFrame([(w, v.tolist()) for w, v in vectors.items()], "tok string, vec array<double>")
    want = {}
    for i, t in enumerate(texts):
        known = [vectors[w] for w in (t or "").split() if w in vectors]
        want[i] = np.mean(known, axis=0) if known else np.zeros(3)
    monkeypatch.setattr(joins, "MIN_HOT_ROWS", 5)
    for limit in (0, 3_000, 8_000, 1 << 28):
        got = {r.doc_id: r.vec for r in embed.lookup_doc_vectors(term_counts(docs), lookup, docs, 3, limit).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i].tolist()) for i in want)


def test_broadcast_level_keeps_within_the_limit(spark):
    rows = [(f"w{i}", [0.5] * 4, n) for i, n in enumerate([1] * 50 + [2] * 20 + [10] * 5 + [100])]
    ranked = spark.createDataFrame(rows, "tok string, vec array<double>, n long")
    size = ranked.select(joins.row_bytes(ranked.schema).alias("b")).first().b
    kept = lambda limit: ranked.where(embed._level() >= embed._broadcast_level(ranked, limit)).count()
    assert [kept(n * (size + 1)) for n in (0, 1, 5, 6, 26, 75, 76)] == [0, 1, 1, 6, 26, 26, 76]



def test_star_cosine_keeps_pairs_without_a_vector(spark):
    table = spark.createDataFrame([("c", 1, "l"), ("c", 2, "l"), ("c", 3, "m"), ("c", 4, "l")], "case_id string, doc_id long, label string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "doc_id long, vec array<double>")
    for size in (0, 1 << 20):
        got = {r.doc_id: (r.is_clone, r.similarity) for r in embed.star_cosine(table, vecs, size).collect()}
        assert got == {2: (True, pytest.approx(math.sqrt(0.5))), 3: (False, 0.0), 4: (True, None)}


def test_pca(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "id int, vec array<double>")
    got = np.array([r.pc for r in embed.pca_projection(df).orderBy("id").collect()])
    _, _, axes = np.linalg.svd(data - data.mean(0))
    assert np.allclose(np.abs(got), np.abs(data @ axes[:2].T), atol=1e-8)


def test_a_run_overwrites_itself_and_the_latest_run_fills(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(1, [float(n)]), (2, [0.5])], "key long, embedding array<double>")
    path = str(tmp_path / "store")
    for _ in range(2):
        vs.write_vectors(rows(1), path, "20240101")
    vs.write_vectors(rows(2), path, "20240102")
    stored = vs.read_vectors(spark, path)
    assert stored.count() == 4
    needed = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    done = vs.backfill(needed, stored, "key", lambda m: m.withColumn("embedding", F.array(F.lit(9.0))))
    assert sorted((r.key, r.embedding, r.origin) for r in done.collect()) == [(1, [2.0], "stored"), (2, [0.5], "stored"), (3, [9.0], "computed")]


def test_anchors_against_all_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 7, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(60, 3, [0.0] * 5), (61, 3, None), (62, 2, [1.0, None, 1.0, 0.0, 0.0]), (63, None, [1.0] * 5), (64, 1, [1.0] * 4)]
    table = spark.createDataFrame(rows, "doc_id long, label int, vec array<double>").repartition(3)
    anchors = {i: (label, np.array(v)) for i, label, v in rows[:7]}
    for limit in (1 << 20, 100):
        got = {(r.anchor_id, r.doc_id): (r.is_clone, r.similarity) for r in embed.anchor_cosine(table, limit).collect()}
        assert got.keys() == {(a, i) for a in anchors for i, _, _ in rows[7:]}
        for (a, i), (same, score) in got.items():
            label, vec = rows[i][1:]
            assert same == (label == anchors[a][0])
            if i in (61, 62, 64):
                assert score is None
            elif i == 60:
                assert score == 0
            else:
                v, w = np.array(vec), anchors[a][1]
                assert score == pytest.approx(v @ w / np.linalg.norm(v) / np.linalg.norm(w))
    assert embed.anchor_cosine(table.limit(0)).count() == 0


def test_word_vectors_shuffle_pairs_and_not_sums(spark, monkeypatch, capsys):
    words = [["a", "b", "a", "a", None, "c"], ["c", "é"], ["z"], [], None, ["b", "a", "c", "b"] * 5]
    table = spark.createDataFrame([(w,) for w in words], "tokens array<string>")
    want = Counter()
    for w in words:
        for i, x in enumerate(w or []):
            for y in (w or [])[i + 1 : i + 3]:
                if x is not None and y is not None:
                    want.update([(x, y), (y, x)])
    for paired in (1 << 19, 3):
        monkeypatch.setattr(embed, "PAIRED", paired)
        assert {(r.tok, r.other): r.n for r in embed.cooccurrences(table, 2).collect()} == want
    table = table.where("tokens is not null and not exists(tokens, t -> t is null)")
    plain = {r.tok: r.vec for r in embed.w2v_train(table, dim=70, window=2).collect()}
    monkeypatch.setattr(embed, "MIN_HOT_ROWS", 1)
    monkeypatch.setattr(embed, "SUMMED", 2)
    made = embed.w2v_train(table, dim=70, window=2)
    hot = {r.tok: r.vec for r in made.collect()}
    assert set(plain) == set(hot) == {"a", "b", "c", "é", "z"} and all(len(v) == 70 for v in hot.values())
    assert all(abs(x - y) < 1e-9 for t in plain for x, y in zip(plain[t], hot[t], strict=True)) and not any(plain["z"])
    # Each word's pairs meet by a plain shuffle, without sums of `dim` numbers before it.
    capsys.readouterr()
    made.explain()
    assert "REPARTITION_BY_COL" in capsys.readouterr().out


def test_signs_are_drawn_once_for_each_word_and_not_for_each_pair(spark, monkeypatch, capsys):
    words = ["w", "é", "", "x" * 300, "z#1"]
    table = spark.createDataFrame([(w,) for w in words], "tok string")
    want = {r.tok: r.signs for r in table.select("tok", F.array(*embed.random_signs(F.col("tok"), 130, 7)).alias("signs")).collect()}
    pairs = pa.RecordBatch.from_arrays([pa.array(words + words), pa.array(words + words), pa.array([1.0] * 10)], ["tok", "other", "w"]).slice(0, 5)
    drawn = []
    monkeypatch.setattr(embed, "md5", lambda text: drawn.append(text) or hashlib.md5(text))
    run = embed._signed_sums(130, 7)
    for _ in range(2):
        assert {t: v for b in run(iter([pairs])) for t, v in zip(*b.to_pydict().values())} == want
    # Three draws of 60 signs for each word, however often it is met.
    assert len(drawn) == 3 * len(words)
    made = embed.w2v_train(spark.createDataFrame([(words,)], "tokens array<string>"), dim=8, window=2)
    capsys.readouterr()
    made.explain()
    assert "md5" not in capsys.readouterr().out


def test_split_lookup_makes_the_terms_once(spark):
    """With a lookup too large to broadcast whole, each term is made once, not once for each of the three uses."""
    made = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(d, f"w{i}", 1) for d in range(6) for i in range(d + 1)]
    terms = spark.createDataFrame(rows, "doc_id long, tok string, cnt long").mapInArrow(passed, "doc_id long, tok string, cnt long")
    lookup = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(5)], "tok string, vec array<double>")
    docs = spark.range(7).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.vec for r in embed.lookup_doc_vectors(terms, lookup, docs, 2, broadcast_bytes=150).collect()}
    assert got == {d: [sum(range(min(d, 4) + 1)) / (min(d, 4) + 1), 1.0] for d in range(6)} | {6: [0.0, 0.0]}
    assert made.value == len(rows)
