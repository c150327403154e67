"""The exact join of similar texts against all pairs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cloneflow.functions import text as tx
from cloneflow.operators import candidates, joins, kgrams
from test_candidates import all_pairs, grams_of, rows_of


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, case_id string, text string")


def pairs_of(rows, threshold, k=5):
    """Similar pairs of the least ids of equal sets."""
    sets = {i: grams_of(t, k) for i, _, t in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    reps = sorted(i for s, i in first.items() if s)
    score = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in reps for b in reps if a > b}
    return {p: s for p, s in score.items() if s >= threshold}


@pytest.mark.parametrize("threshold,k,seed", [(0.8, 5, 4), (0.5, 5, 9), (0.3, 2, 1), (0.95, 1, 3)])
def test_pairs_are_those_of_all_pairs(spark, threshold, k, seed):
    rows = rows_of(seed)
    _, links = kgrams.similar_texts(table_of(spark, rows).repartition(5), k, threshold)
    got = {(r.a, r.b): r.similarity for r in links.collect()}
    want = pairs_of(rows, threshold, k)
    assert got.keys() == want.keys() and want
    assert all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_sizes_at_the_very_threshold(spark):
    # A set of 4n grams within one of 5n grams has a similarity of exactly 0.8.
    rows = [(n * 2 + side, "c", " ".join(f"{n}w{i}" for i in range((4 + side) * n))) for n in range(1, 60, 3) for side in (0, 1)]
    _, links = kgrams.similar_texts(table_of(spark, rows), 1, 0.8)
    assert {(r.a, r.b) for r in links.collect()} == {(n * 2 + 1, n * 2) for n in range(1, 60, 3)}


def test_long_lists_in_blocks(spark, monkeypatch):
    # One text in many versions: its grams are in every list.
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "c", " ".join([*words[: i % 50], f"new{i}", *words[i % 50 :]])) for i in range(150)]
    sets = candidates.shingle_sets(table_of(spark, rows))
    want = set(pairs_of(rows, 0.8))
    for block in (kgrams.BLOCK_ROWS, 7, 1):
        assert {(r.a, r.b) for r in kgrams.similar_sets(sets, 0.8, block).collect()} == want
    monkeypatch.setattr(joins, "MIN_HOT_ROWS", 1)
    monkeypatch.setattr(joins.join_unique, "__defaults__", tuple(0 if d == 64 * 1024 * 1024 else d for d in joins.join_unique.__defaults__))
    assert {(r.a, r.b) for r in kgrams.similar_sets(sets, 0.8, 7).collect()} == want


def test_only_rare_prefixes_are_indexed(spark):
    rows = rows_of(2)
    sets = candidates.shingle_sets(table_of(spark, rows))
    size = {r.doc_id: len(r.grams) for r in sets.collect()}
    indexed = kgrams.rare_prefixes(sets).collect()
    assert indexed and all(r.pos <= size[r.doc_id] - -(-size[r.doc_id] * 8 // 10) for r in indexed)


def test_links_and_classes_with_copies(spark):
    rows = [*rows_of(6), (2000, None, ""), (2001, "c", "a b c d e"), (2002, "c", " a  b c d e ")]
    links, root = all_pairs(rows)
    got = {r.doc_id: r for r in kgrams.kgram_join(table_of(spark, rows)).collect()}
    assert {i: r.class_id for i, r in got.items()} == root
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in p for p in links) for i in root}
    assert kgrams.kgram_join(table_of(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        kgrams.similar_sets(table_of(spark, rows), 1.0)


def test_gram_sets_are_those_of_tokens(spark, monkeypatch):
    spaces = [" ", "\t", "\n", "\x1c", "\x85", "\xa0", " ", " ", " ", " ", "　", "​", "﻿", "\x00"]
    texts = [None, "", "   ", " a", "a b c ", "a b c a b c a b c", "cá \xe9 \U0001f600 a", "a b", "b a b", *[f"a{s}b c{s}{s}a" for s in spaces]]
    table = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "doc_id long, case_id string, text string").coalesce(1)
    for limit in (kgrams.SPLIT_BYTES, 1):
        monkeypatch.setattr(kgrams, "SPLIT_BYTES", limit)
        for k in (1, 2, 3):
            got = {r.doc_id: r.grams for r in kgrams.gram_sets(table, k).collect()}
            assert all(g == sorted(set(g)) for g in got.values())
            plain = {r.doc_id: r.toks for r in table.select("doc_id", tx.tokens(F.col("text")).alias("toks")).collect()}
            sets = {i: {tuple(t[j : j + k]) for j in range(len(t) - k + 1)} if t else set() for i, t in plain.items()}
            named = {}
            for i, runs in sets.items():
                assert len(got[i]) == len(runs)
                for other, more in sets.items():
                    named[i, other] = len(runs & more)
            assert named == {(i, j): len(set(got[i]) & set(got[j])) for i in sets for j in sets}


def test_grams_are_counted_in_buckets(spark, monkeypatch):
    rows = rows_of(3)
    sets = candidates.shingle_sets(table_of(spark, rows)).where(F.size("grams") > 0).repartition(3)
    held = {r.doc_id: r.grams for r in sets.collect()}
    n = Counter(h for grams in held.values() for h in grams)
    want = sorted((i, len(grams), h, n[h]) for i, grams in held.items() for h in grams if n[h] > 1)
    for at_once, bucket in ((1 << 21, 1 << 20), (5, 7), (1, 1)):
        monkeypatch.setattr(kgrams, "AT_ONCE", at_once)
        assert sorted(map(tuple, kgrams.shared_grams(sets, bucket).collect())) == want


def test_only_sets_that_meet_are_sent_to_the_exact_check(spark, monkeypatch):
    rows = rows_of(5)
    sent = []
    monkeypatch.setattr(kgrams, "scored_pairs", lambda pairs, sets: sent.append((pairs, sets)) or candidates.scored_pairs(pairs, sets))
    kgrams.similar_texts(table_of(spark, rows))
    pairs, sets = sent[0]
    ends = {i for p in pairs.collect() for i in p}
    assert ends and len(ends) < len(rows) and {r.doc_id for r in sets.collect()} == ends
