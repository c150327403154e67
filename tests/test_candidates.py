"""Near copies of a whole corpus against all pairs."""

import random

from pyspark.sql import functions as F

from cloneflow.operators import candidates, joins
from cloneflow.operators.components import components


def grams_of(text, k=5):
    toks = (text or "").split()
    return {tuple(toks[i : i + k]) for i in range(len(toks) - k + 1)}


def rows_of(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    made = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        made.append(text)
        for _ in range(rng.randrange(12)):
            copy = list(rng.choice(made[-3:]))
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            made.append(copy)
    made += [made[0], made[0], [], ["few", "words"], ["few", "words"]]
    rng.shuffle(made)
    # Cases play no part: copies lie in different ones.
    return [(i, f"case{i % 5}", " ".join(t)) for i, t in enumerate(made)] + [(1000, "case0", None)]


def all_pairs(rows, threshold=0.8):
    sets = {i: grams_of(t) for i, _, t in rows}
    links = {(a, b) for a in sets for b in sets if a > b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return links, root


def test_classes_reach_what_all_pairs_reach(spark):
    rows = rows_of()
    links, want = all_pairs(rows)
    table = spark.createDataFrame(rows, "doc_id long, case_id string, text string").repartition(5)
    got = {r.doc_id: r for r in candidates.minhash_classes(table).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(rows) and any(a % 5 != b % 5 for a, b in links)
    linked = {i for pair in links for i in pair}
    assert all((r.n_links > 0) == (i in linked) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) <= 2 * len(links)
    assert candidates.minhash_classes(table.limit(0)).count() == 0


def test_hot_buckets_give_the_same_classes(spark, monkeypatch):
    rows = rows_of(9)
    table = spark.createDataFrame(rows, "doc_id long, case_id string, text string")
    plain = sorted(map(tuple, candidates.minhash_classes(table).collect()))
    monkeypatch.setattr(joins, "MIN_HOT_ROWS", 1)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins.join_unique, "__defaults__", tuple(0 if d == 64 * 1024 * 1024 else d for d in joins.join_unique.__defaults__))
    assert sorted(map(tuple, candidates.minhash_classes(table).collect())) == plain


def test_every_link_is_verified(spark):
    rows = rows_of(2)
    links, _ = all_pairs(rows)
    table = spark.createDataFrame(rows, "doc_id long, case_id string, text string")
    found = candidates.minhash_links(candidates.shingle_sets(table)).collect()
    assert found and {(r.a, r.b) for r in found} <= links and all(r.similarity >= 0.8 for r in found)


def test_a_bucket_of_texts_that_are_not_alike_loses_no_link(spark, monkeypatch):
    # All 16 least numbers are the same four values in a bucket when the bands hold one row and a few grams are shared by all: rounds with the least
    # document alone would never compare the last two, which are near copies.
    monkeypatch.setattr(candidates, "signatures", lambda sets: sets.select("doc_id", F.array_repeat(F.lit(7), 64).alias("sig")))
    apart = [(i, [100 * i + j for j in range(20)]) for i in range(8)]
    near = [(i, [10_000 + j for j in range(20)] + [20_000 + i]) for i in (8, 9)]
    # 10 is like 11 and like 0, 11 is not like 0: the links of 0 take 10 out of the bucket before 11 has met it.
    chain = [(10, list(range(2, 20)) + [901, 902]), (11, list(range(4, 20)) + [901, 902, 903])]
    rows = apart + near + chain
    sets = spark.createDataFrame([(i, sorted(g)) for i, g in rows], "doc_id long, grams array<long>")
    alike = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(i, j) for i, g in rows for j, h in rows if i > j and alike(g, h) >= 0.8}
    assert want == {(9, 8), (10, 0), (11, 10)}
    for block in (candidates.BLOCK_ROWS, 3):
        monkeypatch.setattr(candidates.unmet_pairs, "__defaults__", (block,))
        assert {(r.a, r.b) for r in candidates.minhash_links(sets).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(7, 7), (300, 300)]
    root = {i: i for pair in links for i in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_are_made_inside_the_row(spark, monkeypatch, capsys):
    monkeypatch.setattr("cloneflow.functions.similarity.HASHED", 3)
    rows = [(1, [5, (1 << 59) + 7]), (2, []), (3, None), (4, [3]), (5, list(range(0, 9000, 7))), (6, [])]
    table = spark.createDataFrame(rows, "doc_id long, grams array<long>").repartition(1)
    want = {i: [min((a * (h % candidates.MINHASH_PRIME) + b) % candidates.MINHASH_PRIME for h in g) for a, b in candidates.MINHASH_SEEDS] for i, g in rows if g}
    made = candidates.signatures(table)
    assert {r.doc_id: r.sig for r in made.collect()} == want
    every = table.select("doc_id", candidates.sim.minhash(F.col("grams"), candidates.MINHASH_SEEDS, candidates.MINHASH_PRIME).alias("sig"))
    assert {r.doc_id: r.sig for r in every.collect()} == {i: want.get(i, []) for i, _ in rows}
    capsys.readouterr()
    made.explain()
    assert "Aggregate" not in capsys.readouterr().out
