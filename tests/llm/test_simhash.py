import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cloneflow.llm import simhash
from cloneflow.llm.components import connected_components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, fps):
    best = dict(enumerate(range(len(fps))))

    def find(x):
        while best[x] != x:
            x = best[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                best[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def clustered(rng, centres, near, far):
    """Fingerprints around a few centres, chains of small steps, and strangers."""
    found = [rng.getrandbits(64) for _ in range(far)]
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(near):
            found.append(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
            c ^= 1 << rng.randrange(64) if rng.random() < 0.2 else 0
    return sorted(set(found))


def test_fingerprints(docs_of):
    texts = [None, "", " \t\n", "One", "a B c", "a b c d", "A b C d e  f\x0bg", "é x   É y z w", "w " * 3000, "x" * 5000 + " y z " + "q " * 50]
    got = {r.doc_id: r.fp for r in simhash.fingerprints(docs_of(texts)).collect()}
    assert [got[i] % 2**64 for i in range(len(texts))] == [brute_fingerprint(t) for t in texts]


def test_pieces_of_a_long_text_meet(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "Beta", "γ", "d" * 30]) + str(rng.randint(0, 9)) for _ in range(400))
    want = simhash.fingerprint(text)
    for size in (1, 7, 64, 500):
        monkeypatch.setattr("cloneflow.llm.common.PIECE_BYTES", size)
        assert simhash.fingerprint(text) == want
    assert want % 2**64 == brute_fingerprint(text)


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    fps = clustered(rng, 4, 60, 150)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = brute_classes(list(range(len(fps))), fps)
    for most in (4096, 12):
        edges = simhash.links(frame, len(fps), max_bucket=most)
        assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
        roots = {np.int64(r.node).view(np.uint64).item(): r.root for r in connected_components(edges).collect()}
        groups = {}
        for f, c in zip(fps, want, strict=True):
            groups.setdefault(c, []).append(f)
        for members in groups.values():
            assert len({roots.get(f, f) for f in members}) == 1
        assert len({roots.get(f, ("alone", f)) for f in fps}) == len(groups)


def test_classes(docs_of):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts, ids = [None, "", "lonely"], [50, 51, None]
    for g in range(5):
        base = [rng.choice(words) for _ in range(400)]
        for c in range(6):
            copy = list(base)
            copy[rng.randrange(400)] = f"changed{c}"
            texts.append(" ".join(copy if c else base))
            ids.append(100 - 6 * g - c)
    texts += [texts[5], texts[5], texts[9]]
    ids += [ids[5], None, ids[5]]
    got = simhash.near_classes(docs_of(texts, ids)).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = sorted(zip(ids, fps, brute_classes(ids, fps), strict=True), key=repr)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == want
    kept = simhash.dedup(docs_of(texts, ids))
    assert kept.columns == docs_of([]).columns
    names = [r.doc_id for r in kept.collect()]
    assert sorted(names, key=repr) == sorted({c for _, _, c in want if c is not None}, key=repr) + [None] * (None in [c for *_, c in want])
    assert simhash.near_classes(docs_of([])).count() == 0


def test_components_of_chains_and_a_star(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(5, 5), (9, 8), (8, 9)]
    rng.shuffle(pairs)
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(roots[i] == 100 for i in range(100, 161)) and all(roots[i] == 7 for i in range(200, 300))
    assert roots[5] == 5 and roots[8] == roots[9] == 8
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
