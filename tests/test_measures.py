import math
import random
from collections import Counter
from difflib import SequenceMatcher
from hashlib import md5

import pytest

from cloneflow.operators import joins
from cloneflow.operators import measures as ms
from cloneflow.sources.corpus import star_pairs

FIXTURES = [
    # original, suspect, positional Jaccard, Jaccard, overlap
    ("a b a c", "a b c d e", 3 / 7, 0.6, 0.8),
    ("a b c", "a b c", 1.0, 1.0, 1.0),
    ("a a a", "b b b", 0.5, 0.0, 0.0),
    ("a b", "b a", 0.0, 1.0, 1.0),
    ("", "", None, 0.0, 0.0),
    ("", "a b", 0.0, 0.0, 0.0),
]


def random_docs(n=40, seed=11):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(8)]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    for i in range(4, n, 5):  # near and exact copies
        toks = docs[i % 4].split()
        if toks and i % 2:
            toks[len(toks) // 2] = "changed"
        docs[i] = "\n".join(toks)
    return docs


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"c{i % 4}", i, "x" if i % 3 else "y", t) for i, t in enumerate(random_docs())]
    return spark.createDataFrame(rows, "case_id string, doc_id long, label string, text string").repartition(4), rows


def pairs_of(rows):
    first = {}
    for case, doc, _, text in rows:
        first.setdefault(case, (doc, text))
    return {doc: (first[case][1], text) for case, doc, _, text in rows if first[case][0] != doc}


def grams(toks, k):
    return {tuple(toks[i : i + k]) for i in range(len(toks) - k + 1)}


def jac(a, b, empty=0.0):
    return len(a & b) / len(a | b) if a | b else empty


def macro_positional(a, b):
    n = max(len(a), len(b))
    if n == 0:
        return None
    pad = lambda t: (d := list(dict.fromkeys(t))) + [f"DUMMY_NODE_LABEL_{i}" for i in range(len(d), n)]
    x, y = pad(a), pad(b)
    scores = []
    for label in sorted(set(x) | set(y)):
        both = sum(p == label and q == label for p, q in zip(x, y))
        either = sum(p == label or q == label for p, q in zip(x, y))
        scores.append(both / either)
    return sum(scores) / len(scores)


def edit(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    longer = max(len(a), len(b))
    return 1 - above[-1] / longer if longer else 1.0


def prints(toks):
    h = [int(md5(" ".join(toks[i : i + 5]).encode()).hexdigest()[:15], 16) for i in range(len(toks) - 4)]
    return {min(h[i : i + 4]) for i in range(max(len(h) - 3, 1))} if h else set()


def profile(a, b):
    def metrics(t):
        lines = t.count("\n") + 1
        return [len(t.split()), len(set(t.split())), lines, len(t) / lines, len(t)]

    return sum(min(x, y) / max(x, y) if max(x, y) else 1.0 for x, y in zip(metrics(a), metrics(b))) / 5


def brute(name, a, b):
    x, y = a.split(), b.split()
    cx, cy = Counter(x), Counter(y)
    if name == "graph_node_jaccard":
        return macro_positional(x, y)
    if name == "token_overlap":
        hit = sum(t in cy for t in x)
        total = len(x) + len(y) - hit
        return hit / total if total else 0.0
    if name == "bag_quick_ratio":
        return SequenceMatcher(None, x, y).quick_ratio()
    if name == "graph_edit_similarity":
        nodes = len(set(x)) + len(set(y))
        edits = len(set(x) ^ set(y)) + len(grams(x, 2) ^ grams(y, 2))
        return 1 - edits / nodes if nodes else 0.0
    if name == "bow_cosine":
        lengths = math.sqrt(sum(c * c for c in cx.values())) * math.sqrt(sum(c * c for c in cy.values()))
        return sum(cx[t] * cy[t] for t in cx) / lengths if lengths else 0.0
    if name == "fuzzy_token_sort":
        return edit(" ".join(sorted(x)), " ".join(sorted(y)))
    if name == "rolling_hash":
        return len(grams(x, 5) & grams(y, 5)) / len(grams(x, 5)) if grams(x, 5) else 0.0
    if name == "longest_block":
        block = SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size
        return 2 * block / (len(x) + len(y)) if x or y else 1.0
    if name == "jaccard":
        return jac(set(x), set(y))
    if name == "levenshtein":
        return edit(a, b)
    if name == "metric_profile":
        return profile(a, b)
    if name == "ngram_similarity":
        return jac(grams(x, 3), grams(y, 3))
    if name == "rk_match":
        smaller = min(len(grams(x, 5)), len(grams(y, 5)))
        return len(grams(x, 5) & grams(y, 5)) / smaller if smaller else 0.0
    if name == "winnow":
        return jac(prints(x), prints(y))
    if name in ("comment_similarity", "markup_comment_similarity"):
        return 1.0
    if name == "call_similarity":
        return 0.0
    raise KeyError(name)


def same(got, want):
    return got is None if want is None else got == pytest.approx(want, abs=1e-9)


def test_every_measure_against_brute_force(corpus):
    table, rows = corpus
    names = list(ms.MEASURES)
    scored = ms.score_table(table, names).collect()
    pairs = pairs_of(rows)
    assert sorted(r.doc_id for r in scored) == sorted(pairs)
    for r in scored:
        for name in names:
            assert same(r[name], brute(name, *pairs[r.doc_id])), (name, pairs[r.doc_id], r[name])


def test_clone_label_compares_with_the_original(corpus):
    table, rows = corpus
    label = {doc: lab for _, doc, lab, _ in rows}
    got = {r.doc_id: r.is_clone for r in star_pairs(table, {}).collect()}
    assert got == {d: label[d] == label[d % 4] for d in got}


def test_pairs_do_not_depend_on_the_join_strategy(corpus):
    table, _ = corpus
    features = ms.features_of(["jaccard"])
    both = [star_pairs(table, features, broadcast_bytes=b).orderBy("doc_id").collect() for b in (0, 1 << 30)]
    assert [r.asDict() for r in both[0]] == [r.asDict() for r in both[1]]


def test_results_hold_when_nothing_fits_and_every_key_is_hot(corpus, monkeypatch):
    table, _ = corpus
    jobs = [
        lambda: ms.score_table(table, ["jaccard", "bow_cosine", "longest_block"]),
        lambda: ms.tfidf_cosine(table),
        lambda: ms.minhash_candidates(table),
    ]
    plain = [sorted(map(rounded, job().collect())) for job in jobs]
    monkeypatch.setattr(joins, "fits", lambda *_: False)
    monkeypatch.setattr(joins, "MIN_HOT_ROWS", 2)
    assert [sorted(map(rounded, job().collect())) for job in jobs] == plain


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


def test_fixture_rows(spark):
    rows = [(str(i), 2 * i + side, "l", text[side]) for i, text in enumerate(FIXTURES) for side in (0, 1)]
    table = spark.createDataFrame(rows, "case_id string, doc_id long, label string, text string")
    scored = {int(r.case_id): r for r in ms.score_table(table, ["graph_node_jaccard", "jaccard", "token_overlap"]).collect()}
    for i, (_, _, positional, jaccard, overlap) in enumerate(FIXTURES):
        assert same(scored[i].graph_node_jaccard, positional)
        assert scored[i].jaccard == pytest.approx(jaccard)
        assert scored[i].token_overlap == pytest.approx(overlap)


def test_tfidf_cosine(corpus):
    table, rows = corpus
    df = Counter(t for _, _, _, text in rows for t in set(text.split()))
    idf = {t: math.log((len(rows) + 1) / (n + 1)) for t, n in df.items()}
    vec = lambda text: {t: n * idf[t] for t, n in Counter(text.split()).items()}
    length = lambda v: math.sqrt(sum(w * w for w in v.values()))
    got = {r.doc_id: r.similarity for r in ms.tfidf_cosine(table).collect()}
    for doc, (a, b) in pairs_of(rows).items():
        u, v = vec(a), vec(b)
        whole = length(u) * length(v)
        want = sum(w * v.get(t, 0) for t, w in u.items()) / whole if whole else 0.0
        assert got[doc] == pytest.approx(want, abs=1e-9)


def test_tfidf_moves_rare_words_only(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", f"v{rng.randrange(30)}", f"r{i}x{rng.randrange(9)}", "\u3000"]) for _ in range(rng.randrange(50))) for i in range(60)]
    texts += [None, "", "  ", "alone", texts[1], texts[7], "y" * 100, "y" * 100 + " the"]
    rows = [(None if i in (11, 12) else f"c{i % 7 if i % 3 else 0}", i, "x", t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "case_id string, doc_id long, label string, text string").repartition(3)
    bags = {i: Counter((t or "").split()) for _, i, _, t in rows}
    df = Counter(t for bag in bags.values() for t in bag)
    first, want = {}, {}
    for case, i, _, _ in rows:
        if case is not None and first.setdefault(case, i) != i:
            u, v = ({t: n * math.log((len(rows) + 1) / (df[t] + 1)) for t, n in bags[j].items()} for j in (first[case], i))
            whole = math.sqrt(sum(w * w for w in u.values()) * sum(w * w for w in v.values()))
            want[i] = sum(w * v.get(t, 0) for t, w in u.items()) / whole if whole else 0.0
    moved = []
    join = ms.join_unique
    monkeypatch.setattr(ms, "join_unique", lambda big, unique, on, *args, **named: moved.append((on, big.count())) or join(big, unique, on, *args, **named))
    for frequent, suspects, limit in ((1 << 18, 1 << 10, 1 << 24), (1 << 18, 1, 1), (10, 3, 200), (0, 2, 1 << 24)):
        monkeypatch.setattr(ms, "SPLIT_BYTES", limit)
        moved.clear()
        got = {r.doc_id: r.similarity for r in ms.tfidf_cosine(table, frequent, suspects).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
        words = sum(n for on, n in moved if "tok" in on)
        # A word of more than 64 bytes is never among the frequent ones.
        long = sum(1 for case, i, _, _ in rows if case is not None and "y" * 100 in bags[i])
        assert words == long if frequent == 1 << 18 else words > long


def test_minhash_columns(corpus):
    table, rows = corpus
    pairs = pairs_of(rows)
    p = ms.MINHASH_PRIME

    def signature(text):
        h = [int(md5(t.encode()).hexdigest()[:15], 16) % p for t in set(text.split())]
        return [min((a * x + b) % p for x in h) for a, b in ms.MINHASH_SEEDS] if h else []

    for r in ms.minhash_candidates(table).collect():
        a, b = pairs[r.doc_id]
        x, y = signature(a), signature(b)
        assert r.similarity == pytest.approx(jac(set(a.split()), set(b.split())))
        assert r.estimate == pytest.approx(sum(u == v for u, v in zip(x, y)) / len(ms.MINHASH_SEEDS) if x and y else 0.0)
        assert r.candidate == any(x[i : i + 2] == y[i : i + 2] for i in range(0, 64, 2) if x and y)


def test_vocabulary(corpus):
    table, rows = corpus
    n = Counter(t for r in rows for t in r[3].split())
    docs = Counter(t for r in rows for t in set(r[3].split()))
    assert {r.tok: (r.n, r.docs) for r in ms.vocabulary(table).collect()} == {t: (n[t], docs[t]) for t in n}
    assert {r.tok for r in ms.vocabulary(table, min_count=30).collect()} == {t for t in n if n[t] >= 30}


def test_winnow_passages_against_plain_loops(spark):
    k, window = ms.WINNOW_K, ms.WINNOW_WINDOW
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    original = [rng.choice(words) for _ in range(300)]
    fresh = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    texts = [
        original,
        fresh(20) + original[50:90] + fresh(7) + original[200:230] + fresh(3),
        original,
        original[:4],
        original[10:15],
        ["again"] * 200,
        [],
        original[90:130] + original[20:60],
    ]
    rows = [(i, "a", " ".join(t)) for i, t in enumerate(texts)] + [(20, "b", "again " * 100), (21, "b", "again " * 150), (22, "b", None), (30, None, "x"), (40, "c", None), (41, "c", "a b c d e f")]
    got = ms.winnow_passages(spark.createDataFrame(rows, "doc_id long, case_id string, text string")).collect()

    def prints(toks):
        grams = [" ".join(toks[i : i + k]) for i in range(len(toks) - k + 1)]
        hashes = [int(md5(g.encode()).hexdigest()[:15], 16) for g in grams]
        found = set()
        for i in range(max(len(hashes) - window + 1, 1) if hashes else 0):
            part = hashes[i : i + window]
            found.add((min(part), i + max(j for j, h in enumerate(part) if h == min(part))))
        return found

    want = set()
    for case in "abc":
        some = sorted((i, (t or "").split()) for i, c, t in rows if c == case)
        first = {}
        for h, pos in sorted(prints(some[0][1])):
            first.setdefault(h, pos)
        for doc, toks in some[1:]:
            lines = {}
            for h, pos in prints(toks):
                if h in first:
                    lines.setdefault(pos - first[h], []).append(pos)
            for shift, at in lines.items():
                at.sort()
                start = 0
                for j in range(1, len(at) + 1):
                    if j == len(at) or at[j] - at[j - 1] > window:
                        want.add((case, doc, at[start] - shift, at[start], at[j - 1] - at[start] + k, j - start))
                        start = j
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    for r in got:
        if r.case_id == "a":
            assert texts[r.doc_id][r.b_start : r.b_start + r.n_tokens] == original[r.a_start : r.a_start + r.n_tokens]
    assert sum(r.n_tokens for r in got if r.doc_id == 1) >= 70 - 4 * (window - 1)
    with pytest.raises(ValueError):
        ms.winnow_passages(spark.createDataFrame(rows, "doc_id long, case_id string, text string"), 3, 4)
