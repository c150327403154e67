import hashlib
import random
import re

import numpy as np
import pytest

from cloneflow.functions import text as tx
from cloneflow.operators import embed, graph, joins
from cloneflow.operators.measures import term_counts
from cloneflow.plans import catalog
from cloneflow.session import materialize
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(24)]
    texts[9], texts[10], texts[15] = texts[1], "", "solo"  # 9 is an exact copy of its original
    rows = [(f"c{i % 2}", i, "l", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "case_id string, doc_id long, label string, text string"), rows


def edges_of(text):
    t = text.split()
    return set(zip(t, t[1:]))


def test_nodes_edges_stats(docs):
    table, rows = docs
    nodes = {}
    for r in graph.graph_nodes(table).orderBy("doc_id", "pos").collect():
        nodes.setdefault(r.doc_id, []).append(r.token)
    assert nodes == {d: list(dict.fromkeys(t.split())) for _, d, _, t in rows if t}
    got = sorted((r.doc_id, r.src, r.dst) for r in graph.graph_edges(table).collect())
    assert got == sorted((d, *e) for _, d, _, t in rows for e in edges_of(t))
    stats = {r.doc_id: (r.nodes, r.edges) for r in graph.graph_stats(table).collect()}
    assert stats == {d: (len(set(t.split())), len(edges_of(t))) for _, d, _, t in rows}
    made = {r.doc_id: r.tokens for r in graph.edge_tokens(graph.graph_edges(table)).collect()}
    assert made == {d: sorted(f"{u}->{v}" for u, v in edges_of(t)) for _, d, _, t in rows if edges_of(t)}


def test_padding(docs):
    table, rows = docs
    text = {d: t for _, d, _, t in rows}
    got = {}
    for r in graph.pad_nodes(table).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.a_node, r.b_node))
    for doc, both in got.items():
        a, b = text[doc % 2].split(), text[doc].split()
        n = max(len(a), len(b))
        pad = lambda t: (d := list(dict.fromkeys(t))) + [f"DUMMY_NODE_LABEL_{i}" for i in range(len(d), n)]
        assert both == list(zip(pad(a), pad(b)))
    assert len(got) == 22


def test_method_param_edges(spark):
    code = """class A {
      int f(int x, final String[] y) throws E, F { if (x) { h(z); } return 1; }
      void g() { while (q) { } }
    }"""
    table = spark.createDataFrame([(1, code)], "doc_id long, text string")
    got = {(r.src, r.dst) for r in graph.method_param_edges(table).collect()}
    assert got == {("x", "f"), ("y", "f")}
    loose = {(r.src, r.dst) for r in graph.method_param_edges(table, with_body=False).collect()}
    assert loose == {("x", "f"), ("y", "f"), ("z", "h")}


def test_walks_follow_edges_in_both_join_strategies(docs):
    table, rows = docs
    edges = graph.corpus_edges(table)
    want = {e for _, _, _, t in rows for e in edges_of(t)}
    assert {(r.src, r.dst) for r in edges.collect()} == want
    nodes = {u for e in want for u in e}
    runs = []
    for size in (0, 1 << 30):
        walks = {r.walk_id: r.tokens for r in graph.random_walks(edges, 6, 3, broadcast_bytes=size).collect()}
        assert len(walks) == 3 * len(nodes)
        ends = nodes - {u for u, _ in want}
        for key, path in walks.items():
            assert path[0] == key.rsplit("#", 1)[0]
            assert all(step in want for step in zip(path, path[1:]))
            assert len(path) == 6 or path[-1] in ends
        runs.append(walks)
    assert runs[0] == runs[1]


def test_walks_are_the_same_when_every_key_is_hot(docs, monkeypatch):
    table, _ = docs
    edges = graph.corpus_edges(table)
    walk = lambda size: sorted(map(str, graph.random_walks(edges, 4, 2, broadcast_bytes=size).collect()))
    plain = walk(1 << 30)
    monkeypatch.setattr(joins, "MIN_HOT_ROWS", 1)
    assert walk(0) == plain


def test_walks_that_meet_go_on_apart(spark):
    """Every walk draws each step for itself: walks that are at one node after the same number of steps do not share what follows."""
    nodes = [f"n{i}" for i in range(12)]
    edges = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "src string, dst string")
    length, walks = 9, 20
    found = {r.walk_id: r.tokens for r in graph.random_walks(edges, length, walks).collect()}
    assert len(found) == 240 and all(len(w) == length for w in found.values())
    # Shared segments of two steps or more would leave at most `walks` continuations of a node.
    after = {tuple(w[i : i + 4]) for w in found.values() for i in range(2, length - 3)}
    of_node = {n: sum(a[0] == n for a in after) for n in nodes}
    assert min(of_node.values()) > 2 * walks
    # Brute force of one generator per walk.
    order = sorted(nodes, key=lambda n: (int(hashlib.md5(n.encode()).hexdigest()[:15], 16) % joins.SHARDS, n))
    for key, walk in found.items():
        h = int(hashlib.md5(f"42#{key}".encode()).hexdigest()[:15], 16)
        s, t, want = 1 + h % 2147483562, 1 + (h >> 30) % 2147483398, [key.split("#")[0]]
        for _ in range(length - 1):
            s, t = s * 40014 % 2147483563, t * 40692 % 2147483399
            want.append(order[(s - t) % 2147483562 % 12])
        assert walk == want
    draws = np.bincount([order.index(w) for walk in found.values() for w in walk[1:]], minlength=12)
    assert draws.min() > 100 and draws.max() < 220


def test_spectral_space_matches_dense_iteration(docs):
    table, rows = docs
    edges = graph.corpus_edges(table)
    dim = 4
    got = {r.tok: r.vec for r in embed.spectral_embed(edges, dim=dim, rounds=40).collect()}
    toks = sorted(got)
    at = {t: i for i, t in enumerate(toks)}
    adj = np.zeros((len(toks), len(toks)))
    for _, _, _, text in rows:
        t = text.split()
        for u, v in zip(t, t[1:]):
            adj[at[u], at[v]] += 1
            adj[at[v], at[u]] += 1
    d = adj.sum(1)
    values, axes = np.linalg.eigh(adj / np.sqrt(np.outer(d, d)))
    x = np.array([got[t] for t in toks])
    assert np.allclose(x.T @ x, np.eye(dim), atol=1e-8)
    top = axes[:, -1]  # the leading direction lies in the found space
    assert np.linalg.norm(x @ (x.T @ top)) > 0.999


def test_spectral_space_has_converged_with_the_parameters_of_the_query(spark):
    """A random graph of more nodes than the block has vectors, whose leading values lie close together: every vector is an eigenvector, and no
    larger value is missed."""
    rng = random.Random(3)
    n = {}
    for i in range(1, 240):
        for _ in range(2):
            n[f"w{i}", f"w{rng.randrange(i)}"] = rng.randint(1, 5)
    edges = spark.createDataFrame([(u, v, k) for (u, v), k in n.items()], "src string, dst string, n long")
    got = {r.tok: r.vec for r in embed.spectral_embed(edges, catalog.LEARNED_DIM).collect()}
    toks = sorted(got)
    at = {t: i for i, t in enumerate(toks)}
    adj = np.zeros((len(toks), len(toks)))
    for (u, v), k in n.items():
        adj[at[u], at[v]] += k
        adj[at[v], at[u]] += k
    d = adj.sum(1)
    s = adj / np.sqrt(np.outer(d, d))
    x = np.array([got[t] for t in toks])
    assert np.allclose(x.T @ x, np.eye(16), atol=1e-8)
    values = np.diag(x.T @ s @ x)
    assert np.linalg.norm(s @ x - x * values, axis=0).max() <= 2e-5
    assert np.allclose(values, np.linalg.eigvalsh(s)[::-1][:16], atol=1e-8)
    with pytest.raises(RuntimeError, match="residual"):
        embed.spectral_embed(edges, catalog.LEARNED_DIM, rounds=1)
    few = {r.tok: r.vec for r in embed.spectral_embed(edges.where("src = 'w1'"), 4).collect()}
    assert len(few) == 2 and all(len(v) == 4 and v[2:] == [0.0, 0.0] for v in few.values())


def copies_score_one(scores, copy=9):
    got = {r.doc_id: r.similarity for r in scores.collect()}
    assert got[copy] == pytest.approx(1.0)
    assert got[10] == 0.0
    assert all(-1 - 1e-9 <= s <= 1 + 1e-9 for s in got.values()) and len(got) == 22


def graph_scores(table, lookup, dim):
    nodes = graph.graph_nodes(table).select("doc_id", F.col("token").alias("tok"))
    return embed.graph_similarity(table, lookup, nodes, dim)


def test_learned_vectors_score_copies_one(docs):
    table, rows = docs
    vocabulary = {t for _, _, _, text in rows for t in text.split()}
    sentences = table.select(tx.tokens(F.col("text")).alias("tokens"))
    trained = embed.w2v_train(sentences, dim=8)
    assert {r.tok for r in trained.collect()} == vocabulary
    raw = embed.w2v_doc_vectors(term_counts(table), trained, table, 8, unit=False)
    copies_score_one(embed.star_cosine(table, raw))
    unit = {r.doc_id: np.linalg.norm(r.vec) for r in embed.w2v_doc_vectors(term_counts(table), trained, table, 8).collect()}
    assert unit[10] == 0 and unit[1] == pytest.approx(1.0)
    walks = graph.random_walks(graph.corpus_edges(table), 5, 2)
    copies_score_one(graph_scores(table, embed.w2v_train(walks, dim=8, window=10), 8))
    factors = embed.glove_factorize(graph.corpus_edges(table), dim=8)
    assert {r.tok for r in factors.collect()} == vocabulary - {"solo"}
    copies_score_one(graph_scores(table, factors, 8))


def test_word_vectors_do_not_depend_on_partitions(docs):
    table, rows = docs
    sentences = table.select(tx.tokens(F.col("text")).alias("tokens"))
    one, many = ({r.tok: r.vec for r in embed.w2v_train(sentences.repartition(n), dim=100).collect()} for n in (2, 8))
    assert one.keys() == many.keys() and all(len(v) == 100 and np.allclose(v, many[t], atol=1e-6) for t, v in one.items())


def test_word_vectors_against_brute_force(docs):
    table, rows = docs
    near, window, dim = {}, 2, 70
    for *_, text in rows:
        toks = text.split()
        for i in range(len(toks)):
            for j in range(i + 1, min(i + window + 1, len(toks))):
                for u, v in ((toks[i], toks[j]), (toks[j], toks[i])):
                    near[u, v] = near.get((u, v), 0) + 1
    total = {}
    for (u, _), n in near.items():
        total[u] = total.get(u, 0) + n
    whole = sum(total.values())

    def sign(word, i):
        drawn = int(hashlib.md5(f"42#{i // 60}#{word}".encode()).hexdigest()[:15], 16)
        return 2 * (drawn >> i % 60 & 1) - 1

    got = {r.tok: r.vec for r in embed.w2v_train(table.select(tx.tokens(F.col("text")).alias("tokens")), dim, window).collect()}
    for word in list(got)[:40]:
        want = np.zeros(dim)
        for (u, v), n in near.items():
            if u == word and (w := np.log(n * whole / total[u] / total[v])) > 0:
                want += w * np.array([sign(v, i) for i in range(dim)])
        assert np.allclose(got[word], want, atol=1e-6)


def test_factors_against_brute_force(docs):
    table, rows = docs
    dim, rounds, ridge = 4, 2, 0.05
    n = {}
    for *_, text in rows:
        t = text.split()
        for e in zip(t, t[1:]):
            n[e] = n.get(e, 0) + 1

    def sign(word, i):
        return 2 * (int(hashlib.md5(f"42#0#{word}".encode()).hexdigest()[:15], 16) >> i & 1) - 1

    def solve(known, at, to):
        made = {}
        for node in {e[to] for e in n}:
            left, right = ridge * np.eye(dim + 1), np.zeros(dim + 1)
            for e, count in n.items():
                if e[to] == node:
                    z = np.append(known[e[at]][:dim], 1.0)
                    f = min(1.0, (count / 100) ** 0.75)
                    left += f * np.outer(z, z)
                    right += f * z * (np.log(count) - known[e[at]][dim])
            made[node] = np.linalg.solve(left, right)
        return made

    def loss(a, b):
        error = sum(min(1.0, (c / 100) ** 0.75) * (a[u][:dim] @ b[v][:dim] + a[u][dim] + b[v][dim] - np.log(c)) ** 2 for (u, v), c in n.items())
        return error + ridge * sum(x @ x for side in (a, b) for x in side.values())

    columns = {v: np.array([sign(v, i) / 2 for i in range(dim)] + [0.0]) for _, v in n}
    losses = []
    for _ in range(rounds):
        lines = solve(columns, 1, 0)
        losses.append(loss(lines, columns))
        columns = solve(lines, 0, 1)
        losses.append(loss(lines, columns))
    assert losses == sorted(losses, reverse=True)
    got = {r.tok: np.array(r.vec) for r in embed.glove_factorize(graph.corpus_edges(table), dim, rounds=rounds).collect()}
    none = np.zeros(dim + 1)
    assert got.keys() == lines.keys() | columns.keys()
    # The loss that decides when to stop is the one summed edge by edge.
    edges = graph.corpus_edges(table).select("src", "dst", F.least(F.pow(F.col("n") / 100.0, F.lit(0.75)), F.lit(1.0)).alias("f"), F.log(F.col("n").cast("double")).alias("log"))
    given = {u: line for u, line in lines.items()}
    known = edges.sparkSession.createDataFrame([(u, v.tolist()) for u, v in given.items()], "tok string, vec array<double>")
    fitted = embed._fitted(edges, known, "src", "dst", dim, ridge, edges.groupBy("src").agg(F.count("*").alias("n"))).collect()
    optimum = {r.tok: np.array(r.vec) for r in fitted}
    assert sum(r.loss for r in fitted) + ridge * sum(x @ x for x in given.values()) == pytest.approx(loss(given, optimum))
    for word, vec in got.items():
        assert np.allclose(vec, (lines.get(word, none) + columns.get(word, none))[:dim], atol=1e-6)
    # Left to itself it stops after the first round that takes less than the tolerance off.
    while len(losses) < 4 or losses[-3] - losses[-1] > 1e-2 * losses[-1]:
        lines = solve(columns, 1, 0)
        losses.append(loss(lines, columns))
        columns = solve(lines, 0, 1)
        losses.append(loss(lines, columns))
    own = {r.tok: np.array(r.vec) for r in embed.glove_factorize(graph.corpus_edges(table), dim).collect()}
    assert all(np.allclose(vec, (lines.get(word, none) + columns.get(word, none))[:dim], atol=1e-5) for word, vec in own.items())


def test_word_factors_equal_the_dense_decomposition(docs):
    """Inner products of the factors are those of the truncated decomposition of the same matrix, whatever the partitions and blocks."""
    table, _ = docs
    sentences = table.select(tx.tokens(F.col("text")).alias("tokens"))
    weights = embed.positive_pmi(embed.cooccurrences(sentences, 3)).where(F.col("w") > 0)
    entries = weights.collect()
    toks = sorted({r.tok for r in entries})
    at = {t: i for i, t in enumerate(toks)}
    dense = np.zeros((len(toks), len(toks)))
    for r in entries:
        dense[at[r.tok], at[r.other]] = r.w
    values, axes = np.linalg.eigh(dense)
    order = np.argsort(-np.abs(values))
    # A rank behind which there is a gap.
    sizes = np.abs(values)[order]
    dim = 2 + int(np.argmax(sizes[2:12] / sizes[3:13])) + 1
    lead = order[:dim]
    want = axes[:, lead] * np.abs(values[lead]) @ axes[:, lead].T
    for parts, block in ((2, 8192), (8, 16)):
        got = {r.tok: r.vec for r in embed.factorize(weights.repartition(parts), dim, tolerance=1e-13, rounds=400, block=block).collect()}
        x = np.array([got[t] for t in toks])
        assert x.shape == (len(toks), dim) and np.allclose(x @ x.T, want, atol=1e-6)
    with pytest.raises(RuntimeError, match="still move"):
        embed.factorize(weights, dim, tolerance=0.0, rounds=2)


def test_triangle_of_tall_matrix(spark):
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=(n, 5)) for n in (7, 1, 30, 2, 11)]
    rows = spark.createDataFrame([(p.tobytes(),) for p in parts], "vec binary").repartition(4)
    r = embed.tall_triangle(rows, "vec", 5)
    whole = np.vstack(parts)
    assert np.allclose(r.T @ r, whole.T @ whole)


def test_lonely_nodes_have_vectors_of_their_own(spark):
    lookup = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0])], "tok string, vec array<double>")
    nodes = spark.createDataFrame([(1, "a"), (2, "z"), (3, "only"), (4, "only")], "doc_id long, tok string")
    got = {r.tok: r.vec for r in embed.with_lonely_nodes(lookup, nodes, 2).collect()}
    assert got["a"] == [1.0, 0.0] and set(got) == {"a", "z", "only"}
    assert all(np.linalg.norm(v) == pytest.approx(1.0) for v in got.values())


def test_factors_are_the_same_in_pieces_of_any_size(docs, monkeypatch):
    """Nodes of more edges than a piece holds are summed over several pieces; neither that nor the ranges change the factors."""
    table, _ = docs
    edges = graph.corpus_edges(table)
    plain = {r.tok: r.vec for r in embed.glove_factorize(edges, 4, rounds=1).collect()}
    monkeypatch.setattr(embed, "PIECE_EDGES", 2)
    monkeypatch.setattr(embed, "ROUTES", 1)
    dealt = {r.tok: r.vec for r in embed.glove_factorize(edges, 4, rounds=1, block=3).collect()}
    assert dealt.keys() == plain.keys()
    assert all(np.allclose(dealt[t], plain[t], atol=1e-9) for t in plain)


def test_matrix_pieces_hold_their_rows_in_order_without_a_sort_by_row(spark, monkeypatch):
    rng = np.random.default_rng(5)
    entries = {(int(i), int(j)): float(w) for i, j, w in zip(rng.integers(0, 40, 500), rng.integers(0, 40, 500), rng.random(500))}
    table = spark.createDataFrame([(*k, w) for k, w in entries.items()], "i long, j long, w double")
    monkeypatch.setattr(embed, "PIECE_EDGES", 30)
    plans = []
    monkeypatch.setattr(embed, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or materialize(df, name))
    for by in ("i", "j"):
        found, whole = {}, set()
        for r in embed.matrix_pieces(table, 16, by=by).collect():
            rows, heads, cols, w = (np.frombuffer(r[c], k) for c, k in (("rows", np.int64), ("heads", np.int32), ("cols", np.int32), ("w", np.float64)))
            assert (np.diff(rows) > 0).all() and (r.block, r.piece) not in whole
            whole.add((r.block, r.piece))
            found |= {(int(i), int(r.block * 16 + c)): x for i, c, x in zip(np.repeat(rows, np.diff(np.append(heads, len(cols)))), cols, w)}
        assert found == entries and len({b for b, _ in whole}) == 3 and len(whole) > 12
    physical = [p[p.index("== Physical Plan ==") :] for name, p in plans if name == "matrix"]
    assert len(physical) == 2 and not any(re.search(r"Sort \[[^\n]*\bi#\d+L ASC", p) for p in physical)


def test_walks_carry_only_the_edges_that_were_drawn(docs, monkeypatch):
    """What leaves the numbering of edges is one row per node with edges and slot, not every edge of the graph."""
    table, rows = docs
    edges = {e for *_, t in rows for e in edges_of(t)}
    written = {}

    def counted(df, name):
        made = materialize(df, name)
        written.setdefault(name, []).append(made.count())
        return made

    monkeypatch.setattr(graph, "materialize", counted)
    graph.random_walks(graph.corpus_edges(table), 4, 1).collect()
    assert written["edges"] == [len(edges)]
    assert written["steps"] == [len({u for u, _ in edges})] and written["steps"][0] < len(edges)


def test_node_vectors_join_each_name_once(docs, monkeypatch):
    """Two joins on words, one for each side of a pair, bring numbers and totals; the matrix is that of the names."""
    table, _ = docs
    sentences = table.select(tx.tokens(F.col("text")).alias("tokens"))
    want = {(r.tok, r.other): r.w for r in embed.positive_pmi(embed.cooccurrences(sentences, 3)).where(F.col("w") > 0).collect()}
    named = []

    def seen(big, unique, on, *others, **options):
        named.append(on)
        return joins.join_unique(big, unique, on, *others, **options)

    monkeypatch.setattr(embed, "join_unique", seen)
    nodes, entries = embed.numbered_pmi(embed._half_counts(sentences, 3, "tokens"))
    assert named == [["tok"], ["other"]]
    word = {r.idx: r.tok for r in nodes.collect()}
    assert sorted(word) == list(range(len(word)))
    got = {(word[r.i], word[r.j]): r.w for r in entries.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
