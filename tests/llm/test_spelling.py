"""Spelling variants against plain loops over all words and all edits."""

import random
import re
import zlib
from collections import Counter

import pytest

from cloneflow.llm import spelling

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def plain_words(rows, least=5, min_count=3, every=97):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least and n >= min_count}


def plain_groups(words, factor=2):
    near = {}
    for w in words:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))}
        made |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in LETTERS}
        made |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS}
        near[w] = [v for v in made if v in words and v != w]
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    rows = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return rows


def misspelt(rng, word):
    i, kind = rng.randrange(len(word)), rng.randrange(4)
    return [word[:i] + word[i + 1 :], word[:i] + rng.choice(LETTERS[:30]) + word[i + 1 :], word[:i] + word[i] + word[i:], word][kind]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = ["letters", "balloon", "aaaaaa", "spelling", "Straße", "ÀÉÎõü", "mississippi", "kitten", "sitten", "abcde", "abcdef", "zzzzz"]
    made = []
    for i in range(500):
        words = []
        for _ in range(rng.randrange(40)):
            word = rng.choice(base[: rng.randrange(1, 13)])
            for _ in range(rng.randrange(3)):
                word = misspelt(rng, word) or word
            words.append(word.upper() if rng.random() < 0.1 else word)
        made.append((i, rng.choice([" ", ", ", "×1", "\n"]).join(words)))
    long = "ab" * 3000 + "c"
    made += [(None, "letters letter lettersx"), (None, None), (900, ""), (901, "a b c"), (77, "repeated rows"), (77, "repeated rows"), (77, "repeated rows")]
    return made + [(902 + i, f"{long} {long[:-1]} {long}d") for i in range(4)]


@pytest.mark.parametrize("parts,counted,piece", [(1, 200_000, 1 << 20), (5, 10, 7)])
def test_equal_to_plain_loops(spark, rows, docs_of, monkeypatch, parts, counted, piece):
    monkeypatch.setattr(spelling, "MAX_COUNTED", counted)
    monkeypatch.setattr(spelling, "PIECE_CHARS", piece)
    # Functions travel to the workers by name: what is patched here is checked on the spot as well.
    words = Counter()
    for doc_id, text in rows:
        spelling.document_words(doc_id, text or "", words, 5)
    want = plain_words(rows)
    assert {w: n for w, n in words.items() if n >= 3} == want
    docs = docs_of([t for _, t in rows], [i for i, _ in rows]).repartition(parts)
    made = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_spellings(docs).collect()}
    assert made == plain_groups(want)
    assert any(f and r != f for f, r, *_ in made.values()), "no chain of forms"


def test_nodes_of_all_prefixes_across_ranges(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(600)} | {"é", "éé", "a" * 500})
    made = spelling.number_nodes(spark.createDataFrame([(w,) for w in words], "word string").repartition(6), "word", "nodes").collect()
    named = {}
    for r in made:
        assert len(r.nodes) == len(r.word)
        for i, node in enumerate(r.nodes):
            assert named.setdefault(r.word[: i + 1], node) == node
    assert len(set(named.values())) == len(named) and 0 not in named.values()
    last = [r.nodes[-1] for r in sorted(made, key=lambda r: r.word)]
    assert last == sorted(last)


def test_shared_prefix_and_slips():
    assert [spelling.shared_prefix(*p) for p in [("", "a"), ("ab", "ab"), ("ab", "abc"), ("abc", "ab"), ("abx", "aby")]] == [0, 2, 2, 2, 2]
    assert spelling.slipped("hello", 97 * 5) == "ello" and spelling.slipped("hello", 98) == "hello"


def test_no_words(docs_of):
    assert spelling.group_spellings(docs_of([])).count() == 0
    assert spelling.group_spellings(docs_of([None, "", "1 2"])).count() == 0
