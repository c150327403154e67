import random
from collections import Counter
from difflib import SequenceMatcher
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from cloneflow.functions import text as tx
from cloneflow.functions import edit
from cloneflow.functions.edit import distance, longest_block

SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　"


def rows(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")
    return [r.x for r in df.select("id", make(F.col("text")).alias("x")).orderBy("id").collect()]


def random_texts(n=60, words="a b c d e ée ß".split()):
    rng = random.Random(5)
    return ["".join(rng.choice(words) + rng.choice(SPACES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_tokens_split_like_python(spark):
    texts = random_texts() + ["", " ", "\t\n", "one", " lead", "trail "]
    assert rows(spark, texts, tx.tokens) == [t.split() for t in texts]


def test_bag_counts(spark):
    texts = random_texts() + [""]
    got = rows(spark, texts, lambda c: tx.bag(tx.tokens(c)))
    assert [[(e.tok, e.cnt) for e in g] for g in got] == [
        sorted(Counter(t.split()).items(), key=lambda e: e[0].encode()) for t in texts
    ]


def test_gram_hashes_tell_windows_apart(spark):
    texts = random_texts() + ["a b", "a b c"]
    got = rows(spark, texts, lambda c: tx.gram_hashes(tx.tokens(c), 3))
    seen = {}
    for t, hashes in zip(texts, got):
        toks = t.split()
        windows = [tuple(toks[i : i + 3]) for i in range(len(toks) - 2)]
        assert len(hashes) == len(windows)
        for w, h in zip(windows, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_winnow_keeps_window_minima(spark):
    texts = random_texts() + ["a b c d e", "a b c d"]
    got = rows(spark, texts, lambda c: tx.winnow(tx.ordered_gram_hashes(tx.tokens(c), 2), 4))
    for t, prints in zip(texts, got):
        toks = t.split()
        h = [int(md5(" ".join(toks[i : i + 2]).encode()).hexdigest()[:15], 16) for i in range(len(toks) - 1)]
        want = {min(h[i : i + 4]) for i in range(max(len(h) - 3, 1))} if h else set()
        assert set(prints) == want and len(prints) == len(want)


def test_code_features(spark):
    code = 'int f(int x) { // call g(y)\n  String s = "http://x /* no */"; /* two\nlines */ return g(x) + new T(x).h(); }'
    assert set(rows(spark, [code], tx.comment_words)[0]) == {"call", "g", "y", "two", "lines"}
    assert set(rows(spark, [code], tx.called_names)[0]) == {"f", "g", "T", "h"}
    assert rows(spark, ["for (int i) a1 = _b + a1; $c"], tx.identifiers)[0] == ["$c", "_b", "a1", "i"]
    assert rows(spark, ["x <!-- a b -->y<!--c\nd-->"], lambda c: F.sort_array(tx.comment_words(c, markup=True)))[0] == ["a", "b", "c", "d"]


def test_flatten_and_truncate(spark):
    assert rows(spark, ["\na\nb\n"], tx.flatten_lines) == ["ab"]
    assert rows(spark, ["\na\nb\n"], lambda c: tx.flatten_lines(c, with_blank=True)) == ["a b"]
    long = " ".join(str(i) for i in range(600))
    assert rows(spark, [long, "x"], lambda c: F.size(tx.truncate(tx.tokens(c)))) == [512, 1]


def plain_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def test_edit_distance_against_the_full_table():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(0, 90)))
    for _ in range(400):
        a, b = word(), word()
        assert distance(a, b) == distance(b, a) == plain_distance(a, b)
        assert distance(a, a + b) == len(b) and distance(a, a) == 0


def test_longest_block_against_difflib():
    rng = random.Random(4)
    for n in range(300):
        kinds = 1 + n % 4
        a, b = ([rng.randrange(kinds) - (1 << 62) for _ in range(rng.randint(0, 40))] for _ in range(2))
        want = SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
        assert longest_block(np.array(a, dtype="int64"), np.array(b, dtype="int64")) == want
    same = np.zeros(20_000, dtype="int64")
    assert longest_block(same, same[:12_345]) == 12_345


def test_one_text_against_many(monkeypatch):
    rng = random.Random(3)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randint(0, n)))
    for size in (1, 63, 64, 65, 200):
        for step, at_once, read in ((0, 1 << 15, 512), (0, 6, 7), (70_000, 1 << 15, 512)):
            monkeypatch.setattr(edit, "STEP", step)
            monkeypatch.setattr(edit, "AT_ONCE", at_once)
            monkeypatch.setattr(edit, "READ", read)
            a = draw("ab cé\U0001f600", size)
            texts = [draw("ab cdé\U0001f600", n) for n in (2, 64, 90, 90, 300)] + [a, "", a]
            assert edit.distances(a, texts) == [plain_distance(a, t) for t in texts]


def test_winnow_places_of_a_long_text_are_linear(spark):
    """Places without repeats, in a time that does not grow with the square of the text."""
    rng = random.Random(8)
    hashes = [rng.randrange(50) for _ in range(400_000)]
    want = {max(j for j in range(i, i + 4) if hashes[j] == min(hashes[i : i + 4])) for i in range(len(hashes) - 3)}
    table = spark.createDataFrame([(hashes,), ([7, 7],), ([],)], "h array<long>")
    assert "array_distinct" not in str(tx.winnow_places(F.col("h"), 4))
    got = [r.p for r in table.select(tx.winnow_places(F.col("h"), 4).alias("p")).collect()]
    assert [(p.h, p.pos) for p in got[0]] == [(hashes[i], i) for i in sorted(want)]
    assert [len(p) for p in got[1:]] == [1, 0]
