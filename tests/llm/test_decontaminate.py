import random
import re
import tracemalloc

import numpy as np

from cloneflow.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    words, hit, ids, longest = words_of(text), set(), set(), {}
    for item, other in items:
        test = words_of(other)
        size = min(10, len(test))
        for i in range(len(words)):
            for j in range(len(test) - size + 1 if size else 0):
                if words[i : i + size] == test[j : j + size]:
                    hit |= set(range(i, i + size))
                    ids.add(item)
                    n = size
                    while i + n < len(words) and j + n < len(test) and words[i + n] == test[j + n]:
                        n += 1
                    longest[item] = max(longest.get(item, 0), n)
    return len(words), len(hit), sorted(ids), longest


def made_up():
    rng = random.Random(2)
    draw = lambda n: [rng.choice(["a", "B2", "é", "Ünd", "x", "long-word", "q_r"]) for _ in range(n)]
    items = [(i, " ".join(draw(rng.randint(11, 30)))) for i in range(8)]
    items += [(20, "Seven Seas"), (21, "a x a"), (22, ""), (3, "another text under the number three that is longer than ten words"), (100, items[0][1])]
    texts = [None, "", "...", "no match here", "the seven. SEAS! and seven seasons", " ".join(draw(3000))]
    for _, t in items[:8]:
        texts.append(" ".join(draw(20)) + " " + t.upper() + " , " + " ".join(draw(12)) + " " + t[5:60])
    texts += [items[1][1] + " " + items[1][1], items[2][1] * 3, texts[6], "ÉTÉ été"]
    # Words that repeat, alone and in turns, on both sides.
    items += [(30, "z " * 25), (31, "z w " * 9), (32, "z " * 14 + "w " + "z " * 12), (33, "tick tock " * 3)]
    texts += ["z " * 60, "w " + "z w " * 30, "z " * 13 + "w " * 2 + "z " * 31 + "w " + "z " * 11, "tick tock " * 20, "z " * 24 + "w " + "z " * 5 + "a x a"]
    return texts, items


def rows_of(frame, name):
    return {r.doc_id: r[name] for r in frame.collect()}


def test_against_brute_force(spark, docs_of, monkeypatch):
    texts, items = made_up()
    bench = spark.createDataFrame([*items, (None, "no number"), (77, None), items[0]], "item_id long, text string")
    for block, shard, piece in ((16 << 20, 1 << 20, 1 << 20), (200, 50, 13)):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
        monkeypatch.setattr("cloneflow.llm.common.PIECE_BYTES", piece)
        made, name = decontaminate.find_matches(docs_of(texts), bench, block_bytes=block)
        assert made.columns == [*docs_of([]).columns, name]
        got = rows_of(made, name)
        for i, text in enumerate(texts):
            n, hit, ids, longest = brute(text, items)
            assert (got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) == (n, hit, ids), i
            assert sum(s.stop - s.start for s in got[i].spans) == hit
            best = {}
            for m in got[i].matches:
                best[m.item_id] = max(best.get(m.item_id, (0, 0)), (m.words, -m.start))
            assert {item: size for item, (size, _) in best.items()} == longest
            words = words_of(text)
            for item, (size, start) in best.items():
                tests = [words_of(t) for k, t in items if k == item]
                places = [p for p in range(-start + 1) for t in tests for j in range(len(t) - size + 1) if words[p : p + size] == t[j : j + size]]
                assert min(places) == -start


def test_removal_and_empty_tables(spark, docs_of):
    texts, items = made_up()
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [i for i, t in enumerate(texts) if not brute(t, items)[1]]
    left = decontaminate.remove_contaminated(docs_of(texts), bench)
    assert left.columns == docs_of([]).columns and sorted(r.doc_id for r in left.collect()) == clean
    assert decontaminate.remove_contaminated(docs_of(texts), bench.limit(0)).count() == len(texts)
    assert decontaminate.contamination(docs_of([]), bench).count() == 0


def test_one_word_repeated_takes_linear_memory():
    n = 100_000
    tests = decontaminate.TestWindows([(5, "a " * n), (6, "a " * 40)])
    tracemalloc.start()
    (row,) = decontaminate._batch(tests, ["b " + "a " * (n - 1) + "c"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row["matches"] == [{"item_id": 5, "start": 1, "words": n - 1}, {"item_id": 6, "start": 1, "words": 40}]
    assert row["n_hit"] == n - 1 and peak < 400 << 20


def test_common_prefixes():
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, 2, 200), [7], rng.integers(0, 2, 50), [8]])
    names = decontaminate.substring_names(words)
    a, b = rng.integers(0, len(words), (2, 500))
    a, b = a[a != b], b[a != b]
    for x, y, n in zip(a.tolist(), b.tolist(), decontaminate.common_prefixes(names, a, b).tolist(), strict=True):
        same = 0
        while max(x, y) + same < len(words) and words[x + same] == words[y + same]:
            same += 1
        assert n == same
