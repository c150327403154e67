"""Alignment against plain loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cloneflow.llm import alignment

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "漢字", "😀", "\x00", "0", "12", "'s", "<s>", "<unk>", "<0x41>", "<|endoftext|>", "-", "ﬁ", "\xa0", "aaaa", "Über", "word ", "etymology "]


def texts():
    rng = random.Random(5)
    made = [None, "", " ", "  x", "\n", "x" * 900, "12 " * 300, "▁", "a▁b", "the same text", "the same text", "<|endoftext|> here", "漢字仮名" * 50, "new letters \u0558's \u088f1 x", "é" * 70 + "😀" * 40]
    return made + ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 30))) for _ in range(400)]


def plain(texts):
    a_lib, b_lib = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a_lib.encode_special_tokens = True
    shown = {b: c for c, b in alignment.byte_of_character().items()}
    rows, holders = [], Counter()
    for text in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": [], "groups": None}
        rows.append(row)
        if not text:
            continue
        data = (" " + text).encode()
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        a_parts = [a_lib.id_to_token(i) for i in a]
        b_parts = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in b)]
        if "".join(a_parts) != "".join(shown[x] for x in data) or b"".join(b_parts) != data:
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in a_parts]).tolist(), np.cumsum([len(p) for p in b_parts]).tolist()
        groups, start = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a) if start < e <= cut], [i for i, e in zip(b, ends_b) if start < e <= cut]))
            start = cut
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        row.update(n_a=len(a), n_b=len(b), n_groups=len(groups), links=links)
        row["groups"] = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        holders.update(set(links))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    made = []
    for row in rows:
        links = row["links"]
        digest = hashlib.sha256(row["groups"].encode()).hexdigest() if row["groups"] is not None else ""
        n_best = sum(holders[k] == best[k[0]] for k in links)
        made.append((row["n_a"], row["n_b"], row["n_groups"], len(links), n_best, sum(holders[k] for k in links), digest))
    return made


@pytest.mark.parametrize("most", [alignment.FREQUENT, 40, 0])
def test_equal_to_plain_loops(docs_of, most):
    made, want = texts(), plain(texts())
    docs = docs_of(made).repartition(3)
    got = {r.doc_id: r for r in alignment.alignment_report(docs, FIRST, SECOND, most).collect()}
    assert len(got) == len(made)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, made[i]


def test_parts_and_dense_groups_change_nothing(monkeypatch):
    both, made = alignment.Both(FIRST, SECOND), [t or "" for t in texts()] + ["many words in one text " * 40 + "  two blanks 12 a"]

    def plain_rows():
        return [(*r[:5], list(r[5]), list(r[6])) for t in made for r in alignment.align(both, [t])]

    want = plain_rows()
    assert [(*r[:5], list(r[5]), list(r[6])) for r in alignment.align(both, made)] == want
    monkeypatch.setattr(alignment, "PART_CHARS", 5)
    monkeypatch.setattr(alignment, "DENSE", 1)
    assert plain_rows() == want


def test_null_ids_repeats_and_no_rows(docs_of):
    made = alignment.alignment_report(docs_of(["one two", "one two", None, "three"], [None, None, 7, 7]), FIRST, SECOND).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_a) for r in made) == [(False, 7, 0), (False, 7, 1), (True, 0, 2), (True, 0, 2)]
    assert alignment.alignment_report(docs_of([]), FIRST, SECOND).count() == 0
    assert {r.groups_sha256 for r in alignment.alignment_report(docs_of([None, "", "▁"]), FIRST, SECOND).collect()} == {""}


def test_coalesce():
    first, second = alignment.coalesce(np.array([3, 2, 1, 1]), np.array([1, 1, 1, 3, 1]))
    assert first.tolist() == [0, 1, 1, 2] and second.tolist() == [0, 0, 0, 1, 2]


def test_lossy_first_tokenizer_leaves_no_tokens():
    both = alignment.Both(FIRST, SECOND)
    both.bytes[0][both.first.tokenizer.encode(" the", add_special_tokens=False).ids[0]] = b"?"
    bad, good = alignment.align(both, ["the", "words of another text"])
    assert bad == (0, 0, 0, 0, b"", [], []) and good[0] > 0
