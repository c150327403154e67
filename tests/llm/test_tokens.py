"""Token operators against the libraries whose results they must equal."""

import random
import sys

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cloneflow.llm import pieces, tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "the", "ing", " ", "  ", "   ", "\n", "\t", "▁", "é", "ß", "漢字", "😀", "​", "\x00", "\x1c", "\r\n", "0", "12", "'s", "<s>", "</s>", "<unk>", "<0x41>"]
BITS += ["<|endoftext|>", "-", "...", "ﬁ", "é", "　", "\xa0", "\x85", "aaaa", "mmm", "Über", " \n "]


def texts():
    rng = random.Random(1)
    made = [None, "", " ", "\n", " " * 77, "x" * 3000, "ab" * 2000, "the " * 3000, " " * 50 + "the", "\n" * 9]
    made += ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    made += ["".join(rng.choice("abcdeghinorst") for _ in range(200)) for _ in range(100)]
    return made


def test_pieces_equal_the_library(docs_of):
    model, made = sentencepiece.SentencePieceProcessor(model_file=MODEL), texts()
    docs = docs_of(made)
    encoded, name = pieces.encode(docs, MODEL)
    assert encoded.columns == [*docs.columns, name]
    for r in encoded.collect():
        want = model.encode(made[r.doc_id] or "", add_bos=True, add_eos=True)
        assert pieces.unpacked(r[name].ids) == want and r[name].n_tokens == len(want)
        assert r[name].decoded == model.decode(want)
    assert pieces.round_trip(docs_of([]), MODEL).count() == 0


def test_small_caches_change_nothing(monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(pieces, "CACHE_BYTES", 2000)
    monkeypatch.setattr(pieces, "MAX_PAIRS", 7)
    own = pieces.Pieces(MODEL)
    for t in texts()[:300]:
        assert pieces.unpacked(own.encode(t or "")[0]) == model.encode(t or "", add_bos=True, add_eos=True)
    assert own.held <= 2000 + 1000 and len(own.words) <= 12 and len(own.pairs) <= 7
    monkeypatch.setattr(pieces, "IDLE_BYTES", 500)
    own.cut_back()
    assert len(own.words) <= 2 and not own.older and own.held <= 500
    assert pieces.unpacked(own.encode("the text")[0]) == model.encode("the text", add_bos=True, add_eos=True)


def test_compatible_pairs_are_those_that_encoding_leaves():
    own, rng = pieces.Pieces(MODEL), random.Random(4)
    tokens = [i for i in own.left if own.text[i].isalpha()]
    words = {t: -own.rank[i] for i, t in own.text.items() if i in own.left}
    for _ in range(3000):
        x, y = rng.choice(tokens), rng.choice(tokens)
        made = [t for t, _ in pieces.merge_by_priority(list(own.text[x] + own.text[y]), words)]
        assert own.compatible(x, y) == (made == [own.text[x], own.text[y]])


@pytest.mark.parametrize("frequent,cached,at_once,piece", [(20_000, 24 << 20, 100_000, 1 << 20), (3, 10, 5, 4)])
def test_counts_equal_the_library(docs_of, monkeypatch, frequent, cached, at_once, piece):
    library, made = Tokenizer.from_file(BYTES), texts()
    table = tokencount.frequent_lengths(docs_of(made), BYTES, frequent)
    assert len(table) <= frequent

    class Sent:
        value = table

    monkeypatch.setattr(tokencount, "CACHE_BYTES", cached)
    monkeypatch.setattr(tokencount, "AT_ONCE", at_once)
    monkeypatch.setattr(tokencount, "PIECE_CHARS", piece)
    import pyarrow as pa

    count = tokencount._counter(BYTES, tokencount.unlike_characters(BYTES), Sent).func
    got = next(count(iter([pa.array([t or "" for t in made])]))).to_pylist()
    assert got == [len(library.encode(t or "", add_special_tokens=False).ids) for t in made]


def test_report(docs_of):
    library, made = Tokenizer.from_file(BYTES), texts()
    rows = tokencount.token_report(docs_of(made), BYTES, limit=100).collect()
    for r in rows:
        text = made[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
    assert len(rows) == len(made) and tokencount.token_report(docs_of([]), BYTES).count() == 0


def test_all_characters_between_letters_digits_and_contractions():
    """Every code point behind and before a letter, a digit, a sign and a contraction, as the library counts it."""
    library = Tokenizer.from_file(BYTES)
    unlike = set(tokencount.unlike_characters(BYTES))
    assert 0x0558 in unlike and 10_000 < len(unlike) < 30_000
    own = tokencount.PreTokens(BYTES, sorted(unlike), True, tokencount.token_count)
    points = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    for i in range(0, len(points), 1 << 14):
        some = points[i : i + (1 << 14)]
        plain = "\n".join(f"a{c}'s {c}1{c} x!{c}" for c in map(chr, (p for p in some if p not in unlike)))
        assert not own.foreign(plain)
        parts = library.pre_tokenizer.pre_tokenize_str(plain)
        ends = [len(w) for words, _ in own.lists(plain) for w in words]
        assert ends == [b - a for _, (a, b) in parts]
    text = "a" + chr(min(unlike)) + "'s"
    assert own.foreign(text) and sum(own.encoded(text)) == len(library.encode(text, add_special_tokens=False).ids)
