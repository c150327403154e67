"""SentencePiece encoding and decoding with a table of last tokens.

Merging by priority gives every prefix of a word exactly one encoding, so it is enough to know each prefix's last token: among
the tokens that end there (an automaton finds them in one scan) it is the one that is compatible with the last token of what
remains before it, that is, merging the two alone would give just these two. Ids are recovered from the end backwards. The work is
linear in the text, however long a word is. No token crosses from a letter into a blank, nor touches a character
that the vocabulary lacks, so words are encoded one by one and remembered by the worker.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneflow.llm.common import give_back, whole_text, with_result

BLANK = "▁"
MAX_WORD, MAX_PAIRS = 48, 200_000
# Bytes, about, of one generation of remembered parts: a worker holds two while its task runs, and of one what fits IDLE_BYTES between tasks.
CACHE_BYTES = 24 << 20
IDLE_BYTES = 16 << 20
RESULT = "n_tokens long, ids binary, decoded string"
ARROW = pa.struct([("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def merge_by_priority(symbols: list[str], priority: dict[str, float]) -> list[tuple[str, tuple[str, str] | None]]:
    """Plain merging: of all neighbours that make a token the best first, the leftmost at a tie. Each symbol comes with its last merge."""
    text, last = list(symbols), [None] * len(symbols)
    after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(text) and (made := text[i] + text[j]) in priority:
            heapq.heappush(heap, (-priority[made], i, j, made))

    for i in range(len(text) - 1):
        offer(i)
    while heap:
        _, i, j, made = heapq.heappop(heap)
        if text[i] is None or after[i] != j or text[j] is None or text[i] + text[j] != made:
            continue
        last[i], text[i], text[j] = (text[i], text[j]), made, None
        after[i] = after[j]
        if after[i] < len(text):
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [(t, s) for t, s in zip(text, last, strict=True) if t is not None]


class Pieces:
    """The tables of one model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        # Blanks stand for the mark that the model has in their place.
        self.text = {i: names[i].replace(BLANK, " ") for i in plain}
        self.byte = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()}
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        token = {t: i for i, t in self.text.items()}
        score = {t: model.get_score(i) for t, i in token.items() if len(t) > 1}
        mixed = [t for t in token if " " in t.lstrip(" ") or (t.startswith("  ") and t.strip(" ")) or "\n" in t]
        blanks = {t: s for t, s in score.items() if not t.strip(" ")}
        words = {t: s for t, s in score.items() if t.strip(" ")}
        if mixed or len(set(words.values())) < len(words) or len(self.byte) < 256 or blanks and max(blanks.values()) >= min(words.values()):
            raise ValueError(f"{path}: tokens across blanks, equal priorities or no byte tokens")
        self.blanks, self.token = blanks, token
        # Rank of a token's merge, earliest first; single characters come before all.
        self.rank = dict.fromkeys(token.values(), -1)
        for n, t in enumerate(sorted(words, key=words.get, reverse=True)):
            self.rank[token[t]] = n
        self.left, self.right = {}, {}
        self.automaton = ahocorasick.Automaton()
        for t, i in token.items():
            if len(t) == 1:
                self.automaton.add_word(t, (1, i))
            elif t in words:
                made = merge_by_priority(list(t), words)
                # A token that merging never makes of its own text never appears.
                if len(made) == 1:
                    self.left[i], self.right[i] = (token[s] for s in made[0][1])
                    self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.merged = {(self.left[i], self.right[i]): i for i in self.left}
        self.size = size
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.find = re.compile(r" *[^ \n]+|\n| +").findall

    def compatible(self, x: int, y: int) -> bool:
        """Whether the text of tokens x and y, alone, is encoded as x and y.

        The merges of both sides are undone from the latest back; at each step, the two tokens that face each other must not make a
        token that would have been merged before the next of these. The left one merges first at a tie.
        """
        known = self.pairs.get(x * self.size + y)
        if known is not None:
            return known
        a, b, limit, fine = x, y, len(self.rank), None
        while fine is None:
            made = self.merged.get((a, b))
            if made is not None and self.rank[made] < limit:
                fine = False
                continue
            of_a, of_b = self.rank[a], self.rank[b]
            if of_a > of_b:
                limit, a = of_a, self.right[a]
            elif of_b >= 0:
                limit, b = of_b + 1, self.left[b]
            else:
                fine = True
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[x * self.size + y] = fine
        return fine

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text whose only blank, if any, is its first character."""
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs, compatible, many = self.pairs, self.compatible, self.size
        for end, (length, token) in self.automaton.iter(word):
            if size[end + 1]:
                continue
            before = last[end + 1 - length]
            # Nothing merges with the beginning or with a character that has no token.
            if before < 0 or (known if (known := pairs.get(before * many + token)) is not None else compatible(before, token)):
                last[end + 1], size[end + 1] = token, length
        ids, at = [], n
        while at:
            if size[at]:
                ids.append(last[at])
                at -= size[at]
            else:
                ids += [self.byte[b] for b in reversed(word[at - 1].encode("utf-8", "replace"))]
                at -= 1
        return ids[::-1]

    def encode_blanks(self, n: int) -> list[int]:
        """Runs of blanks: their tokens share one priority, the lowest, so they merge from the left, after all else."""
        return [self.token[t] for t, _ in merge_by_priority([" "] * n, self.blanks)]

    def encode_part(self, part: str) -> list[int]:
        word = part.lstrip(" ")
        blanks = len(part) - len(word)
        if not word:
            return self.encode_blanks(blanks)
        ids = self.encode_word(" " + word if blanks else word)
        if blanks < 2:
            return ids
        alone = ids[0] == self.token[" "]
        return self.encode_blanks(blanks - 1 + alone) + ids[alone:]

    def decode_part(self, ids: list[int]) -> str:
        try:
            return "".join([self.text[i] for i in ids])
        except KeyError:
            return b"".join([self.raw.get(i) or self.text[i].encode() for i in ids]).decode("utf-8", "replace")

    def part(self, part: str) -> bytes:
        """Packed ids of one part, remembered if it is short: frequent parts outlive a full cache."""
        made = self.older.get(part)
        if made is None:
            made = b"".join([self.packed[i] for i in self.encode_part(part)])
        if len(part) <= MAX_WORD:
            if self.held >= CACHE_BYTES:
                self.older, self.words, self.held = self.words, {}, 0
            self.words[part] = made
            self.held += 190 + 2 * len(part) + len(made)
        return made

    def cut_back(self) -> None:
        """Forgets what was learnt last, down to IDLE_BYTES: frequent parts come early."""
        self.older, kept, held = {}, {}, 0
        for part, made in self.words.items():
            held += 190 + 2 * len(part) + len(made)
            if held > IDLE_BYTES:
                break
            kept[part] = made
        self.words, self.held = kept, min(held, IDLE_BYTES)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids, as little-endian unsigned 32-bit numbers, begin and end included, and the text that decoding them gives."""
        edge = self.packed[self.begin], self.packed[self.end]
        if not text:
            return b"".join(edge), ""
        known, part = self.words.get, self.part
        whole = " " + text.replace(BLANK, " ")
        ids = b"".join([known(p) or part(p) for p in self.find(whole)])
        return edge[0] + ids + edge[1], self.decode_ids(ids)

    def decode_ids(self, ids: bytes) -> str:
        # Decoding takes back the blank that encoding puts first.
        return self.decode_part(np.frombuffer(ids, "<u4").tolist())[1:]


# One per worker process and file: it outlives a task.
_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoder(path: str):
    """An Arrow function from whole texts to `n_tokens, ids, decoded`."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = loaded(path)
        for array in arrays:
            made = [pieces.encode(text.as_py()) for text in array]
            counts = pa.array([len(ids) // 4 for ids, _ in made], pa.int64())
            fields = [counts, pa.array([ids for ids, _ in made], pa.binary()), pa.array([d for _, d in made], pa.string())]
            yield pa.StructArray.from_arrays(fields, fields=list(ARROW))
        pieces.cut_back()
        give_back()

    return F.arrow_udf(run, RESULT)


def encode(docs: DataFrame, path: str) -> tuple[DataFrame, str]:
    """`docs` with a struct of each whole text's ids (packed, begin and end included), their number and their decoded text, and that column's name.

    `path` is the model file, where every executor has it. Null and empty texts have the two edge ids only. All rows and columns stay,
    nothing is shuffled.
    """
    return with_result(docs, encoder(path))


def unpacked(ids: bytes) -> list[int]:
    return [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    made, name = encode(docs.select("doc_id", whole_text().alias("text")), path)
    found = F.col(name)
    return made.select(
        "doc_id", found["n_tokens"].alias("n_tokens"), F.sha2(found["ids"], 256).alias("ids_sha256"), F.sha2(found["decoded"], 256).alias("decoded_sha256")
    )
