"""Alignment of the tokens of two tokenizers by interval coalescing.

The tokens of both, as byte ranges of one text, are sorted by where they start; the running maximum of their ends is kept, and a
group breaks where a start reaches it, for there tokens of both sides end. Within a group every token of one side is linked to
every token of the other. The texts of a batch stand one behind the other, so a batch is one sort, whatever its number of texts.

How many documents hold a linked pair of ids is counted over the whole corpus. Looking it up needs two tiers: the most frequent pairs, a table of bounded
size, go to every task; a document's rarer pairs, which no single key can dominate, are joined and summed.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneflow.llm.common import give_back, whole_text
from cloneflow.llm.tokencount import PLAIN_CUT, PreTokens, cut_text, unlike_characters, untruncated
from cloneflow.operators.joins import join_unique
from cloneflow.session import materialize

BLANK = "▁"
# A pair of ids is one number: the first above, the second in the lowest bits.
PAIR_BITS = 32
# Pairs that go to every task at most; bytes of text in a batch; links of a group that are written out one by one.
FREQUENT = 1 << 19
BATCH_BYTES = 1 << 19
PART_CHARS = 1 << 19
DENSE = 64
MAX_COUNTED = 1 << 20
# Bytes of ids that a worker remembers while its task runs, and those of an entry besides its text.
CACHE_BYTES, ENTRY_BYTES = 80 << 20, 210
# Ids travel packed, as unsigned 32-bit numbers; the largest one stands for what gives no bytes back.
IDS, LOSSY = "u4", (1 << 32) - 1
LOST = array("I", [LOSSY]).tobytes()


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PackedPreTokens(PreTokens):
    """Remembers packed ids. `tokens` are the bytes of every token."""

    def __init__(self, path: str, unlike: list[int], tokens: list[bytes]):
        super().__init__(path, unlike, False, self.whole_ids, ENTRY_BYTES, CACHE_BYTES)
        self.tokens, self.lossy = tokens, False

    def gives(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids)) == text.encode("utf-8", "replace")

    def whole_ids(self, encoding, text: str) -> bytes:
        """The ids of a pre-token or text, which give its bytes back; otherwise LOSSY stands for it."""
        if self.gives(encoding.ids, text):
            return array("I", encoding.ids).tobytes()
        self.lossy = True
        return LOST

    def values(self, pretokens: list[str]) -> list[bytes]:
        # Without offsets, which nothing reads; the bytes of all are compared at once, and one by one only where they differ.
        made = self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)
        ids = [e.ids for e in made]
        if self.gives(chain.from_iterable(ids), "".join(pretokens)):
            return [array("I", some).tobytes() for some in ids]
        return [self.whole_ids(e, w) for e, w in zip(made, pretokens, strict=True)]


class Both:
    """The two tokenizers with the bytes of all their tokens. The first one's pre-tokens are encoded once for as long as they are remembered."""

    def __init__(self, first: str, second: str, unlike: list[int] | None = None):
        unlike = unlike_characters(first) if unlike is None else unlike
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        plain = untruncated(first)
        byte, size = byte_of_character(), plain.get_vocab_size()
        names = [plain.id_to_token(i) or "" for i in range(size)]
        a = [bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() for n in names]
        count = self.second.get_piece_size()
        pieces = [self.second.id_to_piece(i) for i in range(count)]
        b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.first, self.bytes = PackedPreTokens(first, unlike, a), (a, b)
        self.lengths = tuple(np.array([len(t) for t in side], np.int64) for side in (a, b))
        # Every id in decimal with what can stand behind it: nothing, another of its side, the other side, another group.
        self.text = tuple(np.array([f"{i}{end}" for i in range(len(side)) for end in ("", ",", "|", ";")], object) for side in (a, b))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[list[int]]]:
        """Ids of each text behind a blank, by both, those of the first packed. The second tokenizer puts its own blank first. A long text goes in parts, each of
        which begins with a blank that neither has a token across."""
        parts = [list(cut_text(" " + t, PLAIN_CUT, PART_CHARS)) for t in texts]
        flat = [p for some in parts for p in some]
        own = [None if self.first.foreign(p) else self.pretokens(p) for p in flat]
        long = self.first.learn([words for words in own if words], {})
        get = self.first.known.__getitem__
        a = [b"".join(self.first.encoded(p) if words is None else map(get, words)) for p, words in zip(flat, own, strict=True)]
        self.first.drop(long)
        b = self.second.encode([p[1:] for p in flat], num_threads=1)
        if len(flat) == len(texts):
            return a, b
        bounds = np.cumsum([0, *map(len, parts)]).tolist()
        spans = list(zip(bounds, bounds[1:]))
        return [b"".join(a[i:j]) for i, j in spans], [list(chain.from_iterable(b[i:j])) for i, j in spans]

    def pretokens(self, part: str) -> list[str]:
        lists = [words for words, _ in self.first.lists(part)]
        return lists[0] if len(lists) == 1 else list(chain.from_iterable(lists))

    def covers(self, a: bytes, b: list[int], data: bytes) -> bool:
        """Whether the tokens of either side, joined, are these bytes: known of all that the first one's ids were made of."""
        return not (self.first.lossy and (np.frombuffer(a, IDS) == LOSSY).any()) and b"".join(map(self.bytes[1].__getitem__, b)) == data


def coalesce(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, from the tokens' lengths. Both sides cover the same bytes."""
    ends = np.concatenate([np.cumsum(first), np.cumsum(second)])
    starts = ends - np.concatenate([first, second])
    side = np.repeat([0, 1], [len(first), len(second)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(starts[order][1:] >= reach[:-1])
    found = np.empty(len(order), np.int64)
    found[order] = group
    return found[: len(first)], found[len(first) :]


def _linked(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """`group, first id, second id, times`: the links of all groups; if a group is large, its links as pairs of distinct ids with the
    number of links of each, and otherwise no times."""
    many_a, many_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
    dense = many_a * many_b > DENSE
    heads = np.cumsum(many_b) - many_b
    plain = np.flatnonzero(~dense[of_a]) if dense.any() else np.arange(len(a))
    group = of_a[plain]
    times = many_b[group]
    behind = np.cumsum(times) - times
    at = np.arange(times.sum()) + np.repeat(heads[group] - behind, times)
    found = [[np.repeat(group, times)], [np.repeat(a[plain], times)], [b[at]], [np.ones(len(at), np.int64)]]
    if not dense.any():
        return *(c[0] for c in found[:3]), None
    firsts = np.cumsum(many_a) - many_a
    for g in np.flatnonzero(dense).tolist():
        x, n = np.unique(a[firsts[g] : firsts[g] + many_a[g]], return_counts=True)
        y, m = np.unique(b[heads[g] : heads[g] + many_b[g]], return_counts=True)
        shape = (len(x), len(y))
        made = (np.full(shape, g), np.broadcast_to(x[:, None], shape), np.broadcast_to(y, shape), n[:, None] * m)
        for column, more in zip(found, made, strict=True):
            column.append(more.ravel())
    return tuple(np.concatenate(c) for c in found)


ALIGNED = pa.schema(
    [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)


def align(both: Both, texts: list[str]) -> list[tuple]:
    """For each text, in the order of ALIGNED, its counts, its groups written out, and its distinct pairs with the number of links of each."""
    rows = [(0, 0, 0, 0, b"", [], [])] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    a_of, b_of = both.encode([texts[i] for i in some])
    kept = [(i, a, b) for i, a, b in zip(some, a_of, b_of, strict=True) if both.covers(a, b, b" " + texts[i].encode("utf-8", "replace"))]
    if not kept:
        return rows
    sizes = [np.array([len(k[1]) // 4 for k in kept], np.int64), np.array([len(k[2]) for k in kept], np.int64)]
    a = np.frombuffer(b"".join([k[1] for k in kept]), IDS).astype(np.int64)
    b = np.fromiter(chain.from_iterable(k[2] for k in kept), np.int64, int(sizes[1].sum()))
    of_a, of_b = coalesce(both.lengths[0][a], both.lengths[1][b])
    groups = int(of_a[-1]) + 1
    doc_of_a = np.repeat(np.arange(len(kept)), sizes[0])
    doc_of = np.empty(groups, np.int64)
    doc_of[of_a] = doc_of_a
    in_doc = np.bincount(doc_of, minlength=len(kept))
    links = np.bincount(of_a, minlength=groups) * np.bincount(of_b, minlength=groups)
    links = np.add.reduceat(links, np.cumsum(in_doc) - in_doc)
    # Tokens as text: a group's first side, then its second, and behind each what separates it from the next one.
    group, side = np.concatenate([of_a, of_b]), np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(group, kind="stable")
    group, side = group[order], side[order]
    end = np.full(len(order), 3)
    same = group[1:] == group[:-1]
    end[:-1][same] = np.where(side[1:] == side[:-1], 1, 2)[same]
    tokens = sizes[0] + sizes[1]
    end[np.cumsum(tokens) - 1] = 0
    words, of_first, in_order = np.empty(len(order), object), side == 0, np.concatenate([a, b])[order]
    words[of_first] = both.text[0][in_order[of_first] * 4 + end[of_first]]
    words[~of_first] = both.text[1][in_order[~of_first] * 4 + end[~of_first]]
    stops = np.cumsum(tokens)
    # Distinct pairs of each document, by a sort of one number for (document, pair).
    at, x, y, times = _linked(a, b, of_a, of_b, groups)
    first, second = (len(side) for side in both.lengths)
    key = (doc_of[at] * first + x) * second + y
    if times is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, times = key[order], times[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(heads, len(key))) if times is None else np.add.reduceat(times, heads)
    doc, pair = np.divmod(key[heads], first * second)
    pair = (pair // second) << PAIR_BITS | pair % second
    cuts = np.searchsorted(doc, np.arange(len(kept) + 1))
    for k, (i, _, _) in enumerate(kept):
        text = "".join(words[stops[k] - tokens[k] : stops[k]].tolist()).encode()
        here = slice(cuts[k], cuts[k + 1])
        rows[i] = (int(sizes[0][k]), int(sizes[1][k]), int(in_doc[k]), int(links[k]), text, pair[here], times[here])
    return rows


# One per worker process and pair of files: it outlives a task.
_LOADED: dict[tuple[str, str], Both] = {}


def loaded(first: str, second: str, unlike: list[int]) -> Both:
    if (first, second) not in _LOADED:
        # A task has one core: the library's threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[first, second] = Both(first, second, unlike)
    return _LOADED[first, second]


def _aligner(first: str, second: str, unlike: list[int], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(first, second, unlike)

        def out(ids: list, rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)]
            if digest:
                columns[4] = [hashlib.sha256(g).hexdigest().encode() if n else b"" for g, n in zip(columns[4], columns[0], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, ALIGNED, strict=True)]], names=["doc_id", *ALIGNED.names])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield out(ids, align(both, texts))
                    ids, texts, size = [], [], 0
            if ids:
                yield out(ids, align(both, texts))
        both.first.cut_back()
        give_back()

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, first: str, second: str, digest: bool = False) -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times`: each text's alignment. `groups` is written out (or its digest), `pairs`
    are the distinct linked pairs of ids, first << 32 | second, and `times` the number of links of each."""
    return docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(_aligner(first, second, unlike_characters(first), digest), RESULT)


def _pair_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by pair, summed over as many rows as fit."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy())
        size += len(held[-1])
        if size >= MAX_COUNTED:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def pair_counts(made: DataFrame) -> DataFrame:
    """`pair, n`: in how many documents each pair is linked."""
    local = made.select("pairs").mapInArrow(_pair_counter, "pair long, n long")
    return local.groupBy("pair").agg(F.sum("n").alias("n"))


def _lookup(table):
    """Sums over the pairs that the broadcast table has, and the rest of the pairs with the number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
            cuts = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            pair, links = (x.flatten().to_numpy() for x in (pairs, times))
            at = np.minimum(np.searchsorted(known, pair), len(known) - 1) if len(known) else np.zeros(len(pair), np.int64)
            found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            count = np.zeros(len(pair), np.int64)
            count[found] = n[at[found]]
            tops = np.zeros(len(pair), bool)
            tops[found] = best[at[found]]
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (links * tops, links * count, ~found)]
            best_sum, count_sum, rare = (s[cuts[1:]] - s[cuts[:-1]] for s in sums)
            heads = pa.array(np.concatenate([[0], np.cumsum(rare)]).astype(np.int32))
            left = [pa.ListArray.from_arrays(heads, pa.array(x[~found])) for x in (pair, links)]
            plain = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("pairs", "times")]
            names = [name for name in batch.schema.names if name not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(best_sum), pa.array(count_sum), *left], names=[*names, "n_best", "count_sum", "pairs", "times"])

    return run


def frequent_pairs(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The rows of `counts` above a count that at most `most` rows reach."""
    level = F.floor(F.log2("n")).cast("int")
    reach, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        reach = r.level
    return counts.where(F.lit(False) if reach is None else level >= reach)


def alignment_report(docs: DataFrame, first: str, second: str, most: int = FREQUENT) -> DataFrame:
    """A row per document: `doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`.

    `n_best` are the links whose pair is held by as many documents as any pair of its first id, `count_sum` sums the documents over the
    links. Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an empty digest. Rows that repeat, or
    share an id, are documents of their own. Long texts are encoded in parts, cut where neither tokenizer has a token across.
    """
    made = aligned(docs, first, second, digest=True).withColumn("row", F.monotonically_increasing_id())
    # The row numbers hold from here on: they are written.
    made = materialize(made, "aligned")
    counts = materialize(pair_counts(made), "pair_counts")
    # One row for each id of the first tokenizer at most.
    top = counts.groupBy(F.shiftright("pair", PAIR_BITS).alias("a")).agg(F.max("n").alias("top"))
    judged = counts.withColumn("a", F.shiftright("pair", PAIR_BITS)).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    judged = materialize(judged, "judged_pairs")
    table = frequent_pairs(judged, most).toArrow()
    order = np.argsort(table["pair"].to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best")))
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, row long, n_best long, count_sum long, pairs array<long>, times array<long>"
    known = materialize(made.mapInArrow(_lookup(sent), kinds), "known_pairs")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    digest = F.col("groups").cast("string").alias("groups_sha256")
    if not known.where(F.size("pairs") > 0).head(1):
        return known.select(*plain, "n_best", "count_sum", digest)
    rare = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("at")).select("row", F.col("at.pairs").alias("pair"), F.col("at.times").alias("times"))
    # A pair that is not in the table is held by few documents, so that no key is hot.
    joined = rare.join(judged, "pair")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    both = join_unique(known.drop("pairs", "times"), materialize(sums, "rare_pairs"), ["row"], ["row"], "left")
    n_best = F.col("n_best") + F.coalesce("more_best", F.lit(0))
    return both.select(*plain, n_best.alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), digest)
