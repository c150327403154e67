"""Benchmark decontamination with suffix arrays of the training texts.

The texts of a task are cut into shards of bounded size. A shard's suffix array holds the word positions where a test window can
begin at all (a run of enough words that the benchmark has), sorted by the words that follow. Every test suffix is found in it by
binary search. The hit words of a text, with the items that hit it, make a second suffix array, in which each test suffix finds its longest
verbatim match and where it is. Documents are never shuffled: the benchmark goes to them, in blocks of bounded size, and each
further block is another pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneflow.llm.common import free_name, whole_text, with_result, word_lists
from cloneflow.session import materialize

WINDOW = 10
SHARD_WORDS = 1 << 20
# Bytes of test items in a block: at most half as many windows, of some 100 bytes each on the driver and in every worker.
BLOCK_BYTES = 2 << 20

# A-Z to a-z; digits, a-z and all bytes of other characters stay; the rest parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RESULT = "n_words long, n_hit long, items array<long>, spans array<struct<start:long,stop:long>>, matches array<struct<item_id:long,start:long,words:long>>"
SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
MATCH = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64())])


class TestWindows:
    """The windows of a block of test items, ready to be searched for."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.ids = np.array(sorted({i for i, _ in items}), np.int64)
        texts = []
        for _, text in items:
            words = (w for some in word_lists(text, TABLE) for w in some)
            texts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint32))
        # The words of all texts, one text behind the other, and the item of each text.
        self.words = np.concatenate([*texts, np.zeros(window, np.uint32)])
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.item_of = np.searchsorted(self.ids, np.array([i for i, _ in items], np.int64))
        # One window for each word that enough words follow, and one for a text of fewer.
        lengths = np.minimum(sizes, window)
        many = np.where(sizes > 0, sizes - lengths + 1, 0)
        text = np.repeat(np.arange(len(texts)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + self.starts[text]
        size = lengths[text]
        spread = np.where(np.arange(window) < size[:, None], self.words[at[:, None] + np.arange(window)], 0).astype(">u4")
        keys, first, which = np.unique(spread.view(f"S{4 * window}").ravel(), return_index=True, return_inverse=True)
        self.lengths = size[first] if len(keys) else np.empty(0, np.int64)
        self.low = keys
        high = np.where(np.arange(window) < self.lengths[:, None], spread[first], 0xFFFFFFFF).astype(">u4") if len(keys) else spread
        self.high = np.ascontiguousarray(high).view(f"S{4 * window}").ravel()
        self.shortest = int(self.lengths.min()) if len(keys) else 0
        # The texts of each window, every one once.
        pairs = np.unique(which.ravel() * len(texts) + text) if len(keys) else np.empty(0, np.int64)
        self.text_of = pairs % max(1, len(texts))
        self.first = np.searchsorted(pairs // max(1, len(texts)), np.arange(len(keys) + 1))

    def codes(self, text: str) -> np.ndarray:
        """The words of a text as numbers; 0 is a word that the benchmark does not have."""
        get = self.vocabulary.get
        parts = [np.fromiter((get(w, 0) for w in words), np.uint32, len(words)) for words in word_lists(text, TABLE)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `codes`, and the window that each of them begins, ordered by position."""
        n = len(codes)
        if not n or not self.shortest:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.where(codes == 0, np.arange(n), n)
        ends = np.minimum.accumulate(ends[::-1])[::-1]
        begin = np.flatnonzero(ends - np.arange(n) >= self.shortest)
        padded = np.concatenate([codes, np.zeros(self.window, codes.dtype)])
        at, windows = [], []
        for start in range(0, len(begin), SHARD_WORDS):
            some = begin[start : start + SHARD_WORDS]
            reach = some[:, None] + np.arange(self.window)
            suffixes = np.where(np.arange(self.window) < (ends[some] - some)[:, None], padded[reach], 0).astype(">u4")
            keys = suffixes.view(f"S{4 * self.window}").ravel()
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            left, right = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
            hit = np.flatnonzero(right > left)
            sizes = (right - left)[hit]
            ranks = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left[hit], sizes)
            at.append(some[order[ranks]])
            windows.append(np.repeat(hit, sizes))
        at, windows = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, windows))
        order = np.lexsort((windows, at))
        return at[order], windows[order]


def _spans(at: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """The union of the hit words as [start, stop) spans."""
    reach = np.maximum.accumulate(at + lengths)
    new = np.concatenate([[True], at[1:] > reach[:-1]])
    return list(zip(at[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)].tolist(), strict=True))


def substring_names(words: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words, numbers of the substrings that begin at each position, in their order, until all differ.

    Equal numbers are equal substrings; a substring that the end cuts off is a name of its own.
    """
    names, size = [np.unique(words, return_inverse=True)[1].ravel().astype(np.int64)], 1
    while names[-1].max(initial=0) + 1 < len(words):
        last = names[-1]
        behind = np.zeros(len(last), np.int64)
        behind[: len(last) - size] = last[size:] + 1
        names.append(np.unique(last * (len(last) + 1) + behind, return_inverse=True)[1].ravel())
        size *= 2
    return names


def common_prefixes(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at `a` and at `b` have in common at their beginning; `a` and `b` differ everywhere."""
    found = np.zeros(len(a), np.int64)
    for level in range(len(names) - 1, -1, -1):
        n = len(names[level])
        x, y = a + found, b + found
        inside = (x < n) & (y < n)
        same = inside & (names[level][np.minimum(x, n - 1)] == names[level][np.minimum(y, n - 1)])
        found += same * (1 << level)
    return found


def _longest(tests: TestWindows, codes: np.ndarray, spans: list[tuple[int, int]], windows: np.ndarray) -> list[tuple[int, int, int]]:
    """`(item_id, start, words)`: the longest verbatim match of each item that has one of the windows, the first at a tie.

    The hit words of the text and the items stand in one suffix array, parted by marks that occur once. Each test suffix finds its longest
    match beside its own place in the order: nothing is repeated for the places of a window, however often it occurs.
    """
    hit = np.unique(windows)
    many = tests.first[hit + 1] - tests.first[hit]
    texts = np.unique(tests.text_of[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(tests.first[hit], many)])
    parts = [(codes[a:b], a, -1) for a, b in spans] + [(tests.words[tests.starts[t] : tests.starts[t + 1]], 0, t) for t in texts.tolist()]
    sizes = np.array([len(p) + 1 for p, _, _ in parts])
    heads = np.cumsum(sizes) - sizes
    words = np.concatenate([x for k, (p, _, _) in enumerate(parts) for x in (p, [len(tests.vocabulary) + 1 + k])]).astype(np.int64)
    mark = np.zeros(len(words), bool)
    mark[heads + sizes - 1] = True
    owner = np.repeat([t for _, _, t in parts], sizes)
    start = np.arange(len(words)) - np.repeat(heads - np.array([a for _, a, _ in parts]), sizes)
    names = substring_names(words)
    order = np.argsort(names[-1])
    order = order[~mark[order]]
    of_text = owner[order] < 0
    # The nearest suffix of the text on either side.
    place = np.arange(len(order))
    before = np.maximum.accumulate(np.where(of_text, place, -1))
    behind = np.minimum.accumulate(np.where(of_text, place, len(order))[::-1])[::-1]
    test = np.flatnonzero(~of_text)
    best = np.zeros(len(test), np.int64)
    for near in (before[test], behind[test]):
        some = (near >= 0) & (near < len(order))
        best[some] = np.maximum(best[some], common_prefixes(names, order[test[some]], order[near[some]]))
    item = tests.item_of[owner[order[test]]]
    length = np.zeros(len(tests.ids), np.int64)
    np.maximum.at(length, item, best)
    top = best == length[item]
    item, at = item[top], order[test[top]]
    own = np.flatnonzero((owner < 0) & ~mark)
    rows = {}
    for size in np.unique(length[item]).tolist():
        # Two overlapping names make the substring of this length.
        level = size.bit_length() - 1
        some = length[item] == size
        where = own[own + size <= len(words)]
        # Equal pairs get equal numbers, the test's side behind the text's.
        both = np.concatenate([where, at[some]])
        key = names[level][both] * (len(words) + 1) + names[level][both + size - (1 << level)]
        key = np.unique(key, return_inverse=True)[1].ravel()
        first = np.full(key.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, key[: len(where)], start[where])
        for i, begin in zip(item[some].tolist(), first[key[len(where) :]].tolist(), strict=True):
            rows[i] = min(rows.get(i, (begin, size)), (begin, size))
    return [(int(tests.ids[i]), begin, size) for i, (begin, size) in sorted(rows.items())]


def _batch(tests: TestWindows, texts: list[str]) -> list[dict]:
    """A result per text. The texts share suffix arrays: a word that no window has stands between them."""
    codes = [tests.codes(t) for t in texts]
    sizes = [len(c) for c in codes]
    parted = [x for c in codes for x in (c, np.zeros(1, np.uint32))]
    at, windows = tests.search(np.concatenate(parted) if parted else np.empty(0, np.uint32))
    starts = np.cumsum([0, *(s + 1 for s in sizes)])
    bounds = np.searchsorted(at, starts)
    rows = []
    for i, n in enumerate(sizes):
        here = slice(bounds[i], bounds[i + 1])
        if here.start == here.stop:
            rows.append({"n_words": n, "n_hit": 0, "items": [], "spans": [], "matches": []})
            continue
        local, found = at[here] - starts[i], windows[here]
        spans = _spans(local, tests.lengths[found])
        matches = _longest(tests, codes[i], spans, found)
        rows.append(
            {
                "n_words": n,
                "n_hit": sum(b - a for a, b in spans),
                "items": [m[0] for m in matches],
                "spans": [{"start": a, "stop": b} for a, b in spans],
                "matches": [dict(zip(("item_id", "start", "words"), m, strict=True)) for m in matches],
            }
        )
    return rows


ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(SPAN)), ("matches", pa.list_(MATCH))])
BATCH_CHARS = 8 << 20


def _searcher(tests):
    """An Arrow function of whole texts; `tests` is a broadcast TestWindows."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            rows, some, size = [], [], 0
            for text in array:
                some.append(text.as_py())
                size += len(some[-1])
                if size >= BATCH_CHARS:
                    rows += _batch(tests.value, some)
                    some, size = [], 0
            yield pa.array(rows + _batch(tests.value, some), ARROW)

    return F.arrow_udf(run, RESULT).asNondeterministic()


def _union(old, new):
    """Both structs as one: spans that overlap or touch are joined."""
    spans = F.array_sort(F.concat(old["spans"], new["spans"]))
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= s["start"]),
        F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop"))),
        ),
    ).otherwise(F.concat(done, F.array(s)))
    joined = F.aggregate(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>"), step)
    hits = F.aggregate(joined, F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return F.struct(
        old["n_words"].alias("n_words"),
        hits.alias("n_hit"),
        F.array_union(old["items"], new["items"]).alias("items"),
        joined.alias("spans"),
        F.concat(old["matches"], new["matches"]).alias("matches"),
    )


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """`docs` with a struct of what it shares with `benchmark` (item_id, text), and that column's name.

    The struct: `n_words`; `n_hit`, words inside any occurrence of a window; `items`, the ids whose windows occur; `spans`,
    the hit words as [start, stop); `matches`, per item the longest verbatim match and its place. Null and empty texts have no
    words. Test rows without id or text take no part; rows that repeat an id are one item. All other rows and columns stay. A very long text is
    searched in shards; one word repeated any number of times, in text and item, takes memory in proportion to both lengths.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    made, name = docs, None
    for block in range(blocks):
        # At most about block_bytes of texts, dealt by hash.
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        tests = spark.sparkContext.broadcast(TestWindows([(r.item_id, r.text) for r in part], window))
        made, found = with_result(made, _searcher(tests))
        if name is None:
            name = found
        else:
            both = free_name(made, "_both")
            made = made.withColumn(both, _union(F.col(name), F.col(found))).drop(name, found).withColumnRenamed(both, name)
        if block < blocks - 1:
            made = materialize(made, "searched")
    return made, name


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` that share no window with the benchmark."""
    made, name = find_matches(docs, benchmark, window)
    return made.where(F.col(f"{name}.n_hit") == 0).drop(name)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: counts, a digest of the item ids, and whether it is contaminated."""
    made, name = find_matches(docs.select("doc_id", whole_text().alias("text")), benchmark)
    found = F.col(name)
    ids = F.array_join(F.array_sort(found["items"].cast("array<string>")), ",")
    return made.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (found["n_hit"] > 0).alias("contaminated"),
    )
