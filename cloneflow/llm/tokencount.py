"""Token counts with a two-tier lookup on the map side.

A text's token count is the sum over its pre-tokens, and most pre-tokens are frequent. A table of frequent ones and their
lengths, of fixed size, goes to every task; what it misses is looked up in a cache that a Python worker keeps while its task runs, and
what that misses is encoded, some at a time. No pre-token is ever shuffled.

Texts are parted by a pattern over Unicode classes, whose tables may be newer than the tokenizer's own. The tokenizer is asked how it parts
every letter, number and white space, and a text that holds a character on which the two disagree is encoded by the library whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloneflow.llm.common import give_back, whole_text, with_result

FREQUENT = 20_000
# Rows that the table of frequent pre-tokens is made from, at most twice as many: it changes speed only.
SAMPLE_ROWS = 10_000
MAX_COUNTED = 150_000
MAX_PRETOKEN = 48
# Bytes, about, of what a worker remembers of pre-tokens, and the number that outlives a full cache: those met first, among them the frequent ones.
CACHE_BYTES = 24 << 20
KEPT = 40_000
PIECE_CHARS = 1 << 20
AT_ONCE = 20_000
PROBES = 1 << 14
LIMIT = 1024

# The characters that count as white space, and the pattern that parts a text before its merges.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
# Between a character that is no white space and one that is, no pre-token goes on.
CUT = regex.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])")
# The same where white space is in no doubt.
PLAIN_CUT = re.compile("(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")


def untruncated(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def cut_text(text: str, cut: re.Pattern, size: int) -> Iterator[str]:
    """A long text in parts of at least `size` characters that end where `cut` matches."""
    start = 0
    while len(text) - start > size and (m := cut.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


HIGH = re.compile("[\U00010000-\U0010ffff]")


def _one_of(points: list[int]) -> re.Pattern | None:
    """A pattern of one of these code points, which are in order."""
    ranges: list[list[int]] = []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]") if ranges else None


_UNLIKE: dict[str, list[int]] = {}


def unlike_characters(path: str) -> list[int]:
    """The code points that the file's tokenizer parts otherwise than PATTERN: letters, numbers and white space of either's tables.

    Each is probed behind a letter, a digit and a sign. All other code points are signs to both.
    """
    if path not in _UNLIKE:
        part, found = untruncated(path).pre_tokenizer.pre_tokenize_str, []
        classed = regex.compile(rf"[{WHITE}\p{{L}}\p{{N}}]")
        points = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000 and (classed.match(c := chr(p)) or unicodedata.category(c)[0] in "LNZ")]
        for i in range(0, len(points), PROBES):
            some = points[i : i + PROBES]
            text = "".join(f"a{(c := chr(p))}\n1{c}\n!{c}\n" for p in some)
            own, theirs = {m.span() for m in regex.finditer(PATTERN, text)}, {span for _, span in part(text)}
            found += {some[begin // 9] for begin, _ in own ^ theirs}
        _UNLIKE[path] = sorted(found)
    return _UNLIKE[path]


class PreTokens:
    """Parts texts the way the byte-level tokenizer in a file does, special strings first where they count as such.

    `value` makes what is remembered of a pre-token from its encoding, of about `cost` bytes with its entry.
    """

    def __init__(self, path: str, unlike: list[int], special: bool, value: Callable, cost: int = 140, cache_bytes: int | None = None):
        self.tokenizer, self.value = untruncated(path), value
        self.tokenizer.encode_special_tokens = not special
        strings = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings and special else None
        self.find = regex.compile(PATTERN).findall
        # Apart: a class within the basic plane is one lookup, however many characters it has.
        self.unlike = [_one_of([p for p in unlike if (p > 0xFFFF) == high]) for high in (False, True)]
        self.known: dict = {}
        self.held, self.cost, self.limit = 0, cost, cache_bytes

    def foreign(self, text: str) -> bool:
        """Whether the text is left to the library."""
        if text.isascii():
            return False
        low, high = self.unlike
        return bool(low and low.search(text) or high and HIGH.search(text) and high.search(text))

    def encoded(self, text: str) -> Iterator:
        """The values of a text's parts by the library."""
        for part in cut_text(text, PLAIN_CUT, PIECE_CHARS):
            yield self.value(self.tokenizer.encode(part, add_special_tokens=False), part)

    def lists(self, text: str) -> Iterator[tuple[list[str], int]]:
        """Pre-tokens, some at a time, and the number of special strings before them."""
        if self.special is None or not self.special.search(text):
            parts = [(text, 0)]
        else:
            parts = [(p, int(i > 0)) for i, p in enumerate(self.special.split(text))]
        for part, specials in parts:
            for piece in cut_text(part, CUT, PIECE_CHARS):
                yield self.find(piece), specials
                specials = 0

    def values(self, pretokens: list[str]) -> list:
        made = self.tokenizer.encode_batch(pretokens, add_special_tokens=False)
        return [self.value(e, w) for e, w in zip(made, pretokens, strict=True)]

    def remember(self, frequent: dict) -> None:
        self.known, self.held = dict(frequent), 0

    def cut_back(self) -> None:
        """Forgets all but what was met first."""
        self.remember(dict(islice(self.known.items(), KEPT)))
        self.held = self.cost * len(self.known)

    def learn(self, lists: list[list[str]], frequent: dict) -> list[str]:
        """Encodes all pre-tokens of the lists that are not known, and returns those that are too long to be kept: `drop` them."""
        if self.held >= (self.limit or CACHE_BYTES):
            # Dictionaries keep the order in which entries came.
            self.remember(dict(islice(self.known.items(), max(KEPT, len(frequent)))))
            self.held = self.cost * (len(self.known) - len(frequent))
        new = list(set(chain.from_iterable(lists)).difference(self.known))
        if not new:
            return new
        self.known.update(zip(new, self.values(new), strict=True))
        self.held += sum(map(len, new)) * 2 + self.cost * len(new)
        return [w for w in new if len(w) > MAX_PRETOKEN]

    def drop(self, long: list[str]) -> None:
        for word in long:
            self.held -= len(word) * 2 + self.cost
            del self.known[word]


def token_count(encoding, pretoken: str) -> int:
    return len(encoding.ids)


# One per worker process and file: it outlives a task, but what a task made it remember does not.
_LOADED: dict[str, PreTokens] = {}


def loaded(path: str, unlike: list[int]) -> PreTokens:
    if path not in _LOADED:
        _LOADED[path] = PreTokens(path, unlike, True, token_count)
    return _LOADED[path]


def _heavy(path: str, unlike: list[int]):
    """Each task's most frequent pre-tokens. The rarest half is forgotten whenever there are too many to hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = loaded(path, unlike)
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for words, _ in pretokens.lists(text.as_py()):
                    counts.update(words)
                    if len(counts) > MAX_COUNTED:
                        counts = Counter(dict(counts.most_common(MAX_COUNTED // 2)))
        top = [(w, n) for w, n in counts.most_common(FREQUENT) if n > 1 and len(w) <= MAX_PRETOKEN]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["pretoken", "n"])

    return run


def frequent_lengths(docs: DataFrame, path: str, size: int = FREQUENT, rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Token counts of the `size` most frequent pre-tokens, at most MAX_PRETOKEN characters each, of about `rows` rows chosen by a hash of their text."""
    share = max(1, docs.count() // rows)
    some = docs.select(whole_text().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    unlike = unlike_characters(path)
    local = some.mapInArrow(_heavy(path, unlike), "pretoken string, n long")
    top = local.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(size)
    words = [r.pretoken for r in top.select("pretoken").collect()]
    return dict(zip(words, PreTokens(path, unlike, True, token_count).values(words), strict=True))


def _counter(path: str, unlike: list[int], frequent):
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pretokens, table = loaded(path, unlike), frequent.value
        pretokens.remember(table)
        for array in arrays:
            totals, owners, lists, size = [0] * len(array), [], [], 0

            def settle() -> None:
                long = pretokens.learn(lists, table)
                get = pretokens.known.__getitem__
                for i, words in zip(owners, lists, strict=True):
                    totals[i] += sum(map(get, words))
                pretokens.drop(long)
                owners.clear()
                lists.clear()

            for i, text in enumerate(array):
                text = text.as_py()
                if pretokens.foreign(text):
                    totals[i] = sum(pretokens.encoded(text))
                    continue
                for words, specials in pretokens.lists(text):
                    totals[i] += specials
                    owners.append(i)
                    lists.append(words)
                    size += len(words)
                    if size >= AT_ONCE:
                        settle()
                        size = 0
            settle()
            yield pa.array(totals, pa.int64())
        pretokens.remember({})
        give_back()

    return F.arrow_udf(run, "bigint")


def count_tokens(docs: DataFrame, path: str, size: int = FREQUENT) -> tuple[DataFrame, str]:
    """`docs` with the number of tokens of every whole text, and that column's name. `path` is the tokenizer's file, where every executor has it.

    Null and empty texts have none. All rows and columns stay, and nothing is shuffled.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, size))
    return with_result(docs, _counter(path, unlike_characters(path), frequent))


def token_report(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    made, name = count_tokens(docs.select("doc_id", "text"), path)
    return made.select("doc_id", F.octet_length(whole_text()).cast("bigint").alias("n_bytes"), F.col(name).alias("n_tokens"), (F.col(name) > limit).alias("over_limit"))
