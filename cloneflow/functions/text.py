"""Token, gram and bag columns. All of them are row-local built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters that `\\s` does not know (ASCII separators, next line, and the
# Unicode spaces), and the words that look like a call but are not one.
MORE_SPACES = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
IDENTIFIER_PATTERN = r"[A-Za-z_$][A-Za-z0-9_$]*"
CALL_PATTERN = r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum "
    "extends false final finally float for goto if implements import instanceof int interface long native "
    "new null package private protected public return short static strictfp super switch synchronized this "
    "throw throws transient true try void volatile while"
).split()
MARKUP_COMMENT = r"(?s)<!--.*?-->"
CODE_COMMENT_OR_STRING = r"(?s)\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|//[^\n]*|/\*.*?\*/"
MAX_TOKENS = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once, so that a lambda inside `body` does not evaluate it again per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """White-space tokens in order. Rare spaces become blanks first, which keeps the pattern a fast one."""
    return F.regexp_extract_all(F.translate(text, MORE_SPACES, " " * len(MORE_SPACES)), F.lit(r"\S+"), F.lit(0))


def truncate(toks: Column, limit: int = MAX_TOKENS) -> Column:
    """The model-input cut: at most `limit` leading tokens."""
    return F.slice(toks, 1, limit)


def flatten_lines(text: Column, with_blank: bool = False) -> Column:
    """Drop line breaks, or replace each by a blank and strip the ends."""
    if with_blank:
        return F.trim(F.regexp_replace(text, r"\n", " "))
    return F.regexp_replace(text, r"\n", "")


def _windows(toks: Column, k: int, make: Callable[..., Column], kind: str) -> Column:
    """`make` over the k tokens of every window. Tokens are fetched by index: `slice` would copy the array."""
    return let(
        toks,
        lambda t: F.when(
            F.size(t) >= k,
            F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: make(*[F.get(t, i + o) for o in range(k)])),
        ).otherwise(F.array().cast(f"array<{kind}>")),
    )


def gram_hashes(toks: Column, k: int) -> Column:
    """One 64-bit hash per window of k consecutive tokens."""
    return _windows(toks, k, F.xxhash64, "bigint")


def portable_hash(text: Column) -> Column:
    """A 60-bit hash whose *order* other engines can reproduce: the leading hex digits of md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def ordered_gram_hashes(toks: Column, k: int) -> Column:
    """Like `gram_hashes`, for measures in which the smallest hash wins."""
    return _windows(toks, k, lambda *words: portable_hash(F.concat_ws(" ", *words)), "bigint")


def winnow(hashes: Column, window: int) -> Column:
    """Distinct window minima. Fewer hashes than one window give the minimum of what there is."""
    return let(
        hashes,
        lambda h: F.when(
            F.size(h) > 0,
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size(h) - window, F.lit(0))),
                    lambda i: F.least(*[F.get(h, i + o) for o in range(window)]),
                )
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def winnow_places(hashes: Column, window: int) -> Column:
    """`array<struct<h, pos>>`: the minimum of each window with its place, the rightmost of equal ones, without repeats."""

    def minimum(h: Column, i: Column) -> Column:
        inside = [F.get(h, i + o) for o in range(window)]
        least = F.least(*inside)
        place = reduce(lambda later, o: later.when(inside[o] == least, o), range(window - 2, -1, -1), F.when(inside[-1] == least, window - 1))
        return F.struct(least.alias("h"), (i + place).cast("int").alias("pos"))

    def unrepeated(found: Column) -> Column:
        # The places only grow, so equal ones are neighbours: `array_distinct` compares structs each with each.
        return F.filter(found, lambda p, i: (i == 0) | (F.get(found, i - 1)["pos"] != p["pos"]))

    return let(
        hashes,
        lambda h: F.when(
            F.size(h) > 0,
            let(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - window, F.lit(0))), lambda i: minimum(h, i)), unrepeated),
        ).otherwise(F.array().cast("array<struct<h:bigint,pos:int>>")),
    )


def bag(toks: Column) -> Column:
    """`array<struct<tok, cnt>>` sorted by token: run lengths of the sorted tokens."""

    def runs(s: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(s)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(s, a).alias("tok"), (b - a).cast("bigint").alias("cnt")))

    def run_starts(s: Column) -> Column:
        is_start = lambda i: F.coalesce(F.get(s, i - 1) != F.get(s, i), F.lit(True))
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), is_start)

    return let(
        F.sort_array(toks),
        lambda s: F.when(F.size(s) > 0, let(run_starts(s), lambda st: runs(s, st))).otherwise(
            F.array().cast("array<struct<tok:string,cnt:bigint>>")
        ),
    )


def shared_counts(a: Column, b: Column) -> Column:
    """Tokens that occur in both bags, as `array<struct<ca, cb>>`.

    The two bags are sorted together; a token of both sides then sits in two neighbouring entries.
    """

    def side(entries: Column, number: int) -> Column:
        return F.transform(entries, lambda e: F.struct(e["tok"].alias("tok"), F.lit(number).alias("side"), e["cnt"].alias("cnt")))

    def neighbours(u: Column) -> Column:
        same = F.filter(
            F.sequence(F.lit(0), F.size(u) - 1),
            lambda i: F.coalesce(F.get(u, i)["tok"] == F.get(u, i + 1)["tok"], F.lit(False)),
        )
        return F.transform(same, lambda i: F.struct(F.get(u, i)["cnt"].alias("ca"), F.get(u, i + 1)["cnt"].alias("cb")))

    return let(
        F.sort_array(F.concat(side(a, 0), side(b, 1))),
        lambda u: F.when(F.size(u) > 0, neighbours(u)).otherwise(F.array().cast("array<struct<ca:bigint,cb:bigint>>")),
    )


def identifiers(text: Column) -> Column:
    """Sorted distinct identifiers, language keywords left out."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER_PATTERN), F.lit(0))
    return F.sort_array(F.array_except(F.array_distinct(found), F.array(*[F.lit(k) for k in KEYWORDS])))


def called_names(text: Column) -> Column:
    """Distinct names that are followed by an opening parenthesis, keywords left out."""
    found = F.regexp_extract_all(text, F.lit(CALL_PATTERN), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(k) for k in KEYWORDS]))


def comment_words(text: Column, markup: bool = False) -> Column:
    """Distinct words inside comments. String literals are matched first, so `"http://x"` is no comment."""
    if markup:
        parts = F.regexp_extract_all(text, F.lit(MARKUP_COMMENT), F.lit(0))
    else:
        found = F.regexp_extract_all(text, F.lit(CODE_COMMENT_OR_STRING), F.lit(0))
        parts = F.filter(found, lambda p: p.startswith("/"))
    return F.array_distinct(F.regexp_extract_all(F.array_join(parts, " "), F.lit(r"\w+"), F.lit(0)))


def metric_profile(text: Column, toks: Column) -> Column:
    """Tokens, distinct tokens, lines, characters per line, characters."""
    lines = F.size(F.split(text, "\n"))
    chars = F.char_length(text)
    return F.array(
        F.size(toks).cast("double"),
        F.size(F.array_distinct(toks)).cast("double"),
        lines.cast("double"),
        chars.cast("double") / lines,
        chars.cast("double"),
    )
