"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find what is certain by its form. Looser patterns propose more spans, and labelers vote on every one: on its form, on
lists of known names, on the words around it. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is; its posteriors are the soft labels of a Naive Bayes classifier over features of a span, which decides what is added to the
base. Texts are read once: spans with their votes and features are a table, and all learning works on counts of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneflow.llm.common import ascii_lower, whole_text
from cloneflow.session import materialize

BLOCK = 64
CONTEXT = 32
ROUNDS = 100
ACCEPT = 0.5

# A match begins where a run of its first class begins, or where the match before ended. Otherwise a long run that holds no
# match would be scanned once per character. Possessive repeats give back nothing, so long matches need no stack.
_RUN = r"(?:\G|(?<![{0}]))[{0}]++"

# The lengths of a country's IBAN. Codes that are not listed may have any length.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE",
    31: "MT|SC", 32: "LC", 33: "RU",
}


def _ibans() -> str:
    """The listed lengths in groups of four and a shorter last one, so that a short word behind a spaced IBAN is not its last group."""
    last = lambda n: rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return "|".join(rf"(?:{codes})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{last(n)}" for n, codes in IBAN_COUNTRIES.items())


@dataclass(frozen=True)
class Kind:
    """A pattern; a cheap test that a text can hold it; what a match must satisfy. Base kinds are always kept."""

    name: str
    pattern: str
    guard: str
    base: bool = False


# Order matters: spans that start together are listed in this order.
KINDS = [
    Kind("email", _RUN.format("A-Za-z0-9._%+-") + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    Kind("ip", _RUN.format("0-9") + r"\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_ibans()}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    Kind("hidden_email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{2,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,63}+){1,4}", r"[(\[{]at[)\]}]"),
    Kind("local_phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[.\x20-])[0-9]{3,4}[.\x20-][0-9]{3,4}(?![0-9.-])", r"[0-9][.\x20-][0-9]{3}"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    Kind("secret", r"(?<=(?:token|secret|passw(?:or)?d|api_?key)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?)[A-Za-z0-9+/_-]{8,}+", r"(?:token|secret|passw(?:or)?d|api_?key)[\"']?\x20{0,2}[=:]"),
    Kind("person", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? \p{Lu}[\p{L}'-]{1,30}+(?: \p{Lu}[\p{L}'-]{1,30}+)?", r"(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora?)\.? \p{Lu}"),
]

# Words around a span that speak for a kind, and words that speak against any.
CUES = {
    "email": "mail|contact|write to|reach",
    "ip": "ip|host|server|address|login|from",
    "card": "card|visa|master|credit|pay",
    "phone": "phone|tel|call|fax|mobile|dial|contact",
    "iban": "iban|account|bank|konto|transfer",
    "hidden_email": "mail|contact|write to|reach",
    "local_phone": "phone|tel|call|fax|mobile|dial|contact",
    "national_id": "ssn|social|security|national|id number",
    "secret": "token|secret|password|key",
    "person": "dear|signed|contact|author|name",
}
AGAINST = "version|isbn|issn|page|chapter|section|figure|table|order no|invoice|example|range|from .{0,8} to "
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|it|nl|ch|at"
NOT_PERSONAL = r"(?i)^(?:127\.|10\.|192\.168\.|0\.)|@(?:example|test|localhost)\b|^(?:0+|1234567890123?4?5?6?)$|^(?:noreply|no-reply|info|admin)@"


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: Kind, match: Column) -> Column:
    n = F.char_length(_digits(match))
    if kind.name == "ip":
        # Leading zeros do not count; four digits are more than 255.
        return ~match.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])")
    if kind.name == "card":
        return n.between(12, 19) & F.call_function("luhn_check", F.when(n.between(12, 19), _digits(match)).otherwise("0"))
    if kind.name == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _votes(kind: Kind, span: Column) -> Column:
    """One character per labeler: + for personal data, - against, 0 for no opinion."""
    match, left = span["match"], ascii_lower(span["left"])
    right = ascii_lower(span["right"])
    form = F.lit(kind.base)
    if kind.name == "iban":
        form = F.char_length(F.regexp_replace(match, " ", "")).between(15, 34)
    elif kind.name in ("hidden_email", "national_id"):
        form = F.lit(True)
    elif kind.name == "local_phone":
        form = F.char_length(_digits(match)).between(9, 11)
    elif kind.name == "secret":
        form = match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.char_length(match) >= 16)
    vote = lambda yes, no: F.when(no, "-").when(yes, "+").otherwise("0")
    listed = match.rlike(rf"(?i)\.(?:{ENDINGS})$") if "email" in kind.name else match.rlike(r"^(?:Mr|Mrs|Ms|Dr|Herr|Frau)") if kind.name == "person" else F.lit(False)
    glued = span["left"].rlike(r"[\p{L}\p{N}_]$") | span["right"].rlike(r"^[\p{L}\p{N}_]")
    around = F.concat(left, F.lit(" "), right)
    return F.concat(
        F.when(form, "+").otherwise("0"),
        vote(listed, match.rlike(NOT_PERSONAL)),
        vote(around.rlike(rf"(?:^|[^a-z])(?:{CUES[kind.name]})"), F.lit(False)),
        vote(F.lit(False), left.rlike(rf"(?:{AGAINST})[^a-z]{{0,8}}$")),
        vote(F.char_length(match) >= 7, glued),
    )


def _features(kind: Kind, span: Column) -> Column:
    """Names of what a span is like. Each is one of few."""
    match, left, right = span["match"], span["left"], span["right"]
    size, digits = F.char_length(match), F.char_length(_digits(match))
    edge = lambda c: F.when(c == "", "none").when(c.rlike(r"[\p{L}]"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").otherwise("sign")
    tag = lambda name, value: F.concat(F.lit(f"{kind.name}:{name}="), value.cast("string"))
    return F.array(
        tag("size", F.least((size / 6).cast("int"), F.lit(8))),
        tag("digits", F.least((digits * 4 / size).cast("int"), F.lit(4))),
        tag("before", edge(F.substring(left, -1, 1))),
        tag("after", edge(F.substring(right, 1, 1))),
        tag("signs", F.least(size - F.char_length(F.regexp_replace(match, r"[^\p{L}\p{N}]", "")), F.lit(5))),
        tag("line", left.rlike(r"(?:^|\n)\s*$")),
    )


def _block_sums(steps: Column) -> Column:
    last = F.greatest(F.floor((F.size(steps) - 1) / BLOCK), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))


def _placed(i: int, kind: Kind) -> Column:
    """The valid matches of a kind with their places and what stands around them."""
    matches, gaps, steps, blocks = (F.col(f"{c}{i}") for c in "mgsb")

    def place(match: Column, j: Column) -> Column:
        block = F.floor(j / BLOCK).cast("int")
        start = _sum(F.slice(blocks, F.lit(1), block)) + _sum(F.slice(steps, block * BLOCK + 1, j % BLOCK)) + F.char_length(F.get(gaps, j))
        return F.struct(
            F.lit(i).alias("kind"),
            start.cast("bigint").alias("start"),
            (start + F.char_length(match)).cast("bigint").alias("stop"),
            match.alias("match"),
            F.substring(F.get(gaps, j), -CONTEXT, CONTEXT).alias("left"),
            F.substring(F.get(gaps, j + 1), 1, CONTEXT).alias("right"),
        )

    return F.filter(F.transform(matches, place), lambda s: _valid(kind, s["match"]))


def _judged(i: int, kind: Kind) -> Column:
    return F.transform(
        f"p{i}",
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), _votes(kind, s).alias("votes"), _features(kind, s).alias("features")),
    )


def spans(docs: DataFrame) -> DataFrame:
    """`doc_id, spans`: every row's base spans and candidates, in code points, with votes and features.

    A pattern's matches and the gaps between them come from two scans; start positions are sums of their lengths, by blocks, so that a
    text with very many matches takes no more than linear work. Null and empty texts have no spans.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    none, of = F.array().cast("array<string>"), range(len(KINDS))
    found = {f"m{i}": F.when(F.col("text").rlike(k.guard), F.regexp_extract_all("text", F.lit(k.pattern), 0)).otherwise(none) for i, k in enumerate(KINDS)}
    rows = rows.withColumns(found)
    rows = rows.withColumns({f"g{i}": F.when(F.size(f"m{i}") > 0, F.split("text", k.pattern, -1)).otherwise(none) for i, k in enumerate(KINDS)}).drop("text")
    steps = {f"s{i}": F.zip_with(F.slice(f"g{i}", 1, F.size(f"m{i}")), f"m{i}", lambda g, m: F.char_length(g) + F.char_length(m)) for i in of}
    rows = rows.withColumns(steps)
    rows = rows.withColumns({f"b{i}": _block_sums(F.col(f"s{i}")) for i in of})
    rows = rows.withColumns({f"p{i}": _placed(i, k) for i, k in enumerate(KINDS)})
    judged = [_judged(i, k) for i, k in enumerate(KINDS)]
    return rows.select("doc_id", F.concat(*judged).alias("spans"))


def reliabilities(patterns: list[tuple[int, str, int]], rounds: int = ROUNDS) -> dict[tuple[int, str], float]:
    """The probability of personal data for each (kind, votes), from `kind, votes, count`, by expectation-maximisation.

    Each labeler has its own rates of each vote among true and false spans; each kind has its own share of true ones.
    """
    labelers = range(max((len(v) for _, v, _ in patterns), default=0))
    start = lambda votes: min(0.9, max(0.1, 0.5 + 0.2 * (votes.count("+") - 2 * votes.count("-"))))
    truth = {(k, v): start(v) for k, v, _ in patterns}
    for _ in range(rounds):
        share, rate = {}, {}
        for kind in {k for k, _, _ in patterns}:
            mass = sum(n for k, _, n in patterns if k == kind)
            share[kind] = (1 + sum(n * truth[k, v] for k, v, n in patterns if k == kind)) / (2 + mass)
        for true in (True, False):
            weight = lambda k, v, n, true=true: n * (truth[k, v] if true else 1 - truth[k, v])
            mass = sum(weight(*p) for p in patterns)
            for i in labelers:
                for vote in "+-0":
                    rate[true, i, vote] = (1 + sum(weight(k, v, n) for k, v, n in patterns if v[i] == vote)) / (3 + mass)
        new = {}
        for kind, votes, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(math.log(rate[True, i, x] / rate[False, i, x]) for i, x in enumerate(votes))
            new[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        if max((abs(new[p] - truth[p]) for p in new), default=0) < 1e-9:
            break
        truth = new
    return truth


def classifier(table: DataFrame) -> tuple[dict[int, float], dict[str, float]]:
    """The final classifier: the log odds of each kind and what each feature adds. Both are of bounded size, as kinds and features are."""
    one = table.select(F.explode("spans").alias("s"))
    counted = one.groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).collect()
    truth = reliabilities(sorted((r.kind, r.votes, r.n) for r in counted))
    if not truth:
        return {}, {}
    # At most 3^5 patterns per kind.
    values = ", ".join(f"({k}, '{v}', {p!r}D)" for (k, v), p in sorted(truth.items()))
    soft = table.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(kind, votes, p)")
    grouped = one.select("s.kind", "s.votes", F.explode("s.features").alias("feature")).groupBy("kind", "votes", "feature").agg(F.count(F.lit(1)).alias("n"))
    sums = grouped.join(F.broadcast(soft), ["kind", "votes"]).groupBy("kind", "feature").agg(F.sum(F.col("p") * F.col("n")).alias("yes"), F.sum((1 - F.col("p")) * F.col("n")).alias("no"))
    yes, no = {}, {}
    for (kind, votes), p in truth.items():
        n = sum(r.n for r in counted if (r.kind, r.votes) == (kind, votes))
        yes[kind], no[kind] = yes.get(kind, 1.0) + n * p, no.get(kind, 1.0) + n * (1 - p)
    adds = {r.feature: math.log((r.yes + 1) / (yes[r.kind] + 5)) - math.log((r.no + 1) / (no[r.kind] + 5)) for r in sums.collect()}
    return {k: math.log(yes[k] / no[k]) for k in yes}, adds


def find_personal_data(docs: DataFrame) -> DataFrame:
    """`doc_id, base, spans` for every row: arrays of `(start, kind, stop)`, sorted; `base` is in `spans`. Extra columns are not carried."""
    table = materialize(spans(docs), "spans")
    prior, adds = classifier(table)
    known = lambda pairs, kind: F.create_map(*[F.lit(x) for p in sorted(pairs.items()) for x in p]) if pairs else F.lit(None).cast(kind)
    odds, weights = known(prior, "map<int,double>"), known(adds, "map<string,double>")
    score = lambda s: F.coalesce(F.try_element_at(odds, s["kind"]), F.lit(0.0)) + F.aggregate(
        s["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(weights, f), F.lit(0.0))
    )
    bases = sum(k.base for k in KINDS)
    accepted = lambda s: (s["kind"] < bases) | (score(s) >= math.log(ACCEPT / (1 - ACCEPT)))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    return table.select(
        "doc_id",
        F.array_sort(F.transform(F.filter("spans", lambda s: s["kind"] < bases), plain)).alias("base"),
        F.array_sort(F.transform(F.filter("spans", accepted), plain)).alias("spans"),
    )


def listed(found: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """A row per document: counts of the base kinds, a digest of the base spans, and all spans."""
    found = find_personal_data(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
