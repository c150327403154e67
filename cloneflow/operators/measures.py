"""The catalogue of pair measures.

A row-local measure is a set of per-document features and one expression over the `a_` and `b_` columns of a
pair, so any number of measures is scored in one pass over one join. Measures that need counts over the whole
corpus are DataFrame functions below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloneflow.functions import similarity as sim
from cloneflow.functions import text as tx
from cloneflow.functions.words import SPLIT_BYTES, counted_words, text_slices
from cloneflow.operators.joins import first_rows, join_unique
from cloneflow.session import materialize
from cloneflow.sources.corpus import Features, star_pairs

ROLLING_K = 5
MATCH_K = 5
NGRAM_N = 3
WINNOW_K = 5
WINNOW_WINDOW = 4

# Words whose counts go to every task, and their longest; texts that share a copy of their original.
FREQUENT_WORDS, WORD_BYTES, SUSPECTS = 1 << 18, 64, 1 << 10

# Multiplier and offset of each MinHash permutation, by rule.
MINHASH_PRIME = 2_147_483_647
MINHASH_SEEDS = [((1_103_515_245 * (i + 1) + 12_345) % MINHASH_PRIME, (48_271 * (i + 7)) % MINHASH_PRIME) for i in range(64)]
MINHASH_BAND = 2


@dataclass(frozen=True)
class Measure:
    """Per-document features, columns of the pair made from them (shared by name), and the score."""

    features: Features
    score: Callable[[], Column]
    prepare: dict[str, Callable[[], Column]] = field(default_factory=dict)


def _text(text: Column, toks: Column) -> Column:
    return text


def _token_hashes(text: Column, toks: Column) -> Column:
    return F.transform(toks, lambda t: F.xxhash64(t))


def _distinct(text: Column, toks: Column) -> Column:
    return F.array_distinct(toks)


def _size(text: Column, toks: Column) -> Column:
    return F.size(toks)


def _bag(text: Column, toks: Column) -> Column:
    return tx.bag(toks)


def _grams(k: int) -> Callable[[Column, Column], Column]:
    return lambda text, toks: F.array_distinct(tx.gram_hashes(toks, k))


def _sorted_tokens(text: Column, toks: Column) -> Column:
    return F.array_join(F.sort_array(toks), " ")


def _fingerprints(text: Column, toks: Column) -> Column:
    return tx.winnow(tx.ordered_gram_hashes(toks, WINNOW_K), WINNOW_WINDOW)


def _signature(text: Column, toks: Column) -> Column:
    hashes = F.transform(F.array_distinct(toks), tx.portable_hash)
    return sim.minhash(hashes, MINHASH_SEEDS, MINHASH_PRIME)


def _on(function: Callable[..., Column], *names: str) -> Callable[[], Column]:
    return lambda: function(*[F.col(n) for n in names])


SHARED = {"a_shared": _on(tx.shared_counts, "a_bag", "b_bag")}

MEASURES: dict[str, Measure] = {
    "graph_node_jaccard": Measure(
        {"nodes": _distinct, "size": _size},
        lambda: sim.positional_jaccard(F.col("a_nodes"), F.col("b_nodes"), F.greatest("a_size", "b_size")),
    ),
    "token_overlap": Measure(
        {"bag": _bag, "size": _size}, _on(sim.token_overlap, "a_shared", "a_size", "b_size"), SHARED
    ),
    "bag_quick_ratio": Measure({"bag": _bag, "size": _size}, _on(sim.bag_ratio, "a_shared", "a_size", "b_size"), SHARED),
    "graph_edit_similarity": Measure(
        {"nodes": _distinct, "edges": _grams(2)},
        _on(sim.graph_edit_similarity, "a_nodes", "a_edges", "b_nodes", "b_edges"),
    ),
    "bow_cosine": Measure({"bag": _bag}, _on(sim.bag_cosine, "a_shared", "a_bag", "b_bag"), SHARED),
    "comment_similarity": Measure(
        {"comments": lambda text, toks: tx.comment_words(text)}, lambda: sim.jaccard(F.col("a_comments"), F.col("b_comments"), empty=1.0)
    ),
    "markup_comment_similarity": Measure(
        {"markup": lambda text, toks: tx.comment_words(text, markup=True)},
        lambda: sim.jaccard(F.col("a_markup"), F.col("b_markup"), empty=1.0),
    ),
    "call_similarity": Measure({"calls": lambda text, toks: tx.called_names(text)}, _on(sim.jaccard, "a_calls", "b_calls")),
    "fuzzy_token_sort": Measure({"sorted": _sorted_tokens}, _on(sim.edit_similarity, "a_sorted", "b_sorted")),
    "rolling_hash": Measure({"windows": _grams(ROLLING_K)}, _on(sim.share_of, "a_windows", "b_windows")),
    "jaccard": Measure({"nodes": _distinct}, _on(sim.jaccard, "a_nodes", "b_nodes")),
    "longest_block": Measure({"hashes": _token_hashes}, _on(sim.block_ratio, "a_hashes", "b_hashes")),
    "levenshtein": Measure({"text": _text}, _on(sim.edit_similarity, "a_text", "b_text")),
    "metric_profile": Measure({"profile": tx.metric_profile}, _on(sim.profile_similarity, "a_profile", "b_profile")),
    "ngram_similarity": Measure({"ngrams": _grams(NGRAM_N)}, _on(sim.jaccard, "a_ngrams", "b_ngrams")),
    "rk_match": Measure({"kgrams": _grams(MATCH_K)}, _on(sim.containment, "a_kgrams", "b_kgrams")),
    "winnow": Measure({"prints": _fingerprints}, _on(sim.jaccard, "a_prints", "b_prints")),
}


def features_of(names: list[str]) -> Features:
    return {k: f for n in names for k, f in MEASURES[n].features.items()}


def similarity_columns(pairs: DataFrame, names: list[str]) -> DataFrame:
    """One column per measure, null where a side has no features; the rest of the pair except its features stays."""
    keep = [c for c in pairs.columns if not c.startswith(("a_", "b_"))]
    pairs = pairs.withColumns({k: make() for n in names for k, make in MEASURES[n].prepare.items()})

    def score(name: str) -> Column:
        present = [F.col(side + f).isNotNull() for f in MEASURES[name].features for side in ("a_", "b_")]
        return F.when(reduce(Column.__and__, present), MEASURES[name].score()).alias(name)

    return pairs.select(*keep, *[score(n) for n in names])


def long_scores(wide: DataFrame, names: list[str], digits: int | None = None) -> DataFrame:
    """`measure, similarity` rows from one column per measure."""
    value = lambda n: F.round(F.col(n), digits) if digits is not None else F.col(n)
    rows = F.array(*[F.struct(F.lit(n).alias("measure"), value(n).alias("similarity")) for n in names])
    return wide.select(*[c for c in wide.columns if c not in names], F.inline(rows))


def score_table(table: DataFrame, names: list[str], text: str = "text", label: str | None = "label") -> DataFrame:
    """Every named measure for the star pairs of a table, in one pass."""
    return similarity_columns(star_pairs(table, features_of(names), text, label), names)


def term_counts(table: DataFrame, text: str = "text") -> DataFrame:
    """`case_id, doc_id, tok, cnt`, counted inside the row: no shuffle."""
    return table.select("case_id", "doc_id", F.inline(tx.bag(tx.tokens(F.col(text)))))


def vocabulary(table: DataFrame, text: str = "text", min_count: int = 1) -> DataFrame:
    """`tok, n, docs` over the whole corpus; counts are combined per document and per task before the shuffle."""
    counted = term_counts(table, text).groupBy("tok").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("docs"))
    return counted.where(F.col("n") >= min_count)


def word_documents(table: DataFrame, text: str = "text") -> DataFrame:
    """`tok, n`: the number of documents that hold each word, counted in the tasks before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(0), SPLIT_BYTES):
                words, _, number, _ = counted_words(batch.column(0).slice(start, stop - start))
                n = np.bincount(number, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(n > 0)), pa.array(n[n > 0])], names=["tok", "n"])

    return table.select(F.make_valid_utf8(text)).mapInArrow(counted, "tok string, n bigint").groupBy("tok").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, limit: int = FREQUENT_WORDS) -> tuple[DataFrame, DataFrame]:
    """The words of most documents, at most `limit` and none long, and all others. The bound is a power of the square root of two, so that one number for each comes back."""
    short = F.octet_length("tok") <= WORD_BYTES
    level = F.floor(2 * F.log2("n")).cast("int")
    held, least = 0, 1 << 10
    for r in sorted(counts.where(short).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        held += r.words
        if held > limit:
            break
        least = r.level
    often = short & (level >= least)
    return counts.where(often), counts.where(~often)


def _parts(often: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows `case_id, doc_id, first, salt, text`, each case and salt beginning with its original, to what the frequent words add to every row's squared length and
    product with its original, and the rare words with the row's and the original's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, idf = often.value
        original = None
        for batch in batches:
            for start, stop in text_slices(batch.column("text"), SPLIT_BYTES):
                part = batch.slice(start, stop - start)
                texts, first = part.column("text"), part.column("first").to_numpy(zero_copy_only=False)
                keep = ~first | (part.column("salt").to_numpy() == 0)
                ahead = 0 if original is None else 1
                if ahead:
                    texts, first = pa.concat_arrays([original, texts]), np.append(True, first)
                owner = np.maximum.accumulate(np.where(first, np.arange(len(texts)), 0))
                words, place, number, cnt = counted_words(texts)
                keys = place * len(words) + number
                wanted = owner[place] * len(words) + number
                # An original stands before its suspects, so that every place is inside.
                at = np.searchsorted(keys, wanted)
                theirs = np.where(keys[at] == wanted, cnt[at], 0)
                at = pc.fill_null(pc.index_in(words, value_set=frequent), -1).to_numpy()
                w = idf[at][number]
                square = np.bincount(place, (cnt * w) ** 2, len(texts))
                dot = np.bincount(place, cnt * theirs * w * w, len(texts))
                rare = at[number] < 0
                ends = pa.array(np.searchsorted(place[rare], np.arange(ahead, len(texts) + 1)), pa.int32())
                fields = [words.take(pa.array(number[rare])), pa.array(cnt[rare]), pa.array(theirs[rare])]
                rest = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=["tok", "cnt", "theirs"]))
                columns = [part.column("case_id"), part.column("doc_id"), part.column("first"), pa.array(square[ahead:]), pa.array(dot[ahead:]), rest]
                yield pa.RecordBatch.from_arrays(columns, names=["case_id", "doc_id", "first", "square", "dot", "rare"]).filter(pa.array(keep))
                original = texts.slice(owner[-1], 1)

    return run


def tfidf_cosine(table: DataFrame, frequent: int = FREQUENT_WORDS, suspects: int = SUSPECTS) -> DataFrame:
    """`case_id, doc_id, similarity`: cosine of tf · ln((N+1)/(df+1)) for each star pair.

    Texts are dealt by case, at most about `suspects` behind a copy of their original, so that both meet without moving words. The counts of the `frequent` most frequent words go
    to every task; only the rare words of each text are joined with theirs.
    """
    n = table.count()
    counts = materialize(word_documents(table), "document_frequency")
    often, others = frequent_words(counts, frequent)
    known = often.toArrow()
    # The last entry is that of words which are not frequent.
    idf = np.append(np.log((n + 1.0) / (known["n"].to_numpy() + 1)), 0.0)
    sent = table.sparkSession.sparkContext.broadcast((known["tok"].combine_chunks(), idf))

    cases = table.groupBy("case_id").agg(F.min("doc_id").alias("_first"), F.ceil(F.count(F.lit(1)) / F.lit(suspects)).cast("int").alias("_copies"))
    texts = table.select("case_id", "doc_id", F.make_valid_utf8("text").alias("text"))
    rows = join_unique(texts, materialize(cases, "cases"), ["case_id"], ["doc_id"])
    first = F.col("doc_id") == F.col("_first")
    salts = F.when(first, F.sequence(F.lit(0), F.col("_copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("_copies")).cast("int")))
    dealt = rows.select("case_id", "doc_id", first.alias("first"), F.explode(salts).alias("salt"), "text")
    ordered = dealt.repartition("case_id", "salt").sortWithinPartitions("case_id", "salt", F.desc("first"))
    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in ("case_id", "doc_id"))
    kind = f"{kinds}, first boolean, square double, dot double, rare array<struct<tok:string,cnt:bigint,theirs:bigint>>"
    parts = materialize(ordered.mapInArrow(_parts(sent), kind), "frequent_parts")

    # A word without a row is one document's.
    shared = others.where(F.col("n") > 1)
    rare = join_unique(parts.select("case_id", "doc_id", F.inline("rare")), shared, ["tok"], ["doc_id"], "left", counts=shared)
    weight = F.log(F.lit(n + 1.0) / (F.coalesce("n", F.lit(1)) + 1))
    weighted = rare.select("case_id", "doc_id", (F.col("cnt") * weight).alias("w"), (F.col("theirs") * weight).alias("wa"))
    sums = weighted.groupBy("case_id", "doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("more"), F.sum(F.col("w") * F.col("wa")).alias("more_dot"))
    both = parts.drop("rare").join(sums, ["case_id", "doc_id"], "left")
    norm, dot = F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0))), F.col("dot") + F.coalesce("more_dot", F.lit(0.0))
    whole = materialize(both.select("case_id", "doc_id", "first", norm.alias("norm"), dot.alias("dot")), "products")
    norms = whole.where("first").select("case_id", F.col("norm").alias("norm_a"))
    scored = join_unique(whole.where(~F.col("first")), norms, ["case_id"], ["doc_id"])
    return scored.select("case_id", "doc_id", sim.ratio(F.col("dot"), F.col("norm") * F.col("norm_a")).alias("similarity"))


def winnow_passages(table: DataFrame, k: int = WINNOW_K, window: int = WINNOW_WINDOW) -> DataFrame:
    """`case_id, doc_id, a_start, b_start, n_tokens, n_prints`: the passages that a suspect shares with its original, in tokens from 0.

    Every fingerprint of the suspect points at the place where its original first has it. Those that lie on one diagonal, at most a window
    apart, are one passage; as long as a window is no longer than a gram, its grams overlap, so that all its tokens are shared. Work is linear in the texts however often a gram
    repeats: a passage that the original repeats is reported at its first place. Null, empty and short texts share nothing.
    """
    if window > k:
        raise ValueError("a window longer than a gram leaves tokens between fingerprints unseen")
    places = tx.winnow_places(tx.ordered_gram_hashes(tx.tokens(F.col("text")), k), window)
    first = first_rows(table.select("case_id", "doc_id", "text"), "case_id", "doc_id")
    prints = materialize(first.select("case_id", F.inline(places)).groupBy("case_id", "h").agg(F.min("pos").alias("a_pos")), "original_prints")
    suspects = table.select("case_id", "doc_id", "text").join(first.select("case_id", "doc_id"), ["case_id", "doc_id"], "left_anti")
    hits = join_unique(suspects.select("case_id", "doc_id", F.inline(places)), prints, ["case_id", "h"], ["doc_id", "pos"])
    # One suspect's fingerprints on one diagonal.
    line = W.partitionBy("case_id", "doc_id", F.col("pos") - F.col("a_pos")).orderBy("pos")
    breaks = F.coalesce((F.col("pos") - F.lag("pos").over(line) > window).cast("int"), F.lit(1))
    marked = hits.select("case_id", "doc_id", "a_pos", "pos", breaks.alias("breaks"))
    passage = marked.withColumn("passage", F.sum("breaks").over(line)).groupBy("case_id", "doc_id", (F.col("pos") - F.col("a_pos")).alias("diagonal"), "passage")
    found = passage.agg(F.min("a_pos").alias("a_start"), F.min("pos").alias("b_start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n_prints"))
    return found.select("case_id", "doc_id", "a_start", "b_start", (F.col("end") - F.col("b_start") + k).alias("n_tokens"), "n_prints")


def minhash_candidates(table: DataFrame) -> DataFrame:
    """Every star pair with its exact Jaccard, its MinHash estimate, and whether any LSH band collides.

    Only originals meet suspects, so the work is linear and no pair is lost to the hashing.
    """
    pairs = star_pairs(table, {"nodes": _distinct, "sig": _signature}, label=None)
    equal = F.size(F.filter(F.zip_with("a_sig", "b_sig", lambda x, y: x == y), lambda hit: hit))
    bands = range(0, len(MINHASH_SEEDS), MINHASH_BAND)
    same = [F.slice("a_sig", i + 1, MINHASH_BAND) == F.slice("b_sig", i + 1, MINHASH_BAND) for i in bands]
    usable = (F.size("a_sig") > 0) & (F.size("b_sig") > 0)
    return pairs.select(
        "case_id",
        "doc_id",
        sim.jaccard(F.col("a_nodes"), F.col("b_nodes")).alias("similarity"),
        F.when(usable, equal / F.lit(float(len(MINHASH_SEEDS)))).otherwise(0.0).alias("estimate"),
        (usable & reduce(Column.__or__, same)).alias("candidate"),
    )
