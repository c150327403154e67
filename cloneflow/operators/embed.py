"""Word and node vectors, and document vectors made from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneflow.functions.text import portable_hash
from cloneflow.functions.vector import cosine, l2_normalize
from cloneflow.operators.joins import BROADCAST_BYTES, MIN_HOT_ROWS, first_rows, fits, join_unique, number_rows, row_bytes
from cloneflow.session import discard, materialize

# Word vectors pay for a larger broadcast: otherwise a vector travels with every token of the corpus.
LOOKUP_BYTES = 256 * 1024 * 1024
# Results of a slice of anchors.
PIECE_RESULTS = 1 << 16
# Nodes in a packed range of vectors, and entries in a packed piece of a sparse matrix.
BLOCK_NODES = 1 << 15
PIECE_EDGES = 1 << 19
# Pieces that read one range of vectors in one place, and pieces of one column at most.
ROUTES, COLUMN_PIECES = 32, 1 << 12
# A filter makes no vector larger than this against the others: numbers of four bytes would lose the smaller ones.
MOST_GROWTH = 1e6
# Places of a text whose pairs are counted at once.
PAIRED = 1 << 19
# Rows whose signs are summed at once, places in which a word of very many pairs is summed, and words whose draws a task remembers.
SUMMED, HOT_SALTS, REMEMBERED = 1 << 15, 64, 1 << 18
# Signs that one portable hash gives.
SIGN_BITS = 60


def mean_pool(rows: DataFrame, keys: list[str], dim: int, vec: str = "vec", weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean per key: `dim` sums in one hash aggregation with map-side combine."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = [F.sum(F.get(vec, F.lit(i)).cast("double") * w).alias(f"_s{i}") for i in range(dim)]
    pooled = rows.groupBy(*keys).agg(F.sum(w).alias("_w"), *sums)
    return pooled.select(*keys, F.array(*[F.col(f"_s{i}") / F.col("_w") for i in range(dim)]).alias(vec))


def first_pool(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The vector at the lowest position of each group."""
    return first_rows(rows, key, pos)


def lookup_doc_vectors(terms: DataFrame, lookup: DataFrame, docs: DataFrame, dim: int, broadcast_bytes: int | None = None) -> DataFrame:
    """`doc_id, vec`: mean vector of the known tokens of each document, zeros where none is known.

    `terms` is `doc_id, tok, cnt`; `lookup` is `tok, vec`. With a broadcast lookup the terms of a document
    never leave their task before they are summed. A lookup that is too large for that is split: the words of most documents, up to
    the limit, are broadcast, so that a vector travels only with the terms of rare words.
    """
    limit = LOOKUP_BYTES if broadcast_bytes is None else broadcast_bytes
    terms, lookup = terms.select("doc_id", "tok", "cnt"), lookup.select("tok", "vec")
    if fits(lookup, limit):
        known = terms.join(F.broadcast(lookup), "tok")
    else:
        # Read three times below: made from the texts once.
        terms = materialize(terms, "terms")
        counts = materialize(terms.groupBy("tok").agg(F.count(F.lit(1)).alias("n")), "term_documents")
        ranked = materialize(lookup.join(counts, "tok"), "ranked_lookup")
        least = _broadcast_level(ranked, limit)
        frequent, rare = (ranked.where(c).select("tok", "vec") for c in (_level() >= least, _level() < least))
        near = terms.join(F.broadcast(frequent), "tok")
        # A frequent word that the lookup lacks goes the way of the rare ones: its count is among theirs.
        others = lambda rows: rows.join(F.broadcast(frequent.select("tok")), "tok", "left_anti")
        far = join_unique(others(terms), rare, ["tok"], ["doc_id"], counts=others(counts), small=False)
        known = near.unionByName(far)
    means = mean_pool(known, ["doc_id"], dim, weight="cnt")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return docs.select("doc_id").join(means, "doc_id", "left").select("doc_id", F.coalesce("vec", zeros).alias("vec"))


def _level() -> Column:
    """Powers of the square root of two, so that words of one count stay together."""
    return F.floor(2 * F.log2("n")).cast("int")


def _broadcast_level(ranked: DataFrame, limit: int) -> int:
    """The lowest level of counts down to which all rows together stay within `limit` bytes: one row per level comes back, about a hundred at most."""
    held, least = 0, 1 << 10
    for r in sorted(ranked.groupBy(_level().alias("level")).agg(F.sum(row_bytes(ranked.schema)).alias("bytes")).collect(), reverse=True):
        held += r.bytes
        if held > limit:
            break
        least = r.level
    return least


def star_cosine(table: DataFrame, vectors: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`case_id, doc_id, is_clone, similarity` for the star pairs of `case_id, doc_id, label` by `doc_id, vec`.

    A pair with a missing vector on either side has a null similarity.
    """
    full = table.select("case_id", "doc_id", "label").join(vectors.select("doc_id", "vec"), "doc_id", "left")
    first = first_rows(table.select("case_id", "doc_id", "label"), "case_id", "doc_id")
    a = first.join(vectors.select("doc_id", "vec"), "doc_id", "left").select(
        "case_id", F.col("doc_id").alias("a_id"), F.col("label").alias("a_label"), F.col("vec").alias("a_vec")
    )
    return (
        join_unique(full, a, ["case_id"], ["doc_id"], broadcast_bytes=broadcast_bytes)
        .where(F.col("doc_id") != F.col("a_id"))
        .select(
            "case_id",
            "doc_id",
            (F.col("label") == F.col("a_label")).alias("is_clone"),
            cosine(F.col("a_vec"), F.col("vec")).alias("similarity"),
        )
    )


def _block_cosine(ids: list, labels: list, matrix: np.ndarray):
    """All rows of a batch against all anchors by one matrix product, in slices of at most PIECE_RESULTS results."""
    dim = matrix.shape[1]
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    anchor_ids, anchor_labels = pa.array(ids, pa.int64()), np.array(labels, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE_RESULTS // len(ids))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                doc_id, label, vec = whole.slice(at, step).columns
                usable = np.array([v is not None and len(v) == dim and None not in v for v in vec.to_pylist()], bool)
                x = np.zeros((len(doc_id), dim))
                if usable.any():
                    x[usable] = vec.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                scale = np.sqrt((x * x).sum(axis=1))[:, None] * lengths
                made = np.divide(x @ matrix.T, scale, out=np.zeros(scale.shape), where=scale > 0)
                same = np.array(label.to_pylist(), object)[:, None] == anchor_labels
                known = np.repeat(usable, len(ids))
                rows, columns = np.repeat(np.arange(len(doc_id)), len(ids)), np.tile(np.arange(len(ids)), len(doc_id))
                fields = [anchor_ids.take(pa.array(columns)), doc_id.take(pa.array(rows)), pa.array(same.ravel().astype(bool)), pa.array(made.ravel(), mask=~known)]
                yield pa.RecordBatch.from_arrays(fields, names=["anchor_id", "doc_id", "is_clone", "similarity"])

    return run


def anchor_cosine(vectors: DataFrame, anchor_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`anchor_id, doc_id, is_clone, similarity`: the first vector of each label (the least id) against every vector that is no anchor.

    The anchors are a stated query set. They go to the tasks as matrices of at most `anchor_bytes`, one pass over the vectors for each, and meet a batch in one matrix product;
    no vector is shuffled. A null vector, one with nulls inside or of another length than the anchors has a null similarity, and is no anchor; zeros have 0. Rows without a label are no anchors and no clones.
    """
    table = vectors.select(F.col("doc_id").cast("bigint"), "label", F.col("vec").cast("array<double>").alias("vec"))
    whole = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull())
    anchors = materialize(first_rows(table.where(whole), "label", "doc_id"), "anchors")
    kind = "anchor_id long, doc_id long, is_clone boolean, similarity double"
    n, dim, least = anchors.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.min(F.size("vec"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], kind)
    if dim != least:
        raise ValueError("anchors of different lengths")
    rest = table.join(anchors.select("doc_id"), "doc_id", "left_anti")
    numbered = materialize(number_rows(anchors.withColumn("name", F.col("doc_id").cast("string")), "name"), "numbered_anchors")
    step, made = max(1, anchor_bytes // (8 * dim)), None
    for start in range(0, n, step):
        some = numbered.where((F.col("idx") >= start) & (F.col("idx") < start + step)).select("doc_id", "label", "vec").collect()
        passed = rest.mapInArrow(_block_cosine([r.doc_id for r in some], [r.label for r in some], np.array([r.vec for r in some])), kind)
        made = passed if made is None else made.unionByName(passed)
    return made


def _pair_counts(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of words to `tok, other, n`, tok <= other: the pairs at most `window` places apart, counted for PAIRED places at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            words = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            named = words.dictionary_encode()
            order = pc.sort_indices(named.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            names = named.dictionary.take(order)
            known = named.indices.is_valid().to_numpy(zero_copy_only=False)
            place = np.where(known, rank[named.indices.fill_null(0).to_numpy()], -1) if len(rank) else np.zeros(0, np.int64)
            for start in range(0, len(place), PAIRED):
                met = []
                for k in range(1, window + 1):
                    x, y = place[start : start + PAIRED], place[start + k : start + k + PAIRED]
                    x = x[: len(y)]
                    near = (owner[start : start + len(x)] == owner[start + k : start + k + len(y)]) & (x >= 0) & (y >= 0)
                    met.append((np.minimum(x, y) * len(names) + np.maximum(x, y))[near])
                pairs, n = np.unique(np.concatenate(met), return_counts=True)
                sides = [names.take(pa.array(c)).cast(pa.string()) for c in np.divmod(pairs, len(names))]
                yield pa.RecordBatch.from_arrays([*sides, pa.array(n.astype(np.int64))], names=["tok", "other", "n"])

    return run


def _half_counts(sentences: DataFrame, window: int, tokens: str) -> DataFrame:
    """`tok, other, n`: the rows of `cooccurrences` with tok <= other, so that every pair is shuffled once."""
    pairs = sentences.select(F.col(tokens).cast("array<string>")).mapInArrow(_pair_counts(window), "tok string, other string, n long")
    # A word beside itself is so in both directions.
    return pairs.groupBy("tok", "other").agg(F.sum(F.when(F.col("tok") == F.col("other"), 2 * F.col("n")).otherwise(F.col("n"))).alias("n"))


def _both_ways(half: DataFrame, *values: str) -> DataFrame:
    """Each row, and unless its two words are one, the same with the words exchanged."""
    row = lambda tok, other: F.struct(F.col(tok).alias("tok"), F.col(other).alias("other"), *values)
    one, two = row("tok", "other"), row("other", "tok")
    return half.select(F.inline(F.when(F.col("tok") == F.col("other"), F.array(one)).otherwise(F.array(one, two))))


def cooccurrences(sentences: DataFrame, window: int = 5, tokens: str = "tokens") -> DataFrame:
    """`tok, other, n`: how often two words stand at most `window` places apart, in both directions, combined before the shuffle."""
    return _both_ways(_half_counts(sentences, window, tokens), "n")


def positive_pmi(counts: DataFrame) -> DataFrame:
    """`tok, other, w`: positive pointwise mutual information of `tok, other, n`, whose two sides are alike."""
    return _both_ways(_half_pmi(counts.where(F.col("tok") <= F.col("other")))[0], "w")


def _half_pmi(half: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`tok, other, w` for the rows tok <= other, and `tok, total, n`: the sum of a word's counts and the number of its pairs."""
    half = materialize(half, "cooccurrences")
    sums = materialize(_both_ways(half, "n").groupBy("tok").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n")), "word_totals")
    everything = sums.agg(F.sum("total").cast("double")).first()[0] or 0.0
    per_word = sums.select("tok", "n")
    near = join_unique(half, sums.select("tok", F.col("total").alias("of_tok")), ["tok"], ["other"], counts=per_word)
    far = sums.select(F.col("tok").alias("other"), F.col("total").alias("of_other"))
    near = join_unique(near, far, ["other"], ["tok"], counts=per_word.withColumnRenamed("tok", "other"))
    pmi = F.log(F.col("n") * F.lit(everything) / F.col("of_tok") / F.col("of_other"))
    return near.select("tok", "other", F.greatest(pmi, F.lit(0.0)).alias("w")), sums


def numbered_pmi(half: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`tok, idx, total, n`, the words with their numbers, those of many pairs first, and `i, j, w`: the positive PMI of the counts `tok, other, n`, tok <= other,
    in both directions. Names are joined once for each side, which brings a word's number and its total together."""
    half = materialize(half, "cooccurrences")
    sums = materialize(_both_ways(half, "n").groupBy("tok").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n")), "word_totals")
    everything = sums.agg(F.sum("total").cast("double")).first()[0] or 0.0
    nodes = materialize(number_rows(sums, order="tok", level=_rarity()), "words")
    named = half.withColumnRenamed("n", "met")
    for side, other, i in (("tok", "other", "i"), ("other", "i", "j")):
        known = nodes.select(F.col("tok").alias(side), F.col("idx").alias(i), F.col("total").alias(f"of_{i}"))
        named = join_unique(named, known, [side], [other], counts=nodes.select(F.col("tok").alias(side), "n")).drop(side)
    pmi = F.log(F.col("met") * F.lit(everything) / F.col("of_i") / F.col("of_j"))
    one = named.select("i", "j", pmi.alias("w")).where(F.col("w") > 0)
    entry = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), "w")
    both = F.when(F.col("i") == F.col("j"), F.array(entry("i", "j"))).otherwise(F.array(entry("i", "j"), entry("j", "i")))
    return nodes, one.select(F.inline(both))


def _draws(word: Column, dim: int, seed: int) -> list[Column]:
    return [portable_hash(F.concat_ws("#", F.lit(str(seed)), F.lit(str(i)), word)) for i in range(-(-dim // SIGN_BITS))]


def random_signs(word: Column, dim: int, seed: int) -> list[Column]:
    """`dim` numbers, 1 or -1, that depend on the word and the seed only."""
    drawn = _draws(word, dim, seed)
    return [2 * F.shiftright(drawn[i // SIGN_BITS], i % SIGN_BITS).bitwiseAND(F.lit(1)) - 1 for i in range(dim)]


def _signed_sums(dim: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows `tok, other, w` sorted by `tok` to `tok, vec`, the sum of w times the signs of the other words. A word's draws are those of `random_signs`, made once while it is remembered."""
    known: dict[bytes, tuple[int, ...]] = {}
    starts = [f"{seed}#{i}#".encode() for i in range(-(-dim // SIGN_BITS))]
    places = [64 * (i // SIGN_BITS) + i % SIGN_BITS for i in range(dim)]

    def positive(words: pa.Array) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
        found = []
        for w in words.cast(pa.binary()).to_pylist():
            if (d := known.get(w)) is None:
                d = known[w] = tuple(int.from_bytes(md5(p + w).digest()[:8]) >> 4 for p in starts)
            found.append(d)
        bits = np.unpackbits(np.array(found, "<i8").reshape(len(words), -1).view(np.uint8), axis=1, bitorder="little")
        return np.ascontiguousarray(bits[:, places]).view(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(dim)

        def out(names: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * dim, pa.int32()), pa.array(sums.ravel()))], ["tok", "vec"])

        for whole in batches:
            for at in range(0, whole.num_rows, SUMMED):
                batch = whole.slice(at, SUMMED)
                names = batch.column("tok")
                other = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
                heads = np.concatenate([[0], np.flatnonzero(other) + 1])
                others = batch.column("other").dictionary_encode()
                w = batch.column("w").to_numpy(zero_copy_only=False)[:, None]
                sums = np.add.reduceat(np.where(positive(others.dictionary)[others.indices.to_numpy()], w, -w), heads, axis=0)
                found = names.take(pa.array(heads))
                if held is not None and held != found[0].as_py():
                    yield out(pa.array([held], pa.string()), total[None])
                elif held is not None:
                    sums[0] += total
                # The last word may go on.
                held, total = found[-1].as_py(), sums[-1].copy()
                if len(found) > 1:
                    yield out(found.slice(0, len(found) - 1).cast(pa.string()), sums[:-1])
        if held is not None:
            yield out(pa.array([held], pa.string()), total[None])

    return run


def w2v_train(sentences: DataFrame, dim: int = 100, window: int = 5, min_count: int = 1, seed: int = 42, tokens: str = "tokens") -> DataFrame:
    """`tok, vec` for every word that occurs `min_count` times: its row of the positive PMI matrix of window co-occurrences, projected to
    `dim` numbers by random signs of the context words, which keeps inner products.

    A word without any neighbour has a zero vector. One aggregation counts the pairs, one sums the projections; the model is a table, no
    part of it passes through the driver, and its numbers do not depend on partitions or cores. There is no limit on the vocabulary.
    """
    words = sentences.select(F.explode(tokens).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).select("tok")
    half, sums = _half_pmi(_half_counts(sentences, window, tokens))
    weights = materialize(half.where(F.col("w") > 0), "weights")
    both = _both_ways(weights, "w")
    if min_count > 1:
        both = both.join(words, "tok", "left_semi")
    sums = materialize(sums.where(F.col("n") > MIN_HOT_ROWS).select("tok"), "hot_words")

    def projected(rows: DataFrame, *keys: Column | str) -> DataFrame:
        met = rows.select("tok", "other", "w").repartition(*keys).sortWithinPartitions("tok")
        return met.mapInArrow(_signed_sums(dim, seed), "tok string, vec array<double>")

    # What is shuffled are pairs: sums made before a shuffle would be as many rows, `dim` numbers wide. Only words of more than MIN_HOT_ROWS pairs,
    # of which there are few, are summed in several places.
    hot = F.broadcast(sums)
    parts = projected(both.join(hot, "tok"), "tok", F.pmod(F.xxhash64("other"), F.lit(HOT_SALTS)))
    whole = parts.groupBy("tok").agg(F.array(*[F.sum(F.get("vec", F.lit(i))) for i in range(dim)]).alias("vec"))
    vectors = projected(both.join(hot, "tok", "left_anti"), "tok").unionByName(whole)
    alone = words.join(both.select("tok").distinct(), "tok", "left_anti")
    return vectors.unionByName(alone.select("tok", F.array_repeat(F.lit(0.0), dim).alias("vec")))


def factorize(
    weights: DataFrame, dim: int = 16, seed: int = 42, spare: int = 16, rounds: int = 100, tolerance: float = 1e-3, block: int = BLOCK_NODES
) -> DataFrame:
    """`tok, vec`: the leading factors of a symmetric matrix `tok, other, w`, scaled so that the inner product of two vectors is the entry of
    the matrix's best approximation of rank `dim`, negative eigenvalues taken as positive.

    A randomised range finder: a block of dim + spare random vectors is multiplied with the matrix and made orthonormal again, until none of the
    leading values moves by more than `tolerance` times the largest; it raises when `rounds` rounds do not reach that. Orthonormal
    vectors come from a QR decomposition in each task, whose triangles are combined in a tree; what reaches the driver are
    matrices of the block's width. The start is a hash of the words, so nothing depends on partitions.
    """
    weights = materialize(weights.select("tok", "other", "w"), "weights")
    counts = weights.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    nodes = materialize(number_rows(counts, order="tok"), "words")
    ends = join_unique(weights, nodes.select("tok", F.col("idx").alias("i")), ["tok"], ["other"], counts=nodes.select("tok", "n"))
    there = nodes.select(F.col("tok").alias("other"), F.col("idx").alias("j"))
    ends = join_unique(ends, there, ["other"], ["tok"], counts=nodes.select(F.col("tok").alias("other"), "n"))
    return leading_factors(nodes, ends.select("i", "j", F.col("w").cast("double").alias("w")), dim, seed, spare, rounds, tolerance, block)


def leading_factors(
    nodes: DataFrame,
    entries: DataFrame,
    dim: int,
    seed: int = 42,
    spare: int = 16,
    rounds: int = 100,
    tolerance: float = 1e-3,
    block: int = BLOCK_NODES,
    kind: type = np.float64,
) -> DataFrame:
    """`factorize` for a matrix `i, j, w` whose words `tok` have the numbers `idx`; a word without entries has zeros. Packed vectors are of `kind`: every
    round makes them orthonormal anew, so numbers of four bytes do for a tolerance far above 1e-7."""
    matrix = matrix_pieces(entries, block)
    width = dim + spare
    start = nodes.select("idx", F.array(*[b.cast("double") for b in random_signs(F.col("tok"), width, seed)]).alias("vec"))
    x = materialize(vector_blocks(start, width, block, kind), "vectors")
    turn, before, moved = np.linalg.pinv(tall_triangle(x, "vec", width, kind)), np.zeros(dim), float("inf")
    held = x
    for _ in range(rounds):
        image = product(matrix, _turned(x, turn, width, kind), turn.shape[1], block, keep=True, kind=kind)
        width = turn.shape[1]
        done = materialize(image, "round")
        discard(held)
        values, axes = _leading(done, width, kind)
        now = np.pad(np.abs(values), (0, max(0, dim - len(values))))[:dim]
        moved = np.abs(now - before).max() / (now[0] or 1.0)
        if moved <= tolerance:
            ends = np.pad(axes[:, :dim] * np.sqrt(np.abs(values[:dim])), ((0, 0), (0, max(0, dim - width))))
            return nodes.select("idx", "tok").join(vector_rows(done, ends, width, block, kind), "idx").select("tok", "vec")
        # The images are the next round's vectors, read where they lie.
        before, held = now, done
        x = done.select("block", F.col("before").alias("vec"))
        turn = np.linalg.pinv(tall_triangle(x, "vec", width, kind))
    raise RuntimeError(f"factorize: values still move by {moved:.1e} after {rounds} rounds, more than {tolerance:.1e}")


def tall_triangle(x: DataFrame, column: str, width: int, kind: type = np.float64) -> np.ndarray:
    """R of the QR decomposition of all rows of a packed column: one per task, then of those of some tasks, then of what is left."""

    def reduced(of: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = np.zeros((0, width))
            for batch in batches:
                for value in batch.column(0):
                    r = np.linalg.qr(np.vstack([r, _table(value, width, of)]), mode="r")
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

        return run

    each = materialize(x.select(column).mapInArrow(reduced(kind), "r binary"), "triangles")
    some = each.repartition(max(1, int(each.count() ** 0.5))).mapInArrow(reduced(np.float64), "r binary").collect()
    return np.linalg.qr(np.vstack([np.frombuffer(row.r).reshape(-1, width) for row in some]), mode="r") if some else np.eye(width)


def _turned(x: DataFrame, turn: np.ndarray, width: int, kind: type = np.float64) -> DataFrame:
    """`block, vec, before` with the vectors multiplied by `turn`."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made = (_table(batch.column("vec")[k], width, kind) @ turn).astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("block")[k : k + 1], pa.array([made], pa.binary()), pa.nulls(1, pa.binary())], ["block", "vec", "before"])

    return x.select("block", "vec").mapInArrow(times, "block int, vec binary, before binary")


def _leading(x: DataFrame, width: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the matrix in the span of the orthonormal `vec`, whose image is `before`, largest in size first, and their vectors."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for k in range(batch.num_rows):
                total += _table(batch.column("vec")[k], width, kind).T @ _table(batch.column("before")[k], width, kind)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["sums"])

    parts = x.select("vec", "before").mapInArrow(cross, "sums array<double>").select(F.posexplode("sums").alias("pos", "value"))
    total = np.zeros(width * width)
    for row in parts.groupBy("pos").agg(F.sum("value").alias("value")).collect():
        total[row.pos] = row.value
    total = total.reshape(width, width)
    values, axes = np.linalg.eigh((total + total.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")
    return values[order], axes[:, order]


def word_factors(sentences: DataFrame, dim: int = 16, window: int = 5, seed: int = 42, tokens: str = "tokens") -> DataFrame:
    """`tok, vec`: the leading factors of the positive PMI matrix of window co-occurrences; words without neighbours have zeros."""
    words = sentences.select(F.explode(tokens).alias("tok")).distinct()
    found = leading_factors(*numbered_pmi(_half_counts(sentences, window, tokens)), dim, seed, kind=np.float32)
    return words.join(found, "tok", "left").select("tok", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def with_lonely_nodes(lookup: DataFrame, nodes: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """`lookup` for every token of `nodes`: one without a vector, or with zeros, because it has no neighbour, gets a unit vector of its own, from
    a hash of the token."""
    own = F.array(*[s / F.lit(float(np.sqrt(dim))) for s in random_signs(F.col("tok"), dim, seed)])
    every = nodes.select("tok").distinct().join(lookup, "tok", "left")
    none = F.col("vec").isNull() | F.forall("vec", lambda v: v == 0)
    return every.select("tok", F.when(none, own).otherwise(F.col("vec")).alias("vec"))


def w2v_doc_vectors(terms: DataFrame, lookup: DataFrame, docs: DataFrame, dim: int, unit: bool = True) -> DataFrame:
    """Mean word vector per document, unit length or raw."""
    vectors = lookup_doc_vectors(terms, lookup, docs, dim)
    return vectors.withColumn("vec", l2_normalize(F.col("vec"))) if unit else vectors


def glove_factorize(
    edges: DataFrame,
    dim: int = 16,
    seed: int = 42,
    rounds: int | None = None,
    most: float = 100.0,
    power: float = 0.75,
    ridge: float = 0.05,
    tolerance: float = 1e-2,
    block: int = BLOCK_NODES,
) -> DataFrame:
    """`tok, vec`: the sum of a token's row and column factors, fitted to the logs of the co-occurrences `src, dst, n`.

    The loss of an edge is f(n) (row · column + row bias + column bias - ln n)², with f(n) = min(1, (n / most)^power); `ridge` times the squares of all
    parameters is added. Each half of a round solves one side exactly while the other is fixed, so the loss never grows; rounds go on until one
    takes less than `tolerance` off it (or for the number of `rounds` that is asked for). Nodes have dense numbers and edges lie packed by ranges of the nodes that are
    solved, as for a sparse product; a piece of edges is sent each vector it needs once and adds up whole nodes' normal equations. Only nodes of more than
    PIECE_EDGES edges are summed in several pieces. Of the model, only the loss reaches the driver.
    """
    weight = F.least(F.pow(F.col("n") / F.lit(most), F.lit(power)), F.lit(1.0))
    nodes, one = numbered_edges(edges.select("src", "dst", weight.alias("f"), F.log(F.col("n").cast("double")).alias("log")), "f", "log")
    sides = [fit_pieces(one.select(F.col(at).alias("i"), F.col(to).alias("j"), "f", "log"), block) for at, to in (("j", "i"), ("i", "j"))]
    discard(one)
    start = [s / F.lit(float(np.sqrt(dim))) for s in random_signs(F.col("tok"), dim, seed)]
    packed = vector_blocks(nodes.select("idx", F.array(*start, F.lit(0.0), F.lit(0.0)).alias("vec")), dim + 2, block)
    columns = materialize(packed.select("block", "vec", F.lit(0.0).alias("loss"), F.lit(0.0).alias("squares")), "columns")
    before, done, rows = float("inf"), 0, None
    while True:
        made = materialize(fitted_blocks(*sides[0], columns, dim, ridge, block), "rows")
        discard(columns)
        columns = materialize(fitted_blocks(*sides[1], made, dim, ridge, block), "columns")
        if rows is not None:
            discard(rows)
        rows, done = made, done + 1
        # What is left over at the columns' optimum, and the ridge of the rows.
        loss = (columns.agg(F.sum("loss")).first()[0] or 0.0) + ridge * (rows.agg(F.sum("squares")).first()[0] or 0.0)
        if done == rounds or rounds is None and before - loss <= tolerance * loss:
            break
        before = loss
    parts = [vector_rows(side, np.eye(dim + 2, dim), dim + 2, block) for side in (rows, columns)]
    sums = parts[0].join(parts[1].withColumnRenamed("vec", "more"), "idx").select("idx", F.zip_with("vec", "more", lambda x, y: x + y).alias("vec"))
    return nodes.select("idx", "tok").join(sums, "idx").select("tok", "vec")


def numbered_edges(edges: DataFrame, *values: str) -> tuple[DataFrame, DataFrame]:
    """`tok, n, idx`, the nodes of `src, dst` with their numbers, those of many edges first, and the edges as `i, j` with their values."""
    edges = materialize(edges.select("src", "dst", *values), "named_edges")
    counts = edges.select(F.explode(F.array("src", "dst")).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    nodes = materialize(number_rows(counts, order="tok", level=_rarity()), "nodes")
    named = edges
    for side, name in (("src", "i"), ("dst", "j")):
        numbers = nodes.select(F.col("tok").alias(side), F.col("idx").alias(name))
        named = join_unique(named, numbers, [side], ["dst" if side == "src" else "i"], counts=nodes.select(F.col("tok").alias(side), "n")).drop(side)
    one = materialize(named.select("i", "j", *values), "numbered_edges")
    discard(edges)
    return nodes, one


def fit_pieces(entries: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The entries `i, j, f, log` as `matrix_pieces` that hold all entries of a column, and the routes `block, salt, to, piece, at`: which vectors of a range each
    piece needs, in the order of its rows. A range that many pieces read has several salts."""
    pieces = matrix_pieces(entries, block, ("f", "log"), by="j")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                from_, at = np.divmod(_numbers(batch.column("rows")[k], np.int64), block)
                cuts = np.flatnonzero(np.concatenate([[True], from_[1:] != from_[:-1], [True]]))
                found = [at[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
                own = [pa.array([batch.column(c)[k].as_py()] * len(found), pa.int32()) for c in ("block", "piece")]
                yield pa.RecordBatch.from_arrays([pa.array(from_[cuts[:-1]], pa.int32()), *own, pa.array(found, pa.binary())], ["block", "to", "piece", "at"])

    routes = materialize(pieces.select("block", "piece", "rows").mapInArrow(split, "block int, to int, piece int, at binary"), "wanted")
    salts = F.broadcast(routes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROUTES)).cast("int").alias("salts")))
    salted = routes.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("to", "piece"), F.col("salts")).cast("int"))
    made = materialize(salted, "routes")
    discard(routes)
    return pieces, made


def _solved(sums: np.ndarray, size: int, ridge: float) -> np.ndarray:
    """Normal equations (the upper triangle by rows, the right side, the sum of squares) to their solutions, with the loss that is left behind them."""
    i, j = np.triu_indices(size)
    left = np.zeros((len(sums), size, size))
    left[:, i, j] = left[:, j, i] = sums[:, : len(i)]
    right = sums[:, len(i) : -1]
    found = np.linalg.solve(left + ridge * np.eye(size), right[:, :, None])[:, :, 0]
    # At the optimum x of x'Ax - 2b'x + c with ridge, what is left is c - b'x.
    return np.concatenate([found, sums[:, -1:] - (found * right).sum(axis=1, keepdims=True)], axis=1)


def fitted_blocks(pieces: DataFrame, routes: DataFrame, known: DataFrame, dim: int, ridge: float, block: int) -> DataFrame:
    """`block, vec, loss, squares` for the columns of the pieces: packed factor, bias and loss of each node, given those of the rows; zeros for a number without
    entries. `loss` and `squares` are the block's sums."""
    size, width = dim + 1, dim + 2
    n_sums = size * (size + 1) // 2 + size + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                wanted = _table(batch.column("vec")[k], width)[_numbers(batch.column("at")[k], np.int32), :size].tobytes()
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[k : k + 1] for c in ("to", "piece", "block")], pa.array([wanted], pa.binary())], ["to", "piece", "block", "value"])

    def normal(z: np.ndarray, heads: np.ndarray, cols: np.ndarray, f: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(cols, kind="stable")
        row, cols, f = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(cols))))[order], cols[order], f[order]
        starts = np.flatnonzero(np.concatenate([[True], cols[1:] != cols[:-1]]))
        near = [np.ascontiguousarray(z[:, c])[row] for c in range(dim)] + [np.ones(len(row))]
        left, sums, at = log[order] - z[row, dim], np.empty((len(starts), n_sums)), 0
        for i in range(size):
            weighted = f * near[i]
            for j in range(i, size):
                sums[:, at] = np.add.reduceat(weighted * near[j], starts)
                at += 1
            sums[:, n_sums - 1 - size + i] = np.add.reduceat(weighted * left, starts)
        sums[:, -1] = np.add.reduceat(f * left * left, starts)
        return cols[starts], sums

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("value")[k].is_valid:
                    held.append(_table(batch.column("value")[k], size))
                    continue
                # A piece comes behind the vectors it needs.
                kinds = (("heads", np.int32), ("cols", np.int32), ("f", np.float64), ("log", np.float64))
                at, sums = normal(np.concatenate(held), *(_numbers(batch.column(c)[k], t) for c, t in kinds))
                held, part = [], batch.column("piece")[k].as_py() < 0
                value = sums if part else _solved(sums, size, ridge)
                fields = [batch.column("to")[k : k + 1], pa.array([part]), *[pa.array([v], pa.binary()) for v in (at.astype(np.int32).tobytes(), value.tobytes())]]
                yield pa.RecordBatch.from_arrays(fields, ["block", "part", "at", "value"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made, parts = None, None, {}

        def out() -> pa.RecordBatch:
            for at, sums in parts.items():
                made[at] = _solved(sums[None], size, ridge)[0]
            fields = [pa.array([key], pa.int32()), pa.array([made.tobytes()], pa.binary()), pa.array([made[:, -1].sum()]), pa.array([(made[:, :size] ** 2).sum()])]
            return pa.RecordBatch.from_arrays(fields, ["block", "vec", "loss", "squares"])

        for batch in batches:
            for k in range(batch.num_rows):
                if (b := batch.column("block")[k].as_py()) != key:
                    if key is not None:
                        yield out()
                    key, made, parts = b, np.zeros((block, width)), {}
                at = _numbers(batch.column("at")[k], np.int32)
                if batch.column("part")[k].as_py():
                    for node, sums in zip(at.tolist(), _table(batch.column("value")[k], n_sums), strict=True):
                        parts[node] = parts[node] + sums if node in parts else sums
                else:
                    made[at] = _table(batch.column("value")[k], width)
        if key is not None:
            yield out()

    salts = F.broadcast(routes.select("block", "salts").distinct())
    dealt = known.select("block", "vec").join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    sent = dealt.join(routes.drop("salts"), ["block", "salt"]).select("block", "vec", "to", "piece", "at").mapInArrow(send, "to int, piece int, block int, value binary")
    last = pieces.select(F.col("block").alias("to"), "piece", F.lit((1 << 31) - 1).alias("block"), F.lit(None).cast("binary").alias("value"), "heads", "cols", "f", "log")
    met = sent.unionByName(last, allowMissingColumns=True).repartition("to", "piece").sortWithinPartitions("to", "piece", "block")
    found = met.mapInArrow(fit, "block int, part boolean, at binary, value binary")
    return found.repartition("block").sortWithinPartitions("block", "part", "at").mapInArrow(gather, "block int, vec binary, loss double, squares double")


def _fitted(edges: DataFrame, known: DataFrame, at: str, to: str, dim: int, ridge: float, counts: DataFrame, block: int = BLOCK_NODES) -> DataFrame:
    """`tok, vec, loss` for every `to` node: the factor, and behind it the bias, that fit its edges `f, log` best, given those of the
    `at` nodes, and the loss of its edges with its own ridge."""
    nodes, one = numbered_edges(edges.select(F.col(at).alias("src"), F.col(to).alias("dst"), "f", "log"), "f", "log")
    given = nodes.join(known, "tok").select("idx", F.concat("vec", F.array(F.lit(0.0))).alias("vec"))
    made = fitted_blocks(*fit_pieces(one, block), vector_blocks(given, dim + 2, block), dim, ridge, block)
    rows = vector_rows(made, np.eye(dim + 2), dim + 2, block).join(nodes.select("idx", "tok"), "idx").join(one.select(F.col("j").alias("idx")), "idx", "left_semi")
    return rows.select("tok", F.slice("vec", 1, dim + 1).alias("vec"), F.element_at("vec", dim + 2).alias("loss"))


def spectral_embed(
    edges: DataFrame, dim: int = 16, rounds: int = 60, seed: int = 42, degree: int = 20, tolerance: float = 1e-5, block: int = BLOCK_NODES
) -> DataFrame:
    """`tok, vec`: the leading eigenvectors of the normalised token graph S = D^-1/2 (A + Aᵀ) D^-1/2, largest eigenvalue first.

    Subspace iteration on a block of 1.5 × dim vectors, one of them the known leading one, with a Chebyshev filter of S in each round. It ends
    when every one of the dim vectors q with value t has |S q - t q| <= tolerance, and raises when `rounds` rounds do not reach that.
    Nodes have dense numbers, those of many neighbours first; the vectors are stored by ranges of nodes and the edges by the range that they read from, in
    pieces of bounded size, so that a product with S is one join of few large rows, one pass of numpy over each piece of edges and one
    sum by range. As most edges read from the first ranges, few sums are sent for a node. Between products numbers have four bytes, sums have eight.
    Only three Gram matrices of the vectors reach the driver. Every product is a written table, which is deleted when the next one is written.
    """
    half = materialize(edges.select("src", "dst", F.col("n").cast("double").alias("n")), "half_edges")
    ends = half.select(F.explode(F.array("src", "dst")).alias("tok"), "n")
    nodes = ends.groupBy("tok").agg(F.sum("n").alias("d"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(number_rows(nodes, order="tok", level=_rarity()), "nodes")
    here, there = (nodes.select(F.col("tok").alias(side), F.col("idx").alias(i), F.col("d").alias(d)) for side, i, d in (("src", "i", "di"), ("dst", "j", "dj")))
    counts = {side: nodes.select(F.col("tok").alias(side), "n") for side in ("src", "dst")}
    named = join_unique(half, here, ["src"], ["dst"], counts=counts["src"]).select("dst", "i", "di", "n")
    named = join_unique(named, there, ["dst"], ["i"], counts=counts["dst"])
    one = materialize(named.select("i", "j", (F.col("n") / F.sqrt(F.col("di") * F.col("dj"))).alias("w")), "one_way")
    discard(half)
    entry = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), "w")
    matrix = matrix_pieces(one.select(F.inline(F.array(entry("i", "j"), entry("j", "i")))).groupBy("i", "j").agg(F.sum("w").alias("w")), block)
    discard(one)

    width, kind = dim + dim // 2, np.float32
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "tok"), F.lit(2_000_001)) / F.lit(1_000_000.0)) - 1
    start = nodes.select("idx", F.array(F.sqrt("d"), *[unit(k) for k in range(1, width)]).alias("vec"))
    x = materialize(vector_blocks(start, width, block, kind), "vectors")
    worst = float("inf")
    for _ in range(rounds):
        done = materialize(product(matrix, x, width, block, keep=True, kind=kind), "round")
        discard(x)
        values, turn, residuals = _ritz(done, width, kind)
        worst = residuals[:dim].max(initial=0.0)
        if worst <= tolerance:
            turn = np.pad(turn[:, :dim], ((0, 0), (0, max(0, dim - len(values)))))
            return nodes.select("idx", "tok").join(vector_rows(done, turn, width, block, kind), "idx").select("tok", "vec")
        # The filter damps what lies between -1 and the block's last value.
        fewer, centre, half = len(values), float(values[-1] - 1) / 2, float(values[-1] + 1) / 2
        growth = np.arccosh(max((float(values[0]) - centre) / half, 1.0))
        steps = degree if growth * degree <= np.arccosh(MOST_GROWTH) else max(1, int(np.arccosh(MOST_GROWTH) / growth))
        now = materialize(_first_filter(done, turn, width, centre, half, kind), "step")
        discard(done)
        width = fewer
        for _ in range(steps - 1):
            after = materialize(product(matrix, now, width, block, (2 / half, -2 * centre / half, -1.0), kind=kind), "step")
            discard(now)
            now = after
        x = now.select("block", "vec", F.lit(None).cast("binary").alias("before"))
    raise RuntimeError(f"spectral_embed: residual {worst:.1e} after {rounds} rounds, more than {tolerance:.1e}")


def _rarity() -> Column:
    """Levels of `n`, the largest first."""
    return -F.floor(F.log2("n")).cast("int")


def _numbers(value: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _table(value: pa.Scalar, width: int, kind: type = np.float64) -> np.ndarray:
    return _numbers(value, kind).reshape(-1, width).astype(np.float64, copy=False)


def matrix_pieces(entries: DataFrame, block: int, values: tuple[str, ...] = ("w",), by: str = "i") -> DataFrame:
    """`block, piece, rows, heads, cols` and values from entries `i, j` and values: the entries of a range of columns as packed arrays, sorted by row, with the distinct
    rows and where each begins, in pieces of about PIECE_EDGES entries. A range with more is dealt over several pieces by a hash of the row, numbered from 0; `by` j keeps a
    column whole instead, unless it has over PIECE_EDGES entries, which have pieces of their own, numbered below 0."""
    ranged = entries.withColumn("block", F.floor(F.col("j") / block).cast("int"))
    ranged = materialize(ranged, "entries")
    share = lambda: F.ceil(F.count(F.lit(1)) / F.lit(PIECE_EDGES)).cast("int").alias("pieces")
    dealt = join_unique(ranged, ranged.groupBy("block").agg(share()), ["block"], ["i"]).withColumn("piece", F.pmod(F.xxhash64(by), F.col("pieces")).cast("int"))
    if by == "j":
        # Each stands for more than PIECE_EDGES entries.
        hot = ranged.groupBy("j").agg(share()).where(F.col("pieces") > 1).select("j", F.least("pieces", F.lit(COLUMN_PIECES)).alias("hot"))
        own = -1 - (F.col("j") % block) * COLUMN_PIECES - F.pmod(F.xxhash64("i"), F.col("hot"))
        dealt = dealt.join(F.broadcast(materialize(hot, "hot_columns")), "j", "left").withColumn("piece", F.when(F.col("hot").isNull(), F.col("piece")).otherwise(own).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            i, j, *held_values = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(i, kind="stable")
            i, j, *held_values = (c[order] for c in (i, j, *held_values))
            heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            made = [i[heads].astype(np.int64), heads.astype(np.int32), (j - key[0] * block).astype(np.int32), *[v.astype(np.float64) for v in held_values]]
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], *[pa.array([m.tobytes()], pa.binary()) for m in made]], names)

        for batch in batches:
            b, p, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in fields)
            heads = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (p[1:] != p[:-1])])) if len(b) else []
            for start, stop in zip(heads, [*heads[1:], len(b)], strict=True):
                if key != (here := (int(b[start]), int(p[start]))):
                    if held:
                        yield out()
                    key, held = here, []
                held.append([c[start:stop] for c in rest])
        if held:
            yield out()

    fields, names = ["block", "piece", "i", "j", *values], ["block", "piece", "rows", "heads", "cols", *values]
    # One number per piece, which Spark sorts by its digits; rows are put in order in numpy, a piece at a time.
    whole = F.shiftleft(F.col("block").cast("bigint"), 32) + F.col("piece")
    sorted_ = dealt.select(*fields).repartition("block", "piece").sortWithinPartitions(whole)
    made = materialize(sorted_.mapInArrow(pack, ", ".join(f"{n} {'int' if n in fields else 'binary'}" for n in names[:5]) + "".join(f", {v} binary" for v in values)), "matrix")
    discard(ranged)
    return made


def vector_blocks(rows: DataFrame, width: int, block: int, kind: type = np.float64) -> DataFrame:
    """`block, vec, before` from `idx, vec`: the vectors of each range of nodes as one packed table, zeros where a number has no node."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([held.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], ["block", "vec", "before"])

        for batch in batches:
            blocks, idx = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "idx"))
            vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for b in dict.fromkeys(blocks.tolist()):
                if key != b:
                    if held is not None:
                        yield out()
                    key, held = b, np.zeros((block, width), kind)
                some = blocks == b
                held[idx[some] - b * block] = vectors[some]
        if held is not None:
            yield out()

    ranged = rows.select(F.floor(F.col("idx") / block).cast("int").alias("block"), "idx", "vec")
    return ranged.repartition("block").sortWithinPartitions("block").mapInArrow(pack, "block int, vec binary, before binary")


def product(
    matrix: DataFrame,
    x: DataFrame,
    width: int,
    block: int,
    factors: tuple[float, float, float] = (1.0, 0.0, 0.0),
    keep: bool = False,
    kind: type = np.float64,
) -> DataFrame:
    """`block, vec, before`: the sum of the product of the matrix and `vec`, of `vec` and of `before`, times `factors`; the new
    `before` is the old `vec`. With `keep`, `vec` stays and the new column `before` is the sum. Packed numbers are of `kind`, sums of eight bytes."""
    of_image, of_vec, of_before = factors

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, heads, cols, w = (_numbers(batch.column(c)[k], t) for c, t in (("rows", np.int64), ("heads", np.int32), ("cols", np.int32), ("w", np.float64)))
                vectors, sums = _table(batch.column("vec")[k], width, kind), np.empty((len(rows), width), kind)
                for c in range(width):
                    sums[:, c] = np.add.reduceat(np.ascontiguousarray(vectors[:, c])[cols] * w, heads)
                to, at = np.divmod(rows, block)
                cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
                made = [(int(to[a]), 0, at[a:b].astype(np.int32).tobytes(), sums[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
                if batch.column("piece")[k].as_py() == 0:
                    own = batch.column("block")[k].as_py()
                    made.append((own, 1, None, batch.column("vec")[k].as_py()))
                    if batch.column("before")[k].is_valid:
                        made.append((own, 2, None, batch.column("before")[k].as_py()))
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "kind", "at", "value"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, vec, before = None, None, None, None

        def out() -> pa.RecordBatch:
            made = of_image * total
            if of_vec:
                made += of_vec * _numbers(vec, kind).reshape(made.shape)
            if of_before and before is not None:
                made += of_before * _numbers(before, kind).reshape(made.shape)
            made = made.astype(kind).tobytes()
            sides = [vec.as_py(), made] if keep else [made, vec.as_py()]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *[pa.array([s], pa.binary()) for s in sides]], ["block", "vec", "before"])

        for batch in batches:
            for k in range(batch.num_rows):
                b, what, value = batch.column("block")[k].as_py(), batch.column("kind")[k].as_py(), batch.column("value")[k]
                if b != key:
                    if total is not None:
                        yield out()
                    key, total, vec, before = b, np.zeros((block, width)), None, None
                if what == 0:
                    total[_numbers(batch.column("at")[k], np.int32)] += _table(value, width, kind)
                elif what == 1:
                    vec = value
                else:
                    before = value
        if total is not None:
            yield out()

    # The vectors themselves go along once, with the first piece. Vectors go to all pieces of their range, so that no range is one task's.
    dealt = x.join(F.broadcast(matrix.select("block", "piece")), "block")
    before = F.when((F.col("piece") == 0) & F.lit(bool(of_before)), F.col("before")).alias("before")
    joined = dealt.select("block", "piece", "vec", before).join(matrix, ["block", "piece"])
    parts = joined.mapInArrow(multiply, "block int, kind int, at binary, value binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, vec binary, before binary")


def _ritz(x: DataFrame, width: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Ritz values of S in the span of `vec`, whose image is `before`: largest first, the matrix that turns `vec` into their vectors, and their residuals."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, width, width))
        for batch in batches:
            for k in range(batch.num_rows):
                v, image = (_table(batch.column(c)[k], width, kind) for c in ("vec", "before"))
                total += np.array([v.T @ v, v.T @ image, image.T @ image])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["sums"])

    parts = x.select("vec", "before").mapInArrow(grams, "sums array<double>").select(F.posexplode("sums").alias("pos", "value"))
    total = np.zeros(3 * width * width)
    for row in parts.groupBy("pos").agg(F.sum("value").alias("value")).collect():
        total[row.pos] = row.value
    own, across, images = total.reshape(3, width, width)
    # Vectors of length 1 first. A graph with fewer nodes than vectors has a singular Gram matrix: its spare directions are dropped.
    scale = 1 / np.sqrt(np.where(np.diag(own) > 0, np.diag(own), 1.0))
    lengths, axes = np.linalg.eigh(own * np.outer(scale, scale))
    kept = lengths > max(lengths[-1], 0.0) * 1e-12
    basis = scale[:, None] * axes[:, kept] / np.sqrt(lengths[kept])
    values, axes = np.linalg.eigh(basis.T @ (across + across.T) @ basis / 2)
    values, turn = values[::-1], basis @ axes[:, ::-1]
    squares = np.einsum("ij,ik,kj->j", turn, images, turn) - values**2
    return values, turn, np.sqrt(np.maximum(squares, 0.0))


def _first_filter(x: DataFrame, turn: np.ndarray, width: int, centre: float, half: float, kind: type = np.float64) -> DataFrame:
    """`block, vec, before`: the turned vectors as `before`, and their first step of the filter, (image - centre * vec) / half."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                v, image = (_table(batch.column(c)[k], width, kind) @ turn for c in ("vec", "before"))
                sides = [((image - centre * v) / half).astype(kind).tobytes(), v.astype(kind).tobytes()]
                yield pa.RecordBatch.from_arrays([batch.column("block")[k : k + 1], *[pa.array([s], pa.binary()) for s in sides]], ["block", "vec", "before"])

    return x.select("block", "vec", "before").mapInArrow(turned, "block int, vec binary, before binary")


def vector_rows(x: DataFrame, turn: np.ndarray, width: int, block: int, kind: type = np.float64) -> DataFrame:
    """`idx, vec` from packed vectors, multiplied by `turn`."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made = _table(batch.column("vec")[k], width, kind) @ turn
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * turn.shape[1], pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made)) + batch.column("block")[k].as_py() * block), vectors], ["idx", "vec"])

    return x.select("block", "vec").mapInArrow(unpack, "idx long, vec array<double>")


def pca_projection(vectors: DataFrame, k: int = 2) -> DataFrame:
    """The columns of `vectors` with `pc`, the k principal components of `vec`."""
    as_vector = vectors.withColumn("_v", array_to_vector("vec"))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(as_vector)
    return model.transform(as_vector).withColumn("pc", vector_to_array("_pc")).drop("_v", "_pc", "vec")


def graph_similarity(table: DataFrame, lookup: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """Star cosine of the mean node vector of each document's graph (`nodes` is `doc_id, tok`, distinct)."""
    pooled = lookup_doc_vectors(nodes.withColumn("cnt", F.lit(1)), lookup, table, dim)
    return star_cosine(table, materialize(pooled, "graph_vectors"))
