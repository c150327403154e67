"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams, of bytes and of word shapes, scaled by the log ratio of their class counts. A linear
hinge-loss model is fitted to the scaled, length-normalised rows by dual coordinate descent, one model per shard of a bounded sample, and the shards' weights
are averaged. A logistic curve, fitted to margins that the other shards' models give, turns margins into probabilities. Scoring is
one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneflow.llm.common import whole_text, with_result
from cloneflow.session import materialize

# The model is fitted on at most this many labelled rows, taken by a hash of their id. All rows are scored.
MAX_TRAIN_ROWS = 12_000
SHARD_ROWS = 2_000
BITS = 18
BYTE_GRAMS, SHAPE_GRAMS = (2, 3, 4), (1, 2, 3)
PIECE = 1 << 20
# Rows are divided by sqrt(|x|^2 + FLOOR): a text of few n-grams stays near the constant.
SMOOTHING, COST, EPOCHS, SHARE, FLOOR = 1.0, 1.0, 12, 0.5, 100.0
THRESHOLD = 0.7
HELD_OUT = 2

WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
GAP = re.compile(rb"[\t-\r ]")
# 0: lower case and all characters beyond ASCII, 1: upper case, 2: digit, 3: other.
KIND = np.array([1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 0 if 97 <= b <= 122 or b >= 128 else 3 for b in range(256)], np.uint32)
BYTE_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _bucket(code: np.ndarray, salt: int) -> np.ndarray:
    mixed = (code ^ np.uint32(salt)) * np.uint32(2_654_435_761)
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2_246_822_519)) >> np.uint32(32 - BITS)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop."""
    edge = np.diff(np.concatenate([[1], WHITE[data], [1]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _shapes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A code per word: kinds of its first two characters, its last if that is a sign, whether it is long, whether it repeats the word before."""
    inside = np.flatnonzero(~WHITE[data])
    offset = (inside - np.repeat(start, stop - start)).astype(np.uint64)
    name = np.add.reduceat(BYTE_CODE[data[inside]] * (2 * offset + 1), np.cumsum(stop - start) - (stop - start))
    again = np.zeros(len(start), np.uint32)
    again[1:] = name[1:] == name[:-1]
    last = data[stop - 1].astype(np.uint32)
    last[KIND[last] != 3] = 0
    first, second = KIND[data[start]], KIND[data[np.minimum(start + 1, stop - 1)]]
    return first | second << 2 | last << 4 | again << 12 | (stop - start >= 8).astype(np.uint32) << 13


def _grams(data: np.ndarray, start: np.ndarray, stop: np.ndarray, whole: bool) -> list[np.ndarray]:
    found = []
    wide = data.astype(np.uint32)
    for n in BYTE_GRAMS:
        if len(wide) >= n:
            found.append(_bucket(sum(wide[i : len(wide) - n + 1 + i] << np.uint32(8 * i) for i in range(n)), n * 0x3C6EF372 & 0xFFFFFFFF))
    if len(start):
        # The first word of a later piece cannot tell whether it repeats one.
        shape = _shapes(data, start, stop)[0 if whole else 1 :]
        for n in SHAPE_GRAMS:
            if len(shape) >= n:
                code = np.zeros(len(shape) - n + 1, np.uint32)
                for i in range(n):
                    code = code * np.uint32(1_000_003) + shape[i : len(shape) - n + 1 + i]
                found.append(_bucket(code, n * 0x51ED270B & 0xFFFFFFFF))
    return found


def grams(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The distinct buckets of a whole text's n-grams, sorted. `seen` is a scratch array of False, left as it was.

    A very long text is read in pieces that overlap by enough words for every n-gram to lie in one.
    """
    data, begin, stop = np.frombuffer(text, np.uint8), 0, 0
    overlap = max(SHAPE_GRAMS) + 1
    parts, spilled = [], False
    while stop < len(data):
        gap = GAP.search(text, stop + PIECE) if len(data) - stop > PIECE else None
        stop = gap.start() if gap else len(data)
        starts, stops = _words(data[begin:stop])
        parts += _grams(data[begin:stop], starts, stops, begin == 0)
        if stop < len(data):
            for p in parts:
                seen[p] = True
            parts, spilled = [], True
            begin += int(starts[-overlap]) if len(starts) >= overlap else 0
    if spilled or sum(map(len, parts)) > 6_000:
        for p in parts:
            seen[p] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found
    return np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.empty(0, np.int64)


def _bytes(text) -> bytes:
    return text.as_buffer() if text.is_valid else b""


def _grams_of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    seen = np.zeros(1 << BITS, bool)
    for array in arrays:
        yield pa.array([grams(_bytes(t), seen) for t in array], pa.list_(pa.int32()))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """`doc_id, label, shard, grams` of at most `max_rows` labelled ids. `labels` is `doc_id, label` (0 or 1).

    Ids with null or contradicting labels are left out. The ids are few and bounded, so they go to the texts.
    """
    fine = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    fine = fine.where(F.col("label") == F.col("most")).select("doc_id", "label")
    taken = materialize(fine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "labelled")
    made = F.arrow_udf(_grams_of, "array<int>")
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(taken), "doc_id")
    # An id that the documents repeat counts once.
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    # Two at least: each part's model judges the rows of the others.
    shards = max(2, -(-taken.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int")
    return rows.select("doc_id", "label", shard.alias("shard"), made("text").alias("grams"))


def log_count_ratios(rows: DataFrame, smoothing: float = SMOOTHING) -> np.ndarray:
    """For each bucket the log of how much likelier it is in a row of label 1 than of label 0."""
    counted = rows.select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    # At most 2^BITS rows.
    table = counted.toPandas()
    p, q = (np.full(1 << BITS, smoothing) for _ in range(2))
    p[table.gram] += table.p
    q[table.gram] += table.q
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights of the scaled features, the last one of a constant: min |w|^2/2 + cost * sum of hinge losses.

    Each step solves the dual problem exactly for one row's multiplier and keeps w = sum of alpha * y * x.
    """
    sign = np.where(labels > 0, 1.0, -1.0)
    values = [scaled(r, ratios).astype(np.float32) for r in rows]
    square = np.array([float(v @ v) for v in values]) + 1.0
    w, alpha, rng = np.zeros(len(ratios) + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = sign[i] * (w[x] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def scaled(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    v = ratios[row]
    return v / np.sqrt(v @ v + FLOOR)


def _fit_shard(ratios, share: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        labels = rows.label.to_numpy()
        w = np.zeros((1 << BITS) + 1)
        if 0 < labels.sum() < len(labels):
            w = dual_descent([np.asarray(g, np.int32) for g in rows.grams], labels, ratios.value)
            # Between the model's weights and plain Naive Bayes, whose weights are all alike.
            w[:-1] = share * w[:-1] + (1 - share) * np.abs(w[:-1]).mean()
        return pd.DataFrame({"shard": [key[0]], "w": [w.astype(np.float32).tobytes()], "rows": [len(rows)], "fitted": [bool(w.any())]})

    return run


@dataclass
class Model:
    """Weights by bucket (log ratios included), the ratios, and the curve from margins to probabilities."""

    weights: np.ndarray
    ratios: np.ndarray
    constant: float
    slope: float
    offset: float

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row] @ scaled(row, self.ratios) + self.constant) if len(row) else self.constant

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def logistic_curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method, with targets pulled off 0 and 1 by the class sizes."""
    hits = (labels > 0).sum()
    target = np.where(labels > 0, (hits + 1) / (hits + 2), 1 / (len(labels) - hits + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-6 * beta)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, share: float = SHARE) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, label). With one class or none, every text gets the base rate."""
    spark = docs.sparkSession
    rows = materialize(training_rows(docs, labels, max_rows), "training_rows")
    n, hits = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    ratios = log_count_ratios(rows)
    fallback = Model(np.zeros(1 << BITS), ratios, 0.0, 0.0, float(np.log((hits + 1) / (n - hits + 1))))
    if not 0 < hits < n:
        return fallback
    sent = spark.sparkContext.broadcast(ratios)
    # At most max_rows / SHARD_ROWS rows of 2^BITS numbers each.
    parts = rows.groupBy("shard").applyInPandas(_fit_shard(sent, share), "shard int, w binary, rows long, fitted boolean").collect()
    parts = {r.shard: np.frombuffer(r.w, np.float32).astype(np.float64) for r in parts if r.fitted}
    if not parts:
        return fallback
    total = sum(parts.values())
    # The margin of a row under the mean of the models that have not seen it.
    models = spark.sparkContext.broadcast((parts, total))

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = models.value
        for batch in batches:
            found = []
            for shard, row in zip(batch.column("shard").to_pylist(), batch.column("grams"), strict=True):
                x = row.values.to_numpy().astype(np.int64)
                own = parts.get(shard)
                w = (total - own) / (len(parts) - 1) if own is not None and len(parts) > 1 else total / len(parts)
                found.append(float(w[x] @ scaled(x, sent.value) + w[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("label").cast(pa.int32())], names=["margin", "label"])

    # At most max_rows pairs of numbers; sorted, so that sums do not depend on the order of tasks.
    scored = rows.select("shard", "grams", F.col("label").cast("int").alias("label")).mapInArrow(margins, "margin double, label int").toPandas()
    scored = scored.sort_values(["margin", "label"])
    slope, offset = logistic_curve(scored.margin.to_numpy(), scored.label.to_numpy())
    mean = total / len(parts)
    return Model(mean[:-1], ratios, float(mean[-1]), slope, offset)


def scorer(model: Model, spark):
    """An Arrow function from whole texts to the probability of label 1."""
    sent = spark.sparkContext.broadcast(model)

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen, model = np.zeros(1 << BITS, bool), sent.value
        for array in arrays:
            yield pa.array([model.probability(model.margin(grams(_bytes(t), seen))) for t in array], pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()


def held_out():
    """Rows that lend no label to a fit."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[DataFrame, str]:
    """`docs` with the probability of label 1 for every whole text, and that column's name.

    Only the text is looked at. Null and empty texts get the score of a text without n-grams. `labels` is `doc_id, quality`; held-out ids
    never lend a label. Repeated rows are scored alike; all rows and columns stay.
    """
    usable = labels.where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(docs.select("doc_id", "text"), usable, max_rows)
    return with_result(docs, scorer(model, docs.sparkSession))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold."""
    made, name = score_quality(docs, labels)
    return made.where(F.col(name) >= threshold).drop(name)
