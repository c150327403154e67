"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position.

Texts never travel with their lines: the exploded rows hold two hashes, a document id and a position. Only the
last join, which brings each document its dropped positions, may move texts, and only when those positions are
too many to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneflow.llm.common import SPACES, ascii_lower, free_name, whole_text
from cloneflow.operators.joins import join_unique
from cloneflow.session import materialize

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`doc_id, row, pos, h1, h2`: every line whose key is long enough, its key as a 128-bit hash.

    `row` is a hash of the text: with doc_id it names a row, so rows that repeat a doc_id are told apart.
    """
    lines = docs.select("doc_id", F.xxhash64(whole_text()).alias("row"), F.posexplode(_lines(whole_text())).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
    long_enough = keys.where(F.char_length("key") >= min_chars)
    return long_enough.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`h1, h2, keeper, n_docs`: the keys in at least `min_docs` documents and the largest id among these.

    Grouping by key and document first means that no task ever sees a frequent key's documents together: the second
    aggregation has at most one row per key and task.
    """
    per_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    counted = per_doc.groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n_docs") >= min_docs)


def lost_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`lost_id, lost_row, lost`: per row of `docs` that loses lines, their positions (bounded by the lines of one document)."""
    lines = keyed_lines(docs, min_chars)
    frequent = materialize(frequent_lines(lines, min_docs), "frequent_lines")
    found = join_unique(lines, frequent, ["h1", "h2"], ["doc_id", "pos"])
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("row").alias("lost_row")).agg(F.collect_set("pos").alias("lost"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, str]:
    """`docs` with a struct `(n_lines, n_dropped, kept)` of each row, and that column's name, which clashes with no other.

    A null or empty text is one empty line. A null doc_id counts as no document: it adds nothing to a key's count, and
    its lines go like those of any document that is not the largest. Rows that repeat a doc_id count once and are
    cut alike. Empty input gives no rows.
    """
    lost = materialize(lost_positions(docs, min_chars, min_docs), "lost_lines")
    names = {c: free_name(docs, c) for c in ("_result", "_row", "_lines", "lost_id", "lost_row", "lost")}
    result, row, lines, lost_id, lost_row, gone = names.values()
    lost = lost.toDF(lost_id, lost_row, gone)
    rows = docs.withColumn(row, F.xxhash64(whole_text()))
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(row) == F.col(lost_row)), "left")
    # The lines are a column of their own, so that each text is split once and not once per kept line.
    split = joined.withColumn(lines, _lines(whole_text()))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    made = F.struct(
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col(gone).isNull(), whole_text()).otherwise(kept).alias("kept"),
    )
    return split.withColumn(result, made).drop(row, lost_id, lost_row, gone, lines), result
