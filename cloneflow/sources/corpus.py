"""Labelled corpora: files in case folders, originals, and original-suspect pairs."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneflow.functions.text import tokens
from cloneflow.operators.joins import BROADCAST_BYTES, first_rows, join_unique
from cloneflow.session import materialize

# A feature is made from a document's text and its tokens, which are split once for all features.
Features = dict[str, Callable[[Column, Column], Column]]

# Features smaller than the text they are made of: alone, they are made before a join, which then moves no text.
COMPACT = {"chars", "size", "profile", "sig", "calls", "comments", "markup"}

# Bytes of files that are read at once.
READ_BYTES = 1 << 24

# The three folder names that carry the label.
ORIGINAL, CLONE, NON_CLONE = "original", "plagiarized", "non-plagiarized"


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, or of a local path, and the folder in it."""
    return fs.FileSystem.from_uri(root) if ":" in root.split("/", 1)[0] else (fs.LocalFileSystem(), root)


def list_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """`inside, bytes`: every file below `root` with the suffix, as its path inside it. Case folders are rows, and are listed in the tasks."""
    store, top = _store(root)
    cases = [(f.path,) for f in store.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.Directory]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files = [f for f in store.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file and f.path.endswith(suffix)]
                inside = [f.path[len(top.rstrip("/")) + 1 :] for f in files]
                yield pa.RecordBatch.from_arrays([pa.array(inside, pa.string()), pa.array([f.size for f in files], pa.int64())], names=["inside", "bytes"])

    folders = spark.createDataFrame(cases, "folder string").repartition(max(1, min(len(cases), spark.sparkContext.defaultParallelism)), "folder")
    return folders.mapInArrow(listed, "inside string, bytes long")


def _fits_checksum(store: fs.FileSystem, path: str, data: bytes) -> bool:
    """Whether a local file is as its checksum file says, if there is one: the local file system of Hadoop keeps one beside each file it writes."""
    if not isinstance(store, fs.LocalFileSystem):
        return True
    folder, name = path.rsplit("/", 1)
    try:
        with store.open_input_stream(f"{folder}/.{name}.crc", compression=None) as stream:
            sums = stream.read()
    except FileNotFoundError:
        return True
    if sums[:4] != b"crc\0" or len(sums) < 8 or not (step := int.from_bytes(sums[4:8], "big")):
        return True
    return sums[8:] == b"".join(zlib.crc32(data[k : k + step]).to_bytes(4, "big") for k in range(0, len(data), step))


def _read_files(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`inside, bytes` of listed files to `inside, code, status`, about READ_BYTES at a time."""

    def read(store: fs.FileSystem, path: str, size: int) -> tuple[str | None, str]:
        if not size:
            return "", "empty"
        try:
            with store.open_input_stream(path, compression=None) as stream:
                data = stream.read()
            if not _fits_checksum(store, path, data):
                return None, "unreadable"
        except OSError:
            return None, "unreadable"
        try:
            return data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"), "read"
        except UnicodeDecodeError:
            return None, "not text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["inside", "code", "status"])
        for batch in batches:
            made, held = [], 0
            for inside, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made.append((inside, *read(store, f"{top.rstrip('/')}/{inside}", size)))
                held += size
                if held > READ_BYTES:
                    yield out(made)
                    made, held = [], 0
            if made:
                yield out(made)

    return run


def read_corpus(spark: SparkSession, root: str, suffix: str = ".java") -> DataFrame:
    r"""One row per file below `case/{original,plagiarized,non-plagiarized}/…`, path parts as columns, and `status`.

    The disguise level `L1`…`L6` and the author folder are null where the path has none; folders may carry their column's name, as
    those of `write_corpus` do. Line ends become `\n`. Every listed file has a row: `status` is `read`; `empty`, with the text `''`, for a file of
    zero bytes; `not text` for one that is not UTF-8 and `unreadable` for one that cannot be opened or does not fit the checksum file beside it, both
    with a null `code`. Files are listed, opened once and read in the tasks, and what was read is written as a table: the driver sees case folders only.
    """
    listed = list_files(spark, root, suffix)
    spread = listed.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "inside")
    files = materialize(spread.mapInArrow(_read_files(root), "inside string, code string, status string"), "corpus_files")
    roles = rf"(?:role=)?({ORIGINAL}|{NON_CLONE}|{CLONE})/"
    path = F.concat(F.lit("/"), "inside")
    behind = F.regexp_extract(path, f"/{roles}(.*)$", 2)
    level = F.regexp_extract(behind, r"^(?:level=)?(L\d+)/", 1)
    author = F.regexp_extract(behind, r"^(?:(?:level=)?L\d+/)?(?:author=)?([^/]+)/", 1)
    return files.select(
        F.regexp_extract(path, f"/(?:case_id=)?([^/]+)/{roles}", 1).alias("case_id"),
        F.regexp_extract(path, f"/{roles}", 1).alias("role"),
        F.nullif(level, F.lit("")).alias("level"),
        F.nullif(author, F.lit("")).alias("author"),
        F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("stem"),
        F.concat(F.lit(f"{root.rstrip('/')}/"), "inside").alias("path"),
        "code",
        "status",
    ).where(F.col("role") != "")


def write_corpus(corpus: DataFrame, root: str) -> None:
    """One text file per row below `case_id=…/role=…/author=…`, which `read_corpus` reads with the suffix `.txt`.

    The three columns together name a row. A file holds its text as it is; a null `code` is an empty file. A task that runs again writes the
    same files again.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        for batch in batches:
            for case, role, author, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{top.rstrip('/')}/case_id={quote(case, safe=' ')}/role={role}/author={quote(author, safe=' ')}"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/text.txt") as out:
                    out.write(code.encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    rows = corpus.select("case_id", "role", "author", F.coalesce("code", F.lit("")).alias("code"))
    rows.mapInArrow(written, "files long").agg(F.sum("files")).collect()


def store_corpus(corpus: DataFrame, path: str) -> DataFrame:
    """Keep a corpus as Parquet: small files are opened once, and later jobs read only the columns they use."""
    corpus.write.partitionBy("role").parquet(path)
    return corpus.sparkSession.read.schema(corpus.schema).parquet(path)


def pick_originals(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(originals of the cases that have exactly one, `case_id, originals` of all other cases)."""
    is_original = (F.col("role") == ORIGINAL).cast("int")
    counts = corpus.groupBy("case_id").agg(F.sum(is_original).cast("bigint").alias("originals"))
    originals = corpus.where(F.col("role") == ORIGINAL)
    good = counts.where(F.col("originals") == 1).select("case_id")
    return originals.join(good, "case_id", "left_semi"), counts.where(F.col("originals") != 1)


def _with_features(df: DataFrame, text: str, features: Features, prefix: str) -> DataFrame:
    """`df` with its text replaced by the features, which are null where the text is."""
    keep = [c for c in df.columns if c != text]
    split = df.select(*keep, F.col(text).alias("_text"), tokens(F.col(text)).alias("_toks"))
    readable = F.col("_text").isNotNull()
    made = {name: make(F.col("_text"), F.col("_toks")) for name, make in features.items()}
    return split.select(*keep, *[F.when(readable, col).alias(prefix + name) for name, col in made.items()])


def _join_features(rows: DataFrame, originals: DataFrame, text: str, features: Features, salt_by: list[str], broadcast_bytes: int) -> DataFrame:
    """`rows` beside their case's original, the text replaced by features: before the join if all are compact, behind it otherwise."""
    early = COMPACT.issuperset(features)
    made = _with_features(rows, text, features, "b_") if early else rows
    pairs = join_unique(made, originals, ["case_id"], salt_by, broadcast_bytes=broadcast_bytes)
    return pairs if early else _with_features(pairs, text, features, "b_")


def make_pairs(corpus: DataFrame, features: Features, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each case's original against each of its suspects: `case_id, path, is_clone, a_*, b_*`.

    The features of the originals are made and written once, so that measuring and joining them costs no further
    read of the corpus. Those of the suspects are made behind the join, so that a shuffle moves plain text, which is smaller than most
    features; where all features are compact they are made before it and no text is moved.
    A case without non-clones has fewer rows.
    """
    originals, _ = pick_originals(corpus)
    a = materialize(_with_features(originals.select("case_id", "code"), "code", features, "a_"), "originals")
    suspects = corpus.where(F.col("role") != ORIGINAL).select("case_id", "path", "role", "code")
    pairs = _join_features(suspects, a, "code", features, ["path"], broadcast_bytes)
    return pairs.withColumn("is_clone", F.col("role") == CLONE).drop("role")


def star_pairs(
    table: DataFrame,
    features: Features,
    text: str = "text",
    label: str | None = "label",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Pairs of an unlabelled table `case_id, doc_id, <label>, <text>`: per case the lowest id against the rest.

    A pair counts as a clone when both sides have the same label. The work is linear in the table.
    """
    labels = [F.col(label).alias("_label")] if label else []
    columns = ["case_id", "doc_id", *labels, F.col(text).alias("_body")]
    originals = first_rows(table, "case_id", "doc_id").select(*columns)
    a = _with_features(originals.withColumnsRenamed({"doc_id": "_first", "_label": "_first_label"}), "_body", features, "a_")
    a = materialize(a, "originals")
    pairs = _join_features(table.select(*columns), a, "_body", features, ["doc_id"], broadcast_bytes)
    pairs = pairs.where(F.col("doc_id") != F.col("_first")).drop("_first")
    if label:
        pairs = pairs.withColumn("is_clone", F.col("_label") == F.col("_first_label")).drop("_label", "_first_label")
    return pairs


def label_table(table: DataFrame) -> DataFrame:
    """The corpus columns for a table `case_id, doc_id, label, text`; `level` carries the label."""
    originals = first_rows(table.select("case_id", "doc_id", "label"), "case_id", "doc_id")
    originals = originals.select("case_id", F.col("doc_id").alias("_first"), F.col("label").alias("_label"))
    role = (
        F.when(F.col("doc_id") == F.col("_first"), ORIGINAL)
        .when(F.col("label") == F.col("_label"), CLONE)
        .otherwise(NON_CLONE)
    )
    return join_unique(table, originals, ["case_id"], ["doc_id"]).select(
        "case_id",
        role.alias("role"),
        F.col("label").alias("level"),
        F.lit(None).cast("string").alias("author"),
        F.col("doc_id").cast("string").alias("stem"),
        F.concat_ws("/", "case_id", role, F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("code"),
    )
