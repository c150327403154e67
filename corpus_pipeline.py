"""A corpus from raw documents to tokens: five stages, each a table that the next one reads.

Every stage keeps the columns of documents and all rows that it does not reject; the last one adds the tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneflow.llm import decontaminate, linededup, pieces, quality, simhash
from cloneflow.llm.common import table
from cloneflow.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Labels come from the labels table, texts from this stage's input."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others repeat; a text that loses all its lines is empty. n_chars, where it is a column, follows."""
    made, result = linededup.dedup_lines(docs)
    lost = F.col(f"{result}.n_dropped") > 0
    changed = {"text": F.when(lost, F.col(f"{result}.kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(lost, F.char_length(f"{result}.kept").cast(kind)).otherwise(F.col("n_chars"))
    return made.withColumns(changed).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number and digest of its ids, the ids themselves (packed) and the digest of the text they decode to."""
    made, result = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = F.col(result)
    added = {
        "n_tokens": found["n_tokens"],
        "token_ids": found["ids"],
        "ids_sha256": F.sha2(found["ids"], 256),
        "decoded_sha256": F.sha2(found["decoded"], 256),
    }
    return made.withColumns(added).drop(result)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece_tokens),
]

# Fitted weights, fingerprints and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below `sf_dir`, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
