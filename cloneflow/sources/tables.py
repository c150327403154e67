"""The given Parquet tables in the shapes the measures expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneflow.functions.text import portable_hash
from cloneflow.operators.measures import vocabulary
from cloneflow.session import materialize, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`case_id, doc_id, label, text`: a case per source, the language as label."""
    table = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return table.select(F.col("source").alias("case_id"), "doc_id", F.col("lang").alias("label"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`case_id, doc_id, label, text`: a case per host, the path's first part (a language) as label."""
    table = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    return table.select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("case_id"),
        F.col("page_id").alias("doc_id"),
        F.regexp_extract("url", r"^https?://[^/]+/([a-z]*)", 1).alias("label"),
        F.col("html").alias("text"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, label, vec`: the stored vector of each document that has one."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("vec"))


def word_lookup(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """`tok, vec`: about half of the vocabulary, each word with the vector its hash points at."""
    slots = 2 * vectors.count()
    words = vocabulary(docs).select("tok", F.pmod(portable_hash(F.col("tok")), F.lit(slots)).alias("doc_id"))
    return materialize(words.join(vectors.select("doc_id", "vec"), "doc_id").select("tok", "vec"), "lookup")
