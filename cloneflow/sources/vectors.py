"""Stored vectors: run-versioned JSON and Parquet stores, word-vector text files, get-or-create."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vectors(df: DataFrame, path: str, run_id: str, as_json: bool = False) -> None:
    """Store `key, embedding` under a run id, in place of what that run stored before. JSON keeps one `key<TAB>array` line per vector."""
    if as_json:
        line = F.concat_ws("\t", F.col("key").cast("string"), F.to_json("embedding"))
        df.select(line.alias("value")).write.mode("overwrite").text(f"{path}/run_id={run_id}")
    else:
        df.drop("run_id").write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def read_vectors(spark: SparkSession, path: str, as_json: bool = False) -> DataFrame:
    """`run_id, key, embedding`. A malformed JSON array is null, not an error."""
    if not as_json:
        return spark.read.parquet(path)
    line = F.split("value", "\t", 2)
    return spark.read.text(path).select(
        F.col("run_id").cast("string"),
        F.get(line, F.lit(0)).alias("key"),
        F.from_json(F.get(line, F.lit(1)), "array<double>").alias("embedding"),
    )


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """`word, vec` from lines `word v1 … vn`; a count header (two fields) is dropped."""
    parts = F.split(F.trim("value"), " +")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return lines.select(
        F.get("p", F.lit(0)).alias("word"),
        F.slice("p", F.lit(2), F.size("p") - 1).cast("array<float>").alias("vec"),
    )


def backfill(needed: DataFrame, stored: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`key, embedding, origin`: stored vectors of the needed keys, and computed ones for the rest only.

    A key that several runs stored has the vector of the latest run.
    """
    latest = F.max_by("embedding", "run_id") if "run_id" in stored.columns else F.max("embedding")
    have = stored.groupBy(key).agg(latest.alias("embedding")).join(needed.select(key), key, "left_semi")
    missing = needed.join(stored.select(key), key, "left_anti")
    made = compute(missing).select(key, "embedding")
    return have.withColumn("origin", F.lit("stored")).unionByName(made.withColumn("origin", F.lit("computed")))
