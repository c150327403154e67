"""One query per operator of this package, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneflow.llm import alignment, decontaminate, linededup, mixing, pieces, pii, quality, simhash, spelling, tokencount, topk, urlfilter, warc
from cloneflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


@query
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "quality")
    made, score = quality.score_quality(docs, labels)
    predicted = (F.col(score) >= quality.THRESHOLD).cast("int")
    return made.select("doc_id", quality.held_out().alias("held_out"), F.col(score).alias("score"), predicted.alias("predicted"))


@query
def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    made, result = linededup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    found = F.col(result)
    return made.select("doc_id", found["n_lines"].alias("n_lines"), found["n_dropped"].alias("n_dropped"), F.sha2(found["kept"], 256).alias("kept_sha256"))


@query
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    classes = simhash.near_classes(table(spark, sf, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.report(table(spark, sf, "documents"))


@query
def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = urlfilter.judge_urls(table(spark, sf, "pages"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.token_report(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf, "pages"))


@query
def op11_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"))


@query
def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf, "documents"))


@query
def op13_align(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return alignment.alignment_report(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
