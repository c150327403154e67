"""The pipeline against the brute-force forms of its stages, and the queries of the package against their SQL."""

import hashlib
import os

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from cloneflow.llm import quality
from cloneflow.llm.oracle import ORACLE
from cloneflow.llm.queries import QUERIES
from tests.llm.test_decontaminate import words_of
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute_classes, brute_fingerprint

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def rows_of(frame):
    return sorted(map(repr, frame))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no given tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    sql = duckdb.connect()
    for file in os.listdir(DATA):
        sql.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    got, want = QUERIES[name](spark, DATA), sql.sql(ORACLE[name])
    assert {k: TYPES[t] for k, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    names = sorted(got.columns)
    assert rows_of(map(tuple, got.select(names).collect())) == rows_of(sql.sql(f"SELECT {', '.join(names)} FROM ({ORACLE[name]})").fetchall())


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_dedup", "decontamination", "sentencepiece_tokens"]


def hits(text, windows):
    words = words_of(text)
    return any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no given tables")
def test_pipeline_against_brute_force(spark, tmp_path):
    """Documents of the smallest tables with planted copies, benchmark passages, shared lines, nulls and clashing columns."""
    base = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [r for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [tuple(r[c] for c in columns) for r in base]
    line = "This very line is planted in a great many of the documents"
    rows += [(1000 + i, f"{rows[i][1]}\n{line}\n{items[i].text}", "en", "planted", None) for i in range(3)]
    rows += [(2000 + i, f"{rows[i][1]}\n{line}", None, None, 5) for i in range(6)]
    rows += [(3000 + i, rows[1][1], "en", "copy", 7) for i in range(4)]
    rows += [(None, "a text without a number", "en", "odd", 1), (4000, None, "en", "odd", None), (4001, "", "en", "odd", 0), (3000, rows[1][1], "en", "copy", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"_result": F.lit("mine"), "kept": F.lit(1), "_row": F.lit(2)}).repartition(4)
    shared = str(tmp_path)
    docs.write.parquet(f"{shared}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{shared}/{name}.parquet")
    tests = [words_of(r.text) for r in items]
    windows = {tuple(w[i : i + 10]) for w in tests for i in range(len(w) - 9)} | {tuple(w) for w in tests if 0 < len(w) < 10}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    now = spark.read.parquet(f"{shared}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in now.collect()]
        stage(spark, now, shared).write.parquet(f"{shared}/stage{i}")
        after = spark.read.parquet(f"{shared}/stage{i}")
        rows = [tuple(r) for r in after.collect()]
        if i < 4:
            assert after.columns == now.columns
        if i == 0:
            made, name = quality.score_quality(now, spark.read.parquet(f"{shared}/labels.parquet"))
            scores = {r.doc_id: r[name] for r in made.collect()}
            assert rows_of(rows) == rows_of(r for r in before if scores[r[0]] >= 0.7)
            assert 0 < len(rows) < len(before)
        elif i == 1:
            want = []
            for r, (_, _, lost, kept) in zip(before, brute_lines([r[:2] for r in before]), strict=True):
                want.append(r if not lost else (r[0], kept, *r[2:4], len(kept), *r[5:]))
            assert rows_of(rows) == rows_of(want) and any(a != b for a, b in zip(sorted(map(repr, before)), rows_of(rows), strict=True))
        elif i == 2:
            classes = brute_classes([r[0] for r in before], [brute_fingerprint(r[1]) for r in before])
            names = {c for c in classes if c is not None}
            assert rows_of(r[0] for r in rows if r[0] is not None) == rows_of(names)
            assert set(rows_of(rows)) <= set(rows_of(before)) and len(rows) < len(before)
        elif i == 3:
            assert rows_of(rows) == rows_of(r for r in before if not hits(r[1], windows)) and len(rows) < len(before)
        else:
            for r in after.collect():
                ids = library.encode(r.text or "", add_bos=True, add_eos=True)
                packed = b"".join(x.to_bytes(4, "little") for x in ids)
                assert r.n_tokens == len(ids) and bytes(r.token_ids) == packed and r.ids_sha256 == hashlib.sha256(packed).hexdigest()
                assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
            assert len(rows) == len(before)
        now = after
    whole = corpus_pipeline.run(spark, shared)
    assert rows_of(map(tuple, whole.collect())) == rows_of(map(tuple, now.collect()))


def test_stages_take_empty_tables(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
