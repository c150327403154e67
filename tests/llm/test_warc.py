import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cloneflow.llm import warc


def pages_of(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("<p>äöü€ text\r\n\r\n</p>") for _ in range(50_000))
    html = [None, "", "short", "short", "x" * 99, "x" * 99, "x" * 100, "x" * 100, "é" * 50, "é" * 50, long, long, "WARC/1.1\r\n\r\n" * 20, "y" * 5000]
    rows = [(30 - i, f"http://a.net/{i}", h) for i, h in enumerate(html)]
    rows += [(500, None, long), (None, "http://null.net/", long), (None, "x", "alone" * 100), (77, "http://bad\r\nHeader: x/ y\x00", "z" * 200), rows[10], (78, "u", "z" * 200)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return rows, frame.withColumns({"payload": F.lit("mine"), "record_type": F.lit("mine")}).repartition(3)


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and i is not None and first.get(h) != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows, pages = pages_of(spark)
    assert sorted(map(tuple, warc.archived_pages(pages).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("chunk,segment,file,broadcast", [(1 << 20, 64 << 20, 1 << 30, 1 << 26), (1000, 1, 1, 0), (7, 3000, 8000, 0)])
def test_chunks(spark, chunk, segment, file, broadcast):
    rows, pages = pages_of(spark)
    records = warc.assign_types(warc.digested(pages), broadcast_bytes=broadcast)
    manifest = warc.write_archive(records, chunk_bytes=chunk, segment_bytes=segment, file_bytes=file)
    table = warc.read_archive(manifest, chunk_bytes=chunk).collect()
    want = {(i, len((h or "").encode())): (h or "").encode() for i, _, h in rows}
    parts = {}
    for r in table:
        assert len(r.chunk) <= chunk and r.bytes_so_far == min((r.chunk_no + 1) * chunk, r.bytes_so_far)
        parts.setdefault((r.page_id, r.payload_bytes, r.record_type), {}).setdefault(r.chunk_no, r)
    assert sum(r["last"] for r in table) == len(rows) == sum(r.records for r in manifest.collect())
    for (i, n, kind), chunks in parts.items():
        data = b"".join(chunks[k].chunk for k in sorted(chunks))
        assert data == (want[i, n] if kind == "response" else b"")
        running = hashlib.sha256()
        for k in sorted(chunks):
            running.update(chunks[k].chunk)
            assert chunks[k].digest_so_far == running.hexdigest()
        assert chunks[max(chunks)].intact and chunks[max(chunks)]["last"]


def test_files_are_warc(spark):
    _, pages = pages_of(spark)
    manifest = warc.write_archive(warc.assign_types(warc.digested(pages)))
    paths = {r.path.removeprefix("file://") for r in manifest.collect()}
    text = b"".join(gzip.open(p).read() for p in sorted(paths))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"\nHeader: x" not in text
    assert b"WARC-Target-URI: http://bad%0D%0AHeader:%20x/%20y%00\r\n" in text


def test_damage_is_seen(spark):
    pages = spark.createDataFrame([(1, "u", "good" * 100)], "page_id long, url string, html string")
    records = warc.assign_types(warc.digested(pages)).withColumn("payload_digest", F.lit("0" * 64))
    assert [r.intact for r in warc.read_archive(warc.write_archive(records)).collect()] == [False]


def test_no_pages(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
