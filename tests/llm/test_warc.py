import base64
import hashlib

import pytest
from lorebank.llm import warc

PAGES = [(1, "u 1", "<p>a</p>"), (2, "u\r\n2", "<p>a</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "é" * 50), (None, "n", "é" * 50), (6, "u6", "only"), (7, "d", "dup"), (7, "d", "dup"), (None, None, "lost")]


@pytest.mark.parametrize("least", [0, 5])
def test_records_survive_the_archive(spark, least):
    pages = spark.createDataFrame([(*p, b"x", 1) for p in PAGES], "page_id long, url string, html string, payload binary, digest int").repartition(4)
    folder = warc.write_archive(pages, min_revisit_bytes=least)
    rows = warc.read_archive(spark, folder).collect()
    assert len(rows) == len(PAGES) and all(r.verified for r in rows)
    body = {p[0]: (p[2] or "").encode() for p in PAGES if p[0] is not None}
    for r in rows:
        if r.page_id is None:
            continue
        data = body[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        holder = max(k for k, v in body.items() if v == data)
        if len(data) < least:
            assert r.record_type == "response" and r.refers_to is None
        elif r.page_id != holder:
            assert (r.record_type, r.refers_to) == ("revisit", holder)
    assert sorted(r.record_type for r in rows if r.page_id == 7) == ["response", "revisit" if least <= 3 else "response"]
    payloads = spark.read.parquet(f"{folder}/payloads").collect()
    assert sorted(hashlib.sha256(p.payload).hexdigest() for p in payloads) == sorted({hashlib.sha256((p[2] or "").encode()).hexdigest() for p in PAGES})
    for r in warc.reconstruct_records(spark, folder).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: re")
        assert all(b": " in line for line in head.split(b"\r\n")[1:])


def test_a_damaged_payload_is_noticed(spark):
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    folder = warc.write_archive(pages)
    spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "cast('b' as binary) payload").write.parquet(f"{folder}/bad")
    spark.read.parquet(f"{folder}/bad").write.mode("overwrite").parquet(f"{folder}/payloads")
    assert [r.verified for r in warc.read_archive(spark, folder).collect()] == [False]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(spark, warc.write_archive(pages)).count() == 0
