"""Very long texts, hot groups and odd ids, for the operators whose other tests are short."""

import base64
import hashlib
import random
import zlib

import numpy as np
from lorebank.llm import chat, exact_dedup, sharding, simhash, warc
from pyspark.sql import functions as F

LONG = "word éü " * 250_000


def test_exact_duplicates_of_very_long_texts(spark):
    rows = [(1, LONG), (2, LONG + "  "), (3, LONG.replace(" ", "\n")), (4, LONG + "x"), (4, LONG + "x"), (None, "y"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.duplicate_groups(docs).collect()}
    assert found == {(1, 2, 3), (2, 2, 3), (3, 2, 3), (4, 4, 2), (None, None, 2)}
    assert sorted((r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()), key=str) == [2, 4, None]


def test_repeated_rows_leave_the_same_row_however_they_are_dealt(spark, monkeypatch):
    rows = [(7, "same", k, None) for k in (3, 1, 2)] + [(7, " same", 9, "x"), (8, "other", 0, None)]
    for most in (0, exact_dedup.BROADCAST_KEYS):
        monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", most)
        seen = set()
        for parts in (1, 2, 5):
            docs = spark.createDataFrame(rows, "doc_id long, text string, _lb_key int, _lb_rank string").repartition(parts)
            out = exact_dedup.drop_duplicates(docs)
            assert out.columns == docs.columns
            seen.add(tuple(sorted(out.collect(), key=str)))
        assert len(seen) == 1 and sorted(r.doc_id for r in next(iter(seen))) == [7, 8]
        assert [r.text for r in next(iter(seen)) if r.doc_id == 7] == [" same"]  # the longest text


def test_records_of_many_equal_payloads_and_of_a_long_one(spark):
    pages = [(k, f"u{k}", "hot" if k % 3 else f"page {k}") for k in range(3000)] + [(5000, "long", LONG)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6)
    folder = warc.write_archive(df)
    rows = warc.read_archive(spark, folder).collect()
    assert len(rows) == 3001 and all(r.verified for r in rows)
    hot = [r for r in rows if r.page_id < 3000 and r.page_id % 3]
    assert {r.refers_to for r in hot if r.record_type == "revisit"} == {2999} and sum(r.record_type == "response" for r in hot) == 1
    assert spark.read.parquet(f"{folder}/payloads").count() == 1002
    long = next(r for r in rows if r.page_id == 5000)
    assert long.payload_digest == base64.b32encode(hashlib.sha1(LONG.encode()).digest()).decode() and long.record_type == "response"


def test_odd_ids_and_urls_are_read_back_exactly(spark):
    odd = [("null", "null"), ("a\r\nWARC-Type: x", "http://x/a b?c=%20&d=<e>"), ("é ü>", "http://x/%41%20"), ("", ""), ("%41", "a\r\nX-Target-URI-Encoding: percent"), ("+ ", " "), ("plain", None), (None, "no id")]
    pages = spark.createDataFrame([(i, u, f"body {k}") for k, (i, u) in enumerate(odd)], "page_id string, url string, html string")
    folder = warc.write_archive(pages)
    rows = warc.read_archive(spark, folder, "string", with_url=True).collect()
    assert sorted(((r.page_id, r.url) for r in rows), key=str) == sorted(odd, key=str) and all(r.verified for r in rows)
    for r in warc.reconstruct_records(spark, folder).collect():
        head = bytes(r.record).partition(b"\r\n\r\n")[0]
        assert head.count(b"WARC-Type: ") == 1 and head.count(b"\r\n") <= 9


def test_a_long_conversation_and_long_texts_are_read_back(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"t{k} ### </turn>") for k in range(3000)] + [(2, 0, "user", LONG), (2, 1, "assistant", LONG + "\\### x")]
    out = chat.conversation_digests(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    for r in out:
        own = [t for t in turns if t[0] == r.conv_id]
        said = "".join(t[3] for t in own if t[2] == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in own).encode()).hexdigest()


def test_long_texts_and_hot_copies_in_shards(spark):
    docs = spark.createDataFrame([(k, LONG if k < 3 else "hot") for k in range(900)], "doc_id long, text string").repartition(4)
    rows = sharding.shard_documents(docs, 7).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and {r.text_crc32 for r in rows if r.doc_id < 3} == {zlib.crc32(LONG.encode())}


def test_draws_among_very_many_rows_keep_mean_and_spread():
    rng, good, both, drawn = random.Random(2), 10**10, 4 * 10**11, 10**11
    got = [sharding.hypergeometric(rng, good, both - good, drawn) for _ in range(3000)]
    share = good / both
    spread = (drawn * share * (1 - share) * (both - drawn) / (both - 1)) ** 0.5
    assert abs(np.mean(got) - drawn * share) < 5 * spread / 3000**0.5 and abs(np.std(got) / spread - 1) < 0.07
    middle = [sharding.hypergeometric(rng, 5000, 7000, 4000) for _ in range(20_000)]
    spread = (4000 * 5 / 12 * 7 / 12 * 8000 / 11_999) ** 0.5
    assert abs(np.mean(middle) - 4000 * 5 / 12) < 5 * spread / 20_000**0.5 and abs(np.std(middle) / spread - 1) < 0.03
    tilted = np.mean([(x - 4000 * 5 / 12) ** 3 for x in middle]) / spread**3
    assert abs(tilted) < 0.1


def test_a_large_matrix_is_drawn_in_seconds():
    import time

    began = time.time()
    sent, shards = [1000 + k % 7 for k in range(2000)], [0] * 40
    for k in range(sum(sent)):
        shards[k % 40] += 1
    matrix = sharding.communication_matrix(sent, shards, 5)
    assert [sum(r) for r in matrix] == sent and [sum(c) for c in zip(*matrix, strict=True)] == shards
    assert time.time() - began < 60


def test_no_link_of_a_whole_table_is_lost(spark):
    """Recall of the 4-bit law: all pairs of fingerprints of sf0.01, compared one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    fps = np.array(sorted({int(r.fingerprint, 16) for r in rows}), np.uint64)
    group = {int(r.fingerprint, 16): r.component_id for r in rows}
    links = lost = 0
    for k, fp in enumerate(fps[:-1]):
        for other in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ fp) <= 4]:
            links += 1
            lost += group[int(fp)] != group[int(other)]
    assert links > 0 and lost == 0
    assert all(r.component_id <= r.doc_id for r in rows)


def test_texts_hash_alike_in_both_languages(spark):
    r = spark.createDataFrame([(LONG,)], "t string").select(F.sha2(F.encode("t", "UTF-8"), 256).alias("h")).head()
    assert r.h == hashlib.sha256(LONG.encode()).hexdigest()
