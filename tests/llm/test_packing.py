import random
import zlib

import numpy as np
from lorebank.llm import packing
from tokenizers import Tokenizer

ODD = [None, "", " ", "<|endoftext|> is text here", "x" * 3000, " " * 5000, "word " * 9000, "Ünïcödé 🤦🏼‍♂️ \x00\r\n", "a\n\n\nb"]


def plain_tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path())


def check(pieces, texts):
    t = plain_tokenizer()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
    return sum(p.length for p in pieces) / 2048 / len(by_seq)


def test_fast_ids_equal_the_tokenizer_file(spark, sf):
    t, encode = plain_tokenizer(), packing.encoder(packing.vocabulary_path())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [x for x in ODD if x]
    assert all(encode(x) == t.encode(x, add_special_tokens=False).ids for x in texts)


def test_an_added_token_in_a_text_is_one_id():
    assert packing.encoder(packing.vocabulary_path())("a<|endoftext|>b")[1] == 50256


def test_every_id_lies_in_one_piece(spark):
    texts = dict(enumerate(ODD))
    docs = spark.createDataFrame([(k, x, 1, 2) for k, x in texts.items()], "doc_id long, text string, uid int, offset int").repartition(3)
    check(packing.pack(docs).collect(), texts)


def test_whole_table_is_packed_tightly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(packing.pack(docs).collect(), texts) > 0.97


def test_small_groups_pack_too(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(packing.pack(docs).collect(), texts) > 0.8


def test_best_fit_decreasing_equals_a_plain_search():
    rng = random.Random(4)
    for n in (0, 1, 5, 300):
        lengths = sorted((rng.randint(1, 63) for _ in range(n)), reverse=True)
        rooms, want = [], []
        for x in lengths:
            fits = [r for r in rooms if r >= x]
            if fits:
                want.append(min(fits))
                rooms.remove(min(fits))
                rooms.append(want[-1] - x)
            else:
                want.append(64)
                rooms.append(64 - x)
        placed, offsets = packing.best_fit_decreasing(lengths, 64)
        assert [64 - o for o in offsets] == want
        assert len(set(placed)) == len(rooms)


def test_ids_come_along_on_request_and_empty_tables_work(spark):
    docs = spark.createDataFrame([(None, "hello"), (3, None), (3, None)], "doc_id long, text string")
    rows = packing.pack(docs, with_ids=True).collect()
    assert sorted(len(r.ids) for r in rows) == [1, 1, 2] and all(r.ids[-1] == 1 for r in rows)
    assert {r.doc_id for r in rows} == {None, 3}
    assert packing.pack(docs.limit(0)).count() == 0
