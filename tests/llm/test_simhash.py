import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from lorebank.llm import simhash

WORDS = [f"w{k}" for k in range(200)]
ODD = [None, "", " \t\n", "one", "One two three", "a b c d", "ÄÖ ü a b c", "x " * 50]


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_triples_cover_every_four_positions():
    found = simhash.triples()
    assert len(found) == 20
    assert all(any(set(t) <= set(four) for t in found) for four in combinations(range(8), 4))


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choices(WORDS, k=rng.randint(1, 400))) for _ in range(30)]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_spark_hash_is_the_same(spark):
    rows = spark.createDataFrame([("a b c d",), ("ä ö ü ß",)], "t string").selectExpr("xxhash64(t) h", "t").collect()
    assert all(r.h % 2**64 == xxhash.xxh64_intdigest(r.t.encode(), 42) for r in rows)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.choices(WORDS, k=300) for _ in range(12)]
    texts = list(ODD)
    for words in base:
        texts += [" ".join(words)] * 2
        for _ in range(6):
            near = list(words)
            for _ in range(rng.randint(1, 3)):
                near[rng.randrange(300)] = rng.choice(WORDS)
            texts.append(" ".join(near))
    docs = spark.createDataFrame([(k, t, k, 0) for k, t in enumerate(texts)], "doc_id long, text string, fingerprint long, a long").repartition(5)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert got == {k: (f, c) for k, (f, c) in enumerate(zip(fps, slow_components(fps), strict=True))}
    for most in (0, simhash.BROADCAST_IDS):
        monkeypatch.setattr(simhash, "BROADCAST_IDS", most)
        kept = simhash.keep_representatives(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_components(fps)))


@pytest.mark.parametrize("size", [2, 5, 9, 400])
def test_links_of_a_list_connect_what_is_linked(size):
    rng = np.random.default_rng(size)
    fp = np.unique(rng.integers(0, 1 << 9, size).astype(np.uint64) * np.uint64(0x41))
    keys = np.zeros(len(fp), np.int64)
    links = simhash._links_of(keys, fp, np.arange(len(fp)))
    parent = slow_components([int(x) for x in fp])
    own = list(range(len(fp)))
    for a, b in zip(links.a, links.b, strict=True):
        assert bin(int(fp[a] ^ fp[b])).count("1") <= 4
        x, y = own[a], own[b]
        own = [min(x, y) if o in (x, y) else o for o in own]
    assert own == parent


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "z y x w v u t s")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)
    assert simhash.keep_representatives(docs).count() == 3
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
