import random
import zlib
from collections import Counter

import pytest
from lorebank.llm import sharding


def test_hypergeometric_follows_its_law():
    rng, good, bad, drawn = random.Random(1), 7, 9, 6
    n = 40_000
    got = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    from math import comb

    for k in range(0, 7):
        p = comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn)
        assert abs(got[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9
    big = [sharding.hypergeometric(rng, 10**10, 39 * 10**10, 10**6) for _ in range(300)]
    assert abs(sum(big) / 300 - 25_000) < 60


def test_matrix_has_exact_sums():
    sent, shards = [10, 0, 7, 100, 1], [24, 24, 24, 23, 23]
    m = sharding.communication_matrix(sent, shards, 3)
    assert [sum(r) for r in m] == sent and [sum(c) for c in zip(*m, strict=True)] == shards


@pytest.mark.parametrize("run_rows", [sharding.RUN_ROWS, 10])
def test_shards_are_exact_gapless_and_random(spark, monkeypatch, run_rows):
    monkeypatch.setattr(sharding, "RUN_ROWS", run_rows)
    texts = [None, "", "é", "same"] + ["same"] * 300 + [f"t{k}" for k in range(700)]
    docs = spark.createDataFrame([(k if k != 5 else None, t, 9) for k, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(7)
    rows = sharding.shard_documents(docs, shards=40).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(k if k != 5 else None) for k in range(len(texts)))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        if r.doc_id is not None:
            data = (texts[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {len(rows) // 40, len(rows) // 40 + 1}
    by_seed = [{r.doc_id: r.shard for r in sharding.shard_documents(docs, shards=40, seed=s).collect()} for s in (1, 2)]
    assert sum(by_seed[0][k] == by_seed[1][k] for k in by_seed[0]) < 100
    shard_of_copies = Counter(r.shard for r in rows if r.doc_id is not None and texts[r.doc_id] == "same")
    assert max(shard_of_copies.values()) < 20


def test_rows_keep_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(k, k, k, k, k, k) for k in range(100)], "x long, _lb_pid long, _lb_uid long, shard long, slot long, _LB_KEY long").repartition(3)
    out = sharding.shuffle_into_shards(rows, 7)
    assert sorted(out.columns) == sorted(["x", "_lb_pid", "_lb_uid", "_LB_KEY", "shard", "slot"])
    assert {(r.x, r._lb_pid, r._LB_KEY) for r in out.collect()} == {(k, k, k) for k in range(100)}


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fewer_rows_than_shards(spark):
    rows = sharding.shard_documents(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string"), 40).collect()
    assert len(rows) == 3 and len({r.shard for r in rows}) == 3 and {r.slot for r in rows} == {0}
