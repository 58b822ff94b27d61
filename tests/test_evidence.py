"""Rules of evidence, extraction and turns on small cases."""

import numpy as np
import pytest
from lorebank.functions import embeddings as em
from lorebank.operators import evidence as ev
from lorebank.operators import extraction as ex
from lorebank.streaming import turns as st
from pyspark.sql import functions as F

DAY = 86_400_000_000


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_hash_embeddings():
    texts = ["hello wörld", "", "a", "longer text than the others"]
    got = em.hash_vectors(texts, 8)
    for text, own in zip(texts, got, strict=True):
        v = np.array([fnv(d.to_bytes(8, "little") + text.encode()) / (2**64 - 1) * 2 - 1 for d in range(8)])
        assert np.allclose(own, v / np.linalg.norm(v), atol=1e-6)
    raw = [0.0] * 4
    for i, b in enumerate("abcde".encode()):
        raw[i % 4] += (b - 96) / 32
    assert np.allclose(em.byte_vector("abcde", 4), np.array(raw) / np.linalg.norm(raw), atol=1e-6)
    assert em.byte_vector("", 4).tolist() == [0.0] * 4 and em.hash_vectors([], 4).shape == (0, 4)
    assert em.cache_key("m", "t") == fnv(b"m\xfft")


def test_distinct_items_and_sums():
    assert ev.distinct_items(["The red bike", "red bike", "my blue car", "a", "big blue old car", "blue car big old"]) == ["The red bike", "my blue car", "big blue old car"]
    assert ev.is_sum_question("How much money did I spend?") and ev.is_sum_question("total hours") and ev.is_sum_question("how many days have I spent there")
    assert not ev.is_sum_question("how many bikes") and not ev.is_sum_question("how much fun")
    assert ev.parse_day("on 1970/01/03.") == 2 and ev.parse_day("2024-02-31") is None and ev.parse_day("x") is None


def test_near_duplicates_go_by_prefix_and_length(spark):
    base = "x" * 100
    rows = spark.createDataFrame([(1, base + "a" * 100, "d"), (2, base + "b" * 90, "d"), (3, base + "c" * 50, "d"), (4, "other", "d"), (5, base + "e" * 55, "d")], "id long, content string, date string")
    assert sorted(r.id for r in ev.near_duplicate_evidence(rows).collect()) == [1, 3, 4]


def test_extraction(spark):
    raw = spark.createDataFrame([(1, '```{"entities": [{"name": "Big Fox", "entity_type": "animal", "attributes": {"category": "Pets, wild_life"}}, {"name": "big  fox", "entity_type": "x", "attributes": {"color": "red"}}], "memories": [{"content": "c", "entities": ["Big Fox", "Den"]}]}```'), (2, "no json")], "id long, text string")
    parsed = ex.parse(raw)
    (e,) = ex.entity_rows(parsed).collect()
    assert (e.name, e.entity_type, e.attributes) == ("Big Fox", "x", {"category": "Pets, wild_life", "color": "red"})
    rows = ex.memories_of(parsed)
    assert [(r.subject, r.object) for r in ex.claims_of(rows).collect()] == [("Big Fox", "Den")]
    assert [r.context for r in ex.context_of(rows, ex.entity_rows(parsed)).collect()] == [["pets", "wild life"]]
    texts = spark.createDataFrame([(1, "I like my hearing aids!"), (2, "hearing is fine"), (3, "Phonak BTE hearing aids")], "id long, content string")
    named = spark.createDataFrame([(9, "Phonak BTE hearing aids", "owns")], "entity_id long, name string, relation string")
    assert sorted((r.source, r.label) for r in ex.part_of_edges(texts, named, 0).collect()) == [(1, "owns"), (3, "owns")]
    facts = spark.createDataFrame([(2, "hearing")], "id long, subject string")
    assert sorted(r.target for r in ex.mention_edges(facts, texts, 0).collect()) == [1, 3]


def test_entity_merge(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.8]), (3, "b", [1.0, 0.05]), (4, "c", [0.0, 1.0])], "id long, entity_type string, embedding array<double>")
    roots = ex.merge_similar(rows)
    assert {r.id: r.root for r in roots.collect()} == {1: 1, 2: 1, 3: 1}
    edges = spark.createDataFrame([(1, 2, "Related"), (3, 4, "Related"), (2, 4, "Related")], "source long, target long, edge_type string")
    assert [(r.source, r.target) for r in ex.redirected(edges, roots).collect()] == [(1, 4)]


def test_jobs(spark):
    now = 100 * DAY
    rows = spark.createDataFrame([(i, "Episodic", f"fact {i}. same", [1.0, i / 1000], now - 50 * DAY, now - 50 * DAY, 3, 0.3, 0.9, ["t"]) for i in range(4)], "id long, memory_type string, content string, embedding array<double>, created_at_us long, accessed_at_us long, access_count long, salience double, confidence double, tags array<string>")
    out = ex.sleep_job(rows, now)
    (c,) = out["clusters"].collect()
    assert c.content == "fact 0. same. fact 1. fact 2. fact 3" and c.members == 4 and out["decay"].count() == 4
    answers = ex.enrichment_run(rows, 0, lambda text: str(len(text.split("\n"))), batch=3).collect()
    assert sorted((len(r.ids), r.answer) for r in answers) == [(1, "1"), (3, "3")]
    row = ev.metrics(spark.sql("SELECT 'write' AS kind, cast(null as boolean) AS hit, 10 AS latency_us")).head()
    assert "lorebank_writes_total 1\n" in ev.prometheus(row) and row.avg_write_latency_us == 10.0 and row.cache_hit_rate == 0.0


def test_turns(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "Actually we might be late, maybe deploy"), (1, 1, "assistant", "ok"), (1, 2, "user", "bye")], "conv_id long, turn long, role string, text string")
    rows = st.memories_of_turns(turns)
    assert sorted(r.content for r in rows.collect()) == sorted(["User: Actually we might be late, maybe deploy\nAssistant: ok", "User: bye", "Correction: Actually we might be late, maybe deploy", "Unconfirmed: Actually we might be late, maybe deploy"])
    assert rows.select("id").distinct().count() == 4
    turns.write.parquet(f"{tmp_path}/in")
    got = []
    q = spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(st.store_turns(lambda df, n: got.append((n, df.count())))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and got == [(0, 4)]


@pytest.mark.parametrize("sessions", [2, 4])
def test_evidence_of_many_sessions_drops_assistant_turns(spark, sessions):
    rows = spark.createDataFrame([(i, "c", 0, [f"session:s{i % sessions}", *(["turn:assistant"] if i == 1 else [])]) for i in range(8)], "id long, content string, created_at_us long, tags array<string>")
    out = ev.evidence_rows(rows)
    assert out.count() == (8 if sessions == 2 else 7) and out.where(F.col("date") != "1970-01-01").count() == 0
