"""The client, end to end on a small store."""

import json

import pytest
from lorebank.session import DimensionError, Lorebank, tolerant_json
from lorebank.sources.store import read_bank

DAY = 86_400_000_000
NOW = 1_706_745_600_000_000


@pytest.fixture
def bank(spark, tmp_path):
    words = ["rust", "go", "cake"]
    return Lorebank(spark, str(tmp_path / "bank"), embed=lambda t: [float(w in t.lower()) + 0.01 for w in words])


def test_store_search_and_forget(bank):
    a, b, c = bank.store_many([{"content": "We use Rust", "tags": ["dev"]}, {"content": "We use Go", "tags": ["dev", "old"]}, {"content": "I like cake", "agent_id": "x"}])
    assert bank.memories().count() == 3
    hits = bank.search_text("rust", 2)
    assert hits.head().id == a and hits.columns[-1] != "version"
    assert [r.id for r in bank.search([0.0, 1.0, 0.0], 1).collect()] == [b]
    assert {r.id for r in bank.search_text("use", 5, tags=["dev"]).collect()} <= {a, b}
    bank.relate(a, b, "Supersedes")
    assert b not in {r.id for r in bank.search_text("go", 3).collect()}
    with pytest.raises(KeyError):
        bank.relate(a, "nobody")
    with pytest.raises(DimensionError):
        bank.store("x", embedding=[1.0])
    with pytest.raises(ValueError):
        bank.store("x", memory_type="Dream")
    assert [(r.id, r.depth) for r in bank.traverse(a, 2).orderBy("depth").collect()] == [(a, 0), (b, 1)]
    assert bank.forget(b) == 1 and bank.memories().count() == 2 and bank.edges().count() == 0
    assert bank.forget("x", "agent", hard=False) == 1
    assert bank.get_memory(c).head().valid_until_us is not None
    assert {r.operation_type for r in bank.operations().collect()} == {"store", "relate", "forget"}
    assert {r.id for r in bank.search_multi(["rust", "cake"], 5).collect()} == {a}


def test_query_language_and_context(bank):
    bank.store_many([{"content": "Rust is great", "salience": 0.9}, {"content": "Go is fine", "memory_type": "Correction"}])
    text = bank.recall('RECALL memories WHERE content ~> "rust" LIMIT 5')
    assert "Rust is great" in text and "Go is fine" in text and text.startswith("## ")
    assert bank.query("RECALL WHERE type = correction").count() == 1
    assert bank.recall("RECALL WHERE tag = nothing") == ""


def test_upkeep(bank):
    ids = bank.store_many([{"content": f"c{k}", "salience": 0.04, "created_at_us": NOW - 40 * DAY, "embedding": [1.0, float(k), 0.0]} for k in range(2)])
    assert bank.run_decay(NOW).count() == 2
    assert {round(r.salience, 2) for r in bank.memories().collect()} == {0.01}
    bank.run_archival(NOW)
    assert all("archived" in r.tags for r in bank.memories().collect())
    bank.invalidate(ids[0], NOW)
    assert bank.get_memory(ids[0]).head().valid_until_us == NOW
    assert {r.event_type for r in bank.lifecycle_events().collect()} == {"decayed", "archived", "invalidated"}
    assert bank.memories().head().created_at_us == NOW - 40 * DAY


def test_turns_entities_and_extraction(spark, bank):
    a, b = bank.store_turn("Name: Ada Lovelace", "Hello Ada")
    assert bank.edges().head().label == "assistant_response"
    d = bank.store("Name: Ada Lovelace. Again")
    assert {r.id for r in bank.entity_memories("ada lovelace").collect()} == {a, d}
    assert bank.link_entities() == 1 and bank.link_entities() == 0
    bank.extractor = lambda _: 'Sure:\n```json\n{"memories": [{"content": "uses Rust", "memory_type": "decision", "confidence": 0.9}, {"content": "maybe", "confidence": 0.2}]}\n```'
    (e,) = bank.ingest("User: hi")
    assert bank.get_memory(e).head().memory_type == "Semantic"
    assert bank.clusters(0.99).count() >= 2
    assert bank.search_expanded("what is the latest about rust", 3, reference_us=NOW).count() > 0
    assert not bank.needs_enrichment(0) and bank.communities().count() == 0


def test_derived_layer(spark, bank):
    a = bank.store_with_source("Company: Acme and Beta", "conversation", "c1", "t1")
    b = bank.store("Company: Acme")
    t = bank.tables.derived
    assert t["sources"].rows().head().conversation_id == "c1"
    bank.index_entities()
    bank.index_entities()
    assert sorted(r.canonical for r in t["entities"].rows().collect()) == ["Acme", "Beta"]
    assert t["memory_entities"].rows().count() == 3
    assert {r.id for r in bank.entity_boost("what about acme?").collect()} == {a, b}
    bank.forget(a)
    assert t["memory_entities"].rows().count() == 1 and t["sources"].rows().count() == 0
    for k in range(3):
        hits = bank.search_traced("acme", 2, f"t{k}", retain=2)
    assert [r.rank for r in hits.collect()] == [0] and {r.trace_id for r in t["traces"].rows().collect()} == {"t1", "t2"}
    bank.tables.save_snapshot("x", {"a": 1}, 2)
    assert bank.tables.load_snapshot("x", 2) == {"a": 1} and bank.tables.load_snapshot("y", 2) is None
    with pytest.raises(ValueError):
        bank.tables.load_snapshot("x", 1)


def test_json_and_bank_files(spark, tmp_path):
    assert tolerant_json('x {bad} {"a": "}", "a": 2} y') == {"a": 2} and tolerant_json("none") == {}
    path = tmp_path / "bank.json"
    path.write_text(json.dumps({"memory_bank": [{"section": "s", "tags": ["t"], "items": ["one", "two"]}]}))
    assert [(r.section, r.pos, r.content) for r in read_bank(spark, str(path)).collect()] == [("s", 0, "one"), ("s", 1, "two")]
