"""Queries on the client: stores of the nations as memories, written and read back."""

from __future__ import annotations

import json
import math
import re
import uuid

from pyspark.sql import functions as F

from lorebank.plans.registry import query
from lorebank.runtime import shared_folder
from lorebank.session import DimensionError, Lorebank, tolerant_json
from lorebank.sources import fixtures as fx
from lorebank.sources import store

NOW, DAY = fx.NOW_US, fx.DAY_US

# One memory per nation; the vector turns by a radian per nation.
NB = f"""NB AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, 'the nation ' || n_name || ' of region ' || n_regionkey AS content, 'r' || n_regionkey AS tag, n_nationkey AS k,
  {NOW} - n_nationkey * {DAY} AS created_at_us, (n_nationkey % 10)::DOUBLE / 10.0::DOUBLE AS salience, CAST(CAST([cos(n_nationkey), sin(n_nationkey)] AS FLOAT[]) AS DOUBLE[]) AS e FROM nation)"""


def embed(text: str) -> list[float]:
    """The direction of a text's first number."""
    n = int((re.findall(r"\d+", text) or ["0"])[0])
    return [math.cos(n), math.sin(n)]


def empty_bank(spark, **options) -> Lorebank:
    return Lorebank(spark, f"{shared_folder(spark)}/bank-{uuid.uuid4().hex}", embed, **options)


def nations(spark, sf) -> list:
    return fx.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()


def bank_of(spark, sf, **options) -> Lorebank:
    bank = empty_bank(spark, **options)
    bank.store_many(
        [{"id": str(n.n_nationkey), "content": f"the nation {n.n_name} of region {n.n_regionkey}", "tags": [f"r{n.n_regionkey}"], "created_at_us": NOW - n.n_nationkey * DAY, "salience": n.n_nationkey % 10 / 10} for n in nations(spark, sf)]
    )
    return bank


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


@query("client_store", f"WITH {NB} SELECT id, content, 'Episodic' AS memory_type, tag AS tags, created_at_us, round(salience, 6) AS salience, 2 AS dims FROM NB")
def client_store(spark, sf):
    """A batch in one commit, with the embedder's vectors."""
    return bank_of(spark, sf).memories().select("id", "content", "memory_type", F.array_join("tags", ",").alias("tags"), "created_at_us", r6("salience"), F.size("embedding").alias("dims"))


@query("client_reopen", f"WITH {NB} SELECT id, content FROM NB WHERE k <> 4 UNION ALL SELECT '4', 'changed'")
def client_reopen(spark, sf):
    """A store opened again on its folder has the newest version of every memory."""
    bank = bank_of(spark, sf)
    folder = bank.tables.memories.path.rpartition("/")[0]
    bank.store("changed", id="4")
    bank.close()
    return Lorebank(spark, folder).memories().select("id", "content")


@query("client_close", "SELECT * FROM (VALUES ('closed', true), ('reopened', false)) t(state, refuses)")
def client_close(spark, sf):
    with empty_bank(spark) as bank:
        folder = bank.tables.memories.path.rpartition("/")[0]

    def refuses(x: Lorebank) -> bool:
        try:
            x.memories()
            return False
        except RuntimeError:
            return True

    return spark.createDataFrame([("closed", refuses(bank)), ("reopened", refuses(Lorebank(spark, folder)))], "state string, refuses boolean")


@query("client_get_memory", f"WITH {NB} SELECT id, content FROM NB WHERE k = 9")
def client_get_memory(spark, sf):
    return bank_of(spark, sf).get_memory("9").select("id", "content")


@query("client_store_source", "SELECT 'turn' AS source_type, 'c1' AS conversation_id, 't2' AS turn_id, 'ann' AS actor_id, 'said 5' AS content")
def client_store_source(spark, sf):
    bank = empty_bank(spark)
    memory = bank.store_with_source("said 5", "turn", "c1", "t2", "ann")
    rows = bank.tables.derived["sources"].rows().where(F.col("memory_id") == memory)
    return rows.join(bank.memories().withColumnRenamed("id", "memory_id"), "memory_id").select("source_type", "conversation_id", "turn_id", "actor_id", "content")


@query("client_dimension", "SELECT * FROM (VALUES ('two', false), ('three', true), ('none', false)) t(vector, refused)")
def client_dimension(spark, sf):
    """The first vector sets the length; others are refused, and nothing of their batch is written."""
    bank, out = empty_bank(spark), []
    for name, vector in (("two", [1.0, 0.0]), ("three", [1.0, 0.0, 0.0]), ("none", [])):
        try:
            bank.store_many([{"content": "first", "embedding": [0.0, 1.0]}, {"content": name, "embedding": vector}])
            out.append((name, False))
        except DimensionError:
            out.append((name, True))
    known = bank.memories().where("content <> 'first'").select(F.col("content").alias("vector"))
    return spark.createDataFrame(out, "vector string, refused boolean").join(known.withColumn("known", F.lit(True)), "vector", "left").where(F.col("refused") != F.coalesce("known", F.lit(False))).drop("known")


@query("client_relate", "SELECT CAST(n_nationkey AS VARCHAR) AS source, CAST(n_regionkey AS VARCHAR) AS target, 'PartOf' AS edge_type, 0.5::DOUBLE AS weight, 'of' AS label FROM nation WHERE n_nationkey IN (7, 8)")
def client_relate(spark, sf):
    bank = bank_of(spark, sf)
    for n in nations(spark, sf):
        if n.n_nationkey in (7, 8):
            bank.relate(str(n.n_nationkey), str(n.n_regionkey), "PartOf", 0.5, "of", NOW)
    return bank.edges().select("source", "target", "edge_type", "weight", "label")


@query("client_traverse", "SELECT * FROM (VALUES ('1', 0), ('2', 1), ('3', 2)) t(id, depth)")
def client_traverse(spark, sf):
    """Edges written through the client, read back by the query language."""
    bank = bank_of(spark, sf)
    for a, b, kind in (("1", "2", "Caused"), ("2", "3", "Caused"), ("3", "4", "Before"), ("4", "5", "Caused")):
        bank.relate(a, b, kind, now_us=NOW)
    return bank.query('TRAVERSE "1" DEPTH 4 WHERE edge_type = caused', NOW)


@query("client_forget", f"WITH {NB} SELECT id, 'kept' AS state FROM NB WHERE tag <> 'r2' AND k <> 6 UNION ALL SELECT 'edges', '1'")
def client_forget(spark, sf):
    """Forgetting is final unless told otherwise: memories, their edges and what depends on them go."""
    bank = bank_of(spark, sf)
    for a, b in (("1", "6"), ("1", "5"), ("7", "5")):
        bank.relate(a, b, now_us=NOW)
    bank.forget("6", now_us=NOW)
    bank.forget("r2", "tag", now_us=NOW)
    left = bank.edges().agg(F.count(F.lit(1)).cast("string").alias("state")).select(F.lit("edges").alias("id"), "state")
    return bank.memories().select("id", F.lit("kept").alias("state")).unionByName(left)


@query("client_forget_soft", f"WITH {NB} SELECT id, CASE WHEN tag = 'r3' THEN {NOW} END AS valid_until_us FROM NB")
def client_forget_soft(spark, sf):
    bank = bank_of(spark, sf)
    bank.forget("r3", "tag", hard=False, now_us=NOW)
    return bank.memories().select("id", "valid_until_us")


HYBRID = "0.7::DOUBLE * ({}) + 0.05::DOUBLE * salience + 0.01::DOUBLE"
NEAR = "1.0::DOUBLE / (60 + row_number() OVER (ORDER BY list_cosine_similarity(e, [cos({0}), sin({0})]) DESC, id) - 1)"


def recalled(name: str, number: int, k: int, word: bool) -> str:
    """Common table expressions of a recall: a list by vector, and one word that a single nation has."""
    extra = f" + CASE WHEN id = '{number}' THEN 1.0::DOUBLE / 60 ELSE 0 END" if word else ""
    return f"{name}0 AS (SELECT *, {NEAR.format(number)} AS v FROM NB), {name} AS (SELECT id, {HYBRID.format('v' + extra)} AS score FROM {name}0 ORDER BY score DESC, id LIMIT {k})"


def scored(df):
    return df.select("id", r6("score"))


@query("client_search", f"WITH {NB}, {recalled('A', 3, 5, False)} SELECT id, round(score, 6) AS score FROM A")
def client_search(spark, sf):
    return scored(bank_of(spark, sf).search(embed("3"), 5, now_us=NOW))


@query("client_search_text", f"WITH {NB}, {recalled('A', 17, 4, True)} SELECT id, round(score, 6) AS score FROM A")
def client_search_text(spark, sf):
    return scored(bank_of(spark, sf).search_text("nation_17", 4, now_us=NOW))


@query("client_search_tags", f"WITH {NB}, A0 AS (SELECT *, {NEAR.format(17)} AS v FROM NB WHERE tag IN ('r1', 'r2')) SELECT id, round({HYBRID.format('v')}, 6) AS score FROM A0 ORDER BY 2 DESC, id LIMIT 4")
def client_search_tags(spark, sf):
    return scored(bank_of(spark, sf).search(embed("17"), 4, tags=["r1", "r2"], tags_or=True, now_us=NOW))


RANKED = "SELECT id, {w} / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) AS part FROM {t}"


@query("client_search_multi", f"WITH {NB}, {recalled('A', 11, 4, True)}, {recalled('B', 17, 4, True)}, F AS ({RANKED.format(w='1.0::DOUBLE', t='A')} UNION ALL {RANKED.format(w='1.0::DOUBLE', t='B')}) SELECT id, round(sum(part), 6) AS score FROM F GROUP BY id ORDER BY sum(part) DESC, id LIMIT 4")
def client_search_multi(spark, sf):
    return scored(bank_of(spark, sf).search_multi(["nation_11", "nation_17"], 4, now_us=NOW))


@query("client_search_expanded", f"""WITH {NB}, {recalled('A', 12, 10, True)}, {recalled('B', 14, 5, True)},
C AS (SELECT id, list_cosine_similarity(e, [cos(12), sin(12)]) AS score FROM NB ORDER BY score DESC, id LIMIT 5),
F AS ({RANKED.format(w='1.0::DOUBLE', t='A')} UNION ALL {RANKED.format(w='1.0::DOUBLE', t='B')} UNION ALL {RANKED.format(w='0.6::DOUBLE', t='(SELECT * FROM C WHERE score > 0.3)')}) SELECT id, round(sum(part), 6) AS score FROM F GROUP BY id ORDER BY sum(part) DESC, id LIMIT 5""")
def client_search_expanded(spark, sf):
    """The question, one sub-query and spreading activation."""
    return scored(bank_of(spark, sf).search_expanded("nation_12", 5, now_us=NOW, expand=lambda q: ["nation_14"]))


def counting_judge(prompt: str) -> str:
    """Takes a counting question apart, asks for one more nation, and rates texts by their region."""
    if prompt.startswith("Take"):
        return 'Sure: {"queries": ["nation_14"], "nouns": "", "items": ["nation_20"], "broad": ["Things"]}'
    if prompt.startswith("Score"):
        return json.dumps([2 * int(line.rpartition(" ")[2]) for line in prompt.splitlines() if line.startswith("[")])
    return '["nation_22"]'


@query("client_search_judged", f"""WITH {NB}, {recalled('A', 12, 8, False)}, {recalled('B', 14, 4, True)}, {recalled('I', 20, 15, True)}, {recalled('J', 0, 15, False)}, {recalled('G', 22, 8, True)},
C AS (SELECT id, list_cosine_similarity(e, [cos(12), sin(12)]) AS score FROM NB ORDER BY score DESC, id LIMIT 5),
F AS ({RANKED.format(w='1.0::DOUBLE', t='A')} UNION ALL {RANKED.format(w='1.0::DOUBLE', t='B')} UNION ALL {RANKED.format(w='1.0::DOUBLE', t='I')} UNION ALL {RANKED.format(w='0.4::DOUBLE', t='J')} UNION ALL {RANKED.format(w='0.6::DOUBLE', t='(SELECT * FROM C WHERE score > 0.3)')}),
H AS (SELECT id, sum(part) AS score FROM F GROUP BY id ORDER BY sum(part) DESC, id LIMIT 4),
K AS ({RANKED.format(w='1.0::DOUBLE', t='H')} UNION ALL {RANKED.format(w='1.0::DOUBLE', t='G')}), Z AS (SELECT id, sum(part) AS score FROM K GROUP BY id ORDER BY sum(part) DESC, id LIMIT 4)
SELECT id, 2.0::DOUBLE * CAST(substr(tag, 2) AS INTEGER) AS score FROM Z JOIN NB USING (id) WHERE tag <> 'r0'""")
def client_search_judged(spark, sf):
    """A judge takes the question apart, names what is missing and rates what was found."""
    return scored(bank_of(spark, sf, judge=counting_judge).search_expanded("How many like 12?", 4, now_us=NOW))


@query("client_recall", f"WITH {NB} SELECT '## 📋 Primary Context' || chr(10) || string_agg('- **[Episodic]** (salience: ' || printf('%.2f', salience) || ') ' || content || ' [' || tag || ']', chr(10) ORDER BY salience DESC, id) || chr(10) AS context FROM (SELECT * FROM NB WHERE tag = 'r1' ORDER BY salience DESC, id LIMIT 2)")
def client_recall(spark, sf):
    text = bank_of(spark, sf).recall("RECALL memories WHERE tag = r1 ORDER BY salience DESC LIMIT 2", NOW)
    return spark.createDataFrame([(text,)], "context string")


ANSWER = '```json {"memories": [{"content": "likes 3", "memory_type": "preference", "confidence": 0.9, "tags": ["a"]}, {"content": "went 4", "confidence": 0.7}, {"content": "unsure 5", "confidence": 0.2}], "note": "x"} ```'


@query("client_extract", "SELECT * FROM (VALUES ('likes 3', 'preference', 0.9::DOUBLE), ('went 4', NULL, 0.7::DOUBLE), ('unsure 5', NULL, 0.2::DOUBLE)) t(content, memory_type, confidence)")
def client_extract(spark, sf):
    found = empty_bank(spark, extract=lambda text: ANSWER).extract("user: hello")["memories"]
    return spark.createDataFrame([(m["content"], m.get("memory_type"), m["confidence"]) for m in found], "content string, memory_type string, confidence double")


def stored(bank):
    return bank.memories().select("content", "memory_type", "confidence", F.array_join("tags", ",").alias("tags"))


@query("client_ingest", "SELECT * FROM (VALUES ('likes 3', 'Semantic', 0.9::DOUBLE, 'a'), ('went 4', 'Episodic', 0.7::DOUBLE, '')) t(content, memory_type, confidence, tags)")
def client_ingest(spark, sf):
    bank = empty_bank(spark, extract=lambda text: ANSWER)
    bank.ingest("user: hello")
    return stored(bank)


@query("client_store_extracted", "SELECT * FROM (VALUES ('likes 3', 'Semantic', 0.9::DOUBLE, 'a'), ('went 4', 'Episodic', 0.7::DOUBLE, ''), ('unsure 5', 'Episodic', 0.2::DOUBLE, '')) t(content, memory_type, confidence, tags)")
def client_store_extracted(spark, sf):
    bank = empty_bank(spark)
    bank.store_extracted(tolerant_json(ANSWER))
    return stored(bank)


@query("tolerant_json", "SELECT * FROM (VALUES (0, '{\"a\": 2}'), (1, '{\"b\": {\"c\": 1}}'), (2, '{}'), (3, '{}')) t(n, body)")
def tolerant_json_query(spark, sf):
    """Fences and prose around the object, repeated keys, a broken object before a whole one, and none."""
    texts = ['Here: ```json\n{"a": 1, "a": 2}\n``` done', '{"x": oops} then {"b": {"c": 1}}', "no object", "[1, 2]"]
    return spark.createDataFrame([(n, json.dumps(tolerant_json(t))) for n, t in enumerate(texts)], "n int, body string")


def bank_of_entities(spark, sf, **options):
    """Memories that name their region as a place and their number as a technology."""
    bank = empty_bank(spark, **options)
    bank.store_many([{"id": f"{n.n_nationkey:02}", "content": f"Location: Region{n.n_regionkey}\nTechnology: Tool{n.n_nationkey % 10}", "memory_type": "Episodic", "confidence": 0.9, "created_at_us": NOW - n.n_nationkey * DAY} for n in nations(spark, sf)])
    return bank


@query("client_entity_memories", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id FROM nation WHERE n_regionkey = 2")
def client_entity_memories(spark, sf):
    return bank_of_entities(spark, sf).entity_memories("region2").select("id")


SHARED = "P AS (SELECT lpad(CAST(a.n_nationkey AS VARCHAR), 2, '0') AS source, lpad(CAST(b.n_nationkey AS VARCHAR), 2, '0') AS target FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND (a.n_regionkey = b.n_regionkey OR a.n_nationkey % 10 = b.n_nationkey % 10))"


@query("client_link_entities", f"WITH {SHARED} SELECT source, target FROM P")
def client_link_entities(spark, sf):
    """Linking again adds nothing."""
    bank = bank_of_entities(spark, sf)
    bank.link_entities(NOW)
    bank.link_entities(NOW)
    return bank.edges().select("source", "target")


@query("client_index_entities", "SELECT 'place:region' || n_regionkey AS entity_id, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS memory_id, 'location' AS role FROM nation UNION ALL SELECT 'technology:tool' || (n_nationkey % 10), lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), 'tool' FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'technology:new', '03', 'tool'")
def client_index_entities(spark, sf):
    """A memory's entities are replaced as one bundle when it changes."""
    bank = bank_of_entities(spark, sf)
    bank.index_entities()
    bank.store(f"Location: Region{nations(spark, sf)[3].n_regionkey}\nTechnology: New", id="03")
    bank.index_entities()
    return bank.tables.derived["memory_entities"].rows().select("entity_id", "memory_id", "role")


@query("client_build_communities", "SELECT 'community:place' AS id, 'place: ' || (SELECT string_agg(r, ', ' ORDER BY r) FROM (SELECT DISTINCT 'Region' || n_regionkey AS r FROM nation)) AS content UNION ALL SELECT 'community:technology', 'technology: ' || (SELECT string_agg(r, ', ' ORDER BY r) FROM (SELECT DISTINCT 'Tool' || (n_nationkey % 10) AS r FROM nation))")
def client_build_communities(spark, sf):
    """Building again replaces the summaries."""
    bank = bank_of_entities(spark, sf)
    bank.build_communities()
    bank.build_communities()
    return bank.memories().where(F.array_contains("tags", "community_summary")).select("id", "content")


@query("client_needs_enrichment", "SELECT CAST(least AS INTEGER) AS least, (SELECT count(*) FROM nation) >= least AS due FROM (VALUES (20), (25), (26)) t(least)")
def client_needs_enrichment(spark, sf):
    bank = bank_of_entities(spark, sf)
    return spark.createDataFrame([(k, bank.needs_enrichment(0, k)) for k in (20, 25, 26)], "least int, due boolean")


def number_of_texts(text: str) -> str:
    """An extractor that tells how many places a batch names, and says one thing always."""
    return json.dumps({"memories": [{"content": f"{text.count('Location')} places", "memory_type": "fact", "confidence": 0.95}, {"content": "always the same", "confidence": 0.8}, {"content": "poor", "confidence": 0.1}]})


@query("client_run_enrichment", f"""WITH {SHARED} SELECT * FROM (VALUES ('memories_stored', 2), ('duplicates_skipped', 48), ('communities_created', 2), ('profile_facts', 1)) t(what, n)
UNION ALL SELECT 'entities_linked', count(*) FROM P UNION ALL SELECT 'edges_created', 2""")
def client_run_enrichment(spark, sf):
    """Every nation is of another day and so a batch of its own; equal answers are stored once."""
    bank = bank_of_entities(spark, sf, extract=number_of_texts)
    return spark.createDataFrame(sorted(bank.run_enrichment(now_us=NOW).items()), "what string, n long")


@query("client_consolidate", f"""WITH {NB}, C AS (SELECT * FROM NB WHERE k IN (2, 3, 4)) SELECT 'source' AS part, id, '' AS content, {NOW} AS at_us, 'merged_into_consolidated_memory' AS reason FROM C
UNION ALL SELECT 'merged', 'Semantic', string_agg(lower(content), '. ' ORDER BY id), {NOW}, 'consolidated_memory_created' FROM C UNION ALL SELECT 'edge', id, 'Derived', {NOW}, '1.0' FROM C""")
def client_consolidate(spark, sf):
    """The merged memory, the ended validity of its sources, the edges between them, and the log of all."""
    bank = bank_of(spark, sf)
    new = bank.consolidate_cluster(["2", "3", "4"], NOW)
    log = bank.lifecycle_events().where("event_type = 'consolidated'").select(F.col("memory_id").alias("id"), "reason")
    rows = bank.memories().join(log, "id")
    sources = rows.where(F.col("id") != new).select(F.lit("source").alias("part"), "id", F.lit("").alias("content"), F.col("valid_until_us").alias("at_us"), "reason")
    merged = rows.where(F.col("id") == new).select(F.lit("merged").alias("part"), F.col("memory_type").alias("id"), "content", F.col("created_at_us").alias("at_us"), "reason")
    edges = bank.edges().select(F.lit("edge").alias("part"), F.col("target").alias("id"), F.col("edge_type").alias("content"), F.col("created_at_us").alias("at_us"), F.col("weight").cast("string").alias("reason"))
    return sources.unionByName(merged).unionByName(edges)


@query("client_agents", "SELECT * FROM (VALUES ('ann', '{\"role\": \"b\", \"team\": \"x\"}'), ('bob', '{}')) t(name, metadata)")
def client_agents(spark, sf):
    bank = empty_bank(spark)
    ann, _, eve = (bank.register_agent(n, NOW) for n in ("ann", "bob", "eve"))
    for agent, key, value in ((ann, "role", "a"), (ann, "team", "x"), (ann, "role", "b"), ("nobody", "role", "c")):
        bank.set_agent_metadata(agent, key, value)
    bank.remove_agent(eve)
    return bank.agents().select("name", "metadata")


@query("client_turns", "SELECT * FROM (VALUES ('User: hi 1', 'turn,turn:user', 'Assistant: yes 2', 'Before', 'assistant_response')) t(content, tags, answer, edge_type, label)")
def client_turns(spark, sf):
    bank = empty_bank(spark)
    bank.store_turn("hi 1", "yes 2")
    m = bank.memories()
    e = bank.edges().join(m.select(F.col("id").alias("source"), "content", F.array_join("tags", ",").alias("tags")), "source").join(m.select(F.col("id").alias("target"), F.col("content").alias("answer")), "target")
    return e.select("content", "tags", "answer", "edge_type", "label")


@query("client_events", "SELECT * FROM (VALUES ('store', 3), ('relate', 1), ('only relate', 1)) t(kind, n)")
def client_events(spark, sf):
    """Subscribers hear of every change, of some kinds, and of nothing after they left."""
    bank, heard = empty_bank(spark), []
    first = bank.events.subscribe(lambda kind, rows: heard.append((kind, rows.count())))
    bank.events.subscribe(lambda kind, rows: heard.append((f"only {kind}", rows.count())), ("relate",))
    a, b = bank.store_many([{"content": "1"}, {"content": "2"}])
    bank.store("3")
    bank.relate(a, b)
    bank.events.unsubscribe(first)
    bank.store("4")
    return spark.createDataFrame(heard, "kind string, n long").groupBy("kind").agg(F.sum("n").cast("int").alias("n"))


@query("client_policy_log", f"WITH {NB} SELECT id, 'invalidated' AS event_type, 'invalidate' AS policy, {NOW} AS at_us FROM NB WHERE k = 5 UNION ALL SELECT id, 'forgotten', 'forget', {NOW} FROM NB WHERE tag = 'r1'")
def client_policy_log(spark, sf):
    """What policies wrote about each memory."""
    bank = bank_of(spark, sf)
    bank.invalidate("5", NOW)
    bank.forget("r1", "tag", hard=False, now_us=NOW)
    return bank.lifecycle_events().select(F.col("memory_id").alias("id"), "event_type", "policy", F.col("created_at_us").alias("at_us"))


@query("client_policy_run", f"""WITH {NB}, A AS (SELECT id, 'forget' AS policy, 'apply' AS mode, 'forgotten' AS action, 'applied' AS status, {NOW} AS valid_until_us FROM NB WHERE tag = 'r1'
UNION ALL SELECT id, 'forget', 'preview', 'would_forgotten', 'planned', NULL FROM NB WHERE tag = 'r2') SELECT * FROM A""")
def client_policy_run(spark, sf):
    """One policy applied, one previewed, one cut off before its end, whose actions nobody sees."""
    bank = bank_of(spark, sf)
    ended = lambda tag: bank.memories().where(F.array_contains("tags", tag)).withColumn("valid_until_us", F.lit(NOW))
    bank.run_policy("forget", ended("r1"), "forgotten", scope={"tag": "r1"}, now_us=NOW)
    bank.run_policy("forget", ended("r2"), "forgotten", preview=True, scope={"tag": "r2"}, now_us=NOW)
    t = bank.tables.derived
    t["policy_runs"].upsert(spark.createDataFrame([("cut", "forget", "apply", "started")], "run_id string, policy string, mode string, status string"))
    t["policy_actions"].upsert(spark.createDataFrame([("cut", "forgotten", "3", "applied")], "run_id string, action string, memory_id string, status string"))
    return bank.policy_log().join(bank.memories().select(F.col("id").alias("memory_id"), "valid_until_us"), "memory_id").select(F.col("memory_id").alias("id"), "policy", "mode", "action", "status", "valid_until_us")


@query("client_operations", f"WITH {NB} SELECT 'store' AS operation_type, id AS memory_id FROM NB UNION ALL SELECT 'relate', NULL UNION ALL SELECT 'forget', '3'")
def client_operations(spark, sf):
    bank = bank_of(spark, sf)
    bank.relate("1", "2", now_us=NOW)
    bank.forget("3", now_us=NOW)
    return bank.operations().select("operation_type", "memory_id")


# Storage below the client.


@query("store_snapshots", "SELECT * FROM (VALUES ('topics', '{\"a\": 2}'), ('none', NULL), ('newer', 'refused')) t(name, body)")
def store_snapshots(spark, sf):
    """The last snapshot of a name counts; one of a newer format is refused."""
    tables, out = empty_bank(spark).tables, []
    tables.save_snapshot("topics", {"a": 1}, 1)
    tables.save_snapshot("topics", {"a": 2}, 1)
    tables.save_snapshot("newer", {}, 9)
    for name in ("topics", "none", "newer"):
        try:
            body = tables.load_snapshot(name, 1)
            out.append((name, None if body is None else json.dumps(body)))
        except ValueError:
            out.append((name, "refused"))
    return spark.createDataFrame(out, "name string, body string")


@query("store_derived_rows", "SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, CASE WHEN n_regionkey = 1 THEN 'changed' ELSE n_name END AS canonical, n_name AS alias, CASE WHEN n_regionkey = 2 THEN 'corrected' ELSE 'active' END AS status, CASE WHEN n_nationkey > 0 THEN CAST(n_nationkey - 1 AS VARCHAR) END AS related FROM nation WHERE n_nationkey <> 9")
def store_derived_rows(spark, sf):
    """Upserts and deletions by key of entities, aliases, claims and relationships."""
    n, t = fx.table(spark, sf, "nation").withColumn("entity_id", F.col("n_nationkey").cast("string")), empty_bank(spark).tables.derived
    t["entities"].upsert(n.select("entity_id", F.lit("place").alias("entity_type"), F.col("n_name").alias("canonical")))
    t["entities"].upsert(n.where("n_regionkey = 1").select("entity_id", F.lit("place").alias("entity_type"), F.lit("changed").alias("canonical")))
    t["entities"].delete(n.where("n_nationkey = 9").select("entity_id"))
    t["aliases"].upsert(n.select("entity_id", F.col("n_name").alias("alias"), F.lit(1.0).alias("confidence")))
    t["claims"].upsert(n.select(F.concat(F.lit("c"), "entity_id").alias("claim_id"), F.col("entity_id").alias("subject_id"), F.lit("active").alias("status")))
    t["claims"].upsert(n.where("n_regionkey = 2").select(F.concat(F.lit("c"), "entity_id").alias("claim_id"), F.col("entity_id").alias("subject_id"), F.lit("corrected").alias("status")))
    t["relationships"].upsert(n.where("n_nationkey > 0").select(F.concat(F.lit("r"), "entity_id").alias("relationship_id"), F.col("entity_id").alias("source"), (F.col("n_nationkey") - 1).cast("string").alias("target")))
    own = t["claims"].rows().select(F.col("subject_id").alias("entity_id"), "status")
    near = t["relationships"].rows().select(F.col("source").alias("entity_id"), F.col("target").alias("related"))
    return t["entities"].rows().join(t["aliases"].rows().drop("confidence"), "entity_id").join(own, "entity_id").join(near, "entity_id", "left").select("entity_id", "canonical", "alias", "status", "related")


@query("store_evidence_cascade", "SELECT CAST(n_nationkey AS VARCHAR) AS memory_id, 'c' || n_regionkey AS claim_id FROM nation WHERE n_nationkey NOT IN (4, 8)")
def store_evidence_cascade(spark, sf):
    """Evidence goes with its memory."""
    bank = bank_of(spark, sf)
    rows = fx.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("memory_id"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("claim_id"), F.lit(1.0).alias("confidence"))
    bank.tables.derived["claim_evidence"].upsert(rows)
    bank.forget("4", now_us=NOW)
    bank.forget("8", now_us=NOW)
    return bank.tables.derived["claim_evidence"].rows().select("memory_id", "claim_id")


@query("store_extraction_runs", "SELECT * FROM (VALUES ('run1', 'done', '{\"memories\": []}'), ('run2', 'failed', NULL)) t(run_id, status, output_json)")
def store_extraction_runs(spark, sf):
    t = empty_bank(spark).tables.derived["extraction_runs"]
    for run, status, output in (("run1", "running", None), ("run2", "running", None), ("run1", "done", '{"memories": []}'), ("run2", "failed", None)):
        t.upsert(spark.createDataFrame([(run, status, output)], "run_id string, status string, output_json string"))
    return t.rows().select("run_id", "status", "output_json")


@query("store_graph", f"WITH {fx.E_SQL} SELECT CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, edge_type, round(weight, 6) AS weight FROM E WHERE NOT (source = 3 OR target = 3)")
def store_graph(spark, sf):
    """Edges saved, some deleted, and loaded again from the folder."""
    bank = empty_bank(spark)
    rows = fx.edges(spark, sf).withColumns({"source": F.col("source").cast("string"), "target": F.col("target").cast("string")})
    bank.tables.edges.append(rows)
    bank.tables.edges.append(rows.where("source = '3' or target = '3'"), deleted=True)
    folder = bank.tables.edges.path.rpartition("/")[0]
    return Lorebank(spark, folder).edges().select("source", "target", "edge_type", F.round("weight", 6).alias("weight"))


@query("store_memory_bank", "SELECT 's' || (n_regionkey % 2) AS section, n_name AS content FROM nation")
def store_memory_bank(spark, sf):
    """A bank file in JSON, read into items of sections."""
    folder, own = f"{shared_folder(spark)}/bankfile-{uuid.uuid4().hex}", nations(spark, sf)
    body = {"memory_bank": [{"section": f"s{k}", "tags": ["t"], "items": [n.n_name for n in own if n.n_regionkey % 2 == k]} for k in (0, 1)]}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.text(folder)
    return store.read_bank(spark, folder).select("section", "content")


@query("store_text_chunks", "SELECT * FROM (VALUES ('a', 0, 'one two' || chr(10) || 'three', 'memory_bank,source:a'), ('a', 1, 'four five six', 'memory_bank,source:a'), ('b', 0, 'abcdefghijklmnop', 'memory_bank,source:b'), ('b', 1, 'qrst', 'memory_bank,source:b')) t(source, chunk_index, content, tags)")
def store_text_chunks(spark, sf):
    """Trimmed lines packed into chunks of 16 characters; a longer line is split."""
    texts = spark.createDataFrame([("a", "one two \n\n three\nfour five six\n"), ("b", "abcdefghijklmnopqrst"), ("c", " \n"), ("d", None)], "source string, content string")
    return store.ingest_text(texts, 16).select("source", "chunk_index", "content", F.array_join("tags", ",").alias("tags"))


@query("store_turn_lines", """SELECT id, CAST(pos AS INTEGER) AS pos, line AS content, 'turn,turn:' || role AS tags FROM (SELECT conv_id AS id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS pos, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || replace(text, chr(10), ' ') AS line, role
FROM conversations WHERE turn < 2 AND role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1) WHERE strlen(line) > 15""")
def store_turn_lines(spark, sf):
    """Lines that begin with a speaker, as episodic rows."""
    c = fx.table(spark, sf, "conversations").where("turn < 2 and role in ('user', 'assistant')")
    one = c.groupBy("conv_id", "role").agg(F.min(F.struct("turn", "text")).alias("x"))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.replace("x.text", F.lit("\n"), F.lit(" ")))
    text = one.select("conv_id", F.when(F.col("role") == "user", line).alias("u"), F.when(F.col("role") != "user", line).alias("a")).groupBy("conv_id").agg(F.max("u").alias("u"), F.max("a").alias("a"))
    return store.split_turns(text.select(F.col("conv_id").alias("id"), F.concat(F.coalesce("u", F.lit("-")), F.lit("\n"), F.coalesce("a", F.lit("-"))).alias("content"))).select("id", "pos", "content", F.array_join("tags", ",").alias("tags"))
