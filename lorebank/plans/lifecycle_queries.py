"""Queries on decay, consolidation, inference, policies and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebank.functions import text as tx
from lorebank.operators import filters, lifecycle, pairs, policies
from lorebank.plans import mql
from lorebank.plans.graph_queries import COMPONENTS, PAIRS, vectors
from lorebank.plans.recall_queries import DECAYED, W_E, W_M, W_MV, engine
from lorebank.plans.registry import query
from lorebank.sources import fixtures as fx

NOW, DAY = fx.NOW_US, fx.DAY_US


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


@query("decay_salience", f"{W_M} SELECT id, round({DECAYED}, 6) AS decayed FROM M")
def decay_salience(spark, sf):
    return lifecycle.decayed(fx.memories(spark, sf), NOW).select("id", r6("decayed"))


@query("decay_changed_only", f"{W_M} SELECT id, round(salience, 6) AS before, round({DECAYED}, 6) AS after FROM M WHERE abs({DECAYED} - salience) > 0.001")
def decay_changed_only(spark, sf):
    return lifecycle.decay_policy(fx.memories(spark, sf), NOW).select("id", r6("before"), r6("after"))


@query("needs_archival", f"{W_M} SELECT id FROM M WHERE {DECAYED} < 0.1")
def needs_archival(spark, sf):
    return lifecycle.decayed(fx.memories(spark, sf), NOW).where("decayed < 0.1").select("id")


DECISION = f"CASE WHEN salience < 0.05 AND {NOW} - created_at_us > {30 * DAY} AND access_count < 2 THEN 'Delete' WHEN salience < 0.1 AND {NOW} - created_at_us > {7 * DAY} THEN 'Archive' ELSE 'Keep' END"


@query("archival_decision", f"{W_M} SELECT id, {DECISION} AS decision FROM M")
def archival_decision(spark, sf):
    return fx.memories(spark, sf).select("id", lifecycle.archival_decision(NOW).alias("decision"))


@query("archival_counts", f"{W_M} SELECT {DECISION} AS decision, count(*) AS n FROM M GROUP BY 1")
def archival_counts(spark, sf):
    return fx.memories(spark, sf).groupBy(lifecycle.archival_decision(NOW).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("archive_policy", f"{W_M} SELECT id, array_to_string(list_append(tags, 'archived'), ',') AS tags, round(least(salience, 0.02::DOUBLE), 6) AS salience FROM M WHERE {DECISION} <> 'Keep'")
def archive_policy(spark, sf):
    return lifecycle.archive_policy(fx.memories(spark, sf), NOW).select("id", F.array_join("tags", ",").alias("tags"), r6("salience"))


@query("should_consolidate", f"{W_M} SELECT id FROM M WHERE memory_type = 'Episodic' AND {NOW} - created_at_us > {DAY} AND access_count > 2")
def should_consolidate(spark, sf):
    return fx.memories(spark, sf).where(lifecycle.should_consolidate(NOW)).select("id")


@query("enrichment_candidates", f"{W_M} SELECT id, created_at_us FROM M WHERE memory_type = 'Episodic' AND created_at_us > {NOW - 10 * DAY}")
def enrichment_candidates(spark, sf):
    return lifecycle.enrichment_candidates(fx.memories(spark, sf), NOW - 10 * DAY).select("id", "created_at_us")


@query("maintenance_due", "SELECT CAST(t AS BIGINT) AS turn, concat_ws(',', CASE WHEN t % 50 = 0 THEN 'decay' END, CASE WHEN t % 100 = 0 THEN 'archive' END, CASE WHEN t % 200 = 0 THEN 'consolidate' END) AS due FROM range(1, 401) r(t) WHERE t % 50 = 0")
def maintenance_due(spark, sf):
    return spark.range(1, 401).select(F.col("id").alias("turn"), F.array_join(lifecycle.maintenance_due("id"), ",").alias("due")).where("due <> ''")


@query("consolidate_clusters", f"""{COMPONENTS}, D AS (SELECT doc_id AS id, text FROM documents),
S0 AS (SELECT root, C.id, string_split(text, '.') AS parts FROM C JOIN D USING (id)),
S1 AS (SELECT root, id, unnest(range(1, len(parts) + 1)) AS pos, unnest(list_transform(parts, lambda s: trim(s))) AS sentence FROM S0),
S2 AS (SELECT root, id, pos, lower(sentence) AS s FROM S1 WHERE sentence <> '' QUALIFY row_number() OVER (PARTITION BY root, lower(sentence) ORDER BY id, pos) = 1)
SELECT root, sha256(string_agg(s, '. ' ORDER BY id, pos)) AS content FROM S2 GROUP BY root""")
def consolidate_clusters(spark, sf):
    rows = fx.vector_memories(spark, sf)
    roots = pairs.components(pairs.similar_pairs(vectors(spark, sf), 0.4))
    return lifecycle.consolidated(rows, roots).select("root", F.sha2("content", 256).alias("content"))


DUE = f"""DU AS (SELECT id, content, confidence, embedding FROM MV WHERE confidence > 0.3::DOUBLE AND memory_type = 'Episodic' AND {NOW} - created_at_us > {DAY} AND access_count > 2),
DP AS (SELECT a.id AS a, b.id AS b FROM DU a JOIN DU b ON a.id < b.id AND list_cosine_similarity(a.embedding, b.embedding) > 0.3), DX AS MATERIALIZED (SELECT a AS x, b AS y FROM DP UNION ALL SELECT b, a FROM DP),
DW(id, root) AS (SELECT x, x FROM DX UNION SELECT y, root FROM DW JOIN DX ON x = id), DC AS (SELECT id, min(root) AS root FROM DW GROUP BY id),
D0 AS (SELECT root, DC.id, string_split(content, '.') AS parts FROM DC JOIN DU USING (id)),
D1 AS (SELECT root, id, unnest(range(1, len(parts) + 1)) AS pos, unnest(list_transform(parts, lambda s: trim(s))) AS sentence FROM D0),
D2 AS (SELECT root, id, pos, lower(sentence) AS s FROM D1 WHERE sentence <> '' QUALIFY row_number() OVER (PARTITION BY root, lower(sentence) ORDER BY id, pos) = 1)"""


@query("consolidate_statement", f"WITH RECURSIVE {fx.MV_SQL}, {DUE} SELECT root, string_agg(s, '. ' ORDER BY D2.id, pos) AS content, any_value(members) AS members FROM D2 JOIN (SELECT root, count(*) AS members FROM DC GROUP BY root) USING (root) GROUP BY root")
def consolidate_statement(spark, sf):
    return mql.run("CONSOLIDATE WHERE confidence > 0.3", engine(spark, sf, cluster_above=0.3)).select("root", "content", "members")


def compressed_sql() -> str:
    """Per paragraph the first sentence and those with a keyword, each without the first use of every filler."""
    quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    strip = f"list_reduce([{quoted(tx.FILLERS)}], lambda s, f: CASE WHEN instr(lower(s), f) > 0 AND length(lower(s)) = length(s) THEN replace_first(s, substr(s, instr(lower(s), f), length(f))) ELSE s END, s)"
    strip = strip.replace("replace_first(s, substr(s, instr(lower(s), f), length(f)))", "substr(s, 1, instr(s, substr(s, instr(lower(s), f), length(f))) - 1) || substr(s, instr(s, substr(s, instr(lower(s), f), length(f))) + length(f))")
    return f"""{W_MV}, P0 AS (SELECT id, content, unnest(range(0, len(ps))) AS p, unnest(ps) AS text FROM (SELECT id, content, string_split(content, chr(10) || chr(10)) AS ps FROM MV)),
P1 AS (SELECT id, p, list_filter(list_transform(string_split(text, '.'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '') AS ss FROM P0),
P2 AS (SELECT id, p, unnest(range(0, len(ss))) AS k, unnest(ss) AS s FROM P1),
P3 AS (SELECT id, p, k, trim(regexp_replace({strip}, '\\s+', ' ', 'g')) AS s FROM P2 WHERE k = 0 OR len(list_filter([{quoted(tx.KEY_WORDS)}], lambda w: contains(lower(s), w))) > 0),
P4 AS (SELECT id, s, p, k FROM P3 WHERE s <> '' QUALIFY row_number() OVER (PARTITION BY id, s ORDER BY p, k) = 1),
P5 AS (SELECT id, string_agg(s, '. ' ORDER BY p, k) AS c FROM P4 GROUP BY id)
SELECT id, sha256(coalesce(c, '')) AS compressed, round(strlen(coalesce(c, ''))::DOUBLE / greatest(strlen(content), 1), 6) AS ratio FROM MV LEFT JOIN P5 USING (id)"""


@query("compression", compressed_sql())
def compression(spark, sf):
    return lifecycle.compressed(fx.vector_memories(spark, sf)).select("id", F.sha2("compressed", 256).alias("compressed"), r6("ratio"))


FACTS = """F0 AS (SELECT id, list_filter(list_transform(string_split(content, '.'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM MV),
F1 AS (SELECT id, unnest(range(0, len(ss))) AS sentence_no, unnest(ss) AS s FROM F0),
F2 AS (SELECT id, sentence_no, s, p[1] AS phrase, p[2] AS predicate, instr(lower(s), p[1]) AS found FROM F1, (SELECT unnest([[' is ', 'is'], [' of ', 'of'], [' the ', 'the']]) AS p)),
FA AS (SELECT id, CAST(sentence_no AS INTEGER) AS sentence_no, trim(substr(s, 1, found - 1)) AS subject, predicate, trim(substr(s, found + len(phrase))) AS object FROM F2 WHERE found > 0 AND trim(substr(s, 1, found - 1)) <> '' AND trim(substr(s, found + len(phrase))) <> '')"""
#: The driver's text has few of the usual verbs, so short words that it has stand in for some.
PATTERNS = ((" is ", "is"), (" of ", "of"), (" the ", "the"))


def facts_of(spark, sf):
    return lifecycle.extract_facts(fx.vector_memories(spark, sf), PATTERNS)


@query("facts_extract", f"{W_MV}, {FACTS} SELECT id, sentence_no, subject, predicate, object FROM FA")
def facts_extract(spark, sf):
    return facts_of(spark, sf).drop("confidence")


@query("facts_sentences", "SELECT * FROM (VALUES (0, 'Alice', 'uses', 'PostgreSQL'), (1, 'PostgreSQL', 'is', 'great')) t(sentence_no, subject, predicate, object)")
def facts_sentences(spark, sf):
    return spark.sql("SELECT 'Alice uses PostgreSQL. PostgreSQL is great' AS content").select(F.inline(tx.facts("content")))


@query("facts_dedupe", f"{W_MV}, {FACTS} SELECT id, sentence_no, subject, predicate, object FROM FA QUALIFY row_number() OVER (PARTITION BY lower(subject), predicate, lower(object) ORDER BY id, sentence_no, subject, object) = 1")
def facts_dedupe(spark, sf):
    return lifecycle.dedupe_facts(facts_of(spark, sf)).drop("confidence")


@query("facts_contradict", f"{W_MV}, {FACTS}, K AS (SELECT DISTINCT lower(subject) AS subject, predicate, lower(object) AS object FROM FA) SELECT subject, predicate, a.object, b.object AS other FROM K a JOIN K b USING (subject, predicate) WHERE a.object < b.object")
def facts_contradict(spark, sf):
    return lifecycle.contradicting_facts(facts_of(spark, sf))


@query("interference_pairs", f"WITH {PAIRS.format(0.35)} SELECT a, b, round(similarity, 6) AS similarity FROM P JOIN documents x ON a = x.doc_id JOIN documents y ON b = y.doc_id WHERE x.text <> y.text")
def interference_pairs(spark, sf):
    return lifecycle.interference(pairs.similar_pairs(vectors(spark, sf), 0.35), fx.vector_memories(spark, sf)).select("a", "b", r6("similarity"))


@query("write_inference_actions", f"""{W_MV}, X AS (SELECT n.id AS nid, o.id AS oid, list_cosine_similarity(n.embedding, o.embedding) AS s, n.agent_id AS na, o.agent_id AS oa, n.content AS nc, o.content AS oc, n.created_at_us AS nt, o.created_at_us AS ot, n.memory_type AS nm, o.confidence AS ocf
  FROM MV n JOIN MV o ON n.id <> o.id WHERE n.id % 20 = 0 AND list_cosine_similarity(n.embedding, o.embedding) > 0.25),
B AS (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY s DESC, oid) AS r FROM X)
SELECT 'contradicts' AS action, nid AS source, oid AS target, 1.0::DOUBLE AS weight FROM B WHERE s > 0.35 AND na = oa AND nc <> oc
UNION ALL SELECT unnest(['mark_obsolete', 'invalidate']), nid, oid, 1.0 FROM B WHERE s > 0.33 AND nt > ot
UNION ALL SELECT 'related', nid, oid, round(s, 6) FROM B WHERE s > 0.3 AND s <= 0.33
UNION ALL SELECT 'supersedes', nid, oid, 1.0 FROM B WHERE nm = 'Correction' AND s > 0.28 AND r = 1
UNION ALL SELECT 'lower_confidence', nid, oid, round(greatest(ocf * 0.5::DOUBLE, 0.1::DOUBLE), 6) FROM B WHERE nm = 'Correction' AND s > 0.28 AND r = 1""")
def write_inference_actions(spark, sf):
    rows = fx.vector_memories(spark, sf, F.sha2("text", 256))  # contents are only compared
    return lifecycle.write_inference_between(rows.where("id % 20 = 0"), rows, 0.25, 0.35, 0.33, 0.3, 0.28).select("action", "source", "target", r6("weight"))


@query("extraction_dedupe", f"{W_MV} SELECT DISTINCT n.id FROM MV n JOIN MV o ON n.id <> o.id WHERE n.id % 20 = 0 AND list_cosine_similarity(n.embedding, o.embedding) > 0.35")
def extraction_dedupe(spark, sf):
    rows = fx.vector_memories(spark, sf)
    return lifecycle.new_against_existing(rows.where("id % 20 = 0"), rows, 0.35).select(F.col("new_id").alias("id")).distinct()


def cue_sql(column: str, cues) -> str:
    return "(" + " OR ".join(f"contains({column}, '{c.replace(chr(39), chr(39) * 2)}')" for c in cues) + ")"


SAMPLES = ("I now use Rust instead of Go", "Great work, thanks! It works.", "This is a terrible bug. An error again.", "Actually, I meant the other one", "We might be late, probably", "Please deploy the release. Then review and merge it.", "user: hi\nassistant: hello", "nothing here", "")
VALUES = "X AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SAMPLES)) + ") t(id, content))"
WITH_X = f"WITH {VALUES}"


def samples(spark):
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(s).alias("content")) for i, s in enumerate(SAMPLES)])
    return spark.range(1).select(F.inline(rows))


@query("temporal_cues", f"{WITH_X} SELECT id, {cue_sql('lower(content)', tx.REPLACEMENT_CUES)} AS cue FROM X")
def temporal_cues(spark, sf):
    return samples(spark).select("id", tx.has_replacement_cue("content").alias("cue"))


def sentiment_sql(text: str, source: str) -> str:
    any_of = lambda words: " OR ".join(f"contains(w, '{x}')" for x in words)
    return f"""SELECT id, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (len(list_filter(ws, lambda w: {any_of(tx.POSITIVE)})) - len(list_filter(ws, lambda w: {any_of(tx.NEGATIVE)})))::DOUBLE / greatest(len(ws), 1)::DOUBLE)), 6) AS sentiment
FROM (SELECT id, list_filter(string_split_regex(lower({text}), '[ \\t\\r\\n\\f\\x0b]+'), lambda w: w <> '') AS ws FROM {source})"""


@query("sentiment", f"{WITH_X} {sentiment_sql('content', 'X')}")
def sentiment(spark, sf):
    return samples(spark).select("id", r6(tx.sentiment("content"), "sentiment"))


@query("sentiment_documents", f"WITH D AS (SELECT doc_id AS id, text AS content FROM documents) {sentiment_sql('content', 'D')}")
def sentiment_documents(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), r6(tx.sentiment("text"), "sentiment"))


@query("detect_actions", f"""{WITH_X}, K AS (SELECT unnest([{', '.join(f"['{a}', '{b}']" for a, b in tx.ACTIONS)}]) AS k)
SELECT id, k[1] AS keyword, k[2] AS action_type, substr(trim(list_filter(string_split(lower(content), '.'), lambda s: contains(s, k[1]))[1]), 1, 200) AS detail FROM X, K WHERE contains(lower(content), k[1])""")
def detect_actions(spark, sf):
    return samples(spark).select("id", F.inline(tx.actions("content")))


@query("correction_flag", f"{WITH_X} SELECT id, {cue_sql('lower(content)', tx.CORRECTIONS)} AS correction, {cue_sql('content', tx.SPECULATIONS)} AS speculation FROM X")
def correction_flag(spark, sf):
    return samples(spark).select("id", tx.is_correction("content").alias("correction"), tx.is_speculation("content").alias("speculation"))


@query("conversation_flag", f"{WITH_X} SELECT id, id = 6 AS conversation FROM X")
def conversation_flag(spark, sf):
    return samples(spark).select("id", tx.is_conversation("content").alias("conversation"))


@query("token_estimate", r"SELECT doc_id, CAST(ceil(len(list_filter(string_split_regex(text, '[ \t\r\n\f\x0b]+'), lambda w: w <> '')) * 1.3::DOUBLE) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.token_estimate("text").alias("tokens"))


# Policies and audit over derived tables: links = customers in nations, versions = line items.


@query("forget_closure", f"{W_M} SELECT id FROM M WHERE id = 17 UNION SELECT id FROM M WHERE agent_id = 5 UNION SELECT id FROM M WHERE list_contains(tags, 'signup')")
def forget_closure(spark, sf):
    m = fx.memories(spark, sf)
    return policies.forget_scope("memory", 17, m).union(policies.forget_scope("agent", 5, m)).union(policies.forget_scope("tag", "signup", m)).distinct()


@query("forget_entity_scope", "SELECT DISTINCT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def forget_entity_scope(spark, sf):
    from lorebank.plans.entity_queries import aliases, links

    return policies.forget_scope("alias", "NATION_3", fx.memories(spark, sf), links(spark, sf), aliases(spark, sf))


def labelled_ids(spark, sf):
    """What a scope names here: the vectors of one label."""
    return fx.table(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))


@query("forget_edge_count", f"{W_E}, S AS (SELECT vec_id FROM embeddings WHERE label = 3) SELECT (SELECT count(*) FROM S) AS memories, count(*) AS edges FROM E WHERE source IN (SELECT vec_id FROM S) OR target IN (SELECT vec_id FROM S)")
def forget_edge_count(spark, sf):
    return policies.forget_plan(labelled_ids(spark, sf), fx.edges(spark, sf))


@query("forget_soft", f"{W_M} SELECT id, CASE WHEN agent_id = 5 THEN {NOW} ELSE valid_until_us END AS valid_until_us FROM M")
def forget_soft(spark, sf):
    m = fx.memories(spark, sf)
    return policies.forget_soft(m, policies.forget_scope("agent", 5, m), NOW).select("id", "valid_until_us")


@query("forget_hard_edges", f"{W_E}, S AS (SELECT vec_id FROM embeddings WHERE label = 3) SELECT source, target FROM E WHERE source NOT IN (SELECT vec_id FROM S) AND target NOT IN (SELECT vec_id FROM S)")
def forget_hard_edges(spark, sf):
    return policies.forget_hard(fx.memories(spark, sf), fx.edges(spark, sf), labelled_ids(spark, sf))[1].select("source", "target")


@query("forget_statement", f"{W_M} SELECT id FROM M WHERE id <> 123")
def forget_statement(spark, sf):
    return mql.run("FORGET 123", engine(spark, sf, False)).select("id")


@query("forget_preview", f"{W_M} SELECT id AS memory_id, 'would_forget' AS action, 'planned' AS status FROM M WHERE agent_id = 5")
def forget_preview(spark, sf):
    m = fx.memories(spark, sf)
    return policies.policy_actions(policies.forget_scope("agent", 5, m), "run", "forget", False, NOW).select("memory_id", "action", "status")


@query("correction_plan", """WITH L AS (SELECT c_custkey AS memory_id, c_nationkey AS entity_id FROM customer),
K AS (SELECT c_custkey AS correction FROM customer WHERE c_custkey % 20 = 0)
SELECT correction, b.memory_id AS memory, count(DISTINCT a.entity_id) AS entities FROM K JOIN L a ON correction = a.memory_id JOIN L b ON a.entity_id = b.entity_id WHERE b.memory_id < correction GROUP BY 1, 2""")
def correction_plan(spark, sf):
    from lorebank.plans.entity_queries import links

    rows = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("created_at_us"))
    return policies.correction_plan(rows.where("id % 20 = 0"), links(spark, sf), rows)


@query("enrichment_edges", f"{W_E} SELECT source, target, 'Supports' AS edge_type, CASE WHEN source % 3 = 0 THEN 0.85::DOUBLE ELSE round(least(1.0::DOUBLE, weight * 1.5::DOUBLE), 6) END AS weight FROM E")
def enrichment_edges(spark, sf):
    e = fx.edges(spark, sf).withColumn("weight", F.when(F.col("source") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("weight") * 1.5))
    return policies.enrichment_edges(e, NOW).select("source", "target", "edge_type", r6("weight"))


@query("invalidate_memory", f"{W_M} SELECT id, CASE WHEN id = 42 THEN {NOW} ELSE valid_until_us END AS valid_until_us FROM M")
def invalidate_memory(spark, sf):
    m = fx.memories(spark, sf)
    return policies.forget_soft(m, policies.forget_scope("memory", 42, m), NOW).select("id", "valid_until_us")


@query("invalidated_list", f"{W_M} SELECT id, content, valid_from_us, valid_until_us FROM M WHERE valid_until_us IS NOT NULL")
def invalidated_list(spark, sf):
    return fx.memories(spark, sf).where("valid_until_us is not null").select("id", "content", "valid_from_us", "valid_until_us").orderBy(F.desc("valid_until_us"))


VERSIONS = "V AS (SELECT l_partkey AS memory_id, l_suppkey AS agent, epoch_us(l_shipdate) AS ts_us, l_orderkey * 10 + l_linenumber AS uid, l_quantity AS payload, 1.0::DOUBLE - l_discount AS confidence FROM lineitem)"


def versions(spark, sf):
    line = fx.table(spark, sf, "lineitem")
    return line.select(F.col("l_partkey").alias("memory_id"), F.col("l_suppkey").alias("agent"), F.expr(fx.EPOCH_US.format("l_shipdate")).alias("ts_us"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid"), F.col("l_quantity").alias("payload"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"))


@query("conflict_window", f"WITH {VERSIONS} SELECT DISTINCT a.memory_id, least(a.uid, b.uid) AS first, greatest(a.uid, b.uid) AS second FROM V a JOIN V b ON a.memory_id = b.memory_id AND a.agent <> b.agent AND abs(a.ts_us - b.ts_us) <= 1000000 AND (a.ts_us, a.uid) < (b.ts_us, b.uid)")
def conflict_window(spark, sf):
    return policies.conflicts(versions(spark, sf))


@query("version_as_of", f"WITH {VERSIONS} SELECT memory_id, ts_us, uid, payload FROM V WHERE ts_us <= epoch_us(TIMESTAMP '1999-06-30') QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ts_us DESC, uid DESC, agent DESC, payload DESC) = 1")
def version_as_of(spark, sf):
    at = F.expr(fx.EPOCH_US.format("TIMESTAMP_NTZ '1999-06-30 00:00:00'"))
    return policies.versions_as_of(versions(spark, sf), at, ts="ts_us", tie=("uid",)).select("memory_id", "ts_us", "uid", "payload")


@query("latest_version", f"WITH {VERSIONS} SELECT memory_id, max(uid) AS uid FROM (SELECT memory_id, uid, ts_us, max(ts_us) OVER (PARTITION BY memory_id) AS m FROM V) WHERE ts_us = m GROUP BY memory_id")
def latest_version(spark, sf):
    return policies.resolve_latest(versions(spark, sf))


@query("surest_version", f"WITH {VERSIONS} SELECT memory_id, uid FROM V QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY confidence DESC, ts_us DESC, uid DESC) = 1")
def surest_version(spark, sf):
    return policies.resolve_surest(versions(spark, sf))


@query("version_numbers", f"WITH {VERSIONS} SELECT memory_id, uid, ts_us, CAST(row_number() OVER (PARTITION BY memory_id ORDER BY ts_us, uid, agent, payload) AS INTEGER) AS version FROM V")
def version_numbers(spark, sf):
    return policies.numbered(versions(spark, sf), "memory_id", "ts_us", "uid", "agent", "payload").select("memory_id", "uid", "ts_us", "version")


@query("resource_usage", f"{W_M} SELECT count(*) AS memories, CAST(sum(strlen(content)) AS BIGINT) AS bytes, round(greatest(count(*) * 100.0::DOUBLE / 50000, sum(strlen(content)) * 100.0::DOUBLE / 1000000), 6) AS utilisation FROM M")
def resource_usage(spark, sf):
    return policies.usage(fx.memories(spark, sf), 50_000, 1_000_000).select("memories", "bytes", r6("utilisation"))


@query("agent_over_limit", f"{W_M} SELECT agent_id, count(*) AS memories FROM M GROUP BY agent_id HAVING count(*) > 5")
def agent_over_limit(spark, sf):
    return policies.over_limit(fx.memories(spark, sf), 5)


@query("upsert_latest", f"{W_M}, U AS (SELECT id, content, created_at_us, 0 AS v FROM M UNION ALL SELECT id, 'new', {NOW}, 1 FROM M WHERE memory_type = 'Correction') SELECT id, arg_max(content, v) AS content, arg_min(created_at_us, v) AS created_at_us FROM U GROUP BY id")
def upsert_latest(spark, sf):
    from lorebank.sources.store import latest_view

    rows = fx.memories(spark, sf)
    m = rows.select("id", "content", "created_at_us", F.lit(0).alias("version"))
    new = rows.where("memory_type = 'Correction'").select("id", F.lit("new").alias("content"), F.lit(NOW).alias("created_at_us"), F.lit(1).alias("version"))
    return latest_view(m.unionByName(new)).select("id", "content", "created_at_us")


def operations(spark, sf):
    e = fx.edges(spark, sf).select(F.lit("relate").alias("operation_type"), F.lit(None).cast("long").alias("memory_id"), "source", "target", "created_at_us")
    m = fx.memories(spark, sf).select(F.lit("store").alias("operation_type"), F.col("id").alias("memory_id"), F.lit(None).cast("long").alias("source"), F.lit(None).cast("long").alias("target"), "created_at_us")
    return e.unionByName(m)


OPS = "O AS (SELECT 'relate' AS operation_type, CAST(NULL AS BIGINT) AS memory_id, source, target, created_at_us FROM E UNION ALL SELECT 'store', id, NULL, NULL, created_at_us FROM M)"


@query("memory_history", f"{W_M}, {fx.E_SQL}, {OPS} SELECT operation_type, memory_id, source, target, created_at_us FROM O WHERE memory_id = 31 OR source = 31 OR target = 31")
def memory_history(spark, sf):
    return policies.audit_of(operations(spark, sf), 31)


@query("trace_latest", f"{W_M} SELECT id, content, created_at_us FROM M ORDER BY created_at_us DESC, id LIMIT 20")
def trace_latest(spark, sf):
    return policies.recent(fx.memories(spark, sf), 20, "created_at_us", "id").select("id", "content", "created_at_us")


@query("missing_vectors", "SELECT doc_id AS id FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE vec_id IS NULL")
def missing_vectors(spark, sf):
    d, v = fx.table(spark, sf, "documents"), fx.table(spark, sf, "embeddings")
    return d.join(v, d.doc_id == v.vec_id, "left_anti").select(F.col("doc_id").alias("id"))


@query("space_access", "SELECT CAST(space_id AS BIGINT) AS space_id FROM (SELECT n_nationkey AS space_id FROM nation WHERE n_regionkey = 2 UNION SELECT s_nationkey FROM supplier WHERE s_suppkey % 7 = 2 AND s_suppkey % 4 IN (1, 2, 3))")
def space_access(spark, sf):
    spaces = fx.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("space_id"), F.col("n_regionkey").cast("long").alias("owner_id"))
    kinds = F.array(*[F.lit(p) for p in ("Read", "Write", "ReadWrite", "Admin")])
    acl = fx.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("space_id"), (F.col("s_suppkey") % 7).alias("agent_id"), F.element_at(kinds, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("permission"))
    return filters.accessible_spaces(spaces, acl, 2, "Write")
