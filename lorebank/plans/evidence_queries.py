"""Queries on evidence, extraction, provenance, turns and documented SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebank.functions import embeddings as em
from lorebank.functions import text as tx
from lorebank.operators import evidence as ev
from lorebank.operators import extraction as ex
from lorebank.operators import policies, signals
from lorebank.plans.entity_queries import ALL, aliases, claims, ents, evidence, links, relationships
from lorebank.plans.lifecycle_queries import cue_sql
from lorebank.plans.recall_queries import W_E, W_M, W_MV
from lorebank.plans.registry import query
from lorebank.sources import fixtures as fx
from lorebank.streaming import turns as st

NOW, DAY = fx.NOW_US, fx.DAY_US

# Memories as evidence: every 7th row is an entity node, every 11th an assistant's turn.
TAGGED = """X AS (SELECT id, content, created_at_us, list_concat(['session:s' || (id % 5)], list_concat(CASE WHEN id % 7 = 0 THEN ['entity_name:e'] ELSE [] END,
  list_concat(CASE WHEN id % 11 = 0 THEN ['turn:assistant'] ELSE [] END, CASE WHEN id % 3 = 0 THEN ['date:2024-01-0' || (id % 9 + 1)] ELSE [] END))) AS tags FROM M)"""


def tagged(spark, sf):
    i = F.col("id")
    none = F.array().cast("array<string>")
    tags = F.concat(
        F.array(F.concat(F.lit("session:s"), (i % 5).cast("string"))),
        F.when(i % 7 == 0, F.array(F.lit("entity_name:e"))).otherwise(none),
        F.when(i % 11 == 0, F.array(F.lit("turn:assistant"))).otherwise(none),
        F.when(i % 3 == 0, F.array(F.concat(F.lit("date:2024-01-0"), (i % 9 + 1).cast("string")))).otherwise(none),
    )
    return fx.memories(spark, sf).select("id", "content", "created_at_us", tags.alias("tags"))


@query("evidence_rows", f"""{W_M}, {TAGGED} SELECT id, 's' || (id % 5) AS session, CASE WHEN id % 3 = 0 THEN '2024-01-0' || (id % 9 + 1) ELSE strftime(make_timestamp(created_at_us), '%Y-%m-%d') END AS date
FROM X WHERE id % 7 <> 0 AND id % 11 <> 0 AND (created_at_us <= {NOW - 10 * DAY} OR id % 3 = 0)""")
def evidence_rows(spark, sf):
    return ev.evidence_rows(tagged(spark, sf), NOW - 10 * DAY).select("id", "session", "date")


@query("result_filter", f"{W_M}, {TAGGED} SELECT id FROM X WHERE id % 7 <> 0")
def result_filter(spark, sf):
    return ev.drop_derived(tagged(spark, sf)).select("id")


@query("near_duplicate_evidence", f"{W_M} SELECT min(id) AS id FROM M GROUP BY content")
def near_duplicate_evidence(spark, sf):
    return ev.near_duplicate_evidence(fx.memories(spark, sf).withColumn("date", F.lit("d"))).select("id")


RELATIONS = "R AS (SELECT p_partkey AS id, p_name AS name, (['owns', 'wants to own', 'uses daily', 'unknown', 'someone_else owns', 'likes'])[CAST(p_partkey % 6 + 1 AS INTEGER)] AS relation FROM part)"


def relations(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("owns", "wants to own", "uses daily", "unknown", "someone_else owns", "likes")])
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("relation"))


@query("graph_based_count", f"WITH {RELATIONS} SELECT count(DISTINCT lower(name)) AS n FROM R WHERE relation IN ('owns', 'uses daily', 'unknown')")
def graph_based_count(spark, sf):
    return ev.owned_entities(relations(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query("linked_entities", f"""WITH {fx.E_SQL}, {RELATIONS}, H AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 20 = 0), D AS (SELECT * FROM R WHERE id IN (SELECT id FROM H))
SELECT id FROM D UNION ALL SELECT id FROM R WHERE id IN (SELECT target FROM E WHERE edge_type = 'PartOf' AND source IN (SELECT id FROM H)) AND lower(name) NOT IN (SELECT lower(name) FROM D)""")
def linked_entities(spark, sf):
    return ev.linked_entities(fx.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id")), fx.edges(spark, sf), relations(spark, sf)).select("id")


@query("abstain_rule", f"SELECT CAST(0 AS BIGINT) AS items, '{ev.NO_EVIDENCE}' AS answer")
def abstain_rule(spark, sf):
    return ev.answer_or_abstain(fx.memories(spark, sf).where("content = 'no such text'"))


@query("metrics_snapshot", """SELECT count(*) FILTER (event_type = 'click') AS writes_total, count(*) FILTER (event_type = 'view') AS reads_total, count(*) FILTER (event_type = 'error') AS deletes_total,
round(avg(CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 6) AS cache_hit_rate, round(avg(value) FILTER (event_type = 'click'), 6) AS avg_write_latency_us, round(avg(value) FILTER (event_type = 'view'), 6) AS avg_read_latency_us FROM events""")
def metrics_snapshot(spark, sf):
    kind = F.create_map(*[F.lit(x) for p in (("click", "write"), ("view", "read"), ("error", "delete"), ("signup", "cache")) for x in p])
    log = fx.table(spark, sf, "events").select(F.element_at(kind, F.col("event_type")).alias("kind"), (F.col("event_id") % 3 == 0).alias("hit"), F.col("value").alias("latency_us"))
    out = ev.metrics(log)
    return out.select("writes_total", "reads_total", "deletes_total", *[F.round(c, 6).alias(c) for c in ("cache_hit_rate", "avg_write_latency_us", "avg_read_latency_us")])


@query("active_gaps", "SELECT p_name || p_partkey AS term, 'High' AS priority, 'No stored knowledge about ''' || p_name || p_partkey || '''' AS warning FROM part WHERE p_size > 40 AND p_retailprice < 1000 ORDER BY 1 LIMIT 5")
def active_gaps(spark, sf):
    p = fx.table(spark, sf, "part")
    gaps = p.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("term"), F.when(F.col("p_size") > 40, "High").otherwise("Low").alias("priority"), (F.col("p_retailprice") >= 1000).alias("resolved"))
    return ev.unresolved(gaps)


@query("follow_up_words", r"""SELECT doc_id, array_to_string((list_sort(list_distinct(list_filter(list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: strlen(w) > 3 AND regexp_matches(w, '^\p{Lu}') AND w NOT IN (""" + ", ".join(f"'{w}'" for w in signals.NOT_NAMES) + r"""))))) [1:10], ' ') AS names FROM documents""")
def follow_up_words(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(signals.follow_up_words("text"), " ").alias("names"))


@query("embedding_keys", "SELECT p_partkey AS id, p_name || ' [entities: ' || p_brand || ', ' || p_type || ']' || CASE WHEN p_size % 2 = 0 THEN ' [topics: ' || p_type || ']' ELSE '' END AS key FROM part")
def embedding_keys(spark, sf):
    p = fx.table(spark, sf, "part")
    tags = F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    return p.select(F.col("p_partkey").alias("id"), em.memory_key(F.col("p_name"), F.array("p_brand", "p_type"), tags).alias("key"))


@query("entity_embedding_keys", "SELECT p_partkey AS id, p_name || ' (' || p_type || ') [categories: tool] brand: ' || p_brand || ' size: ' || p_size AS key FROM part")
def entity_embedding_keys(spark, sf):
    p = fx.table(spark, sf, "part").withColumn("a", F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("category"), F.lit("tool"), F.lit("brand"), F.col("p_brand")))
    return p.select(F.col("p_partkey").alias("id"), em.entity_key("p_name", "p_type", "a").alias("key"))


@query("hash_embeddings", """WITH B AS (SELECT p_partkey AS id, p_name, unnest(range(0, strlen(p_name))) AS i, unnest(list_transform(range(0, strlen(p_name)), lambda k: CAST('0x' || substr(hex(encode(p_name)), 2 * k + 1, 2) AS INTEGER))) AS b FROM part),
S AS (SELECT id, i % 16 AS d, sum((b - 96)::DOUBLE / 32.0::DOUBLE) AS v FROM B GROUP BY id, i % 16)
SELECT id, 16 AS dims, round(coalesce(max(v) FILTER (d = 0), 0) / sqrt(sum(v * v)), 2) AS first FROM S GROUP BY id""")
def hash_embeddings(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return p.select("id", F.size(em.hash_embedding("p_name", 16)).alias("dims"), F.round(F.get(em.hash_embedding("p_name", 16, "bytes"), F.lit(0)).cast("double"), 2).alias("first"))


FNV = "list_reduce(list_concat({0}, list_transform(range(0, strlen({1})), lambda k: CAST('0x' || substr(hex(encode({1})), 2 * k + 1, 2) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)"


@query("embedding_cache_keys", f"SELECT n_name, CAST({FNV.format('[109::HUGEINT, 255::HUGEINT]', 'n_name')} AS VARCHAR) AS key FROM nation")
def embedding_cache_keys(spark, sf):
    key = F.pandas_udf(lambda names: names.map(lambda n: str(em.cache_key("m", n))), "string")
    return fx.table(spark, sf, "nation").select("n_name", key("n_name").alias("key"))


@query("hash_embedding_values", f"""WITH D AS (SELECT n_name, d, {FNV.format('[d::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT]', 'n_name')}::DOUBLE / 18446744073709551615.0::DOUBLE * 2 - 1 AS v FROM nation, (SELECT unnest(range(0, 4)) AS d))
SELECT n_name, CAST(d AS INTEGER) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY n_name)), 3) AS value FROM D""")
def hash_embedding_values(spark, sf):
    rows = fx.table(spark, sf, "nation").select("n_name", F.posexplode(em.hash_embedding("n_name", 4)).alias("pos", "value"))
    return rows.select("n_name", "pos", F.round(F.col("value").cast("double"), 3).alias("value"))


@query("part_of_edges", f"{W_MV} SELECT DISTINCT id AS source, CAST(n_nationkey AS BIGINT) + 1000000 AS target FROM (SELECT id, unnest(list_distinct(list_transform(list_filter(string_split_regex(lower(content), '[ \\t\\r\\n\\f\\x0b]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')))) AS w FROM MV), (SELECT n_nationkey, (['the', 'of', 'eau', 'und', 'que'])[n_nationkey % 5 + 1] AS name FROM nation) WHERE w = name")
def part_of_edges(spark, sf):
    names = F.array(*[F.lit(x) for x in ("the", "of", "eau", "und", "que")])
    e = fx.table(spark, sf, "nation").select((F.col("n_nationkey").cast("long") + 1_000_000).alias("entity_id"), F.element_at(names, F.col("n_nationkey") % 5 + 1).alias("name"), F.lit("x").alias("relation"))
    return ex.part_of_edges(fx.vector_memories(spark, sf), e, NOW).select("source", "target")


# All pairs of a category, counted and named from both ends; the query gives them as classes.
@query("category_edges", """WITH C AS (SELECT p_partkey AS id, lower(p_type) AS c FROM part), P AS (SELECT a.c, a.id AS x, b.id AS y FROM C a JOIN C b ON a.c = b.c AND a.id <> b.id)
SELECT id AS entity_id, 'same_category:' || c AS label, least(id, coalesce(min(y), id)) AS representative, count(y) AS links FROM C LEFT JOIN P USING (c) WHERE x = id OR x IS NULL GROUP BY id, c""")
def category_edges(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("category"))
    return ex.category_classes(p)


@query("gist_candidates", f"{ALL} SELECT entity_id, count(DISTINCT memory_id) AS memories FROM LK JOIN EN USING (entity_id) WHERE n_regionkey <> 0 GROUP BY entity_id HAVING count(DISTINCT memory_id) >= 5")
def gist_candidates(spark, sf):
    return ex.gist_candidates(links(spark, sf), ents(spark, sf).where("n_regionkey = 0"))


@query("profile_facts", f"{W_MV} SELECT id, substr(content, 1, 300) AS content FROM MV WHERE memory_type IN ('Semantic', 'Procedural') AND confidence >= 0.5 ORDER BY confidence DESC, id LIMIT 100")
def profile_facts(spark, sf):
    return ex.profile_facts(fx.vector_memories(spark, sf))


@query("enriched_rows", f"{W_M} SELECT id, round(least(confidence, 0.7::DOUBLE), 6) AS confidence, array_to_string(list_append(tags, 'source:enrichment'), ',') AS tags FROM M")
def enriched_rows(spark, sf):
    return ex.enriched(fx.memories(spark, sf)).select("id", F.round("confidence", 6).alias("confidence"), F.array_join("tags", ",").alias("tags"))


@query("derived_edges", f"{W_M} SELECT min(id) OVER (PARTITION BY agent_id) + 1000000000 AS source, id AS target FROM M")
def derived_edges(spark, sf):
    m = fx.memories(spark, sf).select("id", F.col("agent_id").alias("batch"))
    made = m.groupBy("batch").agg((F.min("id") + 1_000_000_000).alias("id"))  # one enriched memory for each agent's rows
    return ex.derived_edges(made, m, NOW).select("source", "target")


VERDICT = "CASE WHEN 0.3::DOUBLE + 0.1::DOUBLE * (id % 8)::DOUBLE < 0.6::DOUBLE THEN 'low_quality' WHEN (id % 10)::DOUBLE / 10.0::DOUBLE >= 0.85::DOUBLE THEN 'duplicate' WHEN memory_type = 'AntiPattern' THEN 'contradiction' ELSE 'store' END"


def verdicts(spark, sf):
    m = fx.memories(spark, sf).select("id", "confidence", "memory_type")
    near = m.select("id", ((F.col("id") % 10).cast("double") / 10.0).alias("similarity"))
    return ex.classify(m.drop("memory_type"), near, m.where("memory_type = 'AntiPattern'"))


@query("extraction_verdicts", f"{W_M} SELECT id, {VERDICT} AS verdict FROM M")
def extraction_verdicts(spark, sf):
    return verdicts(spark, sf)


@query("extraction_statistics", f"{W_M}, V AS (SELECT {VERDICT} AS v FROM M) SELECT count(*) AS total, count(*) FILTER (v = 'store') AS accepted, count(*) FILTER (v = 'low_quality') AS rejected_quality, count(*) FILTER (v = 'duplicate') AS rejected_duplicate, count(*) FILTER (v = 'contradiction') AS contradictions FROM V")
def extraction_statistics(spark, sf):
    return ex.statistics(verdicts(spark, sf))


@query("extraction_parse", "SELECT * FROM (VALUES (1, 0, 'uses Rust', 'Semantic', 0.9::DOUBLE), (1, 1, 'x', 'Episodic', 0.5::DOUBLE)) t(id, pos, content, memory_type, confidence)")
def extraction_parse(spark, sf):
    answer = 'Here: ```json {"memories": [{"content": "uses Rust", "memory_type": "decision", "confidence": 0.9}, {"content": "x"}]} ```'
    raw = spark.range(1).select(F.lit(1).alias("id"), F.lit(answer).alias("text"))
    return ex.memories_of(ex.parse(raw)).select("id", "pos", "content", "memory_type", "confidence")


@query("turn_signals", f"""WITH S AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id, turn, {cue_sql('lower(text)', tx.CORRECTIONS)} AS correction, {cue_sql('text', tx.SPECULATIONS)} AS speculation, CAST(ceil(len(list_filter(string_split_regex(text, '[ \\t\\r\\n\\f\\x0b]+'), lambda w: w <> '')) * 1.3::DOUBLE) AS BIGINT) AS tokens FROM S""")
def turn_signals(spark, sf):
    return st.turn_signals(fx.table(spark, sf, "conversations")).select("conv_id", "turn", "correction", "speculation", "tokens")


@query("turn_exchanges", """WITH T AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 'User: ' || text || CASE WHEN nr = 'assistant' THEN chr(10) || 'Assistant: ' || nt ELSE '' END AS content FROM T WHERE role = 'user'""")
def turn_exchanges(spark, sf):
    return st.exchanges(fx.table(spark, sf, "conversations")).select("conv_id", "turn", "content")


@query("canonical_topics", f"WITH {fx.T_SQL} SELECT conv_id, turn, CASE WHEN starts_with(topic, 'the ') THEN 'THE' ELSE topic END AS topic FROM T")
def canonical_topics(spark, sf):
    t = fx.turns(spark, sf)
    learned = t.where(F.col("topic").startswith("the ")).select(F.upper("topic").alias("raw"), F.lit("THE").alias("canonical")).distinct()
    return st.canonical_topics(t, learned).select("conv_id", "turn", "topic")


@query("conversation_memories", "SELECT conv_id * 100 + turn AS id FROM conversations WHERE conv_id = 3 UNION SELECT conv_id * 100 + turn FROM conversations WHERE conv_id = 3 AND role = 'assistant'")
def conversation_memories(spark, sf):
    c = fx.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("memory_id"), F.col("conv_id").alias("conversation_id"), "role")
    return policies.forget_scope("conversation", 3, None, sources=c).union(policies.forget_scope("conversation", 3, None, sources=c.where("role = 'assistant'"))).distinct()


# Documented SQL over the storage tables, run as SQL on views of the derived tables.


def views(spark, sf):
    """Temporary views under names of their own: memories, edges, entities, links, claims, evidence."""
    for name, df in (("memories", fx.memories(spark, sf)), ("edges", fx.edges(spark, sf)), ("entities", ents(spark, sf)), ("aliases", aliases(spark, sf)), ("links", links(spark, sf)), ("claims", claims(spark, sf)), ("evidence", evidence(spark, sf)), ("relationships", relationships(spark, sf))):
        df.createOrReplaceTempView(f"lb_{name}")


@query("sql_memory_entities", f"{ALL} SELECT entity_type, canonical, round(LK.confidence, 6) AS confidence FROM LK JOIN EN USING (entity_id) WHERE memory_id = 15")
def sql_memory_entities(spark, sf):
    views(spark, sf)
    return spark.sql("SELECT e.entity_type, e.canonical, round(me.confidence, 6) AS confidence FROM lb_links me JOIN lb_entities e ON e.entity_id = me.entity_id WHERE me.memory_id = 15 ORDER BY confidence DESC, e.canonical ASC")


@query("sql_resolve_alias", f"{ALL} SELECT entity_id, entity_type, canonical, alias, confidence FROM AL JOIN EN USING (entity_id) WHERE alias = 'NATION_9'")
def sql_resolve_alias(spark, sf):
    views(spark, sf)
    return spark.sql("SELECT e.entity_id, e.entity_type, e.canonical, a.alias, a.confidence FROM lb_aliases a JOIN lb_entities e ON e.entity_id = a.entity_id WHERE a.alias = 'NATION_9' ORDER BY a.confidence DESC")


@query("sql_graph_neighborhood", f"{W_E} SELECT source, edge_type, target, round(weight, 6) AS weight FROM E WHERE source = 21 OR target = 21")
def sql_graph_neighborhood(spark, sf):
    views(spark, sf)
    return spark.sql("SELECT source, edge_type, target, round(weight, 6) AS weight FROM lb_edges WHERE source = 21 OR target = 21 ORDER BY created_at_us DESC")


@query("sql_claim_provenance", f"{ALL} SELECT claim_id, memory_id, round(EV.confidence, 6) AS confidence FROM EV JOIN CL USING (claim_id) WHERE entity_id = 6 AND status = 'active'")
def sql_claim_provenance(spark, sf):
    views(spark, sf)
    return spark.sql("SELECT c.claim_id, v.memory_id, round(v.confidence, 6) AS confidence FROM lb_evidence v JOIN lb_claims c ON c.claim_id = v.claim_id WHERE c.entity_id = 6 AND c.status = 'active'")


@query("sql_tag_distribution", f"{W_M} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM M) GROUP BY tag")
def sql_tag_distribution(spark, sf):
    views(spark, sf)
    return spark.sql("SELECT tag, COUNT(*) AS n FROM (SELECT explode(tags) AS tag FROM lb_memories) GROUP BY tag ORDER BY n DESC, tag ASC")


@query("event_sessions", """WITH S AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
G AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM S) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events, round(sum(value), 4) AS value FROM G GROUP BY user_id, g""")
def event_sessions(spark, sf):
    e = fx.table(spark, sf, "events")
    w = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    start = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', w.start)"
    return w.select("user_id", F.expr(start).alias("start_us"), "events", "value")
