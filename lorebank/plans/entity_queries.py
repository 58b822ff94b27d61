"""Queries on entities, claims, context assembly and conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from lorebank.functions import text as tx
from lorebank.operators import context, entities, graph
from lorebank.plans.recall_queries import Q, W_M, W_MV, vector_of
from lorebank.plans.registry import query
from lorebank.sources import fixtures as fx
from lorebank.operators import retrieval

NOW = fx.NOW_US

# Derived tables: nations are entities, customers their links, orders claims, line items evidence.
ENT = "EN AS (SELECT CAST(n_nationkey AS BIGINT) AS entity_id, n_name AS canonical, 'place' AS entity_type, n_regionkey FROM nation)"
AL = "AL AS (SELECT entity_id, canonical AS alias, 1.0::DOUBLE AS confidence FROM EN UNION ALL SELECT entity_id, lower(canonical), 0.9::DOUBLE FROM EN)"
LK = "LK AS (SELECT c_custkey AS memory_id, CAST(c_nationkey AS BIGINT) AS entity_id, 0.5::DOUBLE + (c_custkey % 5)::DOUBLE / 10.0::DOUBLE AS confidence FROM customer)"
CL = "CL AS (SELECT o_orderkey AS claim_id, CAST(c_nationkey AS BIGINT) AS entity_id, 0.5::DOUBLE + (o_orderkey % 5)::DOUBLE / 10.0::DOUBLE AS confidence, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'corrected' END AS status, epoch_us(o_orderdate) AS valid_from_us FROM orders JOIN customer ON o_custkey = c_custkey)"
EV = "EV AS (SELECT l_orderkey AS claim_id, l_partkey AS memory_id, 1.0::DOUBLE - l_discount AS confidence FROM lineitem)"
RE = "RE AS (SELECT a.entity_id AS source, b.entity_id AS target, 0.5::DOUBLE + (a.entity_id % 5)::DOUBLE / 10.0::DOUBLE AS confidence, CASE WHEN (a.entity_id + b.entity_id) % 6 = 0 THEN 'rejected' ELSE 'active' END AS status FROM EN a JOIN EN b ON a.n_regionkey = b.n_regionkey AND a.entity_id < b.entity_id)"
ALL = f"WITH {ENT}, {AL}, {LK}, {CL}, {EV}, {RE}"


def ents(spark, sf):
    return fx.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("canonical"), F.lit("place").alias("entity_type"), "n_regionkey")


def aliases(spark, sf):
    e = ents(spark, sf)
    return e.select("entity_id", F.col("canonical").alias("alias"), F.lit(1.0).alias("confidence")).unionByName(e.select("entity_id", F.lower("canonical").alias("alias"), F.lit(0.9).alias("confidence")))


def links(spark, sf):
    return fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_nationkey").cast("long").alias("entity_id"), (F.lit(0.5) + (F.col("c_custkey") % 5).cast("double") / 10.0).alias("confidence"))


def claims(spark, sf):
    o, c = fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("claim_id"), F.col("c_nationkey").cast("long").alias("entity_id"), (F.lit(0.5) + (F.col("o_orderkey") % 5).cast("double") / 10.0).alias("confidence"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("corrected").alias("status"), F.expr(fx.EPOCH_US.format("o_orderdate")).alias("valid_from_us"))


def evidence(spark, sf):
    return fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("memory_id"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"))


def relationships(spark, sf):
    a = ents(spark, sf).select(F.col("entity_id").alias("source"), "n_regionkey")
    b = ents(spark, sf).select(F.col("entity_id").alias("target"), "n_regionkey")
    return a.join(b, "n_regionkey").where("source < target").select("source", "target", (F.lit(0.5) + (F.col("source") % 5).cast("double") / 10.0).alias("confidence"))


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


@query("entity_alias_lookup", f"{ALL} SELECT entity_id, entity_type, canonical, alias, confidence FROM AL JOIN EN USING (entity_id) WHERE alias = 'nation_4'")
def entity_alias_lookup(spark, sf):
    return entities.alias_lookup(aliases(spark, sf), ents(spark, sf), "nation_4")


@query("entity_links_topn", f"{ALL} SELECT entity_id, memory_id, round(confidence, 6) AS confidence FROM LK QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, memory_id) <= 32")
def entity_links_topn(spark, sf):
    return entities.top_links(links(spark, sf)).select("entity_id", "memory_id", r6("confidence"))


@query("entity_relationships", f"{ALL} SELECT source AS entity_id, target AS other FROM RE UNION ALL SELECT target, source FROM RE")
def entity_relationships(spark, sf):
    return entities.related_entities(ents(spark, sf), relationships(spark, sf)).select("entity_id", "other")


@query("claims_valid", f"{ALL} SELECT claim_id FROM CL WHERE status = 'active' AND valid_from_us <= epoch_us(TIMESTAMP '1997-01-01')")
def claims_valid(spark, sf):
    at = F.expr(fx.EPOCH_US.format("TIMESTAMP_NTZ '1997-01-01 00:00:00'"))
    return claims(spark, sf).where((F.col("status") == "active") & (F.col("valid_from_us") <= at)).select("claim_id")


@query("memory_claims", f"{ALL} SELECT DISTINCT claim_id, entity_id FROM CL JOIN EV USING (claim_id) WHERE memory_id = 11")
def memory_claims(spark, sf):
    return claims(spark, sf).join(evidence(spark, sf).where("memory_id = 11").select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id", "entity_id")


@query("claims_without_evidence", f"{ALL} SELECT claim_id FROM CL WHERE claim_id NOT IN (SELECT claim_id FROM EV WHERE confidence > 0.955::DOUBLE)")
def claims_without_evidence(spark, sf):
    return claims(spark, sf).join(evidence(spark, sf).where("confidence > 0.955D"), "claim_id", "left_anti").select("claim_id")


BOOST = f"""{ALL}, G AS (SELECT entity_id, max(confidence) AS ac FROM AL WHERE lower(alias) IN ('nation_4', 'nation_7') GROUP BY entity_id),
D AS (SELECT memory_id AS id, ac * confidence AS b FROM LK JOIN G USING (entity_id) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, memory_id) <= 32),
C AS (SELECT claim_id, ac, confidence AS cc FROM CL JOIN G USING (entity_id) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, claim_id) <= 32),
V AS (SELECT claim_id, memory_id, confidence FROM EV WHERE claim_id IN (SELECT claim_id FROM C) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY confidence DESC, memory_id) <= 32),
O AS (SELECT other, max(rc * ac) AS w FROM (SELECT source AS entity_id, target AS other, confidence AS rc FROM RE WHERE status = 'active' UNION ALL SELECT target, source, confidence FROM RE WHERE status = 'active') JOIN G USING (entity_id) GROUP BY other),
L AS (SELECT memory_id AS id, 0.6::DOUBLE * w * confidence AS b FROM LK JOIN O ON entity_id = other QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, memory_id) <= 32),
RI AS (SELECT source * 100 + target AS relationship_id, source, target, confidence FROM RE WHERE status = 'active'),
RT AS (SELECT relationship_id, max(confidence * ac) AS w FROM (SELECT relationship_id, ac, RI.confidence FROM RI JOIN G ON source = entity_id OR target = entity_id QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY RI.confidence DESC, relationship_id) <= 32) GROUP BY relationship_id),
RV AS (SELECT relationship_id, memory_id, w * confidence AS b FROM (SELECT o_custkey % 5 * 500 + o_orderkey % 25 AS relationship_id, o_orderkey AS memory_id, 0.2::DOUBLE + (o_orderkey % 7)::DOUBLE / 10.0::DOUBLE AS confidence FROM orders) JOIN RT USING (relationship_id) QUALIFY row_number() OVER (PARTITION BY relationship_id ORDER BY confidence DESC, memory_id) <= 32)
SELECT id, round(max(b), 6) AS boost FROM (SELECT memory_id AS id, b FROM RV UNION ALL SELECT * FROM D UNION ALL SELECT memory_id, 0.9::DOUBLE * cc * confidence * ac FROM V JOIN C USING (claim_id) UNION ALL SELECT * FROM L) GROUP BY id"""


@query("entity_boost", BOOST)
def entity_boost(spark, sf):
    hit = entities.matched_aliases(spark, "Tell me about NATION_4, or nation_7?", aliases(spark, sf))
    active = relationships(spark, sf).where((F.col("source") + F.col("target")) % 6 != 0).withColumn("relationship_id", F.col("source") * 100 + F.col("target"))
    shown = fx.table(spark, sf, "orders").select((F.col("o_custkey") % 5 * 500 + F.col("o_orderkey") % 25).alias("relationship_id"), F.col("o_orderkey").alias("memory_id"), (F.lit(0.2) + (F.col("o_orderkey") % 7).cast("double") / 10.0).alias("confidence"))
    return entities.recall_boost(hit, links(spark, sf), claims(spark, sf), evidence(spark, sf), active, shown).select("id", r6("boost"))


@query("query_ngrams", "SELECT unnest(['tell', 'me', 'now', 'tell me', 'me now', 'tell me now']) AS gram")
def query_ngrams(spark, sf):
    return spark.range(1).select(F.explode(tx.query_ngrams(F.lit("Tell me, now!"))).alias("gram"))


@query("entity_resolve", "SELECT * FROM (VALUES ('Alice', 'alice smith', 0.7::DOUBLE, 'rule'), ('bob', 'robert', 0.95::DOUBLE, 'cache'), ('Java', 'java', 1.0::DOUBLE, 'identity'), ('carol  JONES', 'carol', 0.7::DOUBLE, 'rule')) t(name, canonical, confidence, source)")
def entity_resolve(spark, sf):
    names = spark.sql("SELECT explode(array('Alice', 'bob', 'Java', 'carol  JONES')) AS name")
    known = spark.sql("SELECT 'Bob' AS alias, 'robert' AS canonical, 0.95D AS confidence")
    canon = spark.sql("SELECT explode(array('Alice Smith', 'Robert', 'JavaScript', 'Carol')) AS canonical")
    return entities.resolve(names, known, canon)


@query("negative_pairs", f"{ALL} SELECT DISTINCT least(lower(a.canonical), lower(b.canonical)) AS first, greatest(lower(a.canonical), lower(b.canonical)) AS second FROM RE JOIN EN a ON source = a.entity_id JOIN EN b ON target = b.entity_id")
def negative_pairs(spark, sf):
    e = ents(spark, sf)
    named = relationships(spark, sf).join(e.select(F.col("entity_id").alias("source"), F.col("canonical").alias("a")), "source").join(e.select(F.col("entity_id").alias("target"), F.col("canonical").alias("b")), "target")
    return named.unionByName(named.select("target", "source", "confidence", F.col("b").alias("a"), F.col("a").alias("b")), allowMissingColumns=True).select(*entities.negative_key("a", "b")).distinct()


@query("structured_entities", """SELECT * FROM (VALUES (1, 'Ada Lovelace', 'person', 'subject', 0.95::DOUBLE), (1, 'London', 'place', 'location', 0.95::DOUBLE), (1, 'Paris', 'place', 'location', 0.95::DOUBLE),
(2, 'Rust', 'technology', 'tool', 0.95::DOUBLE), (2, 'Tokio', 'technology', 'tool', 0.95::DOUBLE), (2, 'Apollo', 'project', 'subject', 0.95::DOUBLE), (3, 'Blue Whale', 'animal', 'mentioned', 0.98::DOUBLE)) t(id, canonical, entity_type, role, confidence)""")
def structured_entities(spark, sf):
    rows = spark.sql("""SELECT * FROM VALUES (1, 'User: Name: Ada Lovelace. She writes\nLocation: London and Paris, near the sea', array('x')),
      (2, 'Stack: rust plus tokio.\nProject Apollo is large', array()), (3, 'nothing', array('entity:blue whale', 'entity_type:Animal')) AS t(id, content, tags)""")
    return entities.structured_entities(rows.withColumn("tags", F.col("tags").cast("array<string>")))


@query("entity_categories", "SELECT p_type AS entity_type, count(DISTINCT p_name) AS n FROM part GROUP BY p_type HAVING count(DISTINCT p_name) >= 2")
def entity_categories(spark, sf):
    parts = fx.table(spark, sf, "part").select(F.col("p_type").alias("entity_type"), F.col("p_name").alias("canonical"))
    return entities.categories(parts).select("entity_type", F.size("names").cast("long").alias("n"))


@query("entity_merge", "SELECT lower(p_name) AS key, max(p_retailprice / 10000.0::DOUBLE) AS confidence, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types FROM part GROUP BY lower(p_name)")
def entity_merge(spark, sf):
    parts = fx.table(spark, sf, "part").select(F.col("p_type").alias("entity_type"), F.col("p_name").alias("canonical"), (F.col("p_retailprice") / 10000.0).alias("confidence"))
    return entities.merge_entities(parts).select("key", "confidence", F.array_join("types", ",").alias("types"))


# Edges that some pairs have already: every memory to the one 25 ids on.
@query("entity_link_pairs", f"""{ALL}, G AS (SELECT memory_id AS source, memory_id + 25 AS target FROM LK WHERE memory_id % 3 = 0),
P AS (SELECT a.entity_id, a.memory_id AS x, b.memory_id AS y FROM LK a JOIN LK b ON a.entity_id = b.entity_id AND a.memory_id <> b.memory_id),
N AS (SELECT P.* FROM P LEFT JOIN G ON least(x, y) = source AND greatest(x, y) = target WHERE source IS NULL)
SELECT LK.entity_id, memory_id, min(memory_id) OVER (PARTITION BY LK.entity_id) AS representative, count(y) AS new_links FROM LK LEFT JOIN N ON LK.entity_id = N.entity_id AND memory_id = x GROUP BY LK.entity_id, memory_id""")
def entity_link_pairs(spark, sf):
    own = links(spark, sf)
    known = own.where("memory_id % 3 = 0").select(F.col("memory_id").alias("source"), (F.col("memory_id") + 25).alias("target"))
    return entities.shared_entity_classes(own, known)


@query("extraction_validation", "SELECT * FROM (VALUES (1, 'empty content'), (2, 'confidence out of range'), (3, 'validity ends before it begins'), (4, 'attributes are no object')) t(id, violation)")
def extraction_validation(spark, sf):
    rows = spark.sql("""SELECT * FROM VALUES (0, 'fine', 0.5D, 1L, 2L, '{"a": 1}'), (1, ' ', 0.5D, null, null, null), (2, 'x', 1.5D, null, null, null), (3, 'x', 0.5D, 5L, 5L, null), (4, 'x', 0.5D, null, null, '[1]')
      AS t(id, content, confidence, valid_from_us, valid_until_us, attributes)""")
    return entities.violations(rows)


# Context assembly over scored memories: the best 200 by cosine, with scores spread over 0 to 1.
SCORED = f"""{W_MV}, {Q.format(0)}, K AS (SELECT MV.*, (id % 11)::DOUBLE / 10.0::DOUBLE AS score FROM MV, q ORDER BY list_cosine_similarity(embedding, e) DESC, id LIMIT 200)"""
ZONE = "CASE WHEN memory_type IN ('AntiPattern', 'Correction') THEN 'Opening' WHEN score >= 0.8 AND salience >= 0.7 THEN 'Critical' WHEN score >= 0.5 THEN 'Primary' WHEN score >= 0.2 THEN 'Supporting' ELSE 'Closing' END"
TOKENS = r"CAST(ceil(len(list_filter(string_split_regex(content, '[ \t\r\n\f\x0b]+'), lambda w: w <> '')) * 1.3::DOUBLE) AS BIGINT)"


def scored(spark, sf):
    hits = retrieval.knn(fx.vector_memories(spark, sf), vector_of(spark, sf), 200, clamped=False)
    return hits.withColumn("score", (F.col("id") % 11).cast("double") / 10.0)


@query("zone_classify", f"{SCORED} SELECT id, {ZONE} AS zone FROM K")
def zone_classify(spark, sf):
    return scored(spark, sf).select("id", context.zone().alias("zone"))


@query("zone_tokens", f"{SCORED} SELECT {ZONE} AS zone, count(*) AS memories, CAST(sum({TOKENS}) AS BIGINT) AS tokens FROM K GROUP BY 1")
def zone_tokens(spark, sf):
    return context.blocks(scored(spark, sf))


@query("zone_allocation", "SELECT zone, CAST(tokens AS BIGINT) AS tokens FROM (VALUES ('Opening', 409), ('Critical', 1024), ('Primary', 1433), ('Supporting', 819), ('Closing', 409)) t(zone, tokens)")
def zone_allocation(spark, sf):
    return context.zone_allocation(spark, 4096)


@query("greedy_budget", f"""WITH RECURSIVE {SCORED[5:]}, O AS (SELECT id, {TOKENS} AS t, row_number() OVER (ORDER BY score DESC, id) AS r FROM K),
G(r, used, id, taken) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false UNION ALL
  SELECT O.r, CASE WHEN used + t <= 4096 THEN used + t ELSE used END, O.id, used + t <= 4096 FROM G JOIN O ON O.r = G.r + 1)
SELECT id FROM G WHERE taken""")
def greedy_budget(spark, sf):
    return context.fill_budget(scored(spark, sf), 4096).select("id")


def two(column: str) -> str:
    return f"printf('%.2f', {column})"


@query("compact_lines", f"{SCORED} SELECT id, 'M|' || memory_type || '|' || {two('salience')} || '|' || content || '|tags:' || array_to_string(tags, ',') AS line FROM K")
def compact_lines(spark, sf):
    return scored(spark, sf).select("id", context.compact_line().alias("line"))


@query("structured_lines", f"{SCORED} SELECT id, '- **[' || memory_type || ']** (salience: ' || {two('salience')} || ') ' || content || ' [' || array_to_string(tags, ', ') || ']' AS line FROM K")
def structured_lines(spark, sf):
    return scored(spark, sf).select("id", context.structured_line().alias("line"))


@query("delta_lines", f"{SCORED} SELECT id, '- [NEW] ' || memory_type || ' | ' || content AS line FROM K")
def delta_lines(spark, sf):
    return scored(spark, sf).select("id", context.delta_line().alias("line"))


@query("relationship_lines", f"WITH {fx.E_SQL} SELECT source, target, '- ' || substr(source::VARCHAR, 1, 8) || ' --[' || edge_type || ' w=' || {two('weight')} || ']--> ' || substr(target::VARCHAR, 1, 8) AS line FROM E")
def relationship_lines(spark, sf):
    return fx.edges(spark, sf).select("source", "target", context.relationship_line().alias("line"))


def serial_sql(line: str, mark: str, gap: str) -> str:
    labels = ", ".join(f"'{x}'" for x in context.LABELS)
    zones = ", ".join(f"'{x}'" for x in context.ZONES)
    return f"""{SCORED}, Z AS (SELECT *, list_position([{zones}], {ZONE}) AS z FROM K),
B AS (SELECT z, '{mark}' || ([{labels}])[z] || chr(10) || string_agg({line}, chr(10) ORDER BY score DESC, id) || {gap} AS part FROM Z GROUP BY z)
SELECT sha256(string_agg(part, chr(10) ORDER BY z)) AS context FROM B"""


@query("context_compact", serial_sql(f"'M|' || memory_type || '|' || {two('salience')} || '|' || content || '|tags:' || array_to_string(tags, ',')", "# ", "''"))
def context_compact(spark, sf):
    return context.serialise(scored(spark, sf), "compact").select(F.sha2("context", 256).alias("context"))


@query("context_structured", serial_sql(f"'- **[' || memory_type || ']** (salience: ' || {two('salience')} || ') ' || content || ' [' || array_to_string(tags, ', ') || ']'", "## ", "chr(10)"))
def context_structured(spark, sf):
    return context.serialise(scored(spark, sf), "structured").select(F.sha2("context", 256).alias("context"))


def served_sets(spark, sf):
    rows = fx.memories(spark, sf)
    return rows.where("salience > 0.5D").select("id", "content"), rows.where("memory_type = 'Semantic'").select("id", "content")


@query("delta_sets", f"{W_M} SELECT id, CASE WHEN salience <= 0.5 THEN 'added' WHEN memory_type <> 'Semantic' THEN 'removed' ELSE 'unchanged' END AS status FROM M WHERE salience > 0.5 OR memory_type = 'Semantic'")
def delta_sets(spark, sf):
    return context.delta(*served_sets(spark, sf))


@query("delta_text", f"""{W_MV}, {Q.format(0)}, P AS (SELECT id FROM MV, q ORDER BY list_cosine_similarity(embedding, e) DESC, id LIMIT 50), N AS (SELECT id, content FROM MV, q ORDER BY list_cosine_similarity(embedding, e) DESC, id LIMIT 80)
SELECT sha256((SELECT string_agg('[NEW] ' || content, chr(10) ORDER BY id) FROM N WHERE id NOT IN (SELECT id FROM P)) || chr(10) || '[UNCHANGED] 50 memories from previous turn') AS delta""")
def delta_text(spark, sf):
    rows, q = fx.vector_memories(spark, sf), vector_of(spark, sf)
    served = [retrieval.knn(rows, q, k, clamped=False) for k in (50, 80)]
    return context.delta_text(context.delta(*served), rows).select(F.sha2("delta", 256).alias("delta"))


@query("context_prefix", f"""{SCORED}, L AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS n, score, content AS c FROM K), T AS (SELECT id, n, n || '. ' || c || ' (score ' || printf('%.3f', score) || ')' AS line FROM L),
U AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY n) - 1 AS used FROM T) SELECT id, CAST(n AS INTEGER) AS n, substr(line, 1, 50000) AS line FROM U WHERE used <= 50000 OR n = 1""")
def context_prefix(spark, sf):
    return context.bounded_list(scored(spark, sf), 50_000)


@query("session_headers", f"""{SCORED}, R AS (SELECT row_number() OVER (ORDER BY created_at_us, id) AS pos, 's' || (id // 20) AS session, CAST(id AS VARCHAR) AS d, content AS c FROM K)
SELECT CAST(pos AS INTEGER) AS pos, CASE WHEN lag(session) OVER (ORDER BY pos) IS DISTINCT FROM session THEN '--- [Session: ' || session || '] ---' || chr(10) ELSE '' END || '[' || row_number() OVER (ORDER BY pos) || '] [' || d || '] ' || c AS line FROM R""")
def session_headers(spark, sf):
    k = scored(spark, sf)
    pos = F.row_number().over(Window.orderBy("created_at_us", "id"))
    return context.session_headers(k.select(pos.alias("pos"), F.concat(F.lit("s"), F.floor(F.col("id") / 20).cast("string")).alias("session"), F.col("id").cast("string").alias("date"), "content"))


# Turns: trajectories as batch windows.


@query("topic_transitions", f"WITH {fx.T_SQL}, P AS (SELECT conv_id, lag(topic) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, topic FROM T) SELECT prev, topic, count(*) AS n FROM P WHERE prev IS NOT NULL GROUP BY prev, topic")
def topic_transitions(spark, sf):
    from lorebank.streaming.trajectory import transitions

    return transitions(fx.turns(spark, sf))


@query("predict_next", f"""WITH {fx.T_SQL}, P AS (SELECT lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, role AS topic FROM T), N AS (SELECT prev, topic, count(*) AS n FROM P WHERE prev IS NOT NULL GROUP BY prev, topic)
SELECT prev, topic, n FROM N QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, topic) <= 3""")
def predict_next(spark, sf):
    from lorebank.streaming.trajectory import predictions, transitions

    return predictions(transitions(fx.turns(spark, sf).drop("topic").withColumnRenamed("role", "topic")))


@query("resume_context", f"""WITH {fx.T_SQL}, R AS (SELECT conv_id, topic, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM T)
SELECT conv_id, 'You were working on: ' || max(topic) FILTER (r = 1) || CASE WHEN count(*) > 1 THEN ' Recent trajectory: ' || string_agg(topic, ' → ' ORDER BY r DESC) FILTER (r BETWEEN 2 AND 4) ELSE '' END AS context FROM R GROUP BY conv_id""")
def resume_context(spark, sf):
    from lorebank.streaming.trajectory import resume

    return resume(fx.turns(spark, sf))


@query("sum_amounts", "SELECT round(sum(TRY_CAST(regexp_replace(x, '[^0-9.\\-]', '', 'g') AS DOUBLE)) FILTER (TRY_CAST(regexp_replace(x, '[^0-9.\\-]', '', 'g') AS DOUBLE) > 0), 2) AS total FROM (SELECT '$' || CAST(o_totalprice AS VARCHAR) || ' USD' AS x FROM orders)")
def sum_amounts(spark, sf):
    o = fx.table(spark, sf, "orders").select(tx.amount(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" USD"))).alias("x"))
    return o.agg(F.round(F.sum(F.when(F.col("x") > 0, F.col("x"))), 2).alias("total"))


@query("date_differences", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS days, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') // 7 AS weeks, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') // 30 AS months FROM orders")
def date_differences(spark, sf):
    days = F.datediff(F.lit("2001-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    return fx.table(spark, sf, "orders").select("o_orderkey", days.alias("days"), F.expr("datediff(date '2001-01-01', cast(o_orderdate as date)) div 7").alias("weeks"), F.expr("datediff(date '2001-01-01', cast(o_orderdate as date)) div 30").alias("months"))


@query("chronological_order", f"{W_M} SELECT agent_id, id, CAST(row_number() OVER (PARTITION BY agent_id ORDER BY created_at_us, id) AS INTEGER) AS place FROM M")
def chronological_order(spark, sf):
    return fx.memories(spark, sf).select("agent_id", "id", F.row_number().over(Window.partitionBy("agent_id").orderBy("created_at_us", "id")).alias("place"))


@query("word_jaccard", r"""WITH D AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[ \t\r\n\f\x0b]+'), lambda w: length(w) >= 2)) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 6) AS jaccard FROM D a JOIN D b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def word_jaccard(spark, sf):
    c = fx.table(spark, sf, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", r6(tx.jaccard("text", "next"), "jaccard"))


@query("memory_tiers", f"{W_M} SELECT id, CASE memory_type WHEN 'Semantic' THEN 2 WHEN 'Procedural' THEN 3 ELSE 1 END AS tier FROM M")
def memory_tiers(spark, sf):
    return fx.memories(spark, sf).select("id", tx.memory_tier("memory_type").alias("tier"))


@query("permission_lattice", "SELECT a AS held, b AS wanted, a = 'Admin' OR a = b OR (a = 'ReadWrite' AND b IN ('Read', 'Write')) AS permits FROM (SELECT unnest(['Read', 'Write', 'ReadWrite', 'Admin']) AS a), (SELECT unnest(['Read', 'Write', 'ReadWrite', 'Admin']) AS b)")
def permission_lattice(spark, sf):
    kinds = "array('Read', 'Write', 'ReadWrite', 'Admin')"
    return spark.sql(f"SELECT held, explode({kinds}) AS wanted FROM (SELECT explode({kinds}) AS held)").withColumn("permits", tx.permits("held", "wanted"))


@query("evidence_spans", "SELECT doc_id, CAST(strlen(substr(text, 1, instr(text, 'and') - 1)) AS BIGINT) AS start, CAST(strlen(substr(text, 1, instr(text, 'and') - 1)) + 3 AS BIGINT) AS stop FROM documents WHERE instr(text, 'and') > 0")
def evidence_spans(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", tx.evidence_span(F.lit("and"), F.col("text")).alias("s")).where("s is not null")
    return d.select("doc_id", "s.start", F.col("s.stop").cast("long").alias("stop"))


@query("latest_pair_edges", f"WITH {fx.E_SQL} SELECT source, target, edge_type, round(max(weight), 6) AS weight FROM E GROUP BY ALL")
def latest_pair_edges(spark, sf):
    return graph.latest_pair_edges(fx.edges(spark, sf)).select("source", "target", "edge_type", r6("weight"))
