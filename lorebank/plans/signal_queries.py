"""Queries on the query language, on signals of texts and questions, and on the steps that a judge decides."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lorebank.functions import text as tx
from lorebank.operators import context, entities, expansion, extraction, lifecycle, policies, signals
from lorebank.operators import evidence as ev
from lorebank.plans import mql
from lorebank.plans.lifecycle_queries import cue_sql
from lorebank.plans.mql.lexer import tokenize
from lorebank.plans.mql.planner import plan
from lorebank.plans.recall_queries import W_M, W_MV, engine
from lorebank.plans.registry import query
from lorebank.sources import fixtures as fx
from lorebank.streaming import cache, tokens, turns
from lorebank.streaming.runner import bounded_calls, file_stream, run_to_end

NOW, DAY = fx.NOW_US, fx.DAY_US


def rows(spark, values, schema):
    return spark.createDataFrame(list(values), schema)


# The query language.


@query("mql_tokens", """SELECT * FROM (VALUES (0, 'keyword', 'RECALL'), (1, 'keyword', 'MEMORIES'), (2, 'keyword', 'WHERE'), (3, 'word', 'tag'), (4, 'op', '='), (5, 'string', 'a b'), (6, 'keyword', 'AND'), (7, 'word', 'salience'),
(8, 'op', '>='), (9, 'float', '-0.5e1'), (10, 'keyword', 'LIMIT'), (11, 'int', '3'), (12, 'arrow', '->'), (13, 'uuid', '123e4567-e89b-12d3-a456-426614174000'), (14, 'end', '')) t(pos, kind, text)""")
def mql_tokens(spark, sf):
    found = tokenize('recall Memories where tag = "a b" AND salience >= -0.5e1 LIMIT 3 -> 123e4567-e89b-12d3-a456-426614174000')
    return rows(spark, [(n, t.kind, t.text) for n, t in enumerate(found)], "pos int, kind string, text string")


STATEMENTS = (
    ("RECALL memories NEAR [0.1, -2] LIMIT 4", "vector_search", 4, 0), ("RECALL WHERE content ~> \"x\" AND tag = a", "similar_text", 20, 1), ("RECALL memories WHERE tag = a AND tag = b", "tag_scan", 20, 2),
    ("RECALL memories WHERE created > 2024-01-01 AND tag = a LIMIT 7", "error", None, None), ("RECALL memories WHERE created > \"2024-01-01\" AND tag = a LIMIT 7", "time_scan", 7, 2), ("RECALL memories WHERE type = anti_pattern", "full_scan", 20, 1),
    ("RELATE 1 -> 2 AS part_of WITH weight = 0.5", "edge_insert", None, 0), ("FORGET 7", "delete", None, 0), ("CONSOLIDATE WHERE confidence > 0.5", "consolidate", None, 1), ("TRAVERSE 1 DEPTH 3 WHERE edge_type = caused", "traversal", None, 0),
    ("RECALL memories WHERE tag = a OR tag = b", "error", None, None), ("RECALL memories LIMIT -1", "error", None, None), ("RELATE 1 -> 2 AS likes", "error", None, None), ("SELECT 1", "error", None, None),
)


def sql_values(values) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(map(one, v)) + ")" for v in values)


@query("mql_plans", f"SELECT * FROM (VALUES {sql_values(STATEMENTS)}) t(statement, kind, most, filters)")
def mql_plans(spark, sf):
    """Which access each statement gets, and which are errors."""
    out = []
    for text, *_ in STATEMENTS:
        try:
            p = plan(mql.parse(text))
            out.append((text, p.kind, p.limit, len(p.filters)))
        except mql.MqlError:
            out.append((text, "error", None, None))
    return rows(spark, out, "statement string, kind string, most int, filters int")


@query("mql_literals", "SELECT * FROM (VALUES ('salience', '>=', 'float', '0.25'), ('confidence', '<', 'int', '1'), ('tag', '!=', 'str', 'x y'), ('type', '=', 'str', 'AntiPattern'), ('agent', '=', 'str', '123e4567-e89b-12d3-a456-426614174000'), ('space', '=', 'bool', 'True'), ('content', '~>', 'str', 'why \"so\"')) t(field, op, kind, value)")
def mql_literals(spark, sf):
    s = mql.parse('RECALL WHERE salience >= 0.25 AND confidence < 1 AND tag != "x y" AND type = antipattern AND agent = 123e4567-e89b-12d3-a456-426614174000 AND space = true AND content ~> "why \\"so\\""')
    return rows(spark, [(f.field, f.op, type(f.value).__name__, str(f.value).replace("\\", "")) for f in s.filters], "field string, op string, kind string, value string")


@query("mql_type_names", "SELECT * FROM (VALUES ('caused', 'Caused'), ('Before', 'Before'), ('RELATED', 'Related'), ('contradicts', 'Contradicts'), ('supports', 'Supports'), ('supersedes', 'Supersedes'), ('derived', 'Derived'), ('part_of', 'PartOf'), ('partof', 'PartOf')) t(name, edge_type)")
def mql_type_names(spark, sf):
    names = ("caused", "Before", "RELATED", "contradicts", "supports", "supersedes", "derived", "part_of", "partof")
    return rows(spark, [(n, mql.parse(f"RELATE 1 -> 2 AS {n}").edge_type) for n in names], "name string, edge_type string")


@query("mql_execute", f"""{W_M} SELECT 'tag' AS statement, id FROM (SELECT id FROM M WHERE list_contains(tags, 'click') ORDER BY id LIMIT 20)
UNION ALL SELECT 'time', id FROM (SELECT id FROM M WHERE created_at_us >= 1704844800000000 AND created_at_us < 1705017600000000 ORDER BY created_at_us DESC, id LIMIT 9)
UNION ALL SELECT 'all', id FROM (SELECT id FROM M WHERE memory_type = 'Procedural' AND salience > 0.5::DOUBLE AND confidence <= 0.7::DOUBLE ORDER BY salience, id LIMIT 6)""")
def mql_execute(spark, sf):
    own, out = engine(spark, sf, vectors=False), None
    for name, text in (("tag", "RECALL memories WHERE tag = click"), ("time", 'RECALL WHERE created >= "2024-01-10" AND created < "2024-01-12" ORDER BY created DESC LIMIT 9'), ("all", "RECALL WHERE type = procedural AND salience > 0.5 AND confidence <= 0.7 ORDER BY salience LIMIT 6")):
        found = mql.run(text, own).select(F.lit(name).alias("statement"), "id")
        out = found if out is None else out.unionByName(found)
    return out


# Questions.

QUESTIONS = (
    ("When did we meet?", True, False, False, False, False), ("What is the order of the three trips?", True, True, False, False, False), ("Can you recommend a book?", False, False, True, False, False),
    ("What is my current address?", False, False, False, True, False), ("Who joined us at the lake?", False, False, False, False, True), ("Tell me about cake", False, False, False, False, False), ("What did I buy last week?", True, False, False, False, False),
)


@query("question_intents", f"SELECT * FROM (VALUES {sql_values(QUESTIONS)}) t(question, temporal, ordering, preference, knowledge_update, contextual)")
def question_intents(spark, sf):
    out = []
    for q, *_ in QUESTIONS:
        i = signals.intent(q)
        out.append((q, i.temporal, i.ordering, i.preference, i.knowledge_update, i.contextual))
    return rows(spark, out, "question string, temporal boolean, ordering boolean, preference boolean, knowledge_update boolean, contextual boolean")


# The reference is Thursday 2024-02-01.
WINDOWS = (("what 3 days ago?", 3, 2), ("10 days ago", 10, 5), ("two weeks ago", 14, 5), ("last Saturday", 5, 2), ("last thursday", 7, 2), ("a month ago", 30, 5), ("last week", 7, 2))


@query("question_windows", f"SELECT question, {NOW} - days * {DAY} AS target, {NOW} - (days + margin) * {DAY} AS start, least({NOW} - (days - margin) * {DAY}, {NOW}) AS stop FROM (VALUES {sql_values(WINDOWS)}) t(question, days, margin)")
def question_windows(spark, sf):
    found = [(q, signals.time_window(q, NOW)) for q in (*[w[0] for w in WINDOWS], "no time at all")]
    return rows(spark, [(q, *w) for q, w in found if w], "question string, target long, start long, stop long")


@query("question_order_windows", f"SELECT * FROM (VALUES ('order of trips in the past two months', {NOW - 60 * DAY}, {NOW}), ('the last 3 months in order', {NOW - 90 * DAY}, {NOW}), ('any time', NULL, NULL)) t(question, start, stop)")
def question_order_windows(spark, sf):
    out = [(q, *(signals.ordering_window(q, NOW) or (None, None))) for q in ("order of trips in the past two months", "the last 3 months in order", "any time")]
    return rows(spark, out, "question string, start long, stop long")


@query("preference_queries", "SELECT unnest(['user preferences about tea', 'what the user likes or dislikes about tea', 'user experience with tea', 'user interests related to tea']) AS query")
def preference_queries(spark, sf):
    return rows(spark, [(q,) for q in expansion.preference_queries("tea")], "query string")


@query("categorical_retrieval", """WITH X AS (SELECT p_partkey AS id, lower(p_type) AS c, p_size % 3 = 0 AS tagged FROM part), T AS (SELECT min(c) AS wanted FROM X)
SELECT id, CASE WHEN tagged THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS score FROM X, T WHERE c = wanted""")
def categorical_retrieval(spark, sf):
    """Parts of a type, found by their attribute, and better by a context tag."""
    p = fx.table(spark, sf, "part")
    wanted = p.agg(F.min(F.lower("p_type"))).first()[0]
    tag = F.when(F.col("p_size") % 3 == 0, F.array(F.concat(F.lit("context:"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))))).otherwise(F.array().cast("array<string>"))
    own = p.select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.col("p_type").alias("category"))).alias("attributes"), tag.alias("tags"))
    return expansion.categorical(own, [wanted.title(), " "])


@query("question_parts", "SELECT * FROM (VALUES ('queries', 'a'), ('queries', 'b'), ('nouns', 'cake lake'), ('items', 'Red Cars'), ('broad', 'vehicles'), ('categories', 'red_car'), ('categories', 'vehicle'), ('categories', 'vehicles')) t(part, value)")
def question_parts(spark, sf):
    answer = 'ok {"queries": ["a", " b "], "nouns": "cake lake", "items": ["Red Cars"], "broad": ["vehicles"]}'
    parts = expansion.take_apart("How many cars?", lambda prompt: answer)
    other = expansion.take_apart("Which cars?", lambda prompt: answer)
    broken = expansion.take_apart("How many cars?", lambda prompt: "no idea {")
    listed = {"queries": (*parts.queries, *broken.queries), "nouns": (other.nouns,), "items": (*parts.items, *other.items), "broad": parts.broad, "categories": expansion.category_names(parts)}
    return rows(spark, [(k, v) for k, vs in listed.items() for v in vs], "part string, value string")


def rating(prompt: str) -> str:
    """A judge that rates a text by its length, and gives one answer that is no list."""
    return json.dumps([len(line.partition("] ")[2]) % 13 for line in prompt.splitlines() if line.startswith("[")])


@query("judge_rerank", "SELECT n_nationkey AS id, CAST(least(10, length(x) % 13) AS DOUBLE) AS judged FROM (SELECT n_nationkey, repeat('x', n_nationkey) || n_name AS x FROM nation) WHERE length(x) % 13 >= 1")
def judge_rerank(spark, sf):
    hits = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.expr("repeat('x', n_nationkey)"), "n_name").alias("content"), F.lit(1.0).alias("score"))
    return expansion.judged(hits, "which?", rating).select("id", "judged")


@query("judge_answers", "SELECT * FROM (VALUES ('scores', '3.0,10.0,0.0,0.0'), ('no scores', '0.0,0.0'), ('gaps', 'tea,7'), ('verdict', 'invalidate'), ('unknown verdict', 'keep'), ('contradiction', 'supersedes'), ('consolidation', 'merge')) t(what, value)")
def judge_answers(spark, sf):
    out = [
        ("scores", ",".join(map(str, expansion.parse_scores("Scores: [3, 99, -1]", 4)))),
        ("no scores", ",".join(map(str, expansion.parse_scores("none", 2)))),
        ("gaps", ",".join(expansion.gap_terms('Missing: ["tea", 7, " "]'))),
        ("verdict", expansion.verdict("I would INVALIDATE it, not keep it", expansion.VERDICTS, "keep")),
        ("unknown verdict", expansion.verdict("hm", expansion.VERDICTS, "keep")),
        ("contradiction", expansion.verdict("It supersedes the old one", expansion.CONTRADICTION_VERDICTS, "compatible")),
        ("consolidation", expansion.verdict("Merge them", expansion.CONSOLIDATION, "keep_all")),
    ]
    return rows(spark, out, "what string, value string")


@query("judge_write_verdicts", "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 'update' WHEN n_regionkey = 2 THEN 'invalidate' ELSE 'keep' END AS verdict FROM nation")
def judge_write_verdicts(spark, sf):
    def judge(prompt: str) -> str:
        return {"r1": "Update.", "r2": "It must be invalidated: INVALIDATE"}.get(prompt.rpartition(" ")[2], "?")

    pairs = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("new_content"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("old_content"))
    return expansion.write_verdicts(pairs, judge).select("id", "verdict")


@query("sum_questions", "SELECT * FROM (VALUES ('How much money did I spend?', true), ('What is the total cost?', true), ('How many days did I spend there?', true), ('How many cats?', false), ('How much is it?', false)) t(question, sums)")
def sum_questions(spark, sf):
    qs = ("How much money did I spend?", "What is the total cost?", "How many days did I spend there?", "How many cats?", "How much is it?")
    return rows(spark, [(q, ev.is_sum_question(q)) for q in qs], "question string, sums boolean")


@query("distinct_items", "SELECT unnest(['The red bike', 'a blue car', 'tent for two people']) AS item")
def distinct_items(spark, sf):
    return rows(spark, [(i,) for i in ev.distinct_items(["The red bike", "red bike", "a blue car", "my big blue car", "tent for two people", "a two people tent for", "  "])], "item string")


@query("parsed_days", "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day FROM orders UNION ALL SELECT -1, NULL")
def parsed_days(spark, sf):
    day = F.pandas_udf(lambda texts: texts.map(ev.parse_day).astype("Int32"), "int")
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy/M/d"), F.lit(", then")).alias("t"))
    return o.unionByName(rows(spark, [(-1, "on 2024-13-45")], "id long, t string")).select("id", day("t").alias("day"))


# Texts.


@query("canonical_phrases", "SELECT * FROM (VALUES ('blue   whale', 'Blue Whale'), ('(Project Apollo)', 'Apollo'), ('Name Ada', 'Ada'), ('\"iPhone\"', 'iPhone'), ('42', NULL)) t(raw, phrase)")
def canonical_phrases(spark, sf):
    return rows(spark, [(x,) for x in ("blue   whale", "(Project Apollo)", "Name Ada", '"iPhone"', "42")], "raw string").select("raw", entities.canonical_phrase("raw").alias("phrase"))


@query("mapped_types", "SELECT * FROM (VALUES ('Decision', 'Semantic'), ('preference', 'Semantic'), ('FACT', 'Semantic'), ('entity', 'Semantic'), ('correction', 'Correction'), ('anti_pattern', 'AntiPattern'), ('event', 'Episodic'), ('', 'Episodic')) t(kind, memory_type)")
def mapped_types(spark, sf):
    kinds = ("Decision", "preference", "FACT", "entity", "correction", "anti_pattern", "event", "")
    return rows(spark, [(k,) for k in kinds], "kind string").select("kind", tx.mapped_type("kind").alias("memory_type"))


@query("pain_scores", f"""SELECT id, round(strength * hits::DOUBLE / n, 6) AS score, 'CAUTION: ' || description || ' (pain: ' || printf('%.2f', strength) || '). Triggers: [' || t || ']' AS warning
FROM (VALUES (1, 'lost data', 0.9::DOUBLE * exp(-1.0::DOUBLE), 1, 2, 'delete, drop'), (2, 'slow build', 0.5::DOUBLE, 2, 2, 'build, ci')) t(id, description, strength, hits, n, t)""")
def pain_scores(spark, sf):
    """Triggers are substrings of the context's keywords; strength decays with age."""
    known = [(1, "lost data", 0.9, ["delete", "drop"], 1e-6, NOW - 1_000_000), (2, "slow build", 0.5, ["build", "ci"], 0.0, NOW - DAY), (3, "other", 1.0, ["paint"], 0.0, NOW), (4, "none", 1.0, [], 0.0, NOW)]
    scored = signals.pain_scores(rows(spark, known, "id int, description string, intensity double, triggers array<string>, decay_rate double, created_at_us long"), ["Deleted", "rebuild", "CI"], NOW)
    return scored.select("id", F.round("score", 6).alias("score")).join(signals.pain_warnings(scored), "id")


@query("registry_gaps", """WITH W AS (SELECT doc_id AS id, unnest(list_distinct(list_transform(list_filter(string_split_regex(lower(text), '[ \\t\\r\\n\\f\\x0b]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')))) AS w FROM documents)
SELECT id, t.term, 'Medium' AS priority FROM W JOIN (VALUES ('Heat'), ('eau'), ('und')) t(term) ON w = lower(term)""")
def registry_gaps(spark, sf):
    """Registered terms in the documents, without those that are known."""
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return signals.registry_gaps(docs, rows(spark, [("Heat",), ("heat",), ("eau",), ("und",), ("the",), ("two words here",)], "term string").where("term <> 'heat'"), rows(spark, [("THE",)], "term string"))


@query("registry_gap_phrases", "SELECT * FROM (VALUES (1, 'Error Budget', 'High'), (1, 'SLO', 'Medium'), (2, 'SLO', 'Medium')) t(id, term, priority)")
def registry_gap_phrases(spark, sf):
    texts = rows(spark, [(1, "Our error budget and the SLO."), (2, "slo, known"), (3, "errors, budgets")], "id int, content string")
    return signals.registry_gaps(texts, rows(spark, [("Error Budget",), ("SLO",), ("Known",)], "term string"), rows(spark, [("known",)], "term string"))


@query("heuristic_gaps", "SELECT * FROM (VALUES (0, 'blue team'), (1, 'Project Apollo'), (2, 'Kubernetes'), (3, 'kube-proxy'), (4, 'HTTP_2')) t(pos, term)")
def heuristic_gaps(spark, sf):
    found = signals.heuristic_gaps('The "blue team" asked Project Apollo about Kubernetes and kube-proxy over HTTP_2 or Redis', ["the"], ["redis"])
    return rows(spark, enumerate(found), "pos int, term string")


# Extraction, links and upkeep.


@query("merge_groups", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT)), (2, 1), (3, 1), (5, 5), (6, 5)) t(id, root)")
def merge_groups(spark, sf):
    """1 and 2 are nearly equal; 2 and 3 of one type and similar; 3 and 4 as similar and of two types."""
    turned = lambda k, degrees, kind: (k, kind, [__import__("math").cos(degrees / 57.29577951308232), __import__("math").sin(degrees / 57.29577951308232)])
    own = [turned(1, 0, "a"), turned(2, 20, "b"), turned(3, 60, "b"), turned(4, 100, "c"), turned(5, 200, "d"), turned(6, 201, "e")]
    return extraction.merge_similar(rows(spark, own, "id long, entity_type string, embedding array<double>"))


@query("redirected_edges", "SELECT * FROM (VALUES (1, 4, 'Related'), (4, 1, 'Related'), (1, 4, 'PartOf')) t(source, target, edge_type)")
def redirected_edges(spark, sf):
    edges = rows(spark, [(2, 4, "Related"), (1, 4, "Related"), (4, 3, "Related"), (1, 2, "Related"), (3, 4, "PartOf")], "source int, target int, edge_type string")
    return extraction.redirected(edges, rows(spark, [(1, 1), (2, 1), (3, 1)], "id int, root int"))


@query("mention_edges", f"""{W_MV}, W AS (SELECT id, unnest(list_distinct(list_filter(string_split_regex(lower(content), '[ \\t\\r\\n\\f\\x0b]+'), lambda w: w <> ''))) AS w FROM MV), F AS (SELECT id, list_filter(string_split_regex(lower(content), '[ \\t\\r\\n\\f\\x0b]+'), lambda w: w <> '')[1] AS w FROM MV)
SELECT F.id AS source, W.id AS target, 0.5::DOUBLE AS weight FROM F JOIN W USING (w) WHERE F.id <> W.id""")
def mention_edges(spark, sf):
    """Every memory's first word as the subject of a fact, and the other memories that hold it."""
    facts = fx.vector_memories(spark, sf, F.get(tx.words("text"), F.lit(0))).select("id", F.col("content").alias("subject"))
    return extraction.mention_edges(facts, fx.vector_memories(spark, sf), NOW).select("source", "target", "weight")


@query("enrichment_batches", f"""{W_M}, X AS (SELECT *, created_at_us // {DAY} AS day FROM M WHERE memory_type = 'Episodic' AND created_at_us > {NOW - 10 * DAY}),
Y AS (SELECT *, day || ':' || ((row_number() OVER (PARTITION BY day ORDER BY created_at_us, id) - 1) // 10) AS batch FROM X)
SELECT batch, array_to_string(list(id ORDER BY created_at_us, id), ',') AS ids, sha256(string_agg(upper(content), chr(10) ORDER BY created_at_us, id)) AS answer FROM Y GROUP BY batch""")
def enrichment_batches(spark, sf):
    """Batches of ten texts of a day, each given to an extractor once."""
    out = extraction.enrichment_run(fx.memories(spark, sf), NOW - 10 * DAY, str.upper)
    return out.select("batch", F.array_join("ids", ",").alias("ids"), F.sha2("answer", 256).alias("answer"))


@query("sleep_job", f"""{W_MV}, X AS (SELECT * FROM MV ORDER BY id LIMIT 100), D AS (SELECT *, greatest(0.01::DOUBLE, least(1.0::DOUBLE, salience * pow(2.0::DOUBLE, -greatest({NOW} - accessed_at_us, 0)::DOUBLE / {7 * DAY}.0::DOUBLE) + 0.1::DOUBLE * ln(1.0::DOUBLE + access_count::DOUBLE))) AS d FROM X)
SELECT 'decay' AS step, count(*) AS n FROM D WHERE abs(d - salience) > 0.001 UNION ALL SELECT 'archive', count(*) FROM X WHERE salience < 0.1 AND {NOW} - created_at_us > {7 * DAY} OR salience < 0.05 AND {NOW} - created_at_us > {30 * DAY} AND access_count < 2
UNION ALL SELECT 'clusters', 0""")
def sleep_job(spark, sf):
    steps = extraction.sleep_job(fx.vector_memories(spark, sf), NOW, 100, 0.99)
    out = None
    for name, df in steps.items():
        n = df.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("arranged_apart", "SELECT * FROM (VALUES (0, 1), (1, 3), (2, 2), (3, 5), (4, 4)) t(pos, id)")
def arranged_apart(spark, sf):
    """1 and 2 conflict, and so do 4 and 2: the order keeps them apart while it can."""
    return rows(spark, enumerate(lifecycle.arrange_apart([1, 2, 3, 4, 5], {(1, 2), (4, 2), (3, 4)})), "pos int, id int")


@query("applied_actions", f"""{W_M} SELECT id, CASE WHEN id % 10 = 3 THEN {NOW} ELSE valid_until_us END AS valid_until_us, round(CASE WHEN id % 14 = 5 THEN 0.25::DOUBLE ELSE confidence END, 6) AS confidence FROM M""")
def applied_actions(spark, sf):
    """Memories after inference on write: ended, or less sure by the least of several weights."""
    m = fx.memories(spark, sf)
    end = m.where("id % 10 = 3").select(F.lit("invalidate").alias("action"), F.col("id").alias("target"), F.lit(1.0).alias("weight"))
    low = m.where("id % 14 = 5").select(F.lit("lower_confidence").alias("action"), F.col("id").alias("target"), F.explode(F.array(F.lit(0.4), F.lit(0.25))).alias("weight"))
    return lifecycle.apply_invalidations(m, end.unionByName(low), NOW).select("id", "valid_until_us", F.round("confidence", 6).alias("confidence"))


@query("policy_run_rows", f"{W_M} SELECT id AS memory_id, CASE WHEN memory_type = 'AntiPattern' THEN 'forget' ELSE 'would_forget' END AS action, CASE WHEN memory_type = 'AntiPattern' THEN 'applied' ELSE 'planned' END AS status FROM M WHERE memory_type IN ('AntiPattern', 'Correction')")
def policy_run_rows(spark, sf):
    m = fx.memories(spark, sf)
    done = policies.policy_actions(m.where("memory_type = 'AntiPattern'"), "run1", "forget", True, NOW)
    return done.unionByName(policies.policy_actions(m.where("memory_type = 'Correction'"), "run2", "forget", False, NOW)).select("memory_id", "action", "status")


@query("context_delta_text", "SELECT 'Since last turn' || chr(10) || chr(10) || '## 🎯 Critical Context' || chr(10) || '- [NEW] Semantic | new and sure' || chr(10) || '## 📋 Primary Context' || chr(10) || '- [NEW] Episodic | new too' AS context")
def context_delta_text(spark, sf):
    schema = "id int, memory_type string, content string, salience double, tags array<string>, score double"
    now = rows(spark, [(1, "Semantic", "served before", 0.9, [], 0.9), (2, "Semantic", "new and sure", 0.9, [], 0.9), (3, "Episodic", "new too", 0.2, [], 0.6)], schema)
    return context.assemble_delta(now.where("id = 1"), now, header="Since last turn")


@query("join_strategies", "SELECT strategy, n, nations FROM (VALUES ('broadcast'), ('merge'), ('shuffle_hash')) t(strategy), (SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM orders JOIN customer ON o_custkey = c_custkey)")
def join_strategies(spark, sf):
    """One equi-join under each physical strategy; without a hint the choice is left to adaptive execution."""
    o, c, out = fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer"), None
    for hint in ("broadcast", "merge", "shuffle_hash"):
        n = o.join(c.hint(hint), o.o_custkey == c.c_custkey).agg(F.lit(hint).alias("strategy"), F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("nations"))
        out = n if out is None else out.unionByName(n)
    return out


# Streams, caches and queues.

FACTS = ((1, "the heat tion"), (2, "ea the and zz"), (3, "qq ww"))


@query("fact_alerts", """WITH F AS (SELECT * FROM (VALUES (1, 'the heat tion'), (2, 'ea the and zz'), (3, 'the and not')) t(fact_id, fact)), T AS (SELECT doc_id AS key, lower(text) AS x FROM documents),
K AS (SELECT *, list_filter(string_split(fact, ' '), lambda w: strlen(w) >= 3) AS kw FROM F), S AS (SELECT key, fact_id, len(list_filter(kw, lambda w: contains(x, w)))::DOUBLE / len(kw) AS share, contains(x, fact) AS verbatim, NEG AS negated FROM T, K)
SELECT key, fact_id, CASE WHEN share > 0.5 AND NOT verbatim AND negated THEN 'contradiction' ELSE 'reinforcement' END AS kind FROM S WHERE share > 0.5 AND NOT verbatim AND negated OR share > 0.8""".replace("NEG", cue_sql("x", tx.NEGATIONS)))
def fact_alerts(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    facts = rows(spark, [(1, "the heat tion"), (2, "ea the and zz"), (3, "the and not")], "fact_id int, fact string")
    return tokens.alerts(docs, docs.select("key").join(F.broadcast(facts)))  # three facts


@query("stream_cognition", """WITH C AS (SELECT conv_id AS stream_id, turn * 4 + 2 AS seq, lower(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn)) AS x FROM conversations),
F AS (SELECT *, list_filter(string_split(fact, ' '), lambda w: strlen(w) >= 3) AS kw FROM (VALUES (1, 'the heat tion'), (2, 'ea the and zz')) t(fact_id, fact)),
S AS (SELECT stream_id, seq, fact_id, len(list_filter(kw, lambda w: contains(x, w)))::DOUBLE / len(kw) AS share, contains(x, fact) AS verbatim, NEG AS negated FROM C, F)
SELECT stream_id, seq, CAST(fact_id AS BIGINT) AS fact_id, CASE WHEN share > 0.5 AND NOT verbatim AND negated THEN 'contradiction' ELSE 'reinforcement' END AS kind FROM S WHERE share > 0.5 AND NOT verbatim AND negated OR share > 0.8
UNION ALL SELECT stream_id, max(seq) + 1, -1, 'buffer_flushed' FROM C GROUP BY stream_id""".replace("NEG", cue_sql("x", tx.NEGATIONS)))
def stream_cognition(spark, sf):
    """Every conversation as a stream of typed rows: two facts first, a token per turn, a flush at the end."""
    c = file_stream(spark, f"{sf}/conversations.parquet")
    last = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    token = F.struct((F.col("turn") * 4 + 2).alias("seq"), F.lit("token").alias("kind"), F.lit(-1).cast("long").alias("fact_id"), "text")
    facts = [F.struct(F.lit(n).cast("long").alias("seq"), F.lit("known_fact").alias("kind"), F.lit(i).cast("long").alias("fact_id"), F.lit(t).alias("text")) for n, (i, t) in enumerate(FACTS[:2])]
    flush = F.struct((F.col("turn") * 4 + 3).alias("seq"), F.lit("flush").alias("kind"), F.lit(-1).cast("long").alias("fact_id"), F.lit("").alias("text"))
    first, end = F.when(F.col("turn") == 0, F.array(*facts)), F.when(F.col("turn") == F.col("last"), F.array(flush))
    none = F.array().cast("array<struct<seq:bigint,kind:string,fact_id:bigint,text:string>>")
    events = c.join(last, "conv_id").select(F.col("conv_id").alias("stream_id"), F.explode(F.concat(F.coalesce(first, none), F.array(token), F.coalesce(end, none))).alias("e")).select("stream_id", "e.*")
    return run_to_end(tokens.cognition(events)).select("stream_id", "seq", "fact_id", "kind")


@query("stream_process_turns", f"""WITH T AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
X AS (SELECT conv_id, turn, 'turn' AS tags, 'User: ' || text || CASE WHEN nr = 'assistant' THEN chr(10) || 'Assistant: ' || nt ELSE '' END AS content FROM T WHERE role = 'user'
UNION ALL SELECT conv_id, turn, 'auto-correction,anti_pattern', 'Correction: ' || text FROM T WHERE role = 'user' AND {cue_sql('lower(text)', tx.CORRECTIONS)}
UNION ALL SELECT conv_id, turn, 'ghost', 'Unconfirmed: ' || substr(text, 1, 300) FROM T WHERE role = 'user' AND {cue_sql('text', tx.SPECULATIONS)} AND {cue_sql('lower(text)', [a for a, _ in tx.ACTIONS])})
SELECT conv_id, turn, tags, sha256(content) AS content FROM X""")
def stream_process_turns(spark, sf):
    """Turns as a stream, stored by a sink; a batch that runs again gives the same ids."""
    from lorebank.runtime import shared_folder

    folder = f"{shared_folder(spark)}/turns-{__import__('uuid').uuid4().hex}"

    def append(found, number: int) -> None:
        found.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    running = file_stream(spark, f"{sf}/conversations.parquet").writeStream.foreachBatch(turns.store_turns(append)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out").dropDuplicates(["id"]).select("conv_id", "turn", F.array_join("tags", ",").alias("tags"), F.sha2("content", 256).alias("content"))


ENTRIES = "session_id int, topic string, context string, memory_ids array<string>, embedding array<double>, used_us long"


@query("cache_hits", "SELECT * FROM (VALUES (1, 'rust build', 1.0::DOUBLE), (2, 'tea time', 0.8::DOUBLE)) t(session_id, topic, score)")
def cache_hits(spark, sf):
    """By words where no entry of a session has a vector, by vectors where one has."""
    own = [(1, "rust build", "c", [], None, NOW), (1, "go", "c", [], None, NOW), (2, "tea time", "c", [], [0.8, 0.6], NOW), (2, "rust build", "c", [], None, NOW), (3, "cake", "c", [], None, NOW)]
    return cache.hits(rows(spark, own, ENTRIES), "rust build", [1.0, 0.0]).select("session_id", "topic", F.round("score", 6).alias("score"))


@query("cache_entries", "SELECT user_id AS session_id, event_type AS topic, max(epoch_us(ts)) AS used_us FROM events GROUP BY user_id, event_type HAVING 1706745600000000 - max(epoch_us(ts)) <= 864000000000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(epoch_us(ts)) DESC, event_type) <= 3")
def cache_entries(spark, sf):
    """Entries of ten days, three a session."""
    e = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("topic")).agg(F.max(F.expr(fx.EPOCH_US.format("ts"))).alias("used_us"))
    return cache.newest_entries(e, NOW, 10 * DAY, 3)


@query("cache_pre_assembled", "SELECT * FROM (VALUES (1, 'known', 'old', ''), (1, 'tea', 'about tea', 'a,b'), (2, 'tea', 'other', '')) t(session_id, topic, context, ids)")
def cache_pre_assembled(spark, sf):
    """A builder is asked once for each predicted topic that has no entry, and may have nothing."""
    own = rows(spark, [(1, "known", "old", [], None, NOW), (2, "tea", "other", [], None, NOW)], ENTRIES)
    built = {"tea": ("about tea", ["a", "b"], [1.0, 0.0]), "nothing": None, "known": ("new", [], None)}
    out = cache.pre_assemble(own, 1, ["tea", "nothing", "known", "tea"], built.get, NOW)
    return out.select("session_id", "topic", "context", F.array_join("memory_ids", ",").alias("ids"))


@query("bounded_calls", "SELECT doc_id, CAST(length(text) AS VARCHAR) AS answer FROM documents")
def bounded_calls_query(spark, sf):
    """An extractor over texts, at most four calls at a time."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return bounded_calls(docs, lambda text: str(len(text))).select("doc_id", "answer")
