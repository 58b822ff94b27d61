"""Literal expectations of filters, lifecycle, context and text operators."""

import math

import pytest
from lorebank.functions import text as tx
from lorebank.functions import vectors as vx
from lorebank.operators import context, filters, lifecycle, policies, retrieval, signals
from lorebank.sources import store
from pyspark.sql import functions as F

DAY = 86_400_000_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_cosine_of_odd_vectors(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, array(1.0f, 0.0f)), (2, array(0.0f, 0.0f)), (3, array(1.0f)), (4, cast(array() as array<float>)), (5, cast(null as array<float>)) t(id, e)")
    for query in ([1.0, 0.0], [0.5] * 200):
        got = {r.id: r.c for r in rows.select("id", vx.cosine_to("e", query).alias("c")).collect()}
        assert got[2] == got[3] == got[4] == 0.0 and got[1] == (1.0 if len(query) == 2 else 0.0)
    assert one(spark, vx.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)))) == pytest.approx(0.96)


def test_tag_rules(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, array('a', 'b')), (2, array('a')), (3, cast(null as array<string>)), (4, array('a', 'archived')) t(id, tags)")
    pick = lambda c: sorted(r.id for r in rows.where(c).collect())
    assert pick(filters.tags_any(["b", "z"])) == [1] and pick(filters.tags_all(["a", "b"])) == [1]
    assert pick(filters.tags_all([])) == pick(filters.tags_all(["a", "a"])) == []
    assert pick(filters.visible()) == [1, 2, 3] and pick(filters.visible(["archived"])) == [1, 2, 3, 4]


def test_bm25_needs_every_term(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'Rust is fast'), (2, 'rust and go'), (3, 'go fast go'), (4, cast(null as string)) t(id, content)")
    assert [r.id for r in retrieval.bm25(rows, "rust FAST").collect()] == [1]
    assert retrieval.bm25(rows, " ?! ").count() == 0
    assert {r.id for r in retrieval.bm25(rows, "go").collect()} == {2, 3}


def test_recall_hides_what_is_not_current(spark):
    rows = spark.sql("""SELECT id, array(1.0f, cast(id as float) / 10) AS embedding, 'x' AS content, tags, 0.5D AS salience, 0L AS created_at_us, 0L AS valid_from_us, until AS valid_until_us
      FROM VALUES (1L, array('a'), cast(null as bigint)), (2L, array('a'), 5L), (3L, array('archived'), null), (4L, array('a'), null) t(id, tags, until)""")
    edges = spark.sql("SELECT 1L AS source, 4L AS target, 'Supersedes' AS edge_type, 0L AS valid_from_us, cast(null as bigint) AS valid_until_us")
    got = lambda at, **k: [r.id for r in retrieval.recall(rows, edges, [1.0, 0.0], None, 3, at, **k).collect()]
    assert got(10) == [1] and got(4) == [1, 2] and sorted(got(10, tags=["archived"])) == [3]
    boost = spark.sql("SELECT 1L AS id, 9.0D AS boost")
    assert retrieval.recall(rows, edges, [1.0, 0.0], None, 3, 10, boost=boost).head().score > 9


def test_decay_literals(spark):
    d = lambda s, age_days, n: one(spark, retrieval.decay(F.lit(s), F.lit(0), F.lit(n), age_days * DAY))
    assert d(1.0, 7, 0) == pytest.approx(0.5) and d(0.8, 0, 0) == pytest.approx(0.8) and d(0.001, 100, 0) == 0.01
    assert d(0.5, 7, 9) == pytest.approx(0.25 + 0.1 * math.log(10)) and d(1.0, 0, 99) == 1.0


def test_facts_and_text_rules(spark):
    rows = [r.x for r in spark.range(1).select(F.explode(tx.facts(F.lit("Team uses Rust. They switched to Go. is x. A prefers B is C"))).alias("x")).collect()]
    assert [(r.subject, r.predicate, r.object) for r in rows] == [("Team", "uses", "Rust"), ("They", "switched_to", "Go"), ("A prefers B", "is", "C"), ("A", "prefers", "B is C")]
    assert one(spark, tx.token_estimate(F.lit(" a  b\nc "))) == 4 and one(spark, tx.token_estimate(F.lit("  "))) == 0
    assert one(spark, tx.sentiment(F.lit("great great bad x"))) == 0.25 and one(spark, tx.sentiment(F.lit(""))) == 0.0
    assert one(spark, tx.query_ngrams(F.lit("What's (up), Doc?"), 2)) == ["what's", "up", "doc", "what's up", "up doc"]
    assert one(spark, tx.amount(F.lit("about $1,200.50!"))) == 1200.5 and one(spark, tx.money(F.lit(30.0))) == "$30" and one(spark, tx.money(F.lit(2.5))) == "$2.50"
    assert tuple(one(spark, tx.evidence_span(F.lit("b"), F.lit("éab")))) == (3, 4) and one(spark, tx.evidence_span(F.lit("z"), F.lit("ab"))) is None
    assert one(spark, tx.jaccard(F.lit("a bb cc"), F.lit("BB dd"))) == pytest.approx(1 / 3)


def test_compression():
    text = "Actually we decided on Rust. It was sunny. We must ship it very soon.\n\nSecond part. nothing"
    assert lifecycle.compress_text(text) == "we decided on Rust. We must ship it soon. Second part"
    assert lifecycle.compress_text("") == ""


def test_greedy_budget_skips_and_goes_on(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 0.9D, 'a b c d e f g h'), (2, 0.8D, 'a b c d e f g h i j'), (3, 0.7D, 'x'), (4, 0.1D, '') t(id, score, content)").withColumn("memory_type", F.lit("Semantic")).withColumn("salience", F.lit(0.125)).withColumn("tags", F.array())
    assert sorted(r.id for r in context.fill_budget(rows, 14).collect()) == [1, 3, 4]
    text = context.assemble(rows, 14, "compact").head()[0]
    assert text.split("\n")[0] == "# 📋 Primary Context" and "M|Semantic|0.13|x" in text and "# 🔁 Summary & Reinforcement" in text
    keyed = rows.withColumn("k", F.col("id") % 2)
    assert sorted(r.id for r in context.fill_budget(keyed, 14, ["k"]).collect()) == [1, 2, 3, 4]
    gone = context.delta_text(context.delta(rows.where("id < 3"), rows.where("id > 1")), rows).head()[0]
    assert gone == "[NEW] x\n[NEW] \n[REMOVED] a b c d e f g h\n[UNCHANGED] 1 memories from previous turn"
    assert context.assemble_delta(rows.where("id < 3"), rows, header="H").head()[0].startswith("H\n\n## 📋 Primary Context\n- [NEW] Semantic | x")


def test_greedy_budget_equals_a_plain_fill(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice([0.1, 0.5, 0.9, rng.random()]), " ".join("w" * rng.choice([0, 1, 1, 2, 3, 5, 8, 20, 60]))) for i in range(400)]
    df = spark.createDataFrame(rows + [(400, 0.2, None)], "id long, score double, content string")
    for budget in (0, 1, 7, 40, 333):
        left, want = budget, {400}
        for i, _, text in sorted(rows, key=lambda r: (-r[1], r[0])):
            cost = math.ceil(len(text.split()) * 1.3)
            if cost <= left:
                left -= cost
                want.add(i)
        assert {r.id for r in context.fill_budget(df, budget).collect()} == want


def test_write_inference_rules(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1L, array(1.0f, 0.0f), 'Semantic', 'a', 'old', 1L, 0.8D), (2L, array(1.0f, 0.01f), 'Semantic', 'a', 'new', 2L, 0.8D), (3L, array(1.0f, 0.9f), 'Correction', 'b', 'fix', 3L, 0.1D)
      t(id, embedding, memory_type, agent_id, content, created_at_us, confidence)""")
    met = lifecycle.new_against_existing(rows.where("id > 1"), rows, 0.5)
    actions = lifecycle.write_inference(met, rows)
    got = sorted((r.action, r.source, r.target) for r in actions.collect())
    assert ("contradicts", 2, 1) in got and ("mark_obsolete", 2, 1) in got and ("invalidate", 2, 1) in got and ("related", 3, 1) in got
    assert [x for x in got if x[0] == "supersedes"] == [("supersedes", 3, 2)]
    kinds = sorted((r.edge_type, r.source, r.target) for r in lifecycle.actions_to_edges(actions, 9).collect())
    assert kinds.count(("Supersedes", 2, 1)) == 2
    after = {r.id: r for r in lifecycle.apply_invalidations(rows.withColumn("valid_until_us", F.lit(None).cast("long")), actions, 9).collect()}
    assert after[1].valid_until_us == 9 and after[2].confidence == pytest.approx(0.4) and after[3].valid_until_us is None


def test_policies(spark):
    with pytest.raises(ValueError):
        policies.forget_scope("planet", 1, spark.range(1))
    acl = spark.createDataFrame([(1, 5, "Read")], "space_id long, agent_id long, permission string")
    granted = policies.grant(acl, 1, 5, "Admin")
    assert [r.permission for r in granted.collect()] == ["Admin"] and policies.revoke(granted, 1, 5).count() == 0
    versions = spark.createDataFrame([(1, 1, 0, 1, 0.5), (1, 2, 900_000, 2, 0.5), (1, 1, 1_900_001, 3, 0.4), (2, 1, 0, 4, 0.1)], "memory_id long, agent long, ts_us long, uid long, confidence double")
    assert [(r.first, r.second) for r in policies.conflicts(versions).collect()] == [(1, 2)]
    assert {r.memory_id: r.uid for r in policies.resolve_surest(versions).collect()} == {1: 2, 2: 4}


def test_signals(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'disk full', 0.8D, array('disk', 'Deploy'), 0.0D, 0L), (2, 'none', 1.0D, array('zzz'), 0.0D, 0L) t(id, description, intensity, triggers, decay_rate, created_at_us)")
    scored = signals.pain_scores(rows, ["the DISK is", "x"], 5)
    assert [(r.id, r.score) for r in scored.collect()] == [(1, 0.4)]
    assert signals.pain_warnings(scored).head().warning == "CAUTION: disk full (pain: 0.80). Triggers: [disk, Deploy]"
    assert signals.heuristic_gaps('The "quick fix" uses Kubernetes Cluster and my_lib v1.2', stop_words=["the"]) == ["quick fix", "Kubernetes Cluster", "my_lib", "v1.2"]
    gaps = signals.registry_gaps(spark.sql("SELECT 1 AS id, 'we run Big Table and redis' AS content"), spark.sql("SELECT explode(array('big table', 'Redis', 'kafka')) AS term"), spark.sql("SELECT 'redis' AS term"))
    assert [tuple(r) for r in gaps.collect()] == [(1, "big table", "High")]
    assert one(spark, signals.follow_up_words(F.lit("The Anna met (Berlin) Bob again, Anna"))) == ["Anna", "Berlin"]
    i = signals.intent("In what order did I visit last month?")
    assert i.temporal and i.ordering and not i.preference
    ref = 1_706_745_600_000_000  # a Thursday
    assert signals.days_back("what about 3 weeks ago?", ref) == 21 and signals.days_back("last Saturday", ref) == 5 and signals.days_back("last thursday", ref) == 7
    assert signals.days_back("two months ago", ref) == 60 and signals.days_back("a week ago", ref) == 7 and signals.days_back("hello", ref) is None
    target, start, end = signals.time_window("10 days ago", ref)
    assert (ref - target, target - start, end - target) == (10 * DAY, 5 * DAY, 5 * DAY)
    assert signals.ordering_window("order of the past three months", ref) == (ref - 90 * DAY, ref)


def test_arrange_apart():
    assert lifecycle.arrange_apart([1, 2, 3, 4], {(1, 2), (3, 4)}) == [1, 3, 2, 4]
    assert lifecycle.arrange_apart([1, 2], {(1, 2)}) == [1, 2] and lifecycle.arrange_apart([], set()) == []


def test_packing_lines_and_turns(spark):
    assert list(store.pack_lines(" a \n\nbb\nccccccc\nd", 4)) == ["a\nbb", "cccc", "ccc", "d"] or list(store.pack_lines(" a \n\nbb\nccccccc\nd", 4)) == ["a\nbb", "cccc", "ccc\nd"]
    rows = store.split_turns(spark.createDataFrame([(1, "User: a long enough line\nAssistant: ok\nnoise that is long enough")], "id long, content string")).collect()
    assert [(r.pos, r.tags) for r in rows] == [(0, ["turn", "turn:user"])]
    chunks = store.ingest_text(spark.createDataFrame([("s", "one\ntwo")], "source string, content string"), 3).collect()
    assert [(r.chunk_index, r.content, r.tags[1]) for r in chunks] == [(0, "one", "source:s"), (1, "two", "source:s")]
    with pytest.raises(Exception, match="does not have 2 values"):
        store.check_dimension(spark.sql("SELECT array(1.0f) AS embedding"), 2).collect()
