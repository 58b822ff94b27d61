from lorebank.operators import expansion as x
from pyspark.sql import functions as F


def test_answers_are_read_leniently():
    assert x.parse_scores("Scores: [3, 11, -1, \"x\"] ok", 5) == [3.0, 10.0, 0.0, 0.0, 0.0]
    assert x.parse_scores("none", 2) == [0.0, 0.0] and x.parse_scores("[1, 2, 3]", 2) == [1.0, 2.0]
    assert x.gap_terms('missing: ["a", "", "b"]') == ["a", "b"] and x.gap_terms("[bad") == []
    assert x.verdict("I would UPDATE, not keep", x.VERDICTS, "keep") == "update" and x.verdict("?", x.VERDICTS, "keep") == "keep"
    assert len(x.preference_queries("tea")) == 4


def test_categorical(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, array('context:health_device'), cast(null as string)), (2, array('x'), '{"category": "Health device, toy"}'), (3, array('x'), '{"category": "toy"}') t(id, tags, attributes)""")
    assert {r.id: float(r.score) for r in x.categorical(rows, ["Health Device"]).collect()} == {1: 1.2, 2: 1.0}
    assert x.categorical(rows, [" "]).count() == 0


def test_judges(spark):
    hits = spark.sql("SELECT * FROM VALUES (1, 0.9D, 'aa'), (2, 0.8D, 'bbb'), (3, 0.7D, 'c') t(id, score, content)")
    judge = lambda prompt: str([len(line.split("] ", 1)[1]) - 1 for line in prompt.split("\n")[2:]])
    assert [r.id for r in x.judged(hits, "q", judge).collect()] == [2, 1]
    assert x.judged(hits, "q", None).count() == 3
    assert [r.id for r in x.cross_encoded(hits, "q", lambda q, ts: [10.0 * len(t) - 25 for t in ts]).orderBy(F.desc("score")).collect()] == [2, 1, 3]
    more = spark.sql("SELECT 9 AS id, 0.5D AS score")
    assert {r.id for r in x.second_round(hits, [more], 4).collect()} == {1, 2, 3, 9}
    assert x.fuse({"main": hits, "recency": more}, 1).head().id == 9
    pairs = spark.sql("SELECT 'n' AS new_content, 'o' AS old_content")
    assert x.write_verdicts(pairs, lambda p: "Invalidate it").head().verdict == "invalidate" and x.write_verdicts(pairs, None).head().verdict == "keep"
