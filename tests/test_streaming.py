"""Streams give what the batch forms give."""

import pytest
from lorebank.sources import fixtures as fx
from lorebank.streaming import cache, tokens, trajectory
from pyspark.sql import functions as F


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def run(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def source(spark, rows, tmp_path, files=2):
    path = str(tmp_path / "in")
    for part in rows:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_transitions(spark, sf, tmp_path, rocks):
    turns = fx.turns(spark, sf).drop("topic").withColumnRenamed("role", "topic").where("conv_id < 6")
    parts = [turns.where("turn < 2"), turns.where("turn >= 2")]
    got = run(trajectory.stream_transitions(source(spark, parts, tmp_path)), "transitions", "update", tmp_path)
    last = got.groupBy("conv_id", "prev", "topic").agg(F.max("n").alias("n")).groupBy("prev", "topic").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, trajectory.transitions(turns).collect()))


def test_token_buffer(spark, tmp_path, rocks, monkeypatch):
    events = [(1, 0, "token", "we "), (1, 1, "token", "do not "), (2, 0, "token", "x"), (1, 2, "end_of_turn", ""), (1, 3, "token", "use Go"), (1, 4, "flush", ""), (1, 5, "token", "new"), (1, 6, "flush", "")]
    df = spark.createDataFrame(events, "stream_id long, seq long, kind string, token string")
    got = run(tokens.buffered(source(spark, [df.where("seq < 2"), df.where("seq >= 2")], tmp_path)), "buffer", "append", tmp_path)
    assert sorted((r.seq, r.text) for r in got.collect()) == [(2, "we do not "), (4, "we do not use Go"), (6, "new")]


def test_alerts(spark):
    texts = spark.createDataFrame([(1, "We do not use Rust anymore"), (2, "We use Rust daily"), (3, "cake")], "key long, text string")
    facts = spark.createDataFrame([(k, "f", "we use rust") for k in (1, 2, 3)] + [(1, "g", "a b")], "key long, fact_id string, fact string")
    got = {(r.key, r.kind) for r in tokens.alerts(texts, facts).collect()}
    assert got == {(1, "contradiction"), (2, "reinforcement")}


def test_served_sets(spark, tmp_path, rocks):
    df = spark.createDataFrame([(1, 0, 10), (1, 0, 11), (1, 1, 11), (1, 1, 12)], "session_id long, turn long, id long")
    got = run(tokens.served_deltas(source(spark, [df.where("turn = 0"), df.where("turn = 1")], tmp_path)), "served", "append", tmp_path)
    assert sorted((r.turn, r.id, r.status) for r in got.collect()) == [(0, 10, "added"), (0, 11, "added"), (1, 10, "removed"), (1, 12, "added")]


def test_sessions_of_a_table(spark, sf):
    e = fx.table(spark, sf, "events")
    out = tokens.event_windows(e.withColumn("ts", F.col("ts").cast("timestamp")))
    assert out.agg(F.sum("events")).head()[0] == e.count()


def test_speculative_cache(spark):
    entries = spark.sql("SELECT * FROM VALUES (1, 'rust async', array(1.0f, 0.0f), 10L), (1, 'go maps', array(0.0f, 1.0f), 9L), (2, 'baking a cake', cast(null as array<float>), 8L), (2, 'old', cast(null as array<float>), 0L) t(session_id, topic, embedding, used_us)")
    fresh = cache.newest_entries(entries, 10, 5)
    assert fresh.count() == 3
    got = {r.session_id: r.topic for r in cache.hits(fresh, "baking a big cake", [0.9, 0.1]).collect()}
    assert got == {1: "rust async", 2: "baking a cake"}


def test_predictions_fill(spark):
    assert trajectory.fill_predictions(["a"], ["q"], "now", "before") == ["a", "q", "now (continued)"]
    assert trajectory.fill_predictions([], [], "now", "before") == ["now (continued)", "now (revisit)"] or trajectory.fill_predictions([], [], "now", "before") == ["now (continued)", "before (revisit)"]
    counts = spark.createDataFrame([("a", "b", 1)], "prev string, topic string, n long")
    assert trajectory.reinforce(counts, "a", "b", True).head().n == 3 and trajectory.reinforce(counts, "a", "b", False).count() == 0
