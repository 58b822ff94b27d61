"""Streams run to their end over the driver's tables; the oracles are the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebank.plans.recall_queries import W_M
from lorebank.plans.registry import query
from lorebank.sources import fixtures as fx
from lorebank.streaming import tokens, trajectory
from lorebank.streaming.runner import file_stream, run_to_end


@query("stream_transitions", f"WITH {fx.T_SQL}, P AS (SELECT lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, role AS topic, conv_id FROM T) SELECT conv_id, prev, topic, count(*) AS n FROM P WHERE prev IS NOT NULL GROUP BY conv_id, prev, topic")
def stream_transitions(spark, sf):
    turns = file_stream(spark, f"{sf}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("topic"))
    counts = run_to_end(trajectory.stream_transitions(turns), "update")
    return counts.groupBy("conv_id", "prev", "topic").agg(F.max("n").alias("n"))


@query("stream_token_text", """SELECT conv_id AS stream_id, turn * 2 + 1 AS seq, sha256(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn)) AS text FROM conversations""")
def stream_token_text(spark, sf):
    turns = file_stream(spark, f"{sf}/conversations.parquet")
    kinds = F.array(F.struct(F.lit(0).cast("long").alias("k"), F.lit("token").alias("kind")), F.struct(F.lit(1).cast("long").alias("k"), F.lit("end_of_turn").alias("kind")))
    events = turns.select(F.col("conv_id").alias("stream_id"), "turn", "text", F.explode(kinds).alias("e")).select("stream_id", (F.col("turn") * 2 + F.col("e.k")).alias("seq"), "e.kind", F.when(F.col("e.k") == 0, F.col("text")).otherwise("").alias("token"))
    return run_to_end(tokens.buffered(events)).select("stream_id", "seq", F.sha2("text", 256).alias("text"))


@query("stream_served_deltas", """WITH S AS (SELECT DISTINCT user_id AS session_id, (event_id // 100) AS turn, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS id FROM events),
O AS (SELECT session_id, turn, lag(turn) OVER (PARTITION BY session_id ORDER BY turn) AS prev FROM (SELECT DISTINCT session_id, turn FROM S))
SELECT S.session_id, S.turn, S.id, 'added' AS status FROM S JOIN O USING (session_id, turn) LEFT JOIN S p ON p.session_id = S.session_id AND p.turn = O.prev AND p.id = S.id WHERE p.id IS NULL
UNION ALL SELECT O.session_id, O.turn, p.id, 'removed' FROM O JOIN S p ON p.session_id = O.session_id AND p.turn = O.prev LEFT JOIN S n ON n.session_id = O.session_id AND n.turn = O.turn AND n.id = p.id WHERE n.id IS NULL""")
def stream_served_deltas(spark, sf):
    kind = F.create_map(*[x for k, v in (("view", 0), ("click", 1), ("purchase", 2), ("error", 3), ("signup", 4)) for x in (F.lit(k), F.lit(v).cast("long"))])
    rows = file_stream(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("session_id"), F.floor(F.col("event_id") / 100).alias("turn"), F.element_at(kind, F.col("event_type")).alias("id"))
    return run_to_end(tokens.served_deltas(rows)).select("session_id", "turn", "id", "status")


@query("stream_event_counts", f"{W_M} SELECT memory_type, count(*) AS n, round(sum(salience), 4) AS salience FROM M GROUP BY memory_type")
def stream_event_counts(spark, sf):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'Episodic' WHEN 'click' THEN 'Semantic' WHEN 'purchase' THEN 'Procedural' WHEN 'error' THEN 'AntiPattern' ELSE 'Correction' END")
    rows = file_stream(spark, f"{sf}/events.parquet").select(kind.alias("memory_type"), F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("salience"))
    counts = run_to_end(rows.groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"), F.sum("salience").alias("salience")), "update")
    last = counts.groupBy("memory_type").agg(F.max_by(F.struct("n", "salience"), "n").alias("x"))
    return last.select("memory_type", "x.n", F.round("x.salience", 4).alias("salience"))
