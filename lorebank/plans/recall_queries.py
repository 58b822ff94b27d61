"""Queries on recall: filters, vector search, BM25, fusion and boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebank.operators import filters, pairs, retrieval
from lorebank.plans import mql
from lorebank.plans.registry import query
from lorebank.sources import fixtures as fx
from lorebank.types import valid_at

NOW = fx.NOW_US
Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = {})"
W_MV, W_M, W_E = f"WITH {fx.MV_SQL}", f"WITH {fx.M_SQL}", f"WITH {fx.E_SQL}"


def vector_of(spark, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The query vector: the embedding of one row."""
    return [float(x) for x in fx.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).head().embedding]


def engine(spark, sf_dir: str, vectors: bool = True, **options) -> mql.Engine:
    rows = fx.vector_memories(spark, sf_dir) if vectors else fx.memories(spark, sf_dir)
    return mql.Engine(rows, fx.edges(spark, sf_dir), NOW, **options)


def near(spark, sf_dir: str) -> str:
    return "[" + ", ".join(map(repr, vector_of(spark, sf_dir))) + "]"


def scored(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", *more, F.round("score", 6).alias("score"))


@query("knn_topk", f"{W_MV}, {Q.format(0)} SELECT id, round(greatest(0, least(1, list_cosine_similarity(embedding, e))), 6) AS score FROM MV, q ORDER BY list_cosine_similarity(embedding, e) DESC, id LIMIT 10")
def knn_topk(spark, sf):
    return scored(retrieval.knn(fx.vector_memories(spark, sf), vector_of(spark, sf), 10))


@query("knn_many", """WITH V AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT q.id AS query, V.id, round(list_cosine_similarity(V.e, q.e), 6) AS score, CAST(row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(V.e, q.e) DESC, V.id) - 1 AS INTEGER) AS rank FROM V, V q WHERE q.id % 20 = 0 QUALIFY rank < 10""")
def knn_many(spark, sf):
    """Many searches in one job: every vector whose id is divisible by 20, against all."""
    v = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return pairs.nearest(v, v.where("id % 20 = 0"), 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("knn_filtered", f"""{W_MV}, {Q.format(0)} SELECT id, memory_type, round(greatest(0, least(1, list_cosine_similarity(embedding, e))), 6) AS score FROM MV, q
WHERE memory_type = 'Semantic' AND salience > 0.2 AND list_contains(tags, 'en') ORDER BY list_cosine_similarity(embedding, e) DESC, id LIMIT 10""")
def knn_filtered(spark, sf):
    return scored(mql.run(f'RECALL memories NEAR {near(spark, sf)} WHERE type = semantic AND salience > 0.2 AND tag = "en" LIMIT 10', engine(spark, sf)), "memory_type")


@query("knn_time_range", f"{W_MV}, {Q.format(3)} SELECT id, round(list_cosine_similarity(embedding, e), 6) AS score FROM MV, q WHERE created_at_us BETWEEN {NOW - 200 * fx.HOUR_US} AND {NOW - 20 * fx.HOUR_US} ORDER BY list_cosine_similarity(embedding, e) DESC, id LIMIT 15")
def knn_time_range(spark, sf):
    rows = filters.candidates(fx.vector_memories(spark, sf), start_us=NOW - 200 * fx.HOUR_US, end_us=NOW - 20 * fx.HOUR_US)
    return scored(retrieval.knn(rows, vector_of(spark, sf, 3), 15, clamped=False))


@query("similar_to_text", f"{W_MV}, {Q.format(5)} SELECT id, round(greatest(0, least(1, list_cosine_similarity(embedding, e))), 6) AS score FROM MV, q WHERE confidence >= 0.5 ORDER BY list_cosine_similarity(embedding, e) DESC, id LIMIT 5")
def similar_to_text(spark, sf):
    own = vector_of(spark, sf, 5)  # stands for an embedder's answer
    return scored(mql.run('RECALL WHERE content ~> "anything" AND confidence >= 0.5 LIMIT 5', engine(spark, sf, embed=lambda _: own)))


@query("normalised_vectors", f"{W_MV} SELECT id, round(sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 5) AS length, len(embedding) AS dims FROM MV")
def normalised_vectors(spark, sf):
    from lorebank.functions.vectors import norm, normalise

    rows = fx.vector_memories(spark, sf)
    return rows.select("id", F.round(norm("embedding") * norm(normalise("embedding")), 5).alias("length"), F.size("embedding").cast("long").alias("dims"))


@query("recall_tag_any", f"{W_M} SELECT id, memory_type FROM M WHERE list_has_any(tags, ['purchase', 'b3'])")
def recall_tag_any(spark, sf):
    return fx.memories(spark, sf).where(filters.tags_any(["purchase", "b3"])).select("id", "memory_type")


@query("recall_tag_all", f"{W_M} SELECT id, memory_type FROM M WHERE list_contains(tags, 'click') AND list_contains(tags, 'b2') ORDER BY id LIMIT 20")
def recall_tag_all(spark, sf):
    return mql.run('RECALL WHERE tag = "click" AND tag = "b2"', engine(spark, sf, False)).select("id", "memory_type")


@query("tags_repeated_request", f"{W_M} SELECT 'once' AS request, id FROM M WHERE list_contains(tags, 'click') UNION ALL SELECT 'two', id FROM M WHERE list_contains(tags, 'click') AND list_contains(tags, 'b1')")
def tags_repeated_request(spark, sf):
    """A request that repeats a tag matches nothing, where its parts match."""
    m, out = fx.memories(spark, sf), None
    for name, tags in (("once", ["click"]), ("two", ["click", "b1"]), ("repeated", ["click", "click"]), ("none", [])):
        rows = m.where(filters.tags_all(tags)).select(F.lit(name).alias("request"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("tag_prefix", f"{W_M} SELECT id FROM M WHERE len(list_filter(tags, lambda t: starts_with(t, 'pur'))) > 0")
def tag_prefix(spark, sf):
    return fx.memories(spark, sf).where(filters.tag_prefix("pur")).select("id")


@query("recall_time_range", f"{W_M} SELECT id, created_at_us FROM M WHERE created_at_us > epoch_us(TIMESTAMP '2024-01-10') AND created_at_us <= epoch_us(TIMESTAMP '2024-01-12 06:00:00') ORDER BY created_at_us, id LIMIT 500")
def recall_time_range(spark, sf):
    return mql.run('RECALL WHERE created > "2024-01-10" AND created <= "2024-01-12T06:00:00" ORDER BY created LIMIT 500', engine(spark, sf, False)).select("id", "created_at_us")


@query("recall_full_filter", f"{W_M} SELECT id, round(salience, 6) AS salience, round(confidence, 6) AS confidence FROM M WHERE salience > 0.3 AND confidence >= 0.55 AND memory_type = 'Procedural' AND agent_id <> 7 ORDER BY salience DESC, id LIMIT 50")
def recall_full_filter(spark, sf):
    return mql.run("RECALL memories WHERE salience > 0.3 AND confidence >= 0.55 AND type = procedural AND agent != 7 ORDER BY salience DESC LIMIT 50", engine(spark, sf, False)).select("id", F.round("salience", 6).alias("salience"), F.round("confidence", 6).alias("confidence"))


@query("recall_default_limit", f"{W_M} SELECT id FROM M ORDER BY id LIMIT 20")
def recall_default_limit(spark, sf):
    return mql.run("RECALL memories", engine(spark, sf, False)).select("id")


@query("recall_space", f"{W_M} SELECT id, space_id FROM M WHERE space_id = 2 AND salience < 0.01 ORDER BY id LIMIT 20")
def recall_space(spark, sf):
    return mql.run(r'RECALL WHERE space = 2 AND salience < 0.01', engine(spark, sf, False)).select("id", "space_id")


@query("point_lookup", f"{W_M} SELECT id, agent_id, memory_type, content, created_at_us, array_to_string(tags, ',') AS tags FROM M WHERE id = 77")
def point_lookup(spark, sf):
    return fx.memories(spark, sf).where("id = 77").select("id", "agent_id", "memory_type", "content", "created_at_us", F.array_join("tags", ",").alias("tags"))


@query("count_all", f"{W_M} SELECT count(*) AS n FROM M")
def count_all(spark, sf):
    return fx.memories(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@query("scan_edges", f"{W_E} SELECT source, target, edge_type, round(weight, 6) AS weight, valid_until_us FROM E")
def scan_edges(spark, sf):
    return fx.edges(spark, sf).select("source", "target", "edge_type", F.round("weight", 6).alias("weight"), "valid_until_us")


AT = NOW - 20 * fx.DAY_US


@query("valid_at", f"{W_M} SELECT id FROM M WHERE valid_from_us <= {AT} AND (valid_until_us IS NULL OR {AT} < valid_until_us)")
def valid_at_query(spark, sf):
    return fx.memories(spark, sf).where(valid_at(AT)).select("id")


SUPPRESSED = "S AS (SELECT DISTINCT target FROM E WHERE edge_type IN ('Supersedes', 'Contradicts') AND coalesce(valid_from_us, 0) <= {0} AND (valid_until_us IS NULL OR {0} < valid_until_us))".format(NOW)


@query("supersede_suppression", f"{W_MV}, {fx.E_SQL}, {SUPPRESSED} SELECT id FROM MV WHERE id NOT IN (SELECT target FROM S)")
def supersede_suppression(spark, sf):
    return filters.without_suppressed(fx.vector_memories(spark, sf), fx.edges(spark, sf), NOW).select("id")


@query("archived_hidden", f"{W_M} SELECT id FROM (SELECT id, CASE WHEN id % 9 = 0 THEN list_append(tags, 'archived') ELSE tags END AS tags FROM M) WHERE NOT list_contains(tags, 'archived')")
def archived_hidden(spark, sf):
    rows = fx.memories(spark, sf).withColumn("tags", F.when(F.col("id") % 9 == 0, F.array_append("tags", F.lit("archived"))).otherwise(F.col("tags")))
    return rows.where(filters.visible()).select("id")


def bm25_sql(terms: list[str], name: str = "BM") -> str:
    """Explicit BM25 over MV with all terms required."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avglen))" for i in range(len(terms)))
    need = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{name}_c AS (SELECT id, len(w)::DOUBLE AS len, {tf} FROM (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM MV)),
{name}_s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avglen, {df} FROM {name}_c),
{name} AS (SELECT id, {part} AS score FROM {name}_c, {name}_s WHERE {need})"""


@query("bm25_topk", f"{W_MV}, {bm25_sql(['the', 'inea'])} SELECT id, round(score, 6) AS score FROM BM ORDER BY BM.score DESC, id LIMIT 20")
def bm25_topk(spark, sf):
    return scored(retrieval.top(retrieval.bm25(fx.vector_memories(spark, sf), "the inea"), "score", 20))


def hybrid_sql(where: str = "true", k: int = 10, tail: str = "") -> str:
    return f"""{bm25_sql(['the', 'inea'])}, {Q.format(0)},
V AS (SELECT id, row_number() OVER (ORDER BY list_cosine_similarity(embedding, e) DESC, id) - 1 AS rank FROM MV, q WHERE {where} QUALIFY rank < {4 * k}),
B AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM BM WHERE id IN (SELECT id FROM MV WHERE {where}) QUALIFY rank < {4 * k}),
R AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT * FROM V UNION ALL SELECT * FROM B) GROUP BY id),
H AS (SELECT R.id, 0.7::DOUBLE * rrf + 0.05::DOUBLE * salience + 0.01::DOUBLE AS score FROM R JOIN MV USING (id) ORDER BY score DESC, id LIMIT {k}){tail}"""


@query("hybrid_rrf", f"{W_MV}, {hybrid_sql()} SELECT id, round(score, 6) AS score FROM H")
def hybrid_rrf(spark, sf):
    return scored(retrieval.hybrid(fx.vector_memories(spark, sf), vector_of(spark, sf), "the inea", 10))


@query("hybrid_rrf_tags", f"{W_MV}, {hybrid_sql(where='list_contains(tags, $$en$$)')} SELECT id, round(score, 6) AS score FROM H".replace("$$", "'"))
def hybrid_rrf_tags(spark, sf):
    return scored(retrieval.hybrid(fx.vector_memories(spark, sf), vector_of(spark, sf), "the inea", 10, tags=["en"]))


@query("trace_explain", f"{W_MV}, {hybrid_sql()} SELECT H.id, round(score, 6) AS score, V.rank AS vector_rank, B.rank AS bm25_rank, salience FROM H JOIN MV USING (id) LEFT JOIN V USING (id) LEFT JOIN B USING (id)")
def trace_explain(spark, sf):
    rows = retrieval.hybrid(fx.vector_memories(spark, sf), vector_of(spark, sf), "the inea", 10, trace=True)
    return rows.select("id", F.round("score", 6).alias("score"), F.col("vector_rank").cast("long").alias("vector_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), "salience")


@query("recall_hybrid_at", f"""{W_MV}, {fx.E_SQL}, {SUPPRESSED}, {hybrid_sql(k=60)}
SELECT H.id, round(score, 6) AS score FROM H JOIN MV USING (id) WHERE id NOT IN (SELECT target FROM S) AND (valid_until_us IS NULL OR {NOW} < valid_until_us) ORDER BY H.score DESC, id LIMIT 20""")
def recall_hybrid_at(spark, sf):
    return scored(retrieval.recall(fx.vector_memories(spark, sf), fx.edges(spark, sf), vector_of(spark, sf), "the inea", 20, NOW))


def multi_sql(k: int = 10) -> str:
    lists = ",\n".join(f"L{v} AS (SELECT id, row_number() OVER (ORDER BY list_cosine_similarity(embedding, e) DESC, id) - 1 AS rank FROM MV, (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = {v}) QUALIFY rank < 30)" for v in (0, 1, 2))
    return f"{W_MV}, {lists} SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM L0 UNION ALL SELECT * FROM L1 UNION ALL SELECT * FROM L2) GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + rank)) DESC, id LIMIT {k}"


@query("multi_query_rrf", multi_sql())
def multi_query_rrf(spark, sf):
    rows = fx.vector_memories(spark, sf)
    lists = [retrieval.knn(rows, vector_of(spark, sf, v), 30, clamped=False).select("id", "score") for v in (0, 1, 2)]
    return scored(retrieval.multi_query(lists, 10))


@query("weighted_fusion", multi_sql(15).replace("SELECT * FROM L1 UNION ALL SELECT * FROM L2", "SELECT id, rank FROM L1 UNION ALL SELECT id, rank FROM L2").replace("1.0::DOUBLE / (60 + rank)", "w / (60 + rank)").replace("SELECT * FROM L0", "SELECT *, 1.0::DOUBLE AS w FROM L0").replace("SELECT id, rank FROM L1", "SELECT *, 0.4::DOUBLE AS w FROM L1").replace("SELECT id, rank FROM L2", "SELECT *, 1.8::DOUBLE AS w FROM L2"))
def weighted_fusion(spark, sf):
    rows = fx.vector_memories(spark, sf)
    lists = [(retrieval.ranked(retrieval.knn(rows, vector_of(spark, sf, v), 30, clamped=False)), w) for v, w in ((0, 1.0), (1, 0.4), (2, 1.8))]
    return scored(retrieval.top(retrieval.rrf(lists).withColumnRenamed("rrf", "score"), "score", 15))


DECAYED = f"greatest(0.01::DOUBLE, least(1.0::DOUBLE, salience * power(2.0::DOUBLE, -(greatest({NOW} - accessed_at_us, 0)::DOUBLE / {7 * fx.DAY_US}.0::DOUBLE)) + 0.1::DOUBLE * ln(1.0::DOUBLE + access_count::DOUBLE)))"


@query("decay_blend", f"{W_MV}, {Q.format(0)}, K AS (SELECT *, list_cosine_similarity(embedding, e) AS s FROM MV, q ORDER BY s DESC, id LIMIT 25) SELECT id, round(0.7::DOUBLE * s + 0.3::DOUBLE * {DECAYED}, 6) AS score FROM K")
def decay_blend(spark, sf):
    rows = fx.vector_memories(spark, sf)
    return scored(retrieval.blend_decay(retrieval.knn(rows, vector_of(spark, sf), 25, clamped=False).select("id", "score"), rows, NOW))


@query("always_scope", f"{W_MV}, {Q.format(0)}, K AS (SELECT id, list_cosine_similarity(embedding, e) AS s FROM MV, q ORDER BY s DESC, id LIMIT 10) SELECT id, round(s, 6) AS score FROM K UNION ALL SELECT id, 0.85::DOUBLE FROM MV WHERE id % 50 = 0 AND id NOT IN (SELECT id FROM K)")
def always_scope(spark, sf):
    rows = fx.vector_memories(spark, sf).withColumn("tags", F.when(F.col("id") % 50 == 0, F.array_append("tags", F.lit("scope:always"))).otherwise(F.col("tags")))
    return scored(retrieval.append_always(retrieval.knn(rows, vector_of(spark, sf), 10, clamped=False), rows))


@query("recency_boost", f"{W_M} SELECT id, round(salience + least(created_at_us::DOUBLE / {NOW}.0::DOUBLE, 1.0::DOUBLE) * 0.1::DOUBLE, 6) AS score FROM M")
def recency_boost(spark, sf):
    return fx.memories(spark, sf).select("id", F.round(retrieval.recency_boost(F.col("salience"), F.col("created_at_us"), NOW), 6).alias("score"))


@query("proximity_boost", f"{W_M} SELECT id, round(salience + exp(-pow(abs(created_at_us - {AT})::DOUBLE / 86400000000.0::DOUBLE, 2) / 25.0::DOUBLE) * 0.04::DOUBLE, 6) AS score FROM M")
def proximity_boost(spark, sf):
    return fx.memories(spark, sf).select("id", F.round(retrieval.proximity_boost(F.col("salience"), F.col("created_at_us"), AT), 6).alias("score"))


@query("recency_list", f"{W_MV}, {Q.format(0)}, K AS (SELECT id, created_at_us FROM MV, q ORDER BY list_cosine_similarity(embedding, e) DESC, id LIMIT 40) SELECT id, created_at_us FROM K ORDER BY created_at_us DESC, id LIMIT 15")
def recency_list(spark, sf):
    rows = fx.vector_memories(spark, sf)
    return retrieval.newest(retrieval.knn(rows, vector_of(spark, sf), 40, clamped=False).select("id", "score"), rows).select("id", "created_at_us")


@query("spreading_activation", f"""{W_MV}, {fx.E_SQL}, {Q.format(0)},
S AS (SELECT id, s FROM (SELECT id, list_cosine_similarity(embedding, e) AS s FROM MV, q ORDER BY s DESC, id LIMIT 5) WHERE s > 0.3),
U AS (SELECT source, target FROM E UNION SELECT target, source FROM E),
A1 AS (SELECT target AS id, max(s) * 0.85::DOUBLE AS a FROM S JOIN U ON id = source WHERE target NOT IN (SELECT id FROM S) GROUP BY target HAVING max(s) * 0.85::DOUBLE >= 0.3),
A2 AS (SELECT target AS id, max(a) * 0.85::DOUBLE AS a FROM A1 JOIN U ON id = source WHERE target NOT IN (SELECT id FROM S) AND target NOT IN (SELECT id FROM A1) GROUP BY target HAVING max(a) * 0.85::DOUBLE >= 0.3)
SELECT id, round(s, 6) AS activation, 0 AS hop FROM S UNION ALL SELECT id, round(a, 6), 1 FROM A1 UNION ALL SELECT id, round(a, 6), 2 FROM A2""")
def spreading_activation(spark, sf):
    return retrieval.spreading_activation(fx.vector_memories(spark, sf), fx.edges(spark, sf), vector_of(spark, sf)).select("id", F.round("activation", 6).alias("activation"), "hop")


@query("entity_expansion", f"""{W_MV}, {fx.E_SQL}, {Q.format(0)}, K AS (SELECT id, list_cosine_similarity(embedding, e) AS s FROM MV, q ORDER BY s DESC, id LIMIT 10),
U AS (SELECT source, target FROM E UNION ALL SELECT target, source FROM E)
SELECT id, round(max(s), 6) AS score FROM (SELECT id, s FROM K UNION ALL SELECT target, s * 0.9::DOUBLE FROM K JOIN U ON id = source) GROUP BY id""")
def entity_expansion(spark, sf):
    return scored(retrieval.expand_neighbours(retrieval.knn(fx.vector_memories(spark, sf), vector_of(spark, sf), 10, clamped=False), fx.edges(spark, sf)))


@query("rerank_blend", f"""{W_MV}, {Q.format(0)}, K AS (SELECT id, list_cosine_similarity(embedding, e) AS s, (id % 7)::DOUBLE - 3.0::DOUBLE AS c FROM MV, q ORDER BY s DESC, id LIMIT 30)
SELECT id, round(0.7::DOUBLE * s / (SELECT max(s) FROM K) + 0.3::DOUBLE / (1.0::DOUBLE + exp(-c)), 6) AS score FROM K""")
def rerank_blend(spark, sf):
    hits = retrieval.knn(fx.vector_memories(spark, sf), vector_of(spark, sf), 30, clamped=False)
    return scored(retrieval.blend_rerank(hits.withColumn("cross_score", (F.col("id") % 7).cast("double") - 3.0)))
