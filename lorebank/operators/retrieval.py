"""Ranked retrieval: exact vector search, BM25, rank fusion and the boosts built on them.

Every list that is ranked by a window over all of its rows has been cut by a limit first; the cut is
a partial top-k in each task. Word statistics are one pass over the texts that looks for the query's
words only, so no text is exploded or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank.functions.vectors import clamp, cosine_to
from lorebank.operators import filters

# Constants of the rankers.
RRF_K = 60
OVERFETCH, RECALL_OVERFETCH = 4, 3
RRF_WEIGHT, SALIENCE_WEIGHT, RECENCY_WEIGHT, RECENCY_PRIOR = 0.7, 0.05, 0.02, 0.5
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
DECAY_BLEND = 0.3

TOKEN = r"[\p{L}\p{N}]+"


def top(rows: DataFrame, score: str, k: int, key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(score), F.col(key)).limit(k)


def knn(rows: DataFrame, query: Sequence[float], k: int, clamped: bool = True) -> DataFrame:
    """Exact top k by cosine; ties by id."""
    score = cosine_to("embedding", query)
    return top(rows.where(F.col("embedding").isNotNull()).withColumn("score", clamp(score) if clamped else score), "score", k)


def query_terms(text: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", text.lower())))


def whole(term: str) -> str:
    """Pattern of a term that is a maximal run of letters and digits."""
    return rf"(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])"


def bm25(rows: DataFrame, text: str, content: str = "content") -> DataFrame:
    """id and score of the rows with every query term; rows' own statistics, higher is better.

    Counts of terms, rows and lengths are one aggregate over all rows; a query without a term matches
    nothing.
    """
    terms = query_terms(text)
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    lower = F.lower(content)

    def holds(term: str) -> Column:
        """The term as a whole token; the plain substring test comes first, as it is cheap."""
        return lower.contains(term) & lower.rlike(whole(term))

    length = F.regexp_count(lower, F.lit(TOKEN)).cast("double")
    stats = rows.agg(F.count(content).cast("double").alias("n"), F.avg(length).alias("avglen"), *[F.sum(F.when(holds(t), 1.0).otherwise(0.0)).alias(f"df{i}") for i, t in enumerate(terms)])
    matched = rows
    for t in terms:
        matched = matched.where(holds(t))
    counted = matched.select("id", length.alias("len"), *[F.regexp_count(lower, F.lit(whole(t))).cast("double").alias(f"tf{i}") for i, t in enumerate(terms)])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
        score = score + idf * tf * F.lit(BM25_K1 + 1) / (tf + F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("len") / F.col("avglen")))
    return counted.join(F.broadcast(stats)).select("id", score.alias("score"))  # the statistics are one row


def ranked(rows: DataFrame, score: str = "score", key: str = "id") -> DataFrame:
    """0-based rank of a list that is already cut."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.col(key))) - 1)


def rrf(lists: Sequence[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """id and rrf: the weighted sum of 1 / (k + rank) over ranked lists."""
    out = None
    for rows, weight in lists:
        part = rows.select("id", (F.lit(float(weight)) / (F.lit(float(k)) + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("part").alias("rrf"))


def hybrid(rows: DataFrame, query: Sequence[float] | None, text: str | None, k: int, tags: Sequence[str] = (), tags_or: bool = False, start_us: int | None = None, end_us: int | None = None, trace: bool = False) -> DataFrame:
    """id and score: vector and BM25 lists fused by rank, with salience and a constant recency prior.

    BM25 statistics are those of all rows; its matches are filtered. ``trace`` adds the two ranks and
    the salience.
    """
    fetch = OVERFETCH * k
    pool = filters.candidates(rows, tags, tags_or, start_us, end_us)
    lists, ranks = [], {}
    if query is not None and len(query):
        ranks["vector_rank"] = ranked(knn(pool.select("id", "embedding"), query, fetch, clamped=False))
    if text and query_terms(text):
        found = bm25(rows, text)
        if tags or start_us is not None or end_us is not None:
            found = found.join(pool.select("id"), "id", "left_semi")
        ranks["bm25_rank"] = ranked(top(found, "score", fetch))
    lists = [(r, 1.0) for r in ranks.values()]
    if not lists:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    fused = rrf(lists).join(rows.select("id", "salience"), "id", "left")
    score = F.lit(RRF_WEIGHT) * F.col("rrf") + F.lit(SALIENCE_WEIGHT) * F.coalesce("salience", F.lit(0.5)) + F.lit(RECENCY_WEIGHT * RECENCY_PRIOR)
    out = top(fused.withColumn("score", score), "score", k)
    if not trace:
        return out.select("id", "score")
    for name in ("vector_rank", "bm25_rank"):
        out = out.join(ranks[name].select("id", F.col("rank").alias(name)), "id", "left") if name in ranks else out.withColumn(name, F.lit(None).cast("int"))
    return out.select("id", "score", "vector_rank", "bm25_rank", "salience")


def recall(rows: DataFrame, edges: DataFrame, query: Sequence[float] | None, text: str | None, k: int, at_us: int, tags: Sequence[str] = (), tags_or: bool = False, start_us: int | None = None, end_us: int | None = None, boost: DataFrame | None = None) -> DataFrame:
    """Point-in-time hybrid recall: over-fetch, add entity boosts, drop what is not current, cut."""
    hits = hybrid(rows, query, text, RECALL_OVERFETCH * k, tags, tags_or, start_us, end_us)
    if boost is not None:
        hits = hits.join(boost.select("id", "boost"), "id", "full").select("id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"))
    kept = filters.current(hits.join(rows.select("id", "tags", "valid_from_us", "valid_until_us"), "id"), edges, at_us, tags)
    return top(kept.select("id", "score"), "score", k)


def multi_query(lists: Sequence[DataFrame], k: int) -> DataFrame:
    """Lists of several queries (id, score), fused by rank and cut."""
    fused = rrf([(ranked(x), 1.0) for x in lists])
    return top(fused.withColumnRenamed("rrf", "score"), "score", k)


def decay(salience: Column, accessed_at_us: Column, access_count: Column, now_us: int, half_life_us: int = 7 * 86_400_000_000) -> Column:
    """Salience halved per half-life since the last access, raised by use, within 0.01 and 1."""
    age = F.greatest(F.lit(now_us) - accessed_at_us, F.lit(0)).cast("double")
    return clamp(salience * F.pow(F.lit(2.0), -age / F.lit(float(half_life_us))) + F.lit(0.1) * F.log(F.lit(1.0) + access_count.cast("double")), 0.01, 1.0)


def blend_decay(hits: DataFrame, rows: DataFrame, now_us: int) -> DataFrame:
    """Scores mixed with decayed salience."""
    joined = hits.join(rows.select("id", "salience", "accessed_at_us", "access_count"), "id")
    own = decay(F.col("salience"), F.col("accessed_at_us"), F.col("access_count"), now_us)
    return joined.select("id", (F.lit(1 - DECAY_BLEND) * F.col("score") + F.lit(DECAY_BLEND) * own).alias("score"))


def append_always(hits: DataFrame, rows: DataFrame, score: float = 0.85) -> DataFrame:
    """Adds the rows tagged scope:always that are not hits yet."""
    always = rows.where(F.array_contains("tags", "scope:always")).select("id").join(hits, "id", "left_anti")
    return hits.select("id", "score").unionByName(always.withColumn("score", F.lit(score)))


def recency_boost(score: Column, created_us: Column, reference_us: int) -> Column:
    return score + F.least(created_us.cast("double") / F.lit(float(reference_us)), F.lit(1.0)) * 0.10


def proximity_boost(score: Column, created_us: Column, target_us: int) -> Column:
    days = F.abs(created_us - F.lit(target_us)).cast("double") / F.lit(86_400_000_000.0)
    return score + F.exp(-(days * days) / F.lit(25.0)) * 0.04


def newest(hits: DataFrame, rows: DataFrame, k: int = 15, pool: int = 40) -> DataFrame:
    """Of the best ``pool`` hits the newest ``k``."""
    best = top(hits, "score", pool).join(rows.select("id", "created_at_us"), "id")
    return best.orderBy(F.desc("created_at_us"), "id").limit(k)


def spreading_activation(rows: DataFrame, edges: DataFrame, query: Sequence[float], seeds: int = 5, least: float = 0.3, hops: int = 2, damping: float = 0.85, cut: float = 0.3) -> DataFrame:
    """id and activation: the best seeds, then both directions of the edges with a damping per hop.

    A row keeps the activation of its first visit; of one hop's visits the strongest.
    """
    reached = knn(rows, query, seeds, clamped=False).where(F.col("score") > least).select("id", F.col("score").alias("activation"), F.lit(0).alias("hop"))
    both = edges.select("source", "target").union(edges.select("target", "source"))
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.join(both, frontier.id == both.source).groupBy(F.col("target").alias("id")).agg((F.max("activation") * F.lit(damping)).alias("activation"))
        frontier = step.where(F.col("activation") >= cut).join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


def expand_neighbours(hits: DataFrame, edges: DataFrame, factor: float = 0.9) -> DataFrame:
    """Hits and their direct neighbours at a share of the score; the best score of an id counts."""
    both = edges.select("source", "target").union(edges.select("target", "source"))
    near = hits.join(both, hits.id == both.source).select(F.col("target").alias("id"), (F.col("score") * factor).alias("score"))
    return hits.select("id", "score").unionByName(near).groupBy("id").agg(F.max("score").alias("score"))


def blend_rerank(hits: DataFrame, cross: str = "cross_score") -> DataFrame:
    """0.7 of the score by the best score and 0.3 of the logistic cross-encoder score."""
    best = hits.agg(F.max("score").alias("best"))
    return hits.join(F.broadcast(best)).select("id", (F.lit(0.7) * F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0) + F.lit(0.3) / (F.lit(1.0) + F.exp(-F.col(cross)))).alias("score"))


def trace_rows(hits: DataFrame, trace_id: str, created_us: int) -> DataFrame:
    """Rows of the retrieval log for a traced hybrid search."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).withColumn("trace_id", F.lit(trace_id)).withColumn("created_at_us", F.lit(created_us))


def retain(traces: DataFrame, keep: int = 200) -> DataFrame:
    """The newest ``keep`` rows of a log."""
    return traces.orderBy(F.desc("created_at_us"), F.desc("trace_id")).limit(keep)
