"""Exact similarity joins in blocks, and clusters of similar rows.

Rows are dealt to blocks; each unordered pair of blocks meets in one task as two dense matrices, whose
product, TILE rows at a time, gives all cosines. The work is the same for every pair of blocks, so
nothing is skewed, and only pairs above the threshold leave a task. A vector is sent once for each block,
so blocks are as large as a task can hold (BLOCK_BYTES of vectors) and only smaller where they would be
too few to keep the cores busy. Vectors travel with the width they are stored in.

Blocks are cut by direction where that helps: PIVOTS of the vectors are drawn by hash, every vector goes to
its nearest one, and two groups whose caps are too far apart for any cosine above the threshold never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebank.functions.text import words
from lorebank.runtime import durable

#: Bytes of vectors in a block, rows of a block at least, rows and columns of one product.
BLOCK_BYTES, BLOCK_ROWS, TILE = 16_000_000, 256, (2048, 8192)
#: Vectors that a pivot stands for, and the most pivots.
PIVOT_ROWS, PIVOTS = 50_000, 1024
SHARES = 16
#: Pairs that leave a task at a time.
SENT_ROWS = 100_000
TOPIC_WORDS = 5


def _vectors(rows: DataFrame, id_col: str, vector_col: str, carry: Sequence[str] = ()) -> DataFrame:
    return rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), *carry)


def _block_rows(own: DataFrame, n: int, longest: int) -> int:
    """Rows of a block: as many as fit, and few enough that the pairs of blocks are twice the cores."""
    cores = own.sparkSession.sparkContext.defaultParallelism
    return max(BLOCK_ROWS, min(BLOCK_BYTES // (8 * max(1, longest)), -(-n // math.isqrt(4 * cores))))


def _units(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """Unit vectors and their rows, by length; vectors of different lengths have cosine 0, and so have zero vectors."""
    for _, same in part.groupby(part["v"].map(len)):
        m = np.vstack(same["v"].to_numpy()).astype(np.float64)
        length = np.linalg.norm(m, axis=1)
        yield m[length > 0] / length[length > 0, None], same[length > 0]


def _above(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of left, row of right and cosine of all pairs above the threshold, a tile at a time."""
    for i in range(0, len(left), TILE[0]):
        for j in range(0, len(right), TILE[1]):
            sims = left[i : i + TILE[0]] @ right[j : j + TILE[1]].T
            x, y = np.nonzero(sims > threshold)
            yield x + i, y + j, sims[x, y]


def grouped_by_direction(own: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """Rows with the number of their nearest pivot (grp), and whether two groups may hold a close pair.

    The second result takes a threshold. Vectors of another length than the pivots, and zero vectors,
    are a group of their own without a pivot.
    """
    wanted = min(PIVOTS, n // PIVOT_ROWS)
    drawn = [np.array(r.v, np.float64) for r in own.orderBy(F.xxhash64("id"), "id").select("v").limit(wanted).collect()] if wanted > 1 else []
    drawn = [v / np.linalg.norm(v) for v in drawn if len(v) == len(drawn[0]) and np.linalg.norm(v) > 0]
    if len(drawn) < 2:
        return own.withColumn("grp", F.lit(0)), np.zeros((1, 1))
    pivots = np.vstack(drawn)

    @F.pandas_udf("grp int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        grp, angle = np.full(len(vectors), len(pivots)), np.zeros(len(vectors))
        fit = np.flatnonzero((vectors.map(len) == pivots.shape[1]).to_numpy())
        if len(fit):
            m = np.vstack(vectors.iloc[fit].to_numpy()).astype(np.float64)
            length = np.linalg.norm(m, axis=1)
            fit, m, length = fit[length > 0], m[length > 0], length[length > 0]
            sims = m @ pivots.T / length[:, None]
            grp[fit] = sims.argmax(axis=1)
            angle[fit] = np.arccos(np.clip(sims.max(axis=1), -1, 1)) if len(fit) else 0
        return pd.DataFrame({"grp": grp.astype("int32"), "angle": angle})

    dealt = own.withColumn("x", nearest("v")).select("id", "v", "x.*")
    radius = np.zeros(len(pivots))
    for r in dealt.where(F.col("grp") < len(pivots)).groupBy("grp").agg(F.max("angle").alias("r")).collect():
        radius[r.grp] = r.r
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) - radius[:, None] - radius[None, :]
    np.fill_diagonal(between, 0.0)
    # The group without a pivot meets itself alone: no other vector is like one of its own.
    gap = np.full((len(pivots) + 1, len(pivots) + 1), np.inf)
    gap[:-1, :-1], gap[-1, -1] = np.maximum(between, 0.0), 0.0
    return dealt.drop("angle"), gap


def similar_pairs(rows: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """a, b and similarity of all pairs a < b with a cosine above the threshold."""
    own = _vectors(rows, id_col, vector_col)
    spark = own.sparkSession
    n, longest = own.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    grouped, gap = grouped_by_direction(own, n)
    most = _block_rows(own, n, longest or 1)
    parts = {r.grp: -(-r.n // most) for r in grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    meets = [(g, h, parts[g], parts[h]) for g in sorted(parts) for h in sorted(parts) if g <= h and gap[g, h] <= reach]
    near = spark.createDataFrame(meets, "g int, h int, parts_g int, parts_h int")
    dealt = grouped.join(F.broadcast(spark.createDataFrame(sorted(parts.items()), "grp int, parts int")), "grp").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    key = F.struct("g", F.col("i").alias("i"), "h", F.col("j").alias("j"))
    # A block meets every part of a later group as the left one, of an earlier one as the right one.
    left = dealt.join(F.broadcast(near), F.col("grp") == F.col("g")).select("id", "v", "g", "h", F.col("part").alias("i"), F.explode(F.sequence(F.when(F.col("g") == F.col("h"), F.col("part")).otherwise(0), F.col("parts_h") - 1)).alias("j"), F.lit(True).alias("is_left"))
    right = dealt.join(F.broadcast(near), F.col("grp") == F.col("h")).select("id", "v", "g", "h", F.explode(F.sequence(F.lit(0), F.when(F.col("g") == F.col("h"), F.col("part")).otherwise(F.col("parts_g") - 1))).alias("i"), F.col("part").alias("j"), F.lit(False).alias("is_left"))
    right = right.where((F.col("g") != F.col("h")) | (F.col("i") != F.col("j")))  # a block with itself is sent once
    met = left.unionByName(right).select("id", "v", "is_left", key.alias("key"))

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        where, out = key[0], []
        alone = where["g"] == where["h"] and where["i"] == where["j"]
        for unit, same in _units(part):
            ids, first = same["id"].to_numpy(), same["is_left"].to_numpy()
            left, right = (unit, unit) if alone else (unit[first], unit[~first])
            a_ids, b_ids = (ids, ids) if alone else (ids[first], ids[~first])
            for x, y, sims in _above(left, right, threshold):
                a, b = a_ids[x], b_ids[y]
                keep = a < b if alone else np.ones(len(a), bool)
                out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": sims[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []})

    return met.groupBy("key").applyInPandas(join, "a long, b long, similarity double")


def _unit_tables(part: pa.Table) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """What ``_units`` gives, of an Arrow table, so that other columns keep their types and nulls."""
    vectors = part["v"].combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        m = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n).astype(np.float64)
        length = np.linalg.norm(m, axis=1)
        yield m[length > 0] / length[length > 0, None], part.drop_columns("v").take(pa.array(at[length > 0]))


def pairs_between(left: DataFrame, right: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "embedding", carry: Sequence[str] = ()) -> DataFrame:
    """a (of left), b (of right) and similarity of all pairs of different ids with a cosine above the threshold.

    Blocks of one side meet blocks of the other; a side that fits into one block is not repeated for itself.
    The columns to carry travel with the vectors and stand beside each pair as left_<name> and right_<name>,
    so that rules on pairs need no join of the pairs, which may be many more than the rows.
    """
    sides = []
    for k, rows in enumerate((left, right)):
        own = _vectors(rows, id_col, vector_col, carry).withColumn("side", F.lit(k))
        n, longest = own.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        sides.append((own, max(1, -(-n // _block_rows(own, n, longest or 1)))))
    (a, blocks_a), (b, blocks_b) = sides
    a = a.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(blocks_a)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks_b - 1))))
    b = b.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(blocks_b)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks_a - 1))))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, same in _unit_tables(pa.Table.from_batches(list(batches))):
            ids, side = same["id"].to_numpy(), same["side"].to_numpy()
            rows_a, rows_b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for x, y, sims in _above(unit[rows_a], unit[rows_b], threshold):
                x, y = rows_a[x], rows_b[y]
                other = ids[x] != ids[y]
                x, y, sims = x[other], y[other], sims[other]
                for k in range(0, len(x), SENT_ROWS):
                    of = [same.take(pa.array(at[k : k + SENT_ROWS])) for at in (x, y)]
                    beside = {f"{name}_{c}": table[c] for name, table in zip(("left", "right"), of, strict=True) for c in carry}
                    yield from pa.table({"a": of[0]["id"], "b": of[1]["id"], "similarity": sims[k : k + SENT_ROWS]} | beside).combine_chunks().to_batches()

    kinds = [f"{side}_{c} {dict(rows.dtypes)[c]}" for side, rows in (("left", left), ("right", right)) for c in carry]
    return a.unionByName(b).groupBy("i", "j").applyInArrow(join, ", ".join(["a long, b long, similarity double", *kinds]))


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """query, id, score and rank (from 0) of the k rows of greatest cosine to each query; ties by id.

    Blocks of rows meet blocks of queries. A task keeps k rows for each of its queries, so what is ranked
    in the end is k rows a query and block. A query among the rows finds itself.
    """
    sides = []
    for side, df in enumerate((rows, queries)):
        own = _vectors(df, id_col, vector_col).withColumn("side", F.lit(side))
        n, longest = own.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        sides.append((own, max(1, -(-n // _block_rows(own, n, longest or 1)))))
    (a, blocks_a), (b, blocks_b) = sides
    a = a.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(blocks_a)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks_b - 1))))
    b = b.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(blocks_b)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks_a - 1))))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for unit, same in _units(part):
            ids, side = same["id"].to_numpy(), same["side"].to_numpy()
            order = np.argsort(ids[side == 0], kind="stable")  # ties by id
            row_ids, found, asked = ids[side == 0][order], unit[side == 0][order], unit[side == 1]
            query_ids, most = ids[side == 1], min(k, len(order))
            for at in range(0, len(asked) if most else 0, TILE[0]):
                top_sims, top_rows = np.empty((len(asked[at : at + TILE[0]]), 0)), np.empty((len(asked[at : at + TILE[0]]), 0), np.int64)
                for start in range(0, len(found), TILE[1]):
                    sims = np.hstack([top_sims, asked[at : at + TILE[0]] @ found[start : start + TILE[1]].T])
                    where = np.hstack([top_rows, np.broadcast_to(np.arange(start, min(start + TILE[1], len(found))), (len(sims), sims.shape[1] - top_sims.shape[1]))])
                    first = np.argsort(-sims, axis=1, kind="stable")[:, :most]
                    top_sims, top_rows = np.take_along_axis(sims, first, 1), np.take_along_axis(where, first, 1)
                out.append(pd.DataFrame({"query": np.repeat(query_ids[at : at + TILE[0]], top_rows.shape[1]), "id": row_ids[top_rows.ravel()], "score": top_sims.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "score": []})

    found = a.unionByName(b).groupBy("i", "j").applyInPandas(best, "query long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place - 1).where(F.col("rank") < k)


def pairs_within(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """key, a and b: every pair a < b of the ids that share a key, once for each key.

    A key's left rows are dealt to SHARES parts, so that no task makes all pairs of a large key.
    """
    own = rows.select(key, F.col(id_col).alias("a")).distinct()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = own.withColumn("_share", F.pmod(F.xxhash64("a"), F.lit(SHARES)).cast("int")).repartition(parts, key, "_share")
    right = own.select(key, F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share")).repartition(parts, key, "_share")
    return left.join(right, [key, "_share"]).where("a < b").select(key, "a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """id and root (smallest id of its component) for every id in the pairs (a, b).

    Alternates large-star and small-star steps; each round is written to the checkpoint folder.
    """
    stars = durable(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = sign(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = durable(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = durable(large.join(least, "a").select(F.expr("if(b = m, a, b)").alias("a"), F.col("m").alias("b")).distinct())
        if (after := sign(stars)) == before:
            break
        before = after
    return stars.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def cluster_stats(pairs: DataFrame, roots: DataFrame, rows: DataFrame, least_size: int = 2) -> DataFrame:
    """root, size, links and their mean similarity, greatest confidence; clusters of ``least_size`` or more."""
    sizes = roots.join(rows.select("id", "confidence"), "id").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.max("confidence").alias("confidence"))
    links = pairs.join(roots.withColumnRenamed("id", "a"), "a").groupBy("root").agg(F.count(F.lit(1)).alias("links"), F.avg("similarity").alias("mean_similarity"))
    return sizes.join(links, "root").where(F.col("size") >= least_size)


def cluster_candidates(roots: DataFrame, rows: DataFrame, least_size: int = 2) -> DataFrame:
    """root, size, avg_similarity over all pairs of members, and topic: the first words of the first member.

    The cosines of all pairs sum to (|sum u|^2 - sum |u|^2) / 2 over unit vectors u of one length; a zero
    vector, or vectors of different lengths, have cosine 0. ``rows``: id, embedding, content.
    """
    members = roots.join(rows.select("id", F.col("embedding").cast("array<double>").alias("v"), "content"), "id")
    size = F.count(F.lit(1))
    groups = members.groupBy("root").agg(size.alias("size"), F.min_by("content", "id").alias("content")).where(F.col("size") >= least_size)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    units = members.select("root", F.size("v").alias("dim"), "v", length.alias("length")).where("length > 0")
    parts = units.select("root", "dim", "length", F.posexplode("v").alias("pos", "x")).withColumn("u", F.col("x") / F.col("length"))
    sums = parts.groupBy("root", "dim", "pos").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"))
    doubled = sums.groupBy("root").agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("doubled"))
    n = F.col("size").cast("double")
    mean = F.when(F.col("size") < 2, 1.0).otherwise(F.coalesce("doubled", F.lit(0.0)) / (n * (n - 1)))
    return groups.join(doubled, "root", "left").select("root", "size", mean.alias("avg_similarity"), F.array_join(F.slice(words("content"), 1, TOPIC_WORDS), " ").alias("topic"))


def mean_embedding(rows: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """Per key and dimension the mean of the vectors, scaled to unit length: key, pos, value."""
    means = rows.select(key, F.posexplode(vector_col).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lengths = means.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"))
    return means.join(lengths, key).select(key, "pos", F.when(F.col("length") > 0, F.col("m") / F.col("length")).otherwise(F.col("m")).alias("value"))
