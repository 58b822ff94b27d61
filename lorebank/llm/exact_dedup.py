"""Exact de-duplication with a heavy-hitter split.

Texts are equal when they are identical after white space is removed; a SHA-256 digest stands for
the normalised text. A Misra-Gries summary of each partition, merged by addition, names every digest
that can hold more than a set share of the rows. Those few candidates are counted exactly; their
verified winners go to all executors, where the heavy rows are settled without a shuffle. What
remains has no heavy digest and is shuffled by digest in the ordinary way.

Defined cases: a null text counts as empty, so null, empty and blank texts are equal. Ties in length
go to the smallest doc_id, a null doc_id comes last, and of repeated rows exactly one stays. An empty
table gives an empty result. Columns other than the id and the text are never read by
``duplicate_groups``; ``drop_duplicates`` carries them along unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank.llm.common import BLANKS, durable, fresh, whole_text

#: Counters of one partition's summary, and the share of all rows from which a digest is heavy.
#: At most 1 / (HEAVY_SHARE - 1 / (COUNTERS + 1)) digests, here 342, can become candidates.
COUNTERS = 1024
HEAVY_SHARE = 1 / 256
#: Keys of removed documents that are sent to the executors, about 20 bytes each; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def misra_gries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Misra-Gries summary of one partition: at most COUNTERS digests, counts too low by n / (COUNTERS + 1) at most."""
    counters: dict[str, int] = {}
    for batch in batches:
        for digest, n in batch.iloc[:, 0].value_counts(sort=False).items():
            counters[digest] = counters.get(digest, 0) + int(n)
        if len(counters) > COUNTERS:
            cut = sorted(counters.values(), reverse=True)[COUNTERS]
            counters = {digest: n - cut for digest, n in counters.items() if n > cut}
    yield pd.DataFrame({"digest": list(counters.keys()), "n": list(counters.values())}).astype({"digest": "string", "n": "int64"})


def heavy_candidates(digests: DataFrame, column: str, rows: int) -> list[str]:
    """Every digest with at least HEAVY_SHARE of the rows, and at most 342 in all."""
    least = rows * HEAVY_SHARE - rows / (COUNTERS + 1)
    merged = digests.select(column).mapInPandas(misra_gries, "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return [r.digest for r in merged.where(F.col("n") >= F.lit(least)).collect()]


def _rank(length: str, doc_id: str, uid: str) -> Column:
    """Ascending order in which the first row is the one that stays."""
    return F.struct((-F.col(length)).alias("a"), F.col(doc_id).isNull().alias("b"), F.col(doc_id).alias("c"), F.col(uid).alias("d"))


def heavy_winners(table: DataFrame) -> list[tuple]:
    """(digest, winner's doc_id, winner's uid, rows) of each verified heavy digest of a table of digests."""
    rows = table.count()
    if not rows or not (found := heavy_candidates(table, "digest", rows)):
        return []
    exact = table.where(F.col("digest").isin(found)).groupBy("digest").agg(F.min(_rank("length", "doc_id", "uid")).alias("first"), F.count(F.lit(1)).alias("n"))
    return [(r.digest, r["first"].c, r["first"].d, r.n) for r in exact.where(F.col("n") >= F.lit(rows * HEAVY_SHARE)).collect()]


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, length in code points, digest and a row id, computed once."""
    text = whole_text(text_col)
    return durable(docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("length"), F.sha2(normalised(text), 256).alias("digest")).withColumn("uid", F.monotonically_increasing_id()))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    table = digest_table(docs, id_col, text_col)
    spark, kind = docs.sparkSession, dict(table.dtypes)["doc_id"]
    heavy = heavy_winners(table)
    light = table
    parts = []
    if heavy:
        winners = F.broadcast(spark.createDataFrame(heavy, f"digest string, keep_id {kind}, keep_uid long, group_size long"))
        light = table.join(winners.select("digest"), "digest", "left_anti")
        parts.append(table.join(winners, "digest").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("digest").alias("text_sha256")))
    group = Window.partitionBy("digest")
    ranked = group.orderBy(_rank("length", "doc_id", "uid"))
    parts.append(light.select("doc_id", F.first("doc_id").over(ranked).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"), (F.row_number().over(ranked) == 1).alias("kept"), F.col("digest").alias("text_sha256")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are judged on their digests; whole rows meet only the keys of those that go. A row is known by its
    id and a hash of its whole text: up to BROADCAST_KEYS of the keys are sent to the rows, more are joined
    by a shuffle. Where id and text repeat among the rows that stay, or the id is null, those rows are
    ordered by all their columns, and the first one stays.
    """
    text = whole_text(text_col)
    known = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    table = durable(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("uid"), F.length(text).cast("long").alias("length"), F.sha2(normalised(text), 256).alias("digest")))
    heavy = heavy_winners(table)
    own = _rank("length", "doc_id", "uid")
    if heavy:
        winners = F.broadcast(docs.sparkSession.createDataFrame([x[:3] for x in heavy], f"digest string, keep_id {dict(table.dtypes)['doc_id']}, keep_uid long"))
        light = table.join(winners.select("digest"), "digest", "left_anti")
        settled = table.join(winners, "digest").select("doc_id", "uid", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("uid") == F.col("keep_uid"))).alias("stays"))
    else:
        light, settled = table, None
    ranked = Window.partitionBy("digest").orderBy(own)
    judged = light.withColumn("first", F.first(own).over(ranked)).select("doc_id", "uid", own.eqNullSafe(F.col("first")).alias("stays"))
    judged = durable(judged if settled is None else judged.unionByName(settled))
    key, rank = fresh(docs, "key"), fresh(docs, "rank")
    gone = judged.where(~F.col("stays")).select(F.struct(F.col("doc_id").alias("id"), F.col("uid").alias("h")).alias(key)).distinct()
    gone = durable(gone)
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    left = docs.join(gone, known.eqNullSafe(F.col(key)), "left_anti")
    repeats = durable(judged.where("stays").groupBy("doc_id", "uid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.struct(F.col("doc_id").alias("id"), F.col("uid").alias("h")).alias(key)))
    if repeats.isEmpty():
        return left
    order = Window.partitionBy(known).orderBy(F.to_json(F.struct(*docs.columns)))
    one = left.join(repeats, known.eqNullSafe(F.col(key)), "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return one.unionByName(left.join(repeats, known.eqNullSafe(F.col(key)), "left_anti"))
