"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn from the multivariate hypergeometric
law that a uniform permutation of all rows would induce: the shard sizes are fixed, and the partitions
share them out without replacement. The draws go down a binary tree over the partitions: what a half
of a node's rows gives to each shard is hypergeometric given what the node gives. Every node has its own
seed, so a subtree depends on nothing outside but its counts. Rows are sorted in place by a random key,
which ranks them in their partition (the local permutation); the ranks are cut at the drawn counts (the
exchange), and inside its shard each row gets a second random rank (the second permutation). Only
partition sizes reach the driver, of at most PARTS partitions, and as many cut points are sent back; rows
pass through DataFrame functions alone and are shuffled once.

The law is ``rows``: shard sizes differ by one row at most, so all copies of one text spread over the
shards like any other rows, and no group can make a shard or a task large.

Defined cases: a null text has size 16 and the CRC of no bytes; a null doc_id is placed like any
other row; repeated rows are separate rows; an empty table gives an empty result; other columns of
the input are never read.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebank.llm.common import durable, fresh, whole_text

#: Bytes that a row costs besides its text, rows that one task ranks inside a shard, and partitions at most.
ROW_BYTES = 16
RUN_ROWS = 500_000
PARTS = 8192
#: Standard deviation up to which a draw is found by inversion; beyond it by rejection.
INVERTED = 8.0
# The table mountain hat of the ratio of uniforms (Stadlober 1990).
HAT_WIDTH, HAT_SHIFT = 1.7155277699214135, 0.8989161620588988


def _log_factorial_ratio(a: int, b: int) -> float:
    """log(a! / b!), exact to about 1e-9 for numbers as large as all rows: no two large terms are subtracted."""
    if min(a, b) < 32:
        return math.lgamma(a + 1) - math.lgamma(b + 1)

    def rest(n: int) -> float:  # what Stirling's formula leaves
        return (1 / 12 - (1 / 360 - 1 / (1260 * n * n)) / (n * n)) / n

    return (a + 0.5) * math.log1p((a - b) / b) + (a - b) * (math.log(b) - 1) + rest(a) - rest(b)


def _inverted(rng: random.Random, good: int, bad: int, drawn: int, mode: int) -> int:
    """By inversion outward from the mode."""
    low, high = max(0, drawn - bad), min(drawn, good)
    # The chance of the mode, from that of its neighbours: all weights relative to it, summed until they vanish.
    weights = {mode: 1.0}
    for step, last in ((1, high), (-1, low)):
        k, w = mode, 1.0
        while k != last and w > 1e-18:
            at = k if step > 0 else k - 1
            up = (good - at) * (drawn - at) / ((at + 1) * (bad - drawn + at + 1))
            w *= up if step > 0 else 1 / up
            k += step
            weights[k] = w
    left = rng.random() * sum(weights.values())
    for k in sorted(weights, key=lambda k: abs(k - mode)):
        left -= weights[k]
        if left <= 0:
            return k
    return mode


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Good items among ``drawn`` ones taken without replacement."""
    low, high, both = max(0, drawn - bad), min(drawn, good), good + bad
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (both + 2)))
    share = good / both
    spread = math.sqrt(drawn * share * (1 - share) * (both - drawn) / max(1, both - 1) + 0.5)
    if spread <= INVERTED:
        return _inverted(rng, good, bad, drawn, mode)
    middle, width = drawn * share + 0.5, HAT_WIDTH * spread + HAT_SHIFT
    while True:  # ratio of uniforms
        u = rng.random()
        k = math.floor(middle + width * (rng.random() - 0.5) / u) if u > 0 else -1
        if low <= k <= high and 2 * math.log(u) <= (
            _log_factorial_ratio(mode, k) + _log_factorial_ratio(good - mode, good - k) + _log_factorial_ratio(drawn - mode, drawn - k) + _log_factorial_ratio(bad - drawn + mode, bad - drawn + k)
        ):
            return k


def communication_matrix(sent: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows that partition p sends to shard s; row sums are ``sent``, column sums are ``shards``."""
    matrix: list[list[int]] = [[] for _ in sent]
    before = [0, *itertools.accumulate(sent)]
    nodes = [(0, len(sent), list(shards))] if sent else []
    while nodes:
        first, last, room = nodes.pop()
        if last - first == 1:
            matrix[first] = room
            continue
        half = (first + last) // 2
        rng, left, rest, taken = random.Random(f"{seed}:{first}:{last}"), before[half] - before[first], before[last] - before[first], []
        for free in room:
            rest -= free
            taken.append(hypergeometric(rng, free, rest, left))
            left -= taken[-1]
        nodes += [(first, half, taken), (half, last, [a - b for a, b in zip(room, taken, strict=True)])]
    return matrix


def shuffle_into_shards(rows: DataFrame, shards: int = 40, seed: int = 20240229) -> DataFrame:
    """``rows`` with shard (0 to shards - 1) and slot (gapless from 0 in each shard), in place of columns so named."""
    spark = rows.sparkSession
    pid, uid, cuts, rank, key, run_no, start, count = (fresh(rows, x) for x in ("pid", "uid", "ends", "rank", "key", "run", "start", "n"))
    rows = rows.drop("shard", "slot")
    held = durable(rows.coalesce(PARTS).withColumn(pid, F.spark_partition_id()).withColumn(uid, F.monotonically_increasing_id()))
    sizes = sorted(tuple(r) for r in held.groupBy(pid).agg(F.count(F.lit(1))).collect())
    total = sum(n for _, n in sizes)
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in sizes], targets, seed)
    ends = []
    for (partition, _), out in zip(sizes, matrix, strict=True):
        reached, cut = 0, []
        for n in out:
            reached += n
            cut.append(reached)
        ends.append((partition, cut))
    ends_df = spark.createDataFrame(ends, f"{pid} int, {cuts} array<bigint>")
    first, second = F.xxhash64(F.lit(seed), uid), F.xxhash64(F.lit(seed + 1), uid)
    # Sorted in place, a row's number in its partition is its rank.
    placed = (
        held.sortWithinPartitions(first, uid)
        .withColumn(rank, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1)
        .join(F.broadcast(ends_df), pid)
        .withColumn("shard", F.size(F.filter(cuts, lambda end: end < F.col(rank))).cast("int"))
        .drop(cuts, rank, pid)
    )
    # The second permutation orders a shard by a random key. Leading parts of the key cut the shard
    # into runs of bounded size, so that no task ranks a whole shard.
    runs = max(1, math.ceil(total / shards / RUN_ROWS))
    placed = placed.withColumn(key, second).withColumn(run_no, F.floor((F.col(key).cast("double") / F.lit(2.0**64) + F.lit(0.5)) * runs).cast("int"))
    run = Window.partitionBy("shard", run_no).orderBy(key, uid)
    if runs == 1:
        return placed.withColumn("slot", (F.row_number().over(run) - 1).cast("long")).drop(key, run_no, uid)
    placed = durable(placed)
    before = Window.partitionBy("shard").orderBy(run_no).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", run_no).agg(F.count(F.lit(1)).alias(count)).select("shard", run_no, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    return placed.withColumn("slot", F.row_number().over(run) - 1).join(starts, ["shard", run_no]).withColumn("slot", (F.col("slot") + F.col(start)).cast("long")).drop(key, run_no, uid, start)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    utf8 = F.encode(whole_text(text_col), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(utf8) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    return shuffle_into_shards(rows, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
