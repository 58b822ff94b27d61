r"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Words are ``[^\x20\x09-\x0D]+`` of the lower-cased (A-Z) text, a shingle is SHINGLE consecutive words
joined by spaces, repeats included; a text of fewer words is one shingle. A fingerprint bit is set
if more than half of the shingles' XXH64 values (seed 42) have it. Two fingerprints link at DISTANCE
differing bits or fewer.

At most 4 of the 8 byte positions of a linked pair differ, so at least 4 agree. A posting list for a
single position and byte would hold one fingerprint in 256; the index therefore lists fingerprints by
the bytes at three positions. Every 4 positions contain one of 20 triples (Turan's construction), so
20 lists a fingerprint lose no pair. Inside a list the shared positional bytes of a pair are tallied,
pairs short of 4 are let go, and the rest are verified by the exact bit count.

A list of more than LONG fingerprints is split. Its linked pairs agree at one position more, so it becomes
one list for each byte at each of the 5 other positions. Where even that is long, the 4 bytes that are left
differ in at most 4 of their 8 half bytes, and the same 20 triples, of half bytes now, split it once more;
the 20 bits then left bound any list by their number of values.

Only distinct fingerprints are indexed, so copies cost nothing. A list is searched outward from one
fingerprint at a time, against those not reached yet: a crowd of near copies is left as soon as it is
connected, and at most one link per fingerprint leaves a list, not all pairs. Components are found on
the links in a distributed way.

Defined cases: null and blank texts have fingerprint zero and link like any other; equal fingerprints
are one group; a row with a null doc_id gets the component of its fingerprint, or null if no row with
that fingerprint has an id; repeated rows get equal results; an empty table gives an empty result;
extra columns are not read by ``near_duplicates`` and are kept by ``keep_representatives``, which removes
rows by id and fingerprint together, so rows of one id with unlike texts never answer for each other.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank.llm.common import bounded_batches, durable, fresh
from lorebank.llm.components import connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
POSITIONS = 8
#: Positions that agree at least in a linked pair.
AGREE = POSITIONS - DISTANCE
#: Ids of removed documents that are sent to the executors, 16 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Shingles whose bits are counted at once, and list lengths up to which all pairs are compared.
BLOCK = 1 << 15
#: Fingerprints in a posting list from which it is split by further positions.
LONG = 2000
SHORT = 8


def shingle_hashes(text: str, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, in blocks."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    if len(found) <= size:
        yield np.array([xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - size + 1]
    ends = ends[size - 1 :]
    for at in range(0, len(starts), BLOCK):
        own = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)]
        yield np.array(own, np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text or "", size):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(text_col: str = "text", size: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t if isinstance(t, str) else None, size) for t in texts], np.uint64).view(np.int64))

    return of(F.col(text_col))


@functools.cache
def triples() -> list[tuple[int, ...]]:
    """20 triples of the 8 positions such that any 4 positions contain one of them.

    With the positions in three parts, a triple counts if it lies in one part, or has two positions in
    a part and one in the next.
    """
    part = [p % 3 for p in range(POSITIONS)]

    def counts(t: tuple[int, ...]) -> bool:
        own = sorted(part[p] for p in t)
        return len(set(own)) == 1 or any(own.count(k) == 2 and own.count((k + 1) % 3) == 1 for k in range(3))

    return [t for t in combinations(range(POSITIONS), 3) if counts(t)]


def _bits(fp: Column, shift: Column, mask: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, shift.cast("int")).bitwiseAND(mask)


def _table(rows: list) -> Column:
    """A literal array, of arrays where its entries are sequences."""
    return F.array(*[_table(list(r)) if isinstance(r, tuple) else F.lit(r) for r in rows])


def posting_keys(fp: Column) -> Column:
    """Keys of the posting lists of a fingerprint: the triple's number and the three bytes there."""

    def byte(k: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(255)

    return F.array(*[F.lit(n << 24) + byte(i) * (1 << 16) + byte(j) * (1 << 8) + byte(k) for n, (i, j, k) in enumerate(triples())])


def split_by_position(lists: DataFrame) -> DataFrame:
    """Lists by three positions (key, fp, node) as lists by four: part (the positions' number) and key (their bytes)."""
    fours = list(combinations(range(POSITIONS), AGREE))
    of_triple = [tuple(n for n, four in enumerate(fours) if set(t) <= set(four)) for t in triples()]
    parts = lists.withColumn("part", F.explode(F.get(_table(of_triple), F.shiftright("key", 24).cast("int"))))
    at = F.get(_table(fours), F.col("part"))
    bytes_there = [_bits(F.col("fp"), F.get(at, F.lit(k)) * 8, 255) * (1 << 8 * k) for k in range(AGREE)]
    return parts.select(((F.col("part").cast("long") + 1) * (1 << 32) + sum(bytes_there)).alias("key"), "fp", "node")


def split_by_half_bytes(lists: DataFrame) -> DataFrame:
    """Lists by four positions as lists by these and three of the eight half bytes elsewhere."""
    fours = list(combinations(range(POSITIONS), AGREE))
    shifts = [tuple(8 * p + 4 * half for p in range(POSITIONS) if p not in four for half in (0, 1)) for four in fours]
    own = F.get(_table(shifts), F.shiftright("key", 32).cast("int") - 1)
    of_triple = [F.lit((n + 1) << 12) + sum(_bits(F.col("fp"), F.get(own, F.lit(h)), 15) * (1 << 4 * k) for k, h in enumerate(t)) for n, t in enumerate(triples())]
    return lists.select(F.explode(F.array(*of_triple)).alias("part"), "key", "fp", "node").select((F.col("part") * (1 << 40) + F.col("key")).alias("key"), "fp", "node")


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs link: enough positional bytes in common, then few enough bits that differ."""
    differ = np.atleast_1d(a ^ b)
    tally = (differ.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
    out = tally >= AGREE
    out[out] = np.bitwise_count(differ[out]) <= DISTANCE
    return out


def list_links(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all linked fingerprints of one posting list."""
    left, ends_a, ends_b = np.arange(len(fp)), [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = linked(fp[left], fp[at])
            if near.any():
                found, left = left[near], left[~near]
                ends_a.append(np.full(len(found), node[at]))
                ends_b.append(node[found])
                todo.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *ends_a]), np.concatenate([none, *ends_b])


def _links_of(keys: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pd.DataFrame:
    """Links inside the lists of a run of whole lists, sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    ends_a, ends_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in range(2, SHORT + 1):  # all lists of one short length at once
        own = starts[sizes == size]
        for i, j in combinations(range(size), 2) if len(own) else ():
            near = linked(fp[own + i], fp[own + j])
            ends_a.append(node[own[near] + i])
            ends_b.append(node[own[near] + j])
    for start, size in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
        a, b = list_links(fp[start : start + size], node[start : start + size])
        ends_a.append(a)
        ends_b.append(b)
    return pd.DataFrame({"a": np.concatenate(ends_a), "b": np.concatenate(ends_b)})


def links_of_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a partition's posting lists; rows come sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys, fp, node = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["node"].to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last list may go on in the next batch
        if held and held[0][0][0] == keys[-1]:
            held.append((keys, fp, node))
            continue
        parts = [*held, (keys[:cut], fp[:cut], node[:cut])]
        yield _links_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        held = [(keys[cut:], fp[cut:], node[cut:])]
    if held:
        yield _links_of(*(np.concatenate(x) for x in zip(*held, strict=True)))


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (fp, node) that connect all linked ones."""
    lists = nodes.select(F.explode(posting_keys(F.col("fp"))).alias("key"), "fp", "node")
    parts = []
    for split in (split_by_position, split_by_half_bytes):
        long = durable(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG).select("key"))
        if long.isEmpty():
            break
        parts.append(lists.join(long, "key", "left_anti"))
        lists = durable(split(lists.join(long, "key", "left_semi")))
    for part in parts:
        lists = lists.unionByName(part)
    return lists.repartition("key").sortWithinPartitions("key").mapInPandas(links_of_lists, "a long, b long")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp of every row, computed once."""
    bounded_batches(docs.sparkSession)
    return durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(text_col, size).alias("fp")))


def classified(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, fp) with component_id, the smallest doc_id that their fingerprint reaches, and group, a
    number that no two components share (they may share an id)."""
    # Nodes are numbers of fingerprints, not ids: one id may have several fingerprints.
    names = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("id")).where(F.col("id").isNotNull()).withColumn("number", F.monotonically_increasing_id()))
    labels = connected_components(fingerprint_links(names.select("fp", F.col("number").alias("node"))))
    grouped = names.join(labels, names["number"] == labels["node"], "left").select("fp", "id", F.coalesce("component", "number").alias("group"))
    classes = grouped.join(grouped.groupBy("group").agg(F.min("id").alias("component_id")), "group").select("fp", "group", "component_id")
    return rows.join(classes, "fp", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    rows = classified(fingerprinted(docs, id_col, text_col, size))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id stays,
    of several such rows the one with the smallest fingerprint.

    A row is known by its id and a hash of its text. Rows without a doc_id cannot be named as anyone's
    duplicate and stay. Whole rows meet only the keys that go: up to BROADCAST_IDS of them are sent to the
    rows, more are joined by a shuffle. Where id and text repeat among the rows that stay, those rows are
    ordered by all their columns, and the first one stays.
    """
    bounded_batches(docs.sparkSession)
    key, text_hash = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))
    rows = durable(docs.select(key.alias("doc_id"), fingerprints(text_col, size).alias("fp"), text_hash.alias("text_hash")))
    near = classified(rows).where(F.col("doc_id").isNotNull())
    own = F.struct("doc_id", "fp", "text_hash")
    judged = near.join(near.groupBy("group").agg(F.min(own).alias("first")), "group")
    other_id, other_hash, rank = (fresh(docs, x) for x in ("id", "hash", "rank"))
    same, names = (key == F.col(other_id)) & (text_hash == F.col(other_hash)), (F.col("doc_id").alias(other_id), F.col("text_hash").alias(other_hash))
    gone = durable(judged.where(own != F.col("first")).select(*names).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = docs.join(gone, same, "left_anti")
    repeats = durable(judged.where(own == F.col("first")).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*names))
    if repeats.isEmpty():
        return left
    order = Window.partitionBy(key, text_hash).orderBy(F.to_json(F.struct(*docs.columns)))
    one = left.join(repeats, same, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return one.unionByName(left.join(repeats, same, "left_anti"))
