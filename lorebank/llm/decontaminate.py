r"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A text is lower-cased (A-Z only) and read as the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. The test
strings are the windows of 13 consecutive words of each benchmark item; an item with fewer words, but
not none, is one window. Windows of one length m share a table: for every block of two words (one, if
m is 1) it holds how far the search may move on when that block ends the current position, and for
the blocks that end a window the bucket of windows with that suffix. Most positions are never looked
at, a block that ends no window moves the search by up to m - 1 words, and a bucket's windows are
compared with the text directly.

The benchmark reaches the executors in blocks of at most BLOCK_CHARS characters; more than one block
means another pass over the documents and a merge of the hits by document.

Defined cases: null and wordless texts have no words, no hits and are not contaminated; null items
and null item ids match nothing; repeated items count once for each distinct id; an empty benchmark
hits nothing; an empty document table gives an empty result; extra columns are carried by
``drop_contaminated`` and ignored by ``contamination``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebank.llm.common import bounded_batches, fresh

WINDOW = 13
#: Characters of benchmark text in one search table; about 20 times as many bytes of Python objects.
BLOCK_CHARS = 8_000_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = "n_words long, ranges array<bigint>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """The words of a text. UTF-8 bytes give the same words: every byte of a longer character is a word byte."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Table:
    """Shift table and suffix buckets of the windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[tuple[bytes, ...], set[str]]] = {}

    def add(self, window: tuple[bytes, ...], item: str) -> None:
        for end in range(self.block, self.length + 1):
            key = b" ".join(window[end - self.block : end])
            self.shift[key] = min(self.shift.get(key, self.length), self.length - end)
        self.bucket.setdefault(b" ".join(window[-self.block :]), {}).setdefault(window, set()).add(item)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence of a window in a list of words."""
        length, block, n = self.length, self.block, len(text)
        most, shift_of = length - block + 1, self.shift.get
        at = length  # words before this position end with the block under test
        while at <= n:
            key = text[at - 1] if block == 1 else text[at - 2] + b" " + text[at - 1]
            step = shift_of(key, most)
            if step == 0:
                window = tuple(text[at - length : at])
                if items := self.bucket[key].get(window):
                    yield at - length, items
                step = 1
            at += step


def build_tables(items: Iterable[tuple[str, str]], window: int = WINDOW) -> list[Table]:
    tables: dict[int, Table] = {}
    for item, text in items:
        if found := words(text):
            length = min(window, len(found))
            table = tables.setdefault(length, Table(length))
            for start in range(len(found) - length + 1):
                table.add(tuple(found[start : start + length]), item)
    return list(tables.values())


def scan(tables: list[Table], text: str | None) -> tuple[int, list[int], list[str]]:
    """Words of a text, its hit ranges (start, stop, start, stop, ...) and the items that occur."""
    found = words(text)
    spans, items = [], set()
    for table in tables:
        for start, own in table.search(found):
            spans.append((start, start + table.length))
            items |= own
    merged: list[int] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], stop)
        else:
            merged += [start, stop]
    return len(found), merged, sorted(items)


def _scanner(items: list[tuple[str, str]], window: int) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = build_tables(items, window)
        for texts in batches:
            yield pd.DataFrame([scan(tables, t) for t in texts], columns=["n_words", "ranges", "items"])

    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most BLOCK_CHARS characters, or one item where that one is longer."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    if size <= BLOCK_CHARS:
        yield [tuple(r) for r in items.collect()]
        return
    block, used = [], 0
    for r in items.toLocalIterator():
        if block and used + len(r.t) > BLOCK_CHARS:
            yield block
            block, used = [], 0
        block.append((r.i, r.t))
        used += len(r.t)
    yield block


def _merge_ranges(lists: Iterable[Iterable[int]]) -> list[int]:
    spans = sorted((x[k], x[k + 1]) for x in map(list, lists) for k in range(0, len(x), 2))
    out: list[int] = []
    for start, stop in spans:
        if out and start <= out[-1]:
            out[-1] = max(out[-1], stop)
        else:
            out += [start, stop]
    return out


def mark_hits(docs: DataFrame, benchmark: DataFrame, out_col: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with a struct column: n_words, ranges (hit word ranges as start, stop pairs), items."""
    bounded_batches(docs.sparkSession)
    blocks = list(benchmark_blocks(benchmark, item_col, item_text_col))
    if len(blocks) == 1:
        return docs.withColumn(out_col, F.pandas_udf(_scanner(blocks[0], window), HITS)(F.col(text_col)))
    marks = []
    for items in blocks:
        marks.append(fresh(docs, "hits"))
        docs = docs.withColumn(marks[-1], F.pandas_udf(_scanner(items, window), HITS)(F.col(text_col)))
    merge = F.pandas_udf(lambda s: s.map(lambda lists: _merge_ranges(lists)), "array<bigint>")
    struct = F.struct(F.col(f"{marks[0]}.n_words").alias("n_words"), merge(F.array(*[f"{m}.ranges" for m in marks])).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.array(*[f"{m}.items" for m in marks])))).alias("items"))
    return docs.withColumn(out_col, struct).drop(*marks)


def _hit_words(ranges):
    return F.aggregate(F.transform(ranges, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (as sorted strings), contaminated."""
    rows = mark_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "hits", "text", item_col, item_text_col)
    n_hit, n_words = _hit_words(F.col("hits.ranges")), F.col("hits.n_words")
    rows = rows.select("doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.col("hits.items").alias("items"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns; no shuffle."""
    mark, own = fresh(docs, "hits"), docs.columns
    rows = mark_hits(docs, benchmark, mark, text_col, item_col, item_text_col)
    n_hit = _hit_words(F.col(f"{mark}.ranges"))
    return rows.where(~((n_hit > 0) & (20 * n_hit >= F.col(f"{mark}.n_words")))).select(*own)


def items_digest(items: list[str]) -> str:
    """What a result says about its items: SHA-256 of the sorted ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
