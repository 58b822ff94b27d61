"""Best-fit-decreasing packing of token sequences.

A document's token ids, with an end id, are cut into full windows and one rest. Full windows are
sequences of their own. The rests are dealt evenly to groups of at most GROUP_ROWS; in each group they
are taken from the longest to the shortest, and a segment tree over remaining capacities finds the
open window that leaves the least room. A group wastes at most a few windows, whatever the input's
size, and groups pack independently.

Token ids come from the vocabulary that the tokenizer file holds. Its ranks, as the companion
``.tiktoken`` file, give the same ids several times as fast, so that is the usual way; the tokenizer
file itself takes every text that holds the string of an added token (``<|endoftext|>`` is one id there,
whatever ``add_special_tokens`` says), every text that the fast encoder refuses, and every text where no
rank file exists.

Defined cases: a null text is empty; an empty document is one piece that holds the end id alone; ties
in length are ordered by doc_id (null first) and start, and repeated rows are separate pieces; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import math
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebank.llm.common import bounded_batches, durable

WINDOW = 2048
END_ID = 1
GROUP_ROWS = 100_000
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids, for one tokenizer file, as its ``encode(text, add_special_tokens=False)`` gives them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    added = [token.content for token in plain.get_added_tokens_decoder().values()]
    ranks_file = os.path.splitext(path)[0] + ".tiktoken"

    def slow(text: str) -> list[int]:
        return plain.encode(text, add_special_tokens=False).ids

    if not os.path.exists(ranks_file):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(token in text for token in added):
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as refusal:  # the fast encoder's panics are no Exceptions
            if isinstance(refusal, KeyboardInterrupt | SystemExit):
                raise
            return slow(text)

    return encode


def cut_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*(encode(text) if isinstance(text, str) else ()), END_ID], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *([piece.astype("int32")] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])
            yield out.astype({"doc_id": batch["doc_id"].dtype})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    # The id travels as a string, so that a null among numbers does not turn them into floats.
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(cut, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over the capacities 0 to size."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, size.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out (window, room) of the least room that holds ``length``; None if there is none."""
        at, count = length + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up to the first right neighbour that is not empty
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.windows[room].pop(), room


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each length; ``lengths`` is in decreasing order."""
    open_windows, placed, offsets, opened = OpenWindows(window), [], [], 0
    for length in lengths:
        if found := open_windows.tightest(length):
            at, room = found
        else:
            at, room = opened, window
            opened += 1
        placed.append(at)
        offsets.append(window - room)
        if room > length:
            open_windows.put(at, room - length)
    return placed, offsets


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    path = path or vocabulary_path()
    pieces = durable(cut_pieces(docs, path, id_col, text_col, window, with_ids).withColumn("uid", F.monotonically_increasing_id()))
    rests = pieces.where(F.col("length") < window)
    groups = max(1, math.ceil(rests.count() / GROUP_ROWS))
    # Rows are dealt in turn, so no id or text can fill a group; the high bits tell input partitions apart.
    dealt = rests.withColumn("group", F.pmod(F.shiftright("uid", 33) + F.col("uid").bitwiseAND((1 << 33) - 1), F.lit(groups)))
    kind = dict(pieces.dtypes)["doc_id"]

    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "uid"], ascending=[False, True, True, True], na_position="first", kind="stable")
        placed, offsets = best_fit_decreasing(rows["length"].tolist(), window)
        # Odd ids are packed windows of a group, even ones full windows.
        return pd.DataFrame({"uid": rows["uid"].to_numpy(), "sequence_id": ((np.int64(key[0]) << 32) + np.array(placed, np.int64)) * 2 + 1, "offset": np.array(offsets, np.int64)})

    plan = dealt.select("group", "length", F.col("doc_id").cast("string").alias("doc_id"), "start", "uid").groupBy("group").applyInPandas(settle, "uid long, sequence_id long, offset long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    full = pieces.where(F.col("length") == window).withColumn("sequence_id", F.col("uid") * 2).withColumn("offset", F.lit(0).cast("long"))
    packed = rests.join(plan, "uid")
    return full.select(*columns).unionByName(packed.select(*columns)).withColumn("doc_id", F.col("doc_id").cast(kind))
