"""Deterministic hash embeddings, cache keys and the texts that are embedded."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


@functools.cache
def _seeds(dims: int) -> np.ndarray:
    """Hash states after each dimension's number, eight bytes, lowest first."""
    state = np.full(dims, FNV_OFFSET, np.uint64)
    numbers = np.arange(dims, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        state = (state ^ numbers[:, k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return state


def hash_vectors(texts: Sequence[str], dims: int = 384) -> np.ndarray:
    """A row per text: each dimension is the hash of its number and the text, scaled to -1..1; unit length.

    The hash goes byte by byte, so all texts of a batch advance together, the longest first in the rows.
    """
    data = [t.encode() for t in texts]
    order = sorted(range(len(data)), key=lambda i: -len(data[i]))
    lengths = np.array([len(data[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    flat = np.frombuffer(b"".join(data[i] for i in order), np.uint8)
    state = np.tile(_seeds(dims), (len(data), 1))
    active = len(data)
    for p in range(int(lengths[0]) if len(data) else 0):
        while active and lengths[active - 1] <= p:
            active -= 1
        part = state[:active]
        part ^= flat[starts[:active] + p].astype(np.uint64)[:, None]
        part *= np.uint64(FNV_PRIME)  # wraps around
    out = np.empty((len(data), dims), np.float32)
    out[order] = state.astype(np.float64) / float(2**64 - 1) * 2 - 1
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def hash_vector(text: str, dims: int = 384) -> np.ndarray:
    return hash_vectors([text], dims)[0]


def byte_vector(text: str, dims: int = 384) -> np.ndarray:
    """Sums of (byte - 96) / 32 at the byte's position modulo the dimensions; unit length."""
    data = np.frombuffer(text.encode(), np.uint8).astype(np.float32)
    v = np.bincount(np.arange(len(data)) % dims, (data - 96) / 32, dims).astype(np.float32) if len(data) else np.zeros(dims, np.float32)
    length = np.sqrt((v * v).sum())
    return v / length if length > 0 else v


def hash_embedding(text: Column | str, dims: int = 384, kind: str = "hash") -> Column:
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known = [t for t in texts if isinstance(t, str)]
        made = iter(hash_vectors(known, dims) if kind == "hash" else [byte_vector(t, dims) for t in known])
        return pd.Series([next(made) if isinstance(t, str) else None for t in texts], dtype=object)

    return embed(text)


def cache_key(model: str, text: str) -> int:
    """FNV-1a of model, a separator byte and text."""
    state = FNV_OFFSET
    for byte in model.encode() + b"\xff" + text.encode():
        state = ((state ^ byte) * FNV_PRIME) % 2**64
    return state


def memory_key(content: Column | str, entities: Column | str, tags: Column | str, context: Column | str | None = None) -> Column:
    """The text that is embedded for an extracted memory."""
    col = lambda c: F.col(c) if isinstance(c, str) else c

    def part(label: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f" [{label}: "), F.array_join(values, ", "), F.lit("]"))).otherwise(F.lit(""))

    out = F.concat(col(content), part("entities", col(entities)), part("topics", col(tags)))
    return F.concat(out, part("context", col(context))) if context is not None else out


def entity_key(name: str, kind: str, attributes: str) -> Column:
    """The text that is embedded for an entity: categories first, then its other attributes in order."""
    category = F.element_at(attributes, F.lit("category"))
    rest = F.array_sort(F.map_entries(F.map_filter(attributes, lambda k, _: k != "category")))
    return F.concat(
        F.col(name), F.lit(" ("), F.col(kind), F.lit(")"),
        F.when(F.coalesce(category, F.lit("")) != "", F.concat(F.lit(" [categories: "), category, F.lit("]"))).otherwise(F.lit("")),
        F.array_join(F.transform(rest, lambda e: F.concat(F.lit(" "), e["key"], F.lit(": "), e["value"])), ""),
    )


def categories(text: Column) -> Column:
    """Categories of an attribute: comma-separated, lower case, blanks for underscores, sorted."""
    parts = F.transform(F.split(text, ","), lambda c: F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" ")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda c: c != "")))
