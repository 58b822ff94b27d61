"""Language identification by prediction by partial matching.

For each language a byte context tree of every order up to ORDER is counted over a sample of labelled
texts and then frozen. A symbol seen c times in a context with T symbols of D kinds has probability
c / (T + D); the escape to the next shorter context has D / (T + D) (method C); a context that was
never seen costs nothing to leave; below order 0 all 256 bytes are alike. A text's code length under
each language is the exact sum over all of its bytes, and the shortest code names the language.

The trees are frozen, so the cost of a byte depends only on the last ORDER + 1 bytes. Costs of all
strings that were seen are tabulated per order, with one column a language; the texts of a batch are
scored by looking up a hash table for the longest order, and only bytes whose string was never seen in
any language go on to shorter orders. TOGETHER languages share a table, so that its empty entries stay
few: the size of all tables is in proportion to the sample, whatever the number of languages.

The sample: at most SAMPLE_DOCS distinct texts a language, and fewer where so many languages would take
more than SAMPLE_TOTAL texts or MODEL_BYTES bytes in all (but one at least), of at most SAMPLE_BYTES each,
taken whole by the order of a hash of the text. At most LANGUAGES are learned, those with the most
labelled rows. This bounds the model; prediction reads every text whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is everything when
no labelled text exists; ties go to the language that sorts first; repeated rows get equal results;
labelled rows with a null or empty text or a null language are not learned from; an empty table gives
an empty result; extra columns are kept by ``identify`` and never read, but for one that has the name of
its result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank.llm.common import bounded_batches

ORDER = 4
SAMPLE_DOCS = 400
SAMPLE_TOTAL = 4000
SAMPLE_BYTES = 65_536
#: Bytes of all sampled texts, languages learned, and languages in one table.
MODEL_BYTES = 8_000_000
LANGUAGES = 1000
TOGETHER = 8
#: Bytes that are scored at once, which bounds a worker's memory.
PIECE = 1 << 17
UNKNOWN = "und"
#: Bits of a byte without any model.
RAW_BITS = 8.0
#: What it takes to reject a document: bits in all, and bits a byte against the stated language.
ODDS, CONTRADICTION = 64.0, 1.5
LETTER = regex.compile(r"\p{L}")


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def rolling_codes(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte after the first ``order`` ones: the last order + 1 bytes as one number."""
    out = np.zeros(len(data) - order, np.uint64)
    for k in range(order, -1, -1):
        out = (out << np.uint64(8)) | data[order - k : len(data) - k].astype(np.uint64)
    return out


class HashIndex:
    """Open addressing from codes to positions 0, 1, 2, ...; -1 for a code that is not there."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 3))))
        self.shift, self.wrap = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(codes), dtype=np.int32), self._first(codes)
        while len(todo):
            free = self.place[slot] < 0
            won, at = np.unique(np.where(free, slot, -1), return_index=True)
            at = at[won >= 0]
            self.place[slot[at]], self.keys[slot[at]] = todo[at], codes[todo[at]]
            rest = np.ones(len(todo), bool)
            rest[at] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.wrap

    def _first(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * self.FACTOR) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        slot = self._first(codes)
        out = self.place[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != codes))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.wrap
            found = self.place[slot]
            out[todo] = found
            wrong = (found >= 0) & (self.keys[slot] != codes[todo])
            todo, slot = todo[wrong], slot[wrong]
        return out


class Trees:
    """Frozen context trees of a few languages: per order the seen strings and contexts with their costs in bits."""

    def __init__(self, samples: list[list[str]], order: int):
        grams: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
        for texts in samples:
            codes = np.concatenate([np.zeros(0, np.uint64), *(rolling_codes(framed(t, order), order) for t in texts)])
            for k in range(order + 1):
                grams[k].append(np.unique(codes & _mask(k + 1), return_counts=True))
        self.order, self.codes, self.costs, self.contexts, self.escapes = order, [], [], [], []
        n = len(samples)
        for k in range(order + 1):
            codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in grams[k])]))
            contexts = np.unique(codes >> np.uint64(8))
            costs, escapes = np.zeros((len(codes), n), np.float32), np.zeros((len(contexts), n), np.float32)
            under = self.costs[k - 1][np.searchsorted(self.codes[k - 1], codes & _mask(k))] if k else np.full((len(codes), n), 8.0, np.float32)
            of = np.searchsorted(contexts, codes >> np.uint64(8))
            for at, (own, counts) in enumerate(grams[k]):
                ctx = np.searchsorted(contexts, own >> np.uint64(8))
                total = np.bincount(ctx, counts, len(contexts))
                kinds = np.bincount(ctx, minlength=len(contexts)).astype(float)
                seen = total > 0
                escapes[seen, at] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                costs[:, at] = escapes[of, at] + under[:, at]
                costs[np.searchsorted(codes, own), at] = -np.log2(counts / (total[ctx] + kinds[ctx]))
            self.codes.append(codes)
            self.costs.append(costs)
            self.contexts.append(contexts)
            self.escapes.append(escapes)
        self._index: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    def size(self) -> int:
        """Bytes of the tables."""
        return sum(x.nbytes for x in (*self.codes, *self.costs, *self.contexts, *self.escapes))

    def symbol_costs(self, codes: np.ndarray) -> np.ndarray:
        """Cost in bits under each language of the last byte of every code."""
        if self._index is None:
            self._index = [HashIndex(c) for c in self.codes], [HashIndex(c) for c in self.contexts]
        by_code, by_context = self._index
        at = by_code[self.order].find(codes)
        out = self.costs[self.order][np.maximum(at, 0)]
        todo = np.flatnonzero(at < 0)
        if len(todo):
            out[todo] = 0
        for k in range(self.order, -1, -1):
            if not len(todo):
                break
            if k < self.order:
                at = by_code[k].find(codes[todo] & _mask(k + 1))
                hit = at >= 0
                out[todo[hit]] += self.costs[k][at[hit]]
                todo = todo[~hit]
            context = by_context[k].find((codes[todo] & _mask(k + 1)) >> np.uint64(8))
            known = context >= 0
            out[todo[known]] += self.escapes[k][context[known]]
        out[todo] += 8.0
        return out


def framed(text: str, order: int) -> np.ndarray:
    """A text's bytes after ``order`` line feeds."""
    return np.frombuffer(b"\n" * order + text.encode("utf-8", "surrogatepass"), np.uint8)


class Model:
    """Frozen context trees of all languages."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        self.parts = [Trees([samples[x] for x in self.languages[k : k + TOGETHER]], order) for k in range(0, len(self.languages), TOGETHER)]

    def size(self) -> int:
        return sum(p.size() for p in self.parts)

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of every whole text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        rows, size = [], 0

        def flush():
            if not rows:
                return
            buffer = np.concatenate([x for _, x in rows])
            codes = rolling_codes(buffer, self.order)
            lengths = np.array([len(x) for _, x in rows])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            keep = np.ones(len(buffer), bool)
            for k in range(self.order):
                keep[starts + k] = False
            codes, firsts = codes[keep[self.order :]], np.concatenate([[0], np.cumsum(lengths - self.order)[:-1]])
            for k, part in enumerate(self.parts):
                sums = np.add.reduceat(part.symbol_costs(codes), firsts, axis=0, dtype=np.float64)
                np.add.at(out[:, k * TOGETHER : (k + 1) * TOGETHER], [i for i, _ in rows], sums)
            rows.clear()

        for i, text in enumerate(texts):
            data = framed(text, self.order)
            for start in range(0, len(data) - self.order, PIECE):  # a piece starts with the bytes before it
                piece = data[start : start + PIECE + self.order]
                rows.append((i, piece))
                size += len(piece)
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        return out

    def judge(self, texts: list[str | None], stated: list[str | None] | None = None) -> pd.DataFrame:
        """lang_pred, score, bits (bits a byte of the shortest code) and excess (bits a byte more under the
        stated language; null if none is stated or it was not learned) of every text."""
        n = len(texts)
        out = {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "bits": [RAW_BITS] * n, "excess": [None] * n}
        known = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
        if known and self.languages:
            bits = self.code_lengths([texts[i] for i in known])
            best, least = bits.argmin(axis=1), bits.min(axis=1, keepdims=True)
            share = 1.0 / np.exp2(-np.minimum(bits - least, 1000.0)).sum(axis=1)
            at = {x: k for k, x in enumerate(self.languages)}
            for row, i in enumerate(known):
                size = len(texts[i].encode("utf-8", "surrogatepass"))
                out["lang_pred"][i], out["score"][i], out["bits"][i] = self.languages[best[row]], float(share[row]), float(least[row, 0]) / size
                if stated and stated[i] in at:
                    out["excess"][i] = float(bits[row, at[stated[i]]] - least[row, 0]) / size
        return pd.DataFrame(out).astype({"excess": "float64"})

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of every text."""
        rows = self.judge(texts)
        return list(rows["lang_pred"]), list(rows["score"])


def training_sample(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[str]]:
    """Whole distinct texts by language, bounded as the module says."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES))
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.count(F.lit(1)).alias("rows"))
    counts = {r.lang: r.n for r in found.orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    most, most_bytes = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // len(counts))), MODEL_BYTES // len(counts)
    # A hash below the cut keeps about twice the sample of each language (all of it, if it is small).
    cut = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2.0 * most + 200) / max(1, n)))])
    near = rows.where((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) <= F.try_element_at(cut, F.col("lang")))
    few = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    ranked = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    ranked = ranked.withColumn("b", F.sum(F.octet_length("text")).over(order)).where((F.col("r") == 1) | (F.col("b") <= most_bytes))
    out: dict[str, list[str]] = {}
    for r in ranked.select("lang", "text").collect():
        out.setdefault(r.lang, []).append(r.text)
    return {lang: sorted(texts) for lang, texts in out.items()}


def identify(docs: DataFrame, model: Model, out_col: str = "language", text_col: str = "text", stated_col: str | None = None) -> DataFrame:
    """``docs`` with a struct column: lang_pred, score, bits and excess, as ``Model.judge`` says.

    The prediction reads the text alone; ``stated_col`` is only held against it. An input column of the
    result's name is replaced.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits double, excess double")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, stated in batches:
            yield shared.value.judge([t if isinstance(t, str) else None for t in texts], [x if isinstance(x, str) else None for x in stated])

    stated = F.lit(None).cast("string") if stated_col is None else F.col(stated_col).cast("string")
    return docs.withColumn(out_col, judged(F.col(text_col), stated))


def rejected(found: str, text: Column) -> Column:
    """Whether a document goes, by its struct column of ``identify`` and its text.

    It has no language; or no learned language explains it, as its code is at least ODDS bits longer than
    the text as it is; or it is in another language than the stated one, whose code is at least ODDS bits
    and CONTRADICTION bits a byte longer.
    """
    size = F.octet_length(text)
    foreign = (F.col(f"{found}.bits") - RAW_BITS) * size >= ODDS
    contradicted = (F.col(f"{found}.excess") * size >= ODDS) & (F.col(f"{found}.excess") >= CONTRADICTION)
    return (F.col(f"{found}.lang_pred") == UNKNOWN) | foreign | F.coalesce(contradicted, F.lit(False))


def has_letter(text: Column) -> Column:
    """Whether a text has a letter; false for null."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([isinstance(t, str) and LETTER.search(t) is not None for t in texts], dtype=bool)

    return found(text)


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    return Model(training_sample(labelled, lang_col, text_col))
