r"""Personal data: pattern spans, and terms that give the protected values away.

Four kinds of values are found by pattern in whole texts, leftmost and without overlap per kind:
e-mail addresses, IP addresses (parts up to 255), card numbers (12 to 19 digits, Luhn) and phone
numbers (9 to 15 digits). A match that fails its test is dropped and not tried again.

Information-theoretic sanitisation then looks for terms that reveal a protected entity. Entities are the
values found by pattern, and the credentials that a text assigns to one of the names CREDENTIALS
(``token = "..."``) or that name themselves by one of KEY_FORMATS. A term is a word of three letters or
more, or a code: a run of letters, digits and ``_+/-`` of six characters or more with a digit. A term t
discloses the share

    PMI(t; c) / IC(c) = log(N n(t,c) / (n(t) n(c))) / log(N / n(c))

of the information content of an entity c, with document counts over whole texts and all N documents: n(c)
with the entity, n(t) with the term, n(t,c) with both. At GENERALISE or more the term is generalised, at
REMOVE or more it is removed, wherever it stands outside of values, in every document.

A value: t and c meet if one text holds both. One text proves nothing, and near copies of a text prove no
more than it does, so they count only if they meet in at least two different texts that are not copies of
one: the distinct entries of SKETCH min-hash columns over the texts' terms tell how many texts there are
besides copies (see ``independent``). Texts of fewer than COPY_TERMS terms count as they are. Values of one
text alone are left out before pairs are made, and so are terms too frequent to reach GENERALISE: that
needs n(t) <= n(t,c) (N / n(c))^(1 - GENERALISE), and the documents with values already give a lower bound
of n(t).

A credential: t and c meet if the text assigns t to the name, or t has the format. The name stands for many
secrets, and one text is enough to give a secret away; N counts one document more, so that a name in all
of them has content. A code that is written nowhere else discloses all of it, a common word next to nothing.

Each document is scanned once for values, credentials and, if it has a value, its terms; that goes to the
shared folder and all counts of values and pairs come from there. A second pass counts n(t) of the few
candidates, a third one marks. Candidates and disclosing terms reach the executors as sets while there are
at most BROADCAST_TERMS of them; beyond that they meet the documents by shuffles, with equal results.

Defined cases: null texts count as empty; ties and repeated rows are separate documents, and equal
texts never add evidence of their own; a value in every document has no content to disclose; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank.llm.common import bounded_batches, durable, fresh, whole_text

KINDS = ("email", "ip", "card", "phone")
TERM_KIND = "term"
GENERALISE, REMOVE = 0.8, 0.95
BROADCAST_TERMS = 300_000
#: Min-hash columns of a text and how many of them have to agree that texts are no copies, terms from which
#: a text can be told to be a near copy, and the share of new entries that near copies stay below.
SKETCH, AGREE, COPY_TERMS, COPY_SHARE = 9, 7, 16, 0.35
COUNT_ERROR = 0.15

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only be entered at its start, as an earlier match ends with its run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
HAS_DIGIT = re.compile(r"[0-9]")
#: Codes and words, for texts with a digit; without one TERM finds the same.
CODE_OR_TERM = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{6})[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/-]*+|[^\W\d_]{3,}")
# Names that credentials are assigned to.
CREDENTIALS = ("token", "secret", "password", "passwd", "pwd", "passphrase", "api key", "access key", "private key", "credential")
# Formats of keys that name themselves, by name.
KEY_FORMATS = {"akia": r"AKIA[0-9A-Z]{16}", "github": r"gh[pousr]_[A-Za-z0-9]{36}", "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}", "google": r"AIza[0-9A-Za-z_-]{35}"}
KEY = re.compile("(?<![A-Za-z0-9_+/-])(?:" + "|".join(f"(?P<{name}>{form})" for name, form in KEY_FORMATS.items()) + ")(?![A-Za-z0-9_+/-])")
ASSIGNED = re.compile(rf"(?<![A-Za-z])({'|'.join(c.replace(' ', '[_-]?') for c in CREDENTIALS)})[\"']?[\x20\t]{{0,4}}[=:][\x20\t]{{0,4}}([\"']?)([A-Za-z0-9_+/-]{{4,}})", re.I)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @: the local part is the run of its characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern spans, by start and then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 20 else not p.strip("0") or int(p[-20:]) <= 255 and not p[:-20].strip("0") for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint ranges that sorted spans cover."""
    starts, ends = [], []
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def value_of(text: str, start: int, kind: int, end: int) -> str:
    """A span's value, in one spelling."""
    own = text[start:end]
    return f"{KINDS[kind]}:{own.lower() if kind == 0 else NOT_DIGIT.sub('', own) if kind > 1 else own}"


def _tokens(text: str) -> re.Pattern:
    return CODE_OR_TERM if HAS_DIGIT.search(text) else TERM


def words_of(text: str) -> set[str]:
    """The distinct terms of a whole text."""
    return {w.lower() for w in set(_tokens(text).findall(text))}


def free_words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """All words that no span touches, and all codes that lie in none."""
    starts, ends = covered(spans)
    for m in _tokens(text).finditer(text):
        k = bisect_left(starts, m.end())  # the ranges before k start before the term ends
        if not k or ends[k - 1] <= m.start() or (HAS_DIGIT.search(m[0]) and not (starts[k - 1] <= m.start() and m.end() <= ends[k - 1])):
            yield m


def sketch(text: str, terms: list[str]) -> list[int]:
    """Min-hashes of the terms; of a text with few terms, hashes of the text itself."""
    from xxhash import xxh64_intdigest

    named = terms if len(terms) >= COPY_TERMS else [text]
    own = np.array([xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in named], np.uint64)
    return [int(np.bitwise_xor(own * np.uint64(2 * k + 0x9E3779B97F4A7C15), own >> np.uint64(29)).min().view(np.int64)) for k in range(SKETCH)]


def credentials(text: str) -> set[tuple[str, str]]:
    """(name, term) of keys in one of KEY_FORMATS, and of what a text assigns to a credential's name: quoted, after =, or a code."""
    out = {(f"credential:{m.lastgroup}", m[0].lower()) for m in KEY.finditer(text)} if HAS_DIGIT.search(text) else set()
    for m in ASSIGNED.finditer(text) if "=" in text or ":" in text else ():
        if m[2] or HAS_DIGIT.search(m[3]) or ":" not in text[m.end(1) : m.start(3)]:
            name = f"credential:{re.sub('[_-]', '', m[1].lower())}"
            out.update((name, w.lower()) for w in CODE_OR_TERM.findall(m[3]))
    return out


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> dict[tuple[str, str], set[tuple[int, int]]]:
    """Places of the words in a text with each value: (value, word) -> {(start, end)}, outside of all spans."""
    places: dict[str, set[tuple[int, int]]] = {"": set()}  # the value itself, once per document
    for m in free_words(text, spans):
        places.setdefault(m[0].lower(), set()).add(m.span())
    return {(v, w): p for v in {value_of(text, *s) for s in spans} for w, p in places.items()}


def _words(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(words_of(t)) for t in texts], dtype=object)


def _word_places(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"term": m[0].lower(), "start": m.start(), "end": m.end()} for m in free_words(t, base_spans(t))] for t in texts], dtype=object)


PLACES = "array<struct<term:string,start:long,end:long>>"


class Known:
    """A set of terms with a value each, and a quick test which texts may hold one."""

    def __init__(self, terms: dict[str, object]):
        self.terms, self._automaton = terms, None

    def __getstate__(self):
        return {"terms": self.terms, "_automaton": None}

    def may_be_in(self, text: str) -> bool:
        """False only if no term is in the text, not even as a part of a word."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term in self.terms:
                self._automaton.add_word(term, term)
            self._automaton.make_automaton()
        # The small form of a capital sigma depends on what follows it, so a word's may differ from its text's.
        return bool(self.terms) and ("\u03a3" in text or next(self._automaton.iter(text.lower()), None) is not None)


def small_set(rows: DataFrame) -> list | None:
    """The rows, if there are at most BROADCAST_TERMS."""
    known = rows.limit(BROADCAST_TERMS + 1).collect()
    return known if len(known) <= BROADCAST_TERMS else None


def document_frequency(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n: documents whose whole text has the term, for each row of ``terms`` (distinct, column term) that any has."""
    known = small_set(terms)
    if known is None:
        return docs.select(F.explode(F.pandas_udf(_words, "array<string>")(whole_text(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term", "left_semi")
    if not known:
        return terms.select("term", F.lit(0).cast("long").alias("n"))
    names = sorted(r.term for r in known)
    shared = docs.sparkSession.sparkContext.broadcast(Known({t: k for k, t in enumerate(names)}))

    @F.pandas_udf("array<int>")
    def held(texts: pd.Series) -> pd.Series:
        wanted = shared.value
        return pd.Series([[wanted.terms[w] for w in words_of(t) & wanted.terms.keys()] if wanted.may_be_in(t) else [] for t in texts], dtype=object)

    counts = docs.select(F.explode(held(whole_text(text_col))).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(docs.sparkSession.createDataFrame(list(enumerate(names)), "k int, term string"), "k").select("term", "n")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, computed once: uid, doc_id, key (a digest of the text) and its hash, base spans, values,
    credentials, and for texts with values their terms and sketch."""

    @F.pandas_udf("base array<struct<start:long,kind:int,end:long>>, values array<string>, secrets array<struct<value:string,term:string>>, terms array<string>, sketch array<long>")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = base_spans(t)
            values = sorted({value_of(t, *s) for s in spans})
            terms = sorted({m[0].lower() for m in free_words(t, spans)}) if values else []
            rows.append((
                [{"start": a, "kind": k, "end": b} for a, k, b in spans],
                values,
                [{"value": c, "term": w} for c, w in sorted(credentials(t))],
                terms,
                sketch(t, terms) if values else [],
            ))
        return pd.DataFrame(rows, columns=["base", "values", "secrets", "terms", "sketch"])

    bounded_batches(docs.sparkSession)
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("key"), found(text).alias("f"))
    return durable(rows.select("doc_id", "key", "f.*").withColumns({"uid": F.monotonically_increasing_id(), "text_hash": F.xxhash64("key")}))


def repeated(rows: DataFrame, *by: str, copies: bool = True) -> DataFrame:
    """The columns ``by`` and n (rows) where at least two different texts (column text_hash) have them, or without
    ``copies`` two that are no near copies (column sketch). Distinct entries are counted in COUNT_ERROR's registers."""
    entries = [] if copies else [F.approx_count_distinct("text_hash", COUNT_ERROR).alias("texts"), *[F.approx_count_distinct(F.get("sketch", F.lit(k)), COUNT_ERROR).alias(f"s{k}") for k in range(SKETCH)]]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("k0"), F.max("text_hash").alias("k1"), *entries)
    return counts.where((F.col("k0") < F.col("k1")) & (F.lit(True) if copies else independent())).select(*by, "n")


def independent() -> Column:
    """Whether texts (their number) with distinct sketch entries s0, s1, ... are more than copies of one.

    Each near copy adds a new entry to a column with the small share of terms that it changes, another
    text nearly always. AGREE columns have to show enough entries.
    """
    entries = F.get(F.array_sort(F.array(*[f"s{k}" for k in range(SKETCH)])), F.lit(SKETCH - AGREE))
    return entries - 1 >= F.greatest(F.lit(1.0), COPY_SHARE * (F.col("texts") - 1))


def value_pairs(scanned: DataFrame, total: int) -> DataFrame:
    """value, term, n_c, n_tc of pairs that meet in two different texts and may still reach GENERALISE."""
    with_values = scanned.where(F.size("values") > 0)
    held = with_values.select("uid", "text_hash", "sketch", F.explode("values").alias("value"))
    # A value in every document has no content to disclose.
    held = durable(held.join(repeated(held, "value").withColumnRenamed("n", "n_c").where(F.col("n_c") < total), "value"))
    words = with_values.join(held.select("uid").distinct(), "uid", "left_semi").select("uid", "text_hash", "sketch", F.explode("terms").alias("term"))
    least = repeated(words, "term").withColumnRenamed("n", "least")  # n(t) is at least that
    share = F.pow(F.lit(float(total)) / F.col("n_c"), F.lit(1.0 - GENERALISE)) * 1.000001
    met = words.join(least, "term").join(held.select("uid", "value", "n_c"), "uid").where(F.col("least") <= F.col("n_c") * share)
    counts = repeated(met, "value", "term", "n_c", "least", copies=False).withColumnRenamed("n", "n_tc")
    return counts.where(F.col("least") <= F.col("n_tc") * share).select("value", "term", "n_c", "n_tc")


def credential_pairs(scanned: DataFrame) -> DataFrame:
    """value, term, n_c, n_tc of terms that are assigned to a credential's name."""
    given = scanned.select("uid", F.explode("secrets").alias("s")).select("uid", "s.*")
    names = given.select("uid", "value").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_c"))
    return given.groupBy("value", "term").agg(F.count(F.lit(1)).alias("n_tc")).join(names, "value").select("value", "term", "n_c", "n_tc")


def disclosing_terms(docs: DataFrame, text_col: str = "text", scanned: DataFrame | None = None) -> DataFrame:
    """value, term, disclosure of every term at GENERALISE or more."""
    scanned = scan(docs, docs.columns[0], text_col) if scanned is None else scanned
    total = scanned.count()
    of_values = value_pairs(scanned, total).withColumn("size", F.lit(float(total)))
    pairs = durable(of_values.unionByName(credential_pairs(scanned).withColumn("size", F.lit(total + 1.0))))
    seen = document_frequency(docs, pairs.select("term").distinct(), text_col).withColumnRenamed("n", "n_t")
    log_share = F.log(F.col("size") * F.col("n_tc") / (F.greatest("n_t", "n_tc") * F.col("n_c")))
    scored = pairs.join(seen, "term").withColumn("disclosure", log_share / F.log(F.col("size") / F.col("n_c")))
    return scored.where(F.col("disclosure") >= GENERALISE).select("value", "term", "disclosure")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, base (array of start, kind, end) and terms (array of start, end, disclosure)."""
    scanned, text = scan(docs, id_col, text_col), whole_text(text_col)
    risky = durable(disclosing_terms(docs, text_col, scanned).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    known = small_set(risky)
    shared = docs.sparkSession.sparkContext.broadcast(Known({r.term: r.disclosure for r in known or []}))

    @F.pandas_udf("array<struct<start:long,end:long,disclosure:double>>")
    def marks(texts: pd.Series) -> pd.Series:
        out, score = [], shared.value.terms
        for t in texts:
            hit = shared.value.may_be_in(t) and not score.keys().isdisjoint(words_of(t))
            out.append([{"start": m.start(), "end": m.end(), "disclosure": score[w]} for m in free_words(t, base_spans(t)) if (w := m[0].lower()) in score] if hit else [])
        return pd.Series(out, dtype=object)

    none = F.array().cast("array<struct<start:long,end:long,disclosure:double>>")
    if known == []:
        return scanned.select("doc_id", "base", none.alias("terms"))
    # Places depend on the text alone, so equal texts share them.
    texts = docs.select(F.sha2(F.encode(text, "UTF-8"), 256).alias("key"), text.alias("text"))
    if known is None:
        texts = texts.groupBy("key").agg(F.first("text").alias("text"))
        places = texts.select("key", F.explode(F.pandas_udf(_word_places, PLACES)("text")).alias("p")).select("key", "p.*").join(risky, "term")
        by_text = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    else:
        marked = texts.select("key", marks("text").alias("terms")).where(F.size("terms") > 0)
        by_text = marked.groupBy("key").agg(F.first("terms").alias("terms"))
    return scanned.select("doc_id", "base", "key").join(by_text, "key", "left").select("doc_id", "base", F.coalesce("terms", none).alias("terms"))


def joined(spans: Column) -> Column:
    """Spans (start, kind, end) as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM_KIND)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_report(found: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind, a digest of the pattern spans and all spans as text."""
    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")))
    return found.select("doc_id", *counts, F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", terms))).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with private values and disclosing words replaced in the text; other columns stay.

    A value becomes [EMAIL], [IP], [CARD] or [PHONE] (of overlapping spans the first one), a word
    [TERM] or nothing. Rows are matched by a row id, so equal and missing doc_ids do no harm.
    """
    uid, spans = fresh(docs, "uid"), fresh(docs, "spans")
    rows = durable(docs.withColumn(uid, F.monotonically_increasing_id()))
    found = find_private(rows, uid, text_col)

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for t, own, more in zip(texts, base, terms, strict=True):
            if t is None or own is None:
                out.append(t)
                continue
            cuts = sorted([(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in own] + [(s["start"], s["end"], "" if s["disclosure"] >= REMOVE else "[TERM]") for s in more])
            parts, at = [], 0
            for a, b, put in cuts:
                if a >= at:
                    parts += [t[at:a], put]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    hits = found.where((F.size("base") > 0) | (F.size("terms") > 0)).select(F.col("doc_id").alias(uid), F.struct("base", "terms").alias(spans))
    clean = rows.join(hits, uid, "left").withColumn(text_col, F.when(F.col(spans).isNotNull(), replaced(F.col(text_col), F.col(f"{spans}.base"), F.col(f"{spans}.terms"))).otherwise(F.col(text_col)))
    return clean.select(*docs.columns)
