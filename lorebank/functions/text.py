"""Text and other scalar functions as column expressions, with the fixed word lists they use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and labels of the text rules.
POSITIVE = ("great", "excellent", "perfect", "thanks", "awesome", "love", "good", "nice", "wonderful", "fantastic", "helpful", "amazing", "brilliant", "works", "solved")
NEGATIVE = ("bad", "terrible", "awful", "hate", "wrong", "broken", "fail", "error", "bug", "frustrating", "annoying", "useless", "horrible", "worst", "disappointed")
ACTIONS = (
    ("deploy", "deployment"), ("release", "release"), ("migrate", "migration"), ("refactor", "refactoring"), ("debug", "debugging"), ("install", "installation"),
    ("configure", "configuration"), ("test", "testing"), ("build", "building"), ("commit", "version_control"), ("merge", "version_control"), ("review", "code_review"),
)
CORRECTIONS = ("actually", "correction", "i was wrong", "that's not right", "let me correct", "i meant", "not quite", "to clarify", "i misspoke", "update:", "scratch that")
SPECULATIONS = ("might be", "probably", "seems like", "i think", "looks like", "considering", "planning to", "thinking about", "maybe")
FACT_PATTERNS = ((" is ", "is"), (" uses ", "uses"), (" prefers ", "prefers"), (" switched to ", "switched_to"), (" decided on ", "decided_on"))
KEY_WORDS = ("decided", "uses", "prefers", "switched", "chose", "selected", "important", "critical", "must", "should", "always", "never")
FILLERS = ("actually", "basically", "honestly", "really", "very", "quite", "just", "simply", "perhaps", "maybe", "somewhat", "rather", "kind of", "sort of", "you know", "i think", "i mean")
REPLACEMENT_CUES = ("now ", "currently", "no longer", "switched", "migrated", "upgraded", "replaced", "moved", "relocated", "renamed", "rewrote", "launched version", "started at", "joined", "changed to", "instead")
NEGATIONS = ("not ", "never ", "don't ", "doesn't ", "isn't ", "actually ", "instead ")
SPEAKERS = ("user:", "assistant:", "human:", "ai:", "\nq:", "\na:")

#: White space between words, the same in both engines of the tests.
SPACE = r"[ \t\r\n\f\x0b]+"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """The words of a text, split at white space."""
    return F.filter(F.split(_column(text), SPACE), lambda w: w != "")


def token_estimate(text: Column | str) -> Column:
    """ceil(1.3 x words); 0 for a blank text."""
    return F.ceil(F.size(words(text)) * F.lit(1.3)).cast("long")


def normalise_name(text: Column | str) -> Column:
    """Lower case, single blanks, no blanks at the ends."""
    return F.lower(F.array_join(words(text), " "))


def contains_any(text: Column | str, needles: Sequence[str]) -> Column:
    text = _column(text)
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def sentiment(text: Column | str, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(words with a positive part - words with a negative part) / words, within -1 and 1."""
    own = words(F.lower(_column(text)))
    plus, minus = F.size(F.filter(own, lambda w: contains_any(w, positive))), F.size(F.filter(own, lambda w: contains_any(w, negative)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (plus - minus).cast("double") / F.greatest(F.size(own), F.lit(1)).cast("double")))


def sentences(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_column(text), r"\."), lambda s: F.trim(s)), lambda s: s != "")


def actions(text: Column | str, keywords: Sequence[tuple[str, str]] = ACTIONS) -> Column:
    """Array of (keyword, action_type, detail) for each keyword in the lower-cased text.

    The detail is the first sentence that holds the keyword, up to 200 characters.
    """
    lower = F.lower(_column(text))
    parts = F.split(lower, r"\.")

    def found(keyword: str, kind: str) -> Column:
        sentence = F.get(F.filter(parts, lambda s: s.contains(keyword)), F.lit(0))
        return F.when(lower.contains(keyword), F.struct(F.lit(keyword).alias("keyword"), F.lit(kind).alias("action_type"), F.substring(F.trim(sentence), 1, 200).alias("detail")))

    return F.filter(F.array(*[found(*k) for k in keywords]), lambda x: x.isNotNull())


def is_correction(text: Column | str, cues: Sequence[str] = CORRECTIONS) -> Column:
    return contains_any(F.lower(_column(text)), cues)


def is_speculation(text: Column | str, cues: Sequence[str] = SPECULATIONS) -> Column:
    """Case-sensitive, unlike the correction test."""
    return contains_any(text, cues)


def has_replacement_cue(text: Column | str, cues: Sequence[str] = REPLACEMENT_CUES) -> Column:
    return contains_any(F.lower(_column(text)), cues)


def is_conversation(text: Column | str) -> Column:
    """At least two speaker markers."""
    lower = F.lower(_column(text))
    return sum((F.when(lower.contains(s), 1).otherwise(0) for s in SPEAKERS), F.lit(0)) >= 2


def facts(text: Column | str, patterns: Sequence[tuple[str, str]] = FACT_PATTERNS) -> Column:
    """Array of (sentence_no, subject, predicate, object): per sentence the first hit of each pattern."""

    def of(sentence: Column, number: Column) -> Column:
        lower = F.lower(sentence)
        found = []
        for phrase, predicate in patterns:
            at = F.instr(lower, phrase)
            subject = F.trim(F.substring(sentence, F.lit(1), at - 1))
            rest = F.trim(F.substring(sentence, at + len(phrase), F.length(sentence)))
            found.append(F.when((at > 0) & (subject != "") & (rest != ""), F.struct(number.alias("sentence_no"), subject.alias("subject"), F.lit(predicate).alias("predicate"), rest.alias("object"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return F.flatten(F.transform(sentences(text), of))


def memory_tier(memory_type: Column | str) -> Column:
    """Order of the tiers; unknown types count as Episodic."""
    order = F.create_map(*[x for k, v in (("Working", 0), ("Episodic", 1), ("Semantic", 2), ("Procedural", 3), ("Archival", 4)) for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(order, _column(memory_type)), F.lit(1))


def mapped_type(kind: Column | str) -> Column:
    """Memory type of an extracted kind."""
    kind = F.lower(_column(kind))
    return (
        F.when(kind.isin("decision", "preference", "fact", "entity"), "Semantic")
        .when(kind == "correction", "Correction")
        .when(kind == "anti_pattern", "AntiPattern")
        .otherwise("Episodic")
    )


def permits(held: Column | str, wanted: Column | str) -> Column:
    """Admin permits all, ReadWrite permits Read and Write, otherwise the two must be equal."""
    held, wanted = _column(held), _column(wanted)
    return (held == "Admin") | (held == wanted) | ((held == "ReadWrite") & wanted.isin("Read", "Write"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the word sets (words of two characters or more) of two texts."""
    own = [F.array_distinct(F.filter(words(F.lower(_column(x))), lambda w: F.length(w) >= 2)) for x in (a, b)]
    union = F.size(F.array_union(*own))
    return F.when(union > 0, F.size(F.array_intersect(*own)).cast("double") / union).otherwise(F.lit(0.0))


def bare_words(text: Column | str) -> Column:
    """Lower-cased words with punctuation trimmed."""
    return F.filter(F.transform(words(F.lower(_column(text))), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")


def query_ngrams(text: Column | str, longest: int = 5) -> Column:
    """Distinct n-grams of 1 to ``longest`` bare words; for short texts, as every gram reads the text anew."""
    return ngrams(bare_words(text), longest)


def ngrams(own: Column, longest: int) -> Column:
    """Distinct n-grams of 1 to ``longest`` entries of an array of words."""

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(own) - (n - 1))
        return F.when(F.size(own) >= n, F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[grams(n) for n in range(1, longest + 1)])))


def amount(text: Column | str) -> Column:
    """The number in a text of an amount: digits, point and minus are kept; null if nothing parses."""
    return F.regexp_replace(_column(text), r"[^0-9.\-]", "").try_cast("double")


def money(total: Column) -> Column:
    """Dollars, without decimals where the amount is whole."""
    return F.when(total == F.floor(total), F.concat(F.lit("$"), total.cast("long").cast("string"))).otherwise(F.format_string("$%.2f", total))


def evidence_span(needle: Column | str, haystack: Column | str) -> Column:
    """Byte offsets (start, stop) of the first occurrence, null if there is none."""
    needle, haystack = _column(needle), _column(haystack)
    at = F.position(needle, haystack)
    start = F.octet_length(F.substring(haystack, F.lit(1), at - 1)).cast("long")
    return F.when((at > 0) & (needle != ""), F.struct(start.alias("start"), (start + F.octet_length(needle)).alias("stop")))
