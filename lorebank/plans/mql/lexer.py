"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = {
    "RECALL", "MEMORIES", "NEAR", "WHERE", "AND", "OR", "NOT", "ORDER", "BY", "ASC", "DESC", "LIMIT", "RELATE", "AS", "WITH", "WEIGHT", "FORGET", "CONSOLIDATE", "TRAVERSE", "DEPTH", "HOPS", "WITHIN", "EDGE_TYPE", "TRUE", "FALSE",
}

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
TOKEN = re.compile(
    rf"""(?P<blank>\s+)
    |(?P<uuid>{UUID})(?![\w-])
    |(?P<float>[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?\d+[eE][+-]?\d+)
    |(?P<int>[+-]?\d+)(?![\w.])
    |(?P<arrow>->)
    |(?P<op>~>|!=|>=|<=|=|>|<)
    |(?P<punct>[\[\],])
    |"(?P<string>(?:[^"\\]|\\.)*)"
    |(?P<word>[^\W\d][\w-]*)""",
    re.X | re.S,
)


class MqlError(ValueError):
    """A statement that the language does not have."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokenize(source: str) -> list[Token]:
    """Keywords (upper case), words, literals and punctuation; an unknown character is an error."""
    out, at = [], 0
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise MqlError(f"unexpected {source[at]!r} at {at}")
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "word" and text.upper() in KEYWORDS:
            kind, text = "keyword", text.upper()
        if kind != "blank":
            out.append(Token(kind, text, at))
        at = m.end()
    return [*out, Token("end", "", len(source))]
