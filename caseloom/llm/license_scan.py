"""License scans: Aho-Corasick over words, shunting-yard over licence expressions.

A text is lower-cased in A-Z and reduced to its words, single-spaced.  One
Aho-Corasick pass finds every phrase of ``PHRASES`` at word boundaries.  Where
the identifier tag stands, the raw text after it is read as an expression of
licence ids with ``and``, ``or``, ``with`` and brackets; a shunting-yard parser
turns it to postfix order and evaluates it.

``score`` is how freely the text may be reused by what it says: each phrase has
its label's weight, ``or`` takes the larger, ``and`` the smaller, ``with`` (an
exception) adds a fifth; the evidence of a text counts together as under
``and``.  Without evidence it is 0.

Nulls and edge cases: a null or empty text has no words and score 0; texts of
any length are taken whole; overlapping phrases all count; repeated rows are
separate rows; an expression that can't be parsed keeps its labels and has
weight 0.5.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from ._common import map_rows

# Fixed values of the base scan.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Phrases of the method: words as they stand after lower-casing.
MORE_PHRASES = {
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "cc0",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "artistic license": "artistic",
    "free documentation license": "gfdl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "proprietary and confidential": "reserved",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"

#: Prefixes of licence ids in expressions, and what a label allows.
ID_PREFIXES = {
    "mit": "mit", "apache": "apache", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "bsd": "bsd", "mpl": "mpl",
    "isc": "isc", "cc0": "cc0", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by",
    "unlicense": "unlicense", "zlib": "zlib", "bsl": "bsl", "epl": "epl", "cddl": "cddl", "eupl": "eupl", "artistic": "artistic",
    "gfdl": "gfdl", "ms-pl": "ms-pl", "psf": "psf", "python": "psf", "0bsd": "bsd", "licenseref-proprietary": "reserved",
}
WEIGHTS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by": 0.9, "mpl": 0.7,
    "cc-by-sa": 0.6, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "reserved": 0.0,
    "zlib": 1.0, "bsl": 1.0, "psf": 1.0, "artistic": 0.8, "ms-pl": 0.8, "epl": 0.6, "cddl": 0.6, "eupl": 0.5, "gfdl": 0.4,
}
OTHER_ID = ("other", 0.2)

_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_LEXEME = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_TAG_IN_TEXT = re.compile(r"spdx-license-identifier:", re.I)


def label_of(licence_id: str) -> tuple[str, float]:
    name = licence_id.lower()
    for prefix, label in ID_PREFIXES.items():
        if name == prefix or name.startswith((prefix + "-", prefix + "+")):
            return label, WEIGHTS[label]
    return OTHER_ID


def lexemes(text: str, at: int) -> list[str]:
    """The expression that starts at ``at``: ends with its line, or where two ids meet without an operator."""
    out: list[str] = []
    while m := _LEXEME.match(text, at):
        word = m[1] if m[1].lower() not in _PRECEDENCE else m[1].lower()
        is_operand = word not in _PRECEDENCE and word not in "()"
        if is_operand and out and (out[-1] == ")" or out[-1] not in _PRECEDENCE and out[-1] != "("):
            break
        out.append(word.rstrip(".:") if is_operand else word)
        at = m.end()
    return out


def postfix(words: list[str]) -> list[str] | None:
    """Shunting-yard; None if brackets or operands don't fit."""
    out, stack, operand_next = [], [], True
    for w in words:
        if w == "(":
            if not operand_next:
                return None
            stack.append(w)
        elif w == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if operand_next or not stack:
                return None
            stack.pop()
        elif w in _PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[w]:
                out.append(stack.pop())
            stack.append(w)
            operand_next = True
        else:
            out.append(w)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(words: list[str]) -> tuple[set[str], float]:
    """Labels and weight of an expression."""
    order = postfix(words)
    if order is None:
        return {label_of(w)[0] for w in words if w not in _PRECEDENCE and w not in "()"}, 0.5
    stack: list[tuple[set[str], float]] = []
    for w in order:
        if w in _PRECEDENCE:
            (b, y), (a, x) = stack.pop(), stack.pop()
            # The right side of "with" is an exception, not a licence.
            stack.append((a, min(1.0, x + 0.2)) if w == "with" else (a | b, max(x, y) if w == "or" else min(x, y)))
        else:
            label, weight = label_of(w)
            stack.append(({label}, weight))
    return stack.pop()


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in {**MORE_PHRASES, **BASE_PHRASES}.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE_PHRASES))
    a.add_word(f" {TAG} ", (len(TAG) + 2, "", False))
    a.make_automaton()
    return a


def scan_text(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = text.encode().translate(_BYTES).split()
    line = f" {b' '.join(words).decode()} "
    starts, base, labels, weights, tagged = [], set(), set(), [], False
    seen = at = 0
    found = sorted(automaton().iter(line), key=lambda x: x[0] - x[1][0])
    longest: dict[int, int] = {}
    for end, (size, _, _) in found:
        longest[end - size] = max(size, longest.get(end - size, 0))
    for end, (size, label, is_base) in found:
        if not is_base and size < longest[end - size]:  # "cc by" within "cc by nc"
            continue
        if not label:
            tagged = True
            continue
        start = end + 1 - size
        seen, at = seen + line.count(" ", at, start), start
        labels.add(label)
        weights.append(WEIGHTS[label])
        if is_base:
            base.add(label)
            starts.append(seen)
    if tagged:
        for m in _TAG_IN_TEXT.finditer(text):
            if words_after := lexemes(text, m.end()):
                more, weight = evaluate(words_after)
                labels |= more
                weights.append(weight)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), min(weights, default=0.0),
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; no shuffle."""
    return map_rows(
        docs,
        [id_col, text_col],
        lambda key, text: [(key, *scan_text(text or ""))],
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
