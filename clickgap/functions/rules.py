"""Regex rule building on the driver; evaluation is JVM-side ``rlike``.

Rules are tiny (tens of patterns) and become string literals inside the
plan, so Catalyst folds them and whole-stage codegen keeps the match in
the JVM. No per-row Python.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickgap.config import DEFAULT_INTENT_PATTERNS, INTENT_ORDER


def escape_literal(term: str) -> str:
    """Escape ``term`` so it matches literally in a Java regex.

    Backslash before every character that is not a letter, digit or space
    (Java treats a backslash before a non-alphabetic character as literal).
    """
    return "".join(ch if (ch.isalnum() or ch == " ") else "\\" + ch for ch in term)


def clean_terms(terms: Iterable[str] | None) -> list[str]:
    """Trimmed, non-empty terms in input order."""
    return [t.strip() for t in (terms or []) if t and t.strip()]


def parse_term_text(text: str | None) -> list[str]:
    """Comma- or newline-separated keyword text -> trimmed non-empty list."""
    if not text:
        return []
    return [k.strip() for k in text.replace(",", "\n").split("\n") if k.strip()]


def word_pattern(term: str) -> str:
    return r"\b" + escape_literal(term) + r"\b"


def term_patterns(terms: Iterable[str] | None) -> list[str]:
    return [word_pattern(t) for t in clean_terms(terms)]


def any_of(patterns: list[str]) -> str | None:
    """One case-insensitive alternation of the patterns (blank ones dropped)."""
    pats = [p for p in patterns if p and p.strip()]
    if not pats:
        return None
    return "(?iu)" + "|".join("(?:" + p + ")" for p in pats)


def literal(pattern: str) -> str | None:
    """The term of a ``word_pattern`` of letters, digits and spaces, else None."""
    term = pattern[2:-2]
    return term if pattern == word_pattern(term) and term.isascii() and "\\" not in term and term.strip() else None


def matches_any(col: Column, patterns: list[str]) -> Column:
    """Boolean column: ``col`` matches any pattern; ``False`` when none given.

    Words and phrases share one pair of word boundaries, and the regex is only
    asked where an ASCII text holds one of them as a plain substring: matching
    implies that, and looking for substrings is many times cheaper."""
    words = [literal(p) for p in patterns if p and p.strip()]
    if not words or None in words:
        rx = any_of(patterns)
        return F.lit(False) if rx is None else F.coalesce(col.rlike(rx), F.lit(False))
    held = F.lit(False)
    for w in dict.fromkeys(w.lower() for w in words):
        held = held | F.contains(F.lower(col), F.lit(w))
    match = col.rlike(r"(?iu)\b(?:" + "|".join(dict.fromkeys(words)) + r")\b")
    return F.coalesce(F.when((F.octet_length(col) != F.length(col)) | held, match), F.lit(False))


def build_intent_rules(brand_terms: Iterable[str] | None,
                       intent_keywords: dict[str, list[str]] | None) -> dict[str, list[str]]:
    """intent -> regex list.

    Defaults are the built-in patterns with brand regexes first in
    navigational. A keyword list given for an intent *replaces* that
    intent's defaults (brand regexes included); an empty list keeps them.
    Brand terms are lower-cased for the navigational rule.
    """
    brand = [word_pattern(t.lower()) for t in clean_terms(brand_terms)]
    rules = {k: list(v) for k, v in DEFAULT_INTENT_PATTERNS.items()}
    rules["navigational"] = brand + rules["navigational"]
    for intent, words in (intent_keywords or {}).items():
        if intent in rules and isinstance(words, list) and words:
            pats = [word_pattern(w) for w in words if w]
            if pats:
                rules[intent] = pats
    return {k: rules[k] for k in INTENT_ORDER}
