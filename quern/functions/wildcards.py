"""Wildcard patterns: ``%`` any run of characters, ``_`` one character, a backslash escapes the next character.

A lone backslash at the end is dropped.  Patterns become anchored regular expressions, as SQL's LIKE rejects some of
them.
"""

from __future__ import annotations

import re

TERM, PREFIX, WILDCARD = "term", "prefix", "wildcard"


def pieces(pattern: str) -> list[tuple[str, bool]]:
    """(character, is a wildcard) of a pattern, escapes resolved."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
            if at < len(pattern):
                out.append((pattern[at], False))
        else:
            out.append((c, c in "%_"))
        at += 1
    return out


def classify(pattern: str) -> tuple[str, str]:
    """The kind of a pattern and its literal: the term, the prefix, or nothing for a true wildcard."""
    parts = pieces(pattern)
    wild = [k for k, (_, w) in enumerate(parts) if w]
    literal = "".join(c for c, w in parts if not w)
    if not wild:
        return TERM, literal
    if all(parts[k][0] == "%" for k in wild) and wild == list(range(wild[0], len(parts))):
        return PREFIX, literal
    return WILDCARD, ""


def to_regex(pattern: str) -> str:
    """Anchored, for Java and Python alike."""
    return "(?s)^" + "".join((".*" if c == "%" else ".") if w else re.escape(c) for c, w in pieces(pattern)) + "$"


def literal_prefix(pattern: str) -> str:
    """What every match starts with; narrows the dictionary before the regex runs."""
    out = []
    for c, w in pieces(pattern):
        if w:
            break
        out.append(c)
    return "".join(out)
