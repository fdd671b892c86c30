"""Regex values, written once, and the dialect rule that makes them portable.

The masking patterns below are fixed values: they must equal the tool we mirror
for results to agree.  They are written in Python ``re`` notation, exactly as
that tool states them.  ``portable()`` rewrites the two escapes whose meaning
differs between Python, Java (Spark) and RE2 (DuckDB, our oracle):

* ``\\d`` -> ``[0-9]``: only ASCII digits are digits (the masking step filters
  digits with ``[^0-9]`` anyway, so a foreign digit could never be masked).
* ``\\s`` -> an explicit class holding every character Python's ``\\s``
  matches.  Java's ``\\s`` is ASCII-only and RE2's lacks ``\\v``; spelling the
  class out gives the same answer in all three engines, including the
  no-break space between card groups.

Everything else (``\\b``, alternation order, quantifiers) already means the
same in the three engines for the texts we handle.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the mirrored tool), Python notation.
CARD_NUMBER = (
    r"\b"
    r"(\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}"
    r"|\d{4}[-\s]?\d{6}[-\s]?\d{5}"
    r")"
    r"\b"
)
ACCOUNT_NUMBER = r"\b(\d{8,17})\b"
ALREADY_MASKED = r"\b[X#*]{4}[-\s]?[X#*]{4}[-\s]?[X#*]{4}[-\s]?\d{4}\b"  # case-insensitive
ROUTING_NUMBER = r"\b(\d{9})\b"
SEPARATOR = r"[-\s]"
# ---------------------------------------------------------------------------

# Characters matched by Python's ``\s`` on str: ASCII whitespace, the
# information separators 0x1c-0x1f, NEL, no-break space and the Unicode
# space separators / line and paragraph separators.
WHITESPACE_CLASS_BODY = (
    r"\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WHITESPACE = "[" + WHITESPACE_CLASS_BODY + "]"
DIGIT = "[0-9]"


def portable(pattern: str) -> str:
    r"""Rewrite ``\d`` and ``\s`` so Java and RE2 agree with Python.

    Handles the escapes inside and outside character classes; any other escape
    is copied unchanged.
    """
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            if e == "d":
                out.append("0-9" if in_class else DIGIT)
            elif e == "s":
                out.append(WHITESPACE_CLASS_BODY if in_class else WHITESPACE)
            else:
                out.append(c + e)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


CARD_RE = portable(CARD_NUMBER)
ACCOUNT_RE = portable(ACCOUNT_NUMBER)
ROUTING_RE = portable(ROUTING_NUMBER)
SEPARATOR_RE = portable(SEPARATOR)
# The two forms of a card on their own, and what every hit holds (regexes that fail at once away from digits).
CARD16_RE = portable(r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b")
CARD15_RE = portable(r"\b\d{4}[-\s]?\d{6}[-\s]?\d{5}\b")
CARD_NEEDS = NUMBER_NEEDS = "[0-9]{4}[^0-9]?[0-9]{4}"
ACCOUNT_NEEDS = "[0-9]{8}"
# Anchored at the start of the stripped value: leading whitespace is skipped by
# the pattern itself, trailing whitespace cannot change the final ``\b``.
ALREADY_MASKED_RE = "(?i)^" + WHITESPACE + "*" + portable(ALREADY_MASKED)


def java_replacement(literal: str) -> str:
    """Escape a literal so Java's ``replaceAll`` does not read ``$`` or ``\\``."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")
