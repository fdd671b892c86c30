"""Scored detection rules, all native Column expressions.

Each rule is a regex in the subset Java, Python and RE2 read the same way (no
look-around, no back-references), where Java needs it the same matches written so
that it finds them in linear time and bounded stack, an entity type, a score (a constant, or a
Column over the hit for card numbers), and a cheap necessary condition that
lets a row skip the regex entirely.  The regexes and scores are our own
choices; only the entity type names are fixed by the tool we mirror.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrub.functions import patterns as P
from scrub.policy import CustomPattern, Gazetteer, Policy, PolicyError

# Entity type names of the detection step we mirror.
PERSON = "PERSON"
EMAIL_ADDRESS = "EMAIL_ADDRESS"
PHONE_NUMBER = "PHONE_NUMBER"
LOCATION = "LOCATION"
CREDIT_CARD = "CREDIT_CARD"
US_SSN = "US_SSN"
US_BANK_NUMBER = "US_BANK_NUMBER"
DATE_TIME = "DATE_TIME"
NRP = "NRP"
IP_ADDRESS = "IP_ADDRESS"
URL = "URL"
CONFIGURED_IDENTITY = "CONFIGURED_IDENTITY"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
)

EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# Java tries every place of a run before an "@" that never comes, which is quadratic; a match can only start where the
# run does, or where the match before it ended. What ends a run can't be part of it, so nothing is given back.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL_JAVA_RE = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}"
PHONE_RE = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
IP_RE = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
URL_RE = (
    r"\b(?:https?://|www\.)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?"
    r"(?:[/?#][A-Za-z0-9._~:/?#@!$&*+,;=%-]*[A-Za-z0-9_~/=#&-])?"
)
# Java recurses once a label, and ends the JVM on some 10,000 of them, unless labels are never given back. They needn't
# be: all that follows them is optional.
_LABELS = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL_JAVA_RE = URL_RE.replace(_LABELS, r"[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
SSN_RE = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
BANK_RE = r"\b[0-9]{8,17}\b"
DATE_RE = (
    r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?"
    r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"
    rf"|(?:{_MONTHS})\.? [0-9]{{1,2}}(?:, [0-9]{{4}})?)\b"
)

SCORED_STAGE = "scored"
CUSTOM_STAGE = "custom"
IDENTITY_SCORE = 1.0
CUSTOM_SCORE = 0.9


@dataclass(frozen=True)
class Rule:
    entity_type: str
    pattern: str
    score: float | None  # None: score computed per hit by ``score_fn``
    guard: Callable[[Column], Column] | None = None
    score_fn: Callable[[Column], Column] | None = None
    max_score: float = 1.0
    java: str | None = None  # the same matches, as Java finds them fastest

    @property
    def spark_pattern(self) -> str:
        return self.java or self.pattern

    def score_of(self, hit: Column) -> Column:
        return F.lit(self.score) if self.score_fn is None else self.score_fn(hit)

    def may_match(self, t: Column) -> Column:
        """Cheap necessary condition, then one regex find."""
        found = t.rlike(self.spark_pattern)
        return found if self.guard is None else self.guard(t) & found

    def can_pass(self, threshold: float) -> bool:
        return (self.score if self.score is not None else self.max_score) >= threshold


#: What a hit of a rule must hold, as a regex that fails at once away from digits; the rule's own is tried after it.
PHONE_NEEDS = "[0-9]{3}[ .-][0-9]{4}"
IP_NEEDS = r"[0-9]\.[0-9]{1,3}\.[0-9]"
SSN_NEEDS = "[0-9]-[0-9]{2}-[0-9]"
BANK_NEEDS = "[0-9]{8}"
DATE_NEEDS = "[0-9][/-][0-9]"


def _needs(pattern: str) -> Callable[[Column], Column]:
    return lambda t: t.rlike(pattern)


def _may_be_date(t: Column) -> Column:
    out = t.rlike(DATE_NEEDS)
    for month in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"):
        out = out | t.contains(month)
    return out


def luhn_valid(number: Column) -> Column:
    """Luhn checksum over the ASCII digits of ``number``."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    doubled = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
        .otherwise(d.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def card_score(hit: Column) -> Column:
    return F.when(luhn_valid(hit), F.lit(1.0)).otherwise(F.lit(0.3))


BUILTIN_RULES: tuple[Rule, ...] = (
    Rule(EMAIL_ADDRESS, EMAIL_RE, 1.0, lambda t: t.contains("@"), java=EMAIL_JAVA_RE),
    Rule(PHONE_NUMBER, PHONE_RE, 0.6, _needs(PHONE_NEEDS)),
    Rule(IP_ADDRESS, IP_RE, 0.6, _needs(IP_NEEDS)),
    Rule(URL, URL_RE, 0.6, lambda t: t.contains("://") | t.contains("www."), java=URL_JAVA_RE),
    Rule(US_SSN, SSN_RE, 0.85, _needs(SSN_NEEDS)),
    Rule(CREDIT_CARD, P.CARD_RE, None, _needs(P.CARD_NEEDS), card_score, 1.0),
    Rule(US_BANK_NUMBER, BANK_RE, 0.4, _needs(BANK_NEEDS)),
    Rule(DATE_TIME, DATE_RE, 0.6, _may_be_date),
)
BUILTIN_BY_TYPE = {r.entity_type: r for r in BUILTIN_RULES}

_META = set(r"\.^$|?*+()[]{}-#&~")


def escape_term(term: str) -> str:
    """Escape regex metacharacters only (RE2 rejects escaped spaces or letters)."""
    return "".join("\\" + ch if ch in _META else ch for ch in term)


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


MAX_ALTERNATION_TERMS = 200


def terms_pattern(terms) -> str | None:
    """Case-insensitive alternation, longest term first.

    ``\\b`` is put only next to a word character: a term ending in punctuation
    (``Acme Inc.``) would otherwise need a word character after it and miss.
    """
    uniq = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not uniq:
        return None
    if len(uniq) > MAX_ALTERNATION_TERMS:
        warnings.warn(
            f"{len(uniq)} names in one alternation: every value is tried against each of them; "
            "use scrub.operators.gazetteer.gazetteer_spans (an n-gram join) for long lists",
            stacklevel=3,
        )
    alts = []
    for t in uniq:
        pre = r"\b" if _is_word(t[0]) else ""
        post = r"\b" if _is_word(t[-1]) else ""
        alts.append(pre + escape_term(t) + post)
    # (?u): Unicode case folding, as Python's re.IGNORECASE on str (Java folds ASCII only otherwise).
    return "(?iu)(?:" + "|".join(alts) + ")"


def identity_rule(policy: Policy) -> Rule | None:
    p = terms_pattern(list(policy.identities) + list(policy.aliases))
    return None if p is None else Rule(CONFIGURED_IDENTITY, p, IDENTITY_SCORE)


def gazetteer_rule(g: Gazetteer) -> Rule | None:
    p = terms_pattern(g.terms)
    return None if p is None else Rule(g.entity_type, p, g.score)


def custom_rule(p: CustomPattern) -> Rule:
    return Rule(p.entity_type, p.java_regex, CUSTOM_SCORE)


def active_rules(policy: Policy) -> list[Rule]:
    """Rules that are enabled and can reach their threshold, in a stable order."""
    if policy.rules is None:
        chosen = list(BUILTIN_RULES)
    else:
        unknown = [r for r in policy.rules if r not in BUILTIN_BY_TYPE]
        if unknown:
            raise PolicyError(f"unknown built-in rules: {unknown}")
        chosen = [BUILTIN_BY_TYPE[r] for r in policy.rules]
    ident = identity_rule(policy)
    if ident is not None:
        chosen.append(ident)
    for g in policy.gazetteers:
        r = gazetteer_rule(g)
        if r is not None:
            chosen.append(r)
    return [r for r in chosen if policy.enabled(r.entity_type) and r.can_pass(policy.threshold(r.entity_type))]

