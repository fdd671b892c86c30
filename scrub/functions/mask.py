"""Deterministic number masking: card, account and routing numbers.

Masking keeps the last ``n`` digits, replaces every other digit by the mask
character and leaves separators where they are.  One ``regexp_replace`` with a
look-ahead does it: a digit is masked when at least ``n`` digits follow it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrub.functions import patterns as P
from scrub.functions.text import (empty_spans, entity_text, let, memo_column, rebuild, rewrite_stage, scan, span,
                                  with_replacements)
from scrub.policy import FinancialRules, NumberRule

CARD_NUMBER = "CARD_NUMBER"
ACCOUNT_NUMBER = "ACCOUNT_NUMBER"
ROUTING_NUMBER = "ROUTING_NUMBER"
FINANCIAL_STAGE = "financial"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_keep_last(m: Column, n: int, mask_char: str) -> Column:
    """Mask every ASCII digit of ``m`` that has at least ``n`` digits after it."""
    return F.regexp_replace(m, f"[0-9](?=(?:[^0-9]*[0-9]){{{n}}})", P.java_replacement(mask_char))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _mask_value(s: Column, n: int, mask_char: str) -> Column:
    """Mask a stand-alone value.

    Values with ``n`` digits or fewer stay as they are.  With a separator
    (``-`` or whitespace) present every other character stays in place; without
    one, non-digits are dropped and only the masked digits remain.
    """
    digits = _digits(s)
    return (
        F.when(F.length(digits) <= n, s)
        .when(s.rlike(P.SEPARATOR_RE), mask_keep_last(s, n, mask_char))
        .otherwise(mask_keep_last(digits, n, mask_char))
    )


def mask_card(c, preserve_last_n: int = 4, mask_char: str = "X") -> Column:
    """Mask a card number value; values already masked (``XXXX XXXX XXXX 1234``) stay."""
    NumberRule(preserve_last_n, mask_char).check("mask_card")
    s = _col(c)
    return F.when(s.rlike(P.ALREADY_MASKED_RE), s).otherwise(_mask_value(s, preserve_last_n, mask_char))


def mask_account(c, preserve_last_n: int = 4, mask_char: str = "X") -> Column:
    """Mask an account number value."""
    NumberRule(preserve_last_n, mask_char).check("mask_account")
    return _mask_value(_col(c), preserve_last_n, mask_char)


def _number_pass(text: Column, pattern: str, entity_type: str, rule: NumberRule, keep, with_spans: bool, include_text):
    """Mask every ``pattern`` hit of ``text`` unless ``keep(hit)``; record changed hits."""
    n, ch = rule.preserve_last_n, rule.mask_char

    def rewrite(m):
        masked = mask_keep_last(m, n, ch)
        return masked if keep is None else F.when(keep(m), m).otherwise(masked)

    def make(h, r, start, end):
        return F.when(
            h != r,
            span(FINANCIAL_STAGE, entity_type, start, end, None, entity_text(h, include_text), r),
        )

    return rewrite_stage(text, pattern, rewrite, make if with_spans else None)


def _cards_at_once(t: Column, rule: NumberRule, types: bool) -> Column:
    """The card pass on a text whose cards all have 16 digits, as one replacement by groups."""
    left, regex, put, groups = 16 - rule.preserve_last_n, r"\b", "", 0
    for block in range(4):
        if block:
            groups += 1
            regex, put = regex + f"({P.SEPARATOR_RE}?)", put + f"${groups}"
        masked = min(4, max(0, left - 4 * block))
        if masked:
            regex, put = regex + f"[0-9]{{{masked}}}", put + P.java_replacement(rule.mask_char) * masked
        if masked < 4:
            groups += 1
            regex, put = regex + f"([0-9]{{{4 - masked}}})", put + f"${groups}"
    found = F.regexp_count(t, F.lit(P.CARD16_RE)) if left > 0 else F.lit(0)
    return _light(F.regexp_replace(t, regex + r"\b", put), F.array_repeat(F.lit(CARD_NUMBER), found) if types else None)


def _accounts_at_once(t: Column, rule: NumberRule, types: bool) -> Column:
    """The account pass as one replacement: digit after digit from where a number of a masked length starts."""
    n = rule.preserve_last_n
    digit = rf"(?:\G(?!^)|\b(?=(?:[0-9]{{8}}|[0-9]{{10,17}})\b))[0-9](?=[0-9]{{{n}}})"
    # Only numbers longer than what stays are changed.
    lengths = [k for k in (8, *range(10, 18)) if k > n]
    counted = F.regexp_count(t, F.lit(r"\b(?:" + "|".join(f"[0-9]{{{k}}}" for k in lengths) + r")\b")) if lengths else F.lit(0)
    return _light(F.regexp_replace(t, digit, P.java_replacement(rule.mask_char)), F.array_repeat(F.lit(ACCOUNT_NUMBER), counted) if types else None)


def _light(text: Column, types: Column | None) -> Column:
    return F.struct(text.alias("text"), (F.array().cast("array<string>") if types is None else types).alias("types"))


def _masked_only(text: Column, rules: FinancialRules) -> Column:
    """``financial_mask`` without spans."""
    return let(financial_types(text, rules, False), lambda f: F.when(text.isNull(), F.lit(None)).otherwise(
        F.struct(f["text"].alias("text"), empty_spans().alias("spans"))))


@memo_column
def financial_mask(c, rules: FinancialRules | None = None, with_spans: bool = True, include_text=False) -> Column:
    """Two-pass financial masking: cards first, then accounts on the result.

    Returns ``struct<text, spans>``.  Card offsets refer to the input text,
    account offsets to the text after card masking (masking keeps lengths, so
    both equal offsets in the input).  Nine-digit numbers are exempt from the
    account pass (routing numbers); a match holding the mask character is left
    alone.  With ``rules.mask_routing`` a third pass masks nine-digit numbers.
    Text without two groups of four ASCII digits, which every number holds, skips all other regex work.
    """
    rules = rules or FinancialRules()
    text = _col(c)
    acct_ch = rules.account_number.mask_char

    if not with_spans and not rules.mask_routing:
        return _masked_only(text, rules)

    def stages(t):
        card = _number_pass(t, P.CARD_RE, CARD_NUMBER, rules.card_number, None, with_spans, include_text)

        def after_card(cs):
            acct = _number_pass(
                cs["text"],
                P.ACCOUNT_RE,
                ACCOUNT_NUMBER,
                rules.account_number,
                lambda m: (F.length(m) == 9) | m.contains(acct_ch),
                with_spans,
                include_text,
            )
            if not rules.mask_routing:
                return F.struct(acct["text"].alias("text"), F.concat(cs["spans"], acct["spans"]).alias("spans"))

            def after_acct(as_):
                rout = _number_pass(as_["text"], P.ROUTING_RE, ROUTING_NUMBER, rules.routing_number, None, with_spans, include_text)
                return F.struct(
                    rout["text"].alias("text"),
                    F.concat(cs["spans"], as_["spans"], rout["spans"]).alias("spans"),
                )

            return let(acct, after_acct)

        return let(card, after_card)

    return F.when(text.isNull(), F.lit(None)).when(
        ~text.rlike(P.NUMBER_NEEDS), F.struct(text.alias("text"), empty_spans().alias("spans"))
    ).otherwise(let(text, stages))


@memo_column
def financial_types(c, rules: FinancialRules | None = None, types: bool = True) -> Column:
    """``financial_mask`` without offsets: ``struct<text, types>``, one entity type per changed hit (none without ``types``).

    Without offsets a pass is one replacement, but for texts that hold cards of 15 digits.
    """
    rules = rules or FinancialRules()
    text = _col(c)

    def one_pass(t, pattern, entity_type, rule):
        def body(ghr):
            changed = F.size(F.filter(F.zip_with(ghr["h"], ghr["r"], lambda h, r: h != r), lambda x: x))
            return _light(rebuild(ghr), F.array_repeat(F.lit(entity_type), changed) if types else None)

        return let(with_replacements(scan(t, pattern), lambda m: mask_keep_last(m, rule.preserve_last_n, rule.mask_char)), body)

    def cards(t):
        # The cheapest test first: most values hold no card.
        return (F.when(~(t.rlike(P.CARD_NEEDS) & t.rlike(P.CARD_RE)), _light(t, None))
                .when(~t.rlike(P.CARD15_RE), _cards_at_once(t, rules.card_number, types))
                .otherwise(one_pass(t, P.CARD_RE, CARD_NUMBER, rules.card_number)))

    passes = [lambda t: F.when(t.rlike(P.ACCOUNT_NEEDS), _accounts_at_once(t, rules.account_number, types)).otherwise(_light(t, None))]
    if rules.mask_routing:
        passes.append(lambda t: F.when(t.rlike(P.ROUTING_RE), one_pass(t, P.ROUTING_RE, ROUTING_NUMBER, rules.routing_number)).otherwise(_light(t, None)))

    def chain(done, left):
        if not left:
            return done
        return let(left[0](done["text"]), lambda n: chain(
            F.struct(n["text"].alias("text"), F.concat(done["types"], n["types"]).alias("types")), left[1:]))

    def stages(t):
        return let(cards(t), lambda first: chain(first, passes))

    # No number is shorter than eight digits.
    return F.when(text.isNull(), F.lit(None)).when(~text.rlike(P.NUMBER_NEEDS), _light(text, None)).otherwise(let(text, stages))
