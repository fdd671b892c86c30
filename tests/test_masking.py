"""Masking vectors (values and text) and the regex-dialect edges."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import many, one
from scrub.functions.mask import financial_mask, mask_account, mask_card
from scrub.policy import FinancialRules, PolicyError


def fin_text(c):
    return financial_mask(c)["text"]


@pytest.mark.parametrize("value,expected", [
    ("1234567890123456", "XXXXXXXXXXXX3456"),
    ("4111 1111 1111 1234", "XXXX XXXX XXXX 1234"),
    ("1234-5678-9012-3456", "XXXX-XXXX-XXXX-3456"),
    ("XXXX XXXX XXXX 1234", "XXXX XXXX XXXX 1234"),
    ("#### #### #### 9876", "#### #### #### 9876"),
])
def test_card_vectors(spark, value, expected):
    assert one(spark, value, mask_card) == expected


def test_card_keeps_last_four_and_length(spark):
    r = one(spark, "4111111111111234", mask_card)
    assert r.endswith("1234") and len(r) == 16


def test_card_mask_char_and_n(spark):
    assert one(spark, "4111111111111234", lambda c: mask_card(c, mask_char="#")) == "############1234"
    assert one(spark, "4111111111111234", lambda c: mask_card(c, 6)).endswith("111234")


@pytest.mark.parametrize("value,expected", [
    ("000123456789", "XXXXXXXX6789"),
    ("1234567890123456", "XXXXXXXXXXXX3456"),
    ("1234", "1234"),
])
def test_account_vectors(spark, value, expected):
    assert one(spark, value, mask_account) == expected


def test_account_variants(spark):
    assert one(spark, "123456789012", mask_account).endswith("9012")
    assert one(spark, "000123456789", lambda c: mask_account(c, mask_char="#")) == "########6789"


def test_text_vectors(spark):
    out = many(spark, [
        "Card: 4111111111111234 was charged.",
        "Card ending XXXX XXXX XXXX 1234 was charged.",
        "Account 000123456789 has a balance.",
        "Card 4111111111111234 and account 123456789012.",
    ], lambda c: financial_mask(c))
    assert "XXXXXXXXXXXX1234" in out[0]["text"] and len(out[0]["spans"]) >= 1
    assert "XXXX XXXX XXXX 1234" in out[1]["text"]
    assert "XXXXXXXX6789" in out[2]["text"]
    assert len(out[3]["spans"]) >= 1


def test_stage_order_is_visible(spark):
    # Account masking runs before any date or phone rule sees the text.
    assert one(spark, "on 20240115", fin_text) == "on XXXX0115"
    assert one(spark, "total 12345678.90", fin_text) == "total XXXX5678.90"
    assert one(spark, "call 5551234567", fin_text) == "call XXXXXX4567"


def test_nine_digits_exempt_and_routing_opt_in(spark):
    assert one(spark, "route 123456789 ok", fin_text) == "route 123456789 ok"
    routed = one(spark, "route 123456789 ok", lambda c: financial_mask(c, FinancialRules(mask_routing=True))["text"])
    assert routed == "route XXXXX6789 ok"


def test_single_pass_is_not_idempotent(spark):
    seven = "1111 2222 3333 4444 5555 6666 7777"
    once = one(spark, seven, fin_text)
    assert once == "XXXX XXXX XXXX 4444 5555 6666 7777"
    assert one(spark, once, fin_text) == "XXXX XXXX XXXX XXXX XXXX XXXX 7777"  # groups 4-6 now


def test_dialect_edges(spark):
    out = many(spark, [
        "a 4111 1111 1111 1111 b",  # no-break spaces: Python's \s matches them
        "xé12345678",  # letter before the digits: no word boundary
        "4111\n1111\n1111\n1111",  # newline between groups
        "123456789012345678",  # 18 digits: neither card nor account
        "\U0001F600 4111111111111234",  # emoji before the card: offsets in code points
    ], lambda c: financial_mask(c, include_text=True))
    assert out[0]["text"] == "a XXXX XXXX XXXX 1111 b"
    assert out[1]["text"] == "xé12345678"
    assert out[2]["text"] == "XXXX\nXXXX\nXXXX\n1111"
    assert out[3]["text"] == "123456789012345678"
    assert (out[4]["spans"][0]["start"], out[4]["spans"][0]["end"]) == (2, 18)


def test_policy_rejects_bad_rules():
    with pytest.raises(PolicyError):
        FinancialRules(card_number=type(FinancialRules().card_number)(0, "X")).card_number.check("c")
    with pytest.raises(PolicyError):
        type(FinancialRules().card_number)(4, "7").check("c")
    with pytest.raises(PolicyError):
        type(FinancialRules().card_number)(4, "XX").check("c")


# ------------------------------------------------------------ a small Python model of the masking rule
def model_mask(value: str, n: int = 4, ch: str = "X") -> str:
    digits = [c for c in value if c in "0123456789"]
    if len(digits) <= n:
        return value
    to_mask = len(digits) - n
    if not re.search(r"[-\s]", value):
        return ch * to_mask + "".join(digits[-n:])
    out, seen = [], 0
    for c in value:
        if c in "0123456789":
            out.append(ch if seen < to_mask else c)
            seen += 1
        else:
            out.append(c)
    return "".join(out)


_alphabet = st.sampled_from(list("0123456789 -./aX# "))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(_alphabet, max_size=24), min_size=1, max_size=20))
def test_account_mask_matches_model(spark, values):
    got = many(spark, values, mask_account)
    assert got == [model_mask(v) for v in values]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("0123456789 -ab\n")), max_size=60), min_size=1, max_size=20))
def test_text_masking_invariants(spark, values):
    got = many(spark, values, fin_text)
    for v, g in zip(values, got):
        assert len(g) == len(v)  # one-character mask keeps lengths
        for a, b in zip(v, g):  # only digits change, and only into the mask character
            assert a == b or (a in "0123456789" and b == "X")


def test_more_dialect_edges(spark):
    out = many(spark, [
        "٤١١١١١١١١١١١١٢٣٤",  # Arabic-Indic
        "1111 2222 3333 4444 5555",  # five groups: the first sixteen digits form the card
        "acct 1234567 and 12345678",  # seven digits are below the account length
    ], fin_text)
    assert out[0] == "٤١١١١١١١١١١١١٢٣٤"
    assert out[1] == "XXXX XXXX XXXX 4444 5555"
    assert out[2] == "acct 1234567 and XXXX5678"
