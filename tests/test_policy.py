"""Policy defaults and eager validation."""

import pytest

from scrub.policy import CustomPattern, NumberRule, Policy, PolicyError, validate_on


def test_defaults():
    p = Policy()
    assert p.confidence_threshold == 0.5
    assert p.financial.card_number == NumberRule(4, "X")
    assert p.include_globs == ("*.csv", "*.pdf") and p.exclude_globs == ()
    assert p.replacement("PERSON") == "[PERSON]" and p.enabled("PERSON")


@pytest.mark.parametrize("pattern", ["(unclosed", "(?P<n>x)", "a*"])
def test_bad_custom_patterns_fail_fast(pattern):
    with pytest.raises(PolicyError):
        Policy(custom_patterns=(CustomPattern("bad", pattern),))


def test_bad_action_and_numbers():
    with pytest.raises(PolicyError):
        Policy(custom_patterns=(CustomPattern("x", "x", action="shout"),))
    with pytest.raises(PolicyError):
        NumberRule(0, "X").check("r")


def test_java_compiles_patterns(spark):
    validate_on(spark, Policy(custom_patterns=(CustomPattern("ok", r"\bCUST-[0-9]{6}\b"),)))


ADVANCED = """
dry_run: false
confidence_threshold: 0.6
identities: ["Jane Q. Public", "Acme Financial LLC"]
aliases: ["J. Q. Public", "Acme Financial"]
custom_patterns:
  - name: "employee_id"
    regex: "\\\\bEMP-[0-9]{5}\\\\b"
    action: "replace"
    replacement: "[EMPLOYEE_ID]"
financial_rules:
  account_number: {preserve_last_n: 4, mask_char: "X"}
  card_number: {preserve_last_n: 4, mask_char: "X"}
entity_types:
  DATE_TIME: {enabled: false}
  LOCATION: {enabled: true, replacement: "[LOCATION]"}
csv:
  sensitive_columns: ["ssn", "tax_id"]
  preserve_headers: true
pdf:
  output_formats: {txt: true, md: false, json_report: true, pdf: false}
include_globs: ["statement_*.csv", "*.pdf"]
exclude_globs: ["archive_*.csv"]
"""


def test_policy_from_config_file(tmp_path, spark):
    from pyspark.sql import functions as F

    from scrub.operators.redact import redact_text
    from scrub.policy import load_policy

    p = tmp_path / "config.yaml"
    p.write_text(ADVANCED)
    pol = load_policy(str(p))
    assert pol.confidence_threshold == 0.6 and not pol.enabled("DATE_TIME")
    assert pol.sensitive_columns == ("ssn", "tax_id") and pol.formats == ("txt", "json")
    assert pol.include_globs == ("statement_*.csv", "*.pdf") and pol.exclude_globs == ("archive_*.csv",)
    df = spark.createDataFrame([("Jane Q. Public paid EMP-12345 on 2024-01-15 via 4111111111111111",)], "t string")
    got = df.select(redact_text(F.col("t"), pol)).first()[0]
    assert got == "[CONFIGURED_IDENTITY] paid [EMPLOYEE_ID] on 2024-01-15 via XXXXXXXXXXXX1111"
    assert load_policy(None) == Policy()
