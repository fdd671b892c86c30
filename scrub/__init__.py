"""scrub: find, mask and replace personal and financial data with Spark.

The most used entry points::

    from scrub import Policy, redact, redact_table
    df.select(redact(F.col("text"), Policy()).alias("r"))   # struct<redacted, entities, changed>
"""

from scrub.functions.mask import financial_mask, mask_account, mask_card
from scrub.operators.redact import redact, redact_by_lang, redact_frame, redact_text
from scrub.operators.tables import redact_table
from scrub.policy import CustomPattern, EntityConfig, FinancialRules, Gazetteer, NumberRule, Policy

__all__ = [
    "CustomPattern", "EntityConfig", "FinancialRules", "Gazetteer", "NumberRule", "Policy",
    "financial_mask", "mask_account", "mask_card",
    "redact", "redact_by_lang", "redact_frame", "redact_text", "redact_table",
]
