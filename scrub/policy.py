"""Redaction policy: frozen dataclasses, validated eagerly on the driver.

A policy is plain Python data.  Nothing here touches Spark except the optional
``validate_on(spark)`` check, which compiles every pattern on the JVM so a bad
regex fails when the policy is built, not halfway through a job.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

# Fixed values that must equal the tool we mirror.
DEFAULT_THRESHOLD = 0.5
DEFAULT_PRESERVE_LAST_N = 4
DEFAULT_MASK_CHAR = "X"
DEFAULT_REPLACEMENT_TEMPLATE = "[{entity_type}]"
REDACTED = "[REDACTED]"
FULL_COLUMN_REDACTION = "FULL_COLUMN_REDACTION"
DEFAULT_INCLUDE_GLOBS = ("*.csv", "*.pdf")
SUPPORTED_EXTENSIONS = (".csv", ".pdf")
CUSTOM_ACTIONS = ("replace", "redact", "detect")


class PolicyError(ValueError):
    """Raised when a policy cannot be compiled into Spark expressions."""


@dataclass(frozen=True)
class NumberRule:
    """Mask every digit of a matched number except the last ``preserve_last_n``."""

    preserve_last_n: int = DEFAULT_PRESERVE_LAST_N
    mask_char: str = DEFAULT_MASK_CHAR

    def check(self, name: str) -> None:
        if self.preserve_last_n < 1:
            raise PolicyError(f"{name}.preserve_last_n must be >= 1")
        if len(self.mask_char) != 1 or self.mask_char.isdigit():
            raise PolicyError(f"{name}.mask_char must be one non-digit character")


@dataclass(frozen=True)
class FinancialRules:
    card_number: NumberRule = field(default_factory=NumberRule)
    account_number: NumberRule = field(default_factory=NumberRule)
    routing_number: NumberRule = field(default_factory=NumberRule)
    # Routing numbers are declared but never masked by default: nine-digit
    # numbers stay readable.  ``mask_routing=True`` opts in.
    mask_routing: bool = False


@dataclass(frozen=True)
class CustomPattern:
    """User regex with an action: replace (literal text), redact or detect only."""

    name: str
    regex: str
    action: str = "replace"
    replacement: str = REDACTED

    @property
    def entity_type(self) -> str:
        return self.name.upper()

    @property
    def java_regex(self) -> str:
        """The pattern as Spark (Java) runs it: ``(?U)`` gives ``\\d \\w \\s \\b`` the Unicode
        meaning they have in Python ``re`` on str, the syntax the pattern was written in."""
        return "(?U)" + self.regex

    def output(self) -> str | None:
        """Literal text put in place of a hit; ``None`` keeps the hit."""
        if self.action == "replace":
            return self.replacement
        if self.action == "redact":
            return REDACTED
        return None


@dataclass(frozen=True)
class EntityConfig:
    enabled: bool = True
    replacement: str = DEFAULT_REPLACEMENT_TEMPLATE
    confidence_threshold: float | None = None  # per-type override of the global one


@dataclass(frozen=True)
class Gazetteer:
    """A caller-supplied list of names detected as ``entity_type``.

    Short lists compile into one case-insensitive alternation; long lists (or a
    DataFrame of names) go through the token n-gram join in
    ``scrub.operators.gazetteer``.
    """

    entity_type: str
    terms: tuple[str, ...]
    score: float = 0.85


@dataclass(frozen=True)
class Policy:
    confidence_threshold: float = DEFAULT_THRESHOLD
    entity_types: dict = field(default_factory=dict)  # str -> EntityConfig
    financial: FinancialRules = field(default_factory=FinancialRules)
    identities: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    custom_patterns: tuple[CustomPattern, ...] = ()
    gazetteers: tuple[Gazetteer, ...] = ()
    sensitive_columns: tuple[str, ...] = ()
    include_globs: tuple[str, ...] = DEFAULT_INCLUDE_GLOBS
    exclude_globs: tuple[str, ...] = ()
    # Scored rules switched on; None = every built-in rule.
    rules: tuple[str, ...] | None = None
    # What findings keep of the matched text: False (nothing), True (raw text) or
    # "sha256" (a digest).  Raw text only when asked: the audit itself can leak.
    include_text: bool | str = False
    formats: tuple[str, ...] = ("txt", "md", "json")
    # Whether applying runs that are given a report folder save their report.
    create_audit_report: bool = True

    def __post_init__(self):
        self.financial.card_number.check("financial.card_number")
        self.financial.account_number.check("financial.account_number")
        self.financial.routing_number.check("financial.routing_number")
        for p in self.custom_patterns:
            if p.action not in CUSTOM_ACTIONS:
                raise PolicyError(f"custom pattern {p.name!r}: action must be one of {CUSTOM_ACTIONS}")
            check_pattern(p.regex, p.name)
        if self.include_text not in (False, True, "sha256"):
            raise PolicyError("include_text must be False, True or 'sha256'")
        for f in self.formats:
            if f not in ("txt", "md", "json"):
                raise PolicyError(f"unknown output format {f!r}")

    def entity(self, entity_type: str) -> EntityConfig:
        return self.entity_types.get(entity_type, EntityConfig())

    def enabled(self, entity_type: str) -> bool:
        return self.entity(entity_type).enabled

    def threshold(self, entity_type: str) -> float:
        t = self.entity(entity_type).confidence_threshold
        return self.confidence_threshold if t is None else t

    def replacement(self, entity_type: str) -> str:
        return self.entity(entity_type).replacement.format(entity_type=entity_type)

    def with_(self, **kw) -> "Policy":
        return replace(self, **kw)

    @classmethod
    def from_config(cls, cfg: dict | None) -> "Policy":
        """A policy from a config mapping with the mirrored tool's keys (as loaded from its YAML files).

        Keys nothing reads there (``dry_run``, ``retain_*``, ``output_dir``,
        ``csv.preserve_headers``, ``csv.chunk_size``, ``pdf.extract_tables``,
        ``pdf.output_formats.pdf``) are accepted and ignored.
        """
        cfg = cfg or {}

        def rule(d):
            d = d or {}
            return NumberRule(int(d.get("preserve_last_n", DEFAULT_PRESERVE_LAST_N)), d.get("mask_char", DEFAULT_MASK_CHAR))

        fin = cfg.get("financial_rules") or {}
        entity_types = {
            name: EntityConfig(bool(v.get("enabled", True)), v.get("replacement", DEFAULT_REPLACEMENT_TEMPLATE),
                               v.get("confidence_threshold"))
            for name, v in (cfg.get("entity_types") or {}).items()
        }
        fmts = ((cfg.get("pdf") or {}).get("output_formats") or {})
        formats = tuple(f for f, key in (("txt", "txt"), ("md", "md"), ("json", "json_report")) if fmts.get(key, True))
        return cls(
            confidence_threshold=float(cfg.get("confidence_threshold", DEFAULT_THRESHOLD)),
            entity_types=entity_types,
            financial=FinancialRules(rule(fin.get("card_number")), rule(fin.get("account_number")),
                                     rule(fin.get("routing_number"))),
            identities=tuple(cfg.get("identities") or ()),
            aliases=tuple(cfg.get("aliases") or ()),
            custom_patterns=tuple(CustomPattern(p["name"], p["regex"], p.get("action", "replace"),
                                                p.get("replacement", REDACTED)) for p in cfg.get("custom_patterns") or ()),
            sensitive_columns=tuple((cfg.get("csv") or {}).get("sensitive_columns") or ()),
            include_globs=tuple(cfg.get("include_globs") or DEFAULT_INCLUDE_GLOBS),
            exclude_globs=tuple(cfg.get("exclude_globs") or ()),
            formats=formats,
            create_audit_report=bool(cfg.get("create_audit_report", True)),
        )


def load_policy(path: str | None) -> Policy:
    """Read a YAML config file (the mirrored tool's format) into a :class:`Policy`; defaults when ``None``."""
    if path is None:
        return Policy()
    import yaml

    with open(path) as f:
        return Policy.from_config(yaml.safe_load(f) or {})


def check_pattern(regex: str, name: str = "pattern") -> None:
    """Reject patterns Spark's (Java) regex engine would read differently or not at all."""
    if "(?P<" in regex or "(?P=" in regex:
        raise PolicyError(f"{name}: Python-only named group syntax; use (?<name>...)")
    try:
        compiled = re.compile(regex)
    except re.error as e:
        raise PolicyError(f"{name}: invalid regex: {e}") from e
    if compiled.fullmatch("") is not None:
        raise PolicyError(f"{name}: pattern matches the empty string")


def validate_on(spark, policy: Policy) -> None:
    """Compile every custom pattern on the JVM (fails fast with Spark's own error)."""
    from pyspark.sql import functions as F

    if not policy.custom_patterns:
        return
    probes = [F.lit("").rlike(p.java_regex).alias(f"p{i}") for i, p in enumerate(policy.custom_patterns)]
    spark.range(1).select(*probes).collect()


DEFAULT_POLICY = Policy()
