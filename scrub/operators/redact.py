"""The redaction pipeline as one Column expression.

``redact(text, policy)`` runs three stages on every value, in this order:

1. financial masking (cards, then accounts), deterministic, keeps lengths;
2. scored detection on the masked text: every enabled rule that can reach its
   threshold scans the text, spans below the threshold are dropped, overlaps
   are resolved greedily and the survivors are replaced by their template;
3. custom patterns, one pass each in policy order, with their own action.

The result is ``struct<redacted, entities, changed>``.  Span offsets refer to
the input of the stage that found them (``entities[*].stage`` says which).
Everything is built-in expressions: Catalyst keeps it in one projection next
to the scan, no Python runs per row, no shuffle is introduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrub.functions import patterns as P
from scrub.functions.detector import DETECTION_TYPE
from scrub.functions.mask import financial_mask, financial_types
from scrub.functions.rules import CUSTOM_STAGE, SCORED_STAGE, Rule, active_rules
from scrub.functions.spans import replace_spans, resolve_overlaps, rule_spans
from scrub.functions.text import SPANS_TYPE, empty_spans, entity_text, let, memo_column, rewrite_stage, span
from scrub.policy import DEFAULT_POLICY, CustomPattern, Policy


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _guarded(rule: Rule, t: Column, value: Column) -> Column:
    return value if rule.guard is None else F.when(rule.guard(t), value).otherwise(empty_spans())


def _detected_spans(extra: Column, t: Column, policy: Policy) -> Column:
    """Detector output (``array<struct<entity_type,start,end,score>>``) as policy-filtered spans."""
    configured = {k: v for k, v in policy.entity_types.items()}
    off = [k for k, v in configured.items() if not v.enabled]
    thr = {k: policy.threshold(k) for k in configured}
    rep = {k: policy.replacement(k) for k in configured}

    def lookup(d: dict, key: Column, default: Column) -> Column:
        if not d:
            return default
        m = F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])
        return F.coalesce(F.element_at(m, key), default)

    def keep(d):
        ok = d["score"] >= lookup(thr, d["entity_type"], F.lit(policy.confidence_threshold))
        return ok & ~d["entity_type"].isin(*off) if off else ok

    def as_span(d):
        text = entity_text(t.substr(d["start"] + 1, d["end"] - d["start"]), policy.include_text)
        masked = lookup(rep, d["entity_type"], F.concat(F.lit("["), d["entity_type"], F.lit("]")))
        return span(SCORED_STAGE, d["entity_type"], d["start"], d["end"], d["score"], text, masked)

    return F.transform(F.filter(F.coalesce(extra, F.array().cast(DETECTION_TYPE)), keep), as_span)


def scored_stage(text, policy: Policy = DEFAULT_POLICY, rules: list[Rule] | None = None,
                 extra: Column | None = None) -> Column:
    """Stage 2: ``struct<text, spans>`` with detected spans replaced.

    ``extra`` adds spans found outside the rules (a detector column computed on
    the same text); they take part in threshold, enable switch and overlap
    resolution like rule spans.
    """
    rules = active_rules(policy) if rules is None else rules
    t0 = _col(text)
    if not rules and extra is None:
        return F.struct(t0.alias("text"), empty_spans().alias("spans"))

    def body(t):
        found = [
            _guarded(
                r,
                t,
                rule_spans(t, r.spark_pattern, SCORED_STAGE, r.entity_type, r.score_of,
                           F.lit(policy.replacement(r.entity_type)), policy.include_text),
            )
            for r in rules
        ]
        thresholds = {r.entity_type: policy.threshold(r.entity_type) for r in rules}
        if any(r.score is None for r in rules):
            tmap = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))])
            found = [F.filter(f, lambda s: s["score"] >= F.element_at(tmap, s["entity_type"])) for f in found]
        if extra is not None:
            found.append(_detected_spans(extra, t, policy))
        allspans = found[0] if len(found) == 1 else F.concat(*found)

        def finish(spans):
            return let(resolve_overlaps(spans),
                       lambda kept: F.struct(replace_spans(t, kept).alias("text"), kept.alias("spans")))

        return let(allspans, finish)

    # No rule can match: skip the span machinery (one find per rule, cheapest first).
    any_hit = F.lit(False) if not rules else rules[0].may_match(t0)
    for r in rules[1:]:
        any_hit = any_hit | r.may_match(t0)
    if extra is not None:
        any_hit = any_hit | (F.coalesce(F.size(extra), F.lit(0)) > 0)
    untouched = F.struct(t0.alias("text"), empty_spans().alias("spans"))
    return F.when(t0.isNull(), F.lit(None)).when(~any_hit, untouched).otherwise(let(t0, body))


def _literal_replacement(text: str) -> str:
    """A replacement string that Java's regex takes literally."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def scored_light(text, policy: Policy = DEFAULT_POLICY, rules: list[Rule] | None = None) -> Column:
    """Stage 2 without offsets: ``struct<text, types>``, the replaced text and one entity type per finding.

    Hits of one rule never overlap each other, so a value that only one rule of
    constant score can touch is one ``regexp_replace`` and one count.  Only
    values that several rules hit, or one scored per hit, need spans.
    """
    rules = active_rules(policy) if rules is None else rules
    t0 = _col(text)
    no_types = F.array().cast("array<string>")
    if not rules:
        return F.struct(t0.alias("text"), no_types.alias("types"))

    def body(t):
        def choose(hits):
            out = None
            sole = F.size(F.filter(hits, lambda x: x)) == 1
            for i, r in enumerate(rules):
                if r.score is None:
                    continue
                done = F.struct(
                    F.regexp_replace(t, r.spark_pattern, _literal_replacement(policy.replacement(r.entity_type))).alias("text"),
                    F.array_repeat(F.lit(r.entity_type), F.regexp_count(t, F.lit(r.spark_pattern))).alias("types"),
                )
                out = (F.when if out is None else out.when)(sole & hits[i], done)
            full = let(scored_stage(t, policy, rules),
                       lambda s: F.struct(s["text"].alias("text"), F.transform(s["spans"], lambda x: x["entity_type"]).alias("types")))
            none = F.struct(t.alias("text"), no_types.alias("types"))
            empty = F.size(F.filter(hits, lambda x: x)) == 0
            return F.when(empty, none).otherwise(full if out is None else out.otherwise(full))

        return let(F.array(*[F.coalesce(r.may_match(t), F.lit(False)) for r in rules]), choose)

    return F.when(t0.isNull(), F.lit(None)).otherwise(let(t0, body))


def custom_pass(text: Column, p: CustomPattern, include_text=False, with_spans: bool = True) -> Column:
    """One custom pattern: ``struct<text, spans>``; every hit is recorded, action decides the text."""
    out = p.output()

    def rewrite(m):
        return F.lit(out) if out is not None else F.lit(None).cast("string")

    def make(h, r, s, e):
        return span(CUSTOM_STAGE, p.entity_type, s, e, None, entity_text(h, include_text), r)

    return rewrite_stage(text, p.java_regex, rewrite, make if with_spans else None)


def custom_stage(text, policy: Policy = DEFAULT_POLICY, with_spans: bool = True) -> Column:
    """Stage 3: custom patterns, one pass each, in policy order.

    One pattern is one pass.  Several are folded with ``aggregate`` over their
    indices, the step being a ``CASE`` whose branches are the passes: nesting
    depth stays the same however many patterns there are (chained ``let``s
    would deepen by one level per pattern and exhaust the analyzer's iteration
    budget), and every branch keeps a literal, compiled-once pattern.
    """
    pats = policy.custom_patterns
    t0 = _col(text)
    if not pats:
        return F.struct(t0.alias("text"), empty_spans().alias("spans"))
    if len(pats) == 1:
        return custom_pass(t0, pats[0], policy.include_text, with_spans)

    def step(acc, i):
        def joined(p):
            return let(custom_pass(acc["text"], p, policy.include_text, with_spans),
                       lambda n: F.struct(n["text"].alias("text"), F.concat(acc["spans"], n["spans"]).alias("spans")))

        out = F.when(i == 0, joined(pats[0]))
        for k, p in enumerate(pats[1:], start=1):
            out = out.when(i == k, joined(p))
        return out

    init = F.struct(t0.alias("text"), empty_spans().alias("spans"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(pats) - 1)), init, step)


def may_change(t: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """True when some stage could touch ``t`` (a cheap "may hold PII" filter).

    Financial masking needs a card or account hit (the account pass on masked
    text can only find what the original held), every scored and custom rule
    needs its own hit.  Checks are ordered cheap first and short-circuit.
    """
    fin = [P.CARD_RE, P.ACCOUNT_RE] + ([P.ROUTING_RE] if policy.financial.mask_routing else [])
    any_fin = t.rlike(fin[0])
    for p in fin[1:]:
        any_fin = any_fin | t.rlike(p)
    out = t.rlike(P.NUMBER_NEEDS) & any_fin
    for r in active_rules(policy):
        out = out | r.may_match(t)
    for p in policy.custom_patterns:
        out = out | t.rlike(p.java_regex)
    return out


@memo_column
def redact(c, policy: Policy = DEFAULT_POLICY) -> Column:
    """Full pipeline on one string column: ``struct<redacted, entities, changed>``.

    Each stage short-circuits values it cannot touch (one find per rule), so no
    whole-pipeline pre-check is added: it would repeat those finds.
    """
    return _redact_all(_col(c), policy)


def _after_financial(original: Column, fin: Column, policy: Policy) -> Column:
    """Stages 2 and 3 on a financial result ``fin``, assembled into the redaction struct."""
    def after_scored(sc):
        def after_custom(cu):
            return F.struct(
                cu["text"].alias("redacted"),
                F.concat(fin["spans"], sc["spans"], cu["spans"]).alias("entities"),
                (~original.eqNullSafe(cu["text"])).alias("changed"),
            )

        return let(custom_stage(sc["text"], policy), after_custom)

    return let(scored_stage(fin["text"], policy), after_scored)


def _redact_all(original: Column, policy: Policy) -> Column:
    fin = financial_mask(original, policy.financial, True, policy.include_text)
    return let(fin, lambda f: _after_financial(original, f, policy))


@memo_column
def redact_text(c, policy: Policy = DEFAULT_POLICY) -> Column:
    """Only the redacted string (no entity bookkeeping beyond what stage 2 needs)."""
    t = _col(c)
    fin = financial_mask(t, policy.financial, False, False)
    sc = let(fin, lambda f: scored_light(f["text"], policy))
    return let(sc, lambda s: custom_stage(s["text"], policy, with_spans=False))["text"]


@memo_column
def redact_types(c, policy: Policy = DEFAULT_POLICY) -> Column:
    """``redact`` for audits: ``struct<redacted, entities, changed>`` with only the type of each finding."""
    t = _col(c)

    def all_types(f, s, cu):
        types = F.concat(f["types"], s["types"], F.transform(cu["spans"], lambda x: x["entity_type"]))
        return F.struct(
            cu["text"].alias("redacted"),
            F.transform(types, lambda x: F.struct(x.alias("entity_type"))).alias("entities"),
            (~t.eqNullSafe(cu["text"])).alias("changed"),
        )

    return let(financial_types(t, policy.financial),
               lambda f: let(scored_light(f["text"], policy), lambda s: let(custom_stage(s["text"], policy), lambda cu: all_types(f, s, cu))))


def redact_by_lang(c, lang, policies: dict, default: Policy = DEFAULT_POLICY) -> Column:
    """Pick the rule set by a language column; unknown languages use ``default``.

    When every rule set masks numbers the same way, financial masking runs once
    and only the later stages branch by language.
    """
    lang_c = _col(lang)
    original = _col(c)
    shared = all(p.financial == default.financial and p.include_text == default.include_text
                 for p in policies.values())

    def choose(make):
        expr = None
        for code, pol in policies.items():
            expr = (F.when if expr is None else expr.when)(lang_c == F.lit(code), make(pol))
        return make(default) if expr is None else expr.otherwise(make(default))

    if not shared:
        return choose(lambda pol: redact(c, pol))
    fin = financial_mask(original, default.financial, True, default.include_text)
    return let(fin, lambda f: choose(lambda pol: _after_financial(original, f, pol)))


def redact_frame(df: DataFrame, text_col: str, policy: Policy = DEFAULT_POLICY, detectors=(), alias: str = "r",
                 found: str | None = None) -> DataFrame:
    """``df`` plus ``alias`` = ``struct<redacted, entities, changed, status>``, with Python detectors merged in.

    A pandas UDF cannot run inside a lambda, so the stages become projections:
    financial masking first, then every detector as a top-level Arrow-batched
    call on the masked text, then the scored stage, which merges the detector
    spans with the rule spans before overlap resolution, then custom patterns.
    A value some detector failed on is never passed through half-redacted:
    ``status`` is ``failed`` and ``redacted``/``entities`` are null.  ``found`` names a
    column of spans on the masked text that were found otherwise (dictionary hits).
    """
    cols = list(df.columns)
    fin = financial_mask(F.col(text_col), policy.financial, True, policy.include_text)
    staged = df.select(*cols, fin.alias("_fin"))
    if detectors:
        calls = [d(F.col("_fin.text")) for d in detectors]
        failed = F.lit(False)
        for f in calls:
            failed = failed | f.isNull()
        failed = F.col(text_col).isNotNull() & failed
        det = calls[0] if len(calls) == 1 else F.concat(*[F.coalesce(f, F.array().cast(DETECTION_TYPE)) for f in calls])
        staged = staged.select(*cols, "_fin", det.alias("_det"), failed.alias("_failed"))
        extra = F.col("_det")
    else:
        staged = staged.select(*cols, "_fin", F.lit(False).alias("_failed"))
        extra = None
    if found:
        names = F.coalesce(F.col(found), F.array().cast(DETECTION_TYPE))
        extra = names if extra is None else F.concat(F.coalesce(extra, F.array().cast(DETECTION_TYPE)), names)
    sc = scored_stage(F.col("_fin.text"), policy, extra=extra)
    original = F.col(text_col)

    def after_scored(s):
        def after_custom(cu):
            return F.struct(
                cu["text"].alias("redacted"),
                F.concat(F.col("_fin.spans"), s["spans"], cu["spans"]).alias("entities"),
                (~original.eqNullSafe(cu["text"])).alias("changed"),
                F.lit("ok").alias("status"),
            )

        return let(custom_stage(s["text"], policy), after_custom)

    fail = F.struct(F.lit(None).cast("string").alias("redacted"), F.lit(None).cast(SPANS_TYPE).alias("entities"),
                    F.lit(False).alias("changed"), F.lit("failed").alias("status"))
    out = F.when(F.col("_failed"), fail).otherwise(let(sc, after_scored))
    return staged.select(*cols, out.alias(alias))
