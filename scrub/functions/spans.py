"""Span arrays: listing, overlap resolution and replacement, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrub.functions.text import PREFIX_BLOCK, empty_spans, entity_text, hit_spans, let, scan, span, with_replacements


def rule_spans(text: Column, pattern: str, stage: str, entity_type: str, score_of, masked: Column | None,
               include_text) -> Column:
    """Every hit of one regex as a span (offsets in code points of ``text``)."""

    def body(ghr):
        return hit_spans(
            ghr,
            lambda h, r, s, e: span(stage, entity_type, s, e, score_of(h), entity_text(h, include_text), masked),
        )

    found = let(with_replacements(scan(text, pattern), lambda m: F.lit(None).cast("string")), body)
    return F.when(text.rlike(pattern), found).otherwise(empty_spans())


def by_start(spans: Column) -> Column:
    """Sort spans by (start, end, entity_type)."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("k1"), s["end"].alias("k2"),
                                                   s["entity_type"].alias("k3"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


#: A span as the choice among overlaps sees it: its rank first, its end, its place in the list.
_OPEN = "array<struct<worse:double,shorter:int,start:int,kind:string,end:int,at:int>>"


def _greedy(open_spans: Column) -> Column:
    """Of ranked spans, best first, those that overlap none taken before."""
    return F.aggregate(
        F.array_sort(open_spans),
        F.array().cast(_OPEN),
        lambda acc, x: F.when(
            F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )["at"]


def _sweep(ordered: Column) -> Column:
    """The greedy choice among spans sorted by start, in one pass over them.

    ``open`` holds the spans not yet decided.  Once the next span starts at or after the end of the best of them,
    everything that overlaps this best has been seen and is worse: it is kept, what overlaps it goes, and what
    lies before it, which nothing later can reach, is chosen among itself.  What lies after it stays open.  A span
    stays open only while each better one overlaps the next, so there are few: among equal scores lengths must grow.
    ``aggregate`` copies its state at every step; only places are gathered there, in blocks.
    """
    n = F.size(ordered)

    def ranked(i):
        s = F.element_at(ordered, i)
        return F.struct((-F.coalesce(s["score"], F.lit(0.0))).alias("worse"), (s["start"] - s["end"]).alias("shorter"),
                        s["start"].alias("start"), s["entity_type"].alias("kind"), s["end"].alias("end"), i.alias("at"))

    def step(acc, i):
        best = F.array_min(acc["open"])
        before = F.filter(
            acc["open"],
            lambda o: (o["end"] <= best["start"]) | ((o["start"] == best["start"]) & (o["end"] == best["end"])),
        )
        # The second test matters for spans of no characters, which lie before and after themselves.
        after = F.filter(acc["open"], lambda o: (o["start"] >= best["end"]) & (o["end"] > best["start"]))
        decided = F.coalesce(best["end"] <= F.element_at(ordered, i)["start"], F.lit(False))
        return F.struct(
            F.concat(F.when(decided, after).otherwise(acc["open"]), F.array(ranked(i))).cast(_OPEN).alias("open"),
            F.when(decided, F.concat(acc["kept"], _greedy(before))).otherwise(acc["kept"]).alias("kept"),
        )

    no_places = F.array().cast("array<int>")

    def one_block(acc, b):
        own = F.sequence(b * PREFIX_BLOCK + 1, F.least(n, (b + 1) * PREFIX_BLOCK))
        return F.aggregate(
            own, F.struct(acc["open"].alias("open"), no_places.alias("kept")), step,
            lambda a: F.struct(a["open"].alias("open"), F.concat(acc["kept"], a["kept"]).alias("kept")))

    places = F.aggregate(
        F.sequence(F.lit(0), F.floor((n - 1) / PREFIX_BLOCK).cast("int")),
        F.struct(F.array().cast(_OPEN).alias("open"), no_places.alias("kept")), one_block,
        lambda acc: F.array_sort(F.concat(acc["kept"], _greedy(acc["open"]))))
    return F.transform(places, lambda i: F.element_at(ordered, i))


def resolve_overlaps(spans: Column) -> Column:
    """Greedy choice among overlapping spans.

    Candidates are taken by score (high first), then length (long first), then
    start and entity type; a candidate is kept when it overlaps none already
    kept.  The result is sorted by start.
    """
    def pick(sorted_spans):
        # Sorted by start, any overlap shows between neighbours: one pass decides whether a choice is needed at all.
        clash = F.exists(
            F.sequence(F.lit(2), F.size(sorted_spans)),
            lambda i: F.element_at(sorted_spans, i)["start"] < F.element_at(sorted_spans, i - 1)["end"],
        )
        return F.when(clash, _sweep(sorted_spans)).otherwise(sorted_spans)

    return F.when(F.size(spans) <= 1, spans).otherwise(let(by_start(spans), pick))


#: Spans that share one cut of the text when they are replaced.
CUT = 64


def replace_spans(text: Column, spans: Column) -> Column:
    """Put each span's ``masked`` text in place of its range; spans disjoint, sorted by start.

    ``substr`` walks from the start of its string.  The text is therefore first cut into stretches of CUT spans, and
    pieces are taken from their stretch.
    """
    n = F.size(spans)

    def stretch(i):
        own = F.slice(spans, i * CUT + 1, CUT)
        at = F.when(i == 0, F.lit(0)).otherwise(F.element_at(spans, F.greatest(i * CUT, F.lit(1)))["end"])
        return F.struct(own.alias("own"), at.alias("at"),
                        text.substr(at + 1, F.element_at(own, -1)["end"] - at).alias("t"))

    def replaced(c):
        def piece(s, i):
            prev_end = F.when(i == 0, c["at"]).otherwise(F.element_at(c["own"], F.greatest(i, F.lit(1)))["end"])
            return F.concat(c["t"].substr(prev_end - c["at"] + 1, s["start"] - prev_end), s["masked"])

        return F.array_join(F.transform(c["own"], piece), "")

    cuts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CUT).cast("int")), stretch)
    last_end = F.element_at(spans, -1)["end"]
    body = F.concat(F.array_join(F.transform(cuts, replaced), ""), text.substr(last_end + 1, F.length(text) + 1))
    return F.when(F.coalesce(n, F.lit(0)) == 0, text).otherwise(body)


def offsets_of(text: Column, pattern: str) -> Column:
    """``array<struct<start,end>>`` of every hit of ``pattern`` (A1 on its own)."""
    return F.transform(
        rule_spans(text, pattern, "scan", "", lambda h: F.lit(None), None, False),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
    )
