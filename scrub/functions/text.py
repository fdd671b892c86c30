"""Column building blocks for rewriting matches inside text, JVM-side.

A regex stage is expressed with two built-ins that scan the text the same way:
``split(t, p, -1)`` gives the gaps between matches and
``regexp_extract_all(t, p, 0)`` the matches; ``size(gaps) == size(hits) + 1``.
Zipping them back with a per-match rewrite rebuilds the text.  Offsets come from
a running sum over the gap and hit lengths (code points, like Python ``str``).

Every intermediate that is used twice is bound once with :func:`let`, otherwise
chained stages re-run upstream regexes 2^k times.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_TYPE = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("masked", T.StringType()),
    ]
)
SPANS_TYPE = T.ArrayType(SPAN_TYPE)


def _key_part(a):
    """Cache key of one argument; ``None`` when it cannot be shared safely.

    Only plain by-name columns (``F.col("text")``) are shared, by their exact
    name parts; a column taken from a DataFrame (``df["text"]``) is bound to
    that DataFrame's plan.
    """
    if not isinstance(a, Column):
        return repr(a)
    try:
        node = a._jc.node()
        if node.getClass().getSimpleName() != "UnresolvedAttribute" or node.planId().isDefined():
            return None
        parts = node.nameParts()
        return ("col", tuple(parts.apply(i) for i in range(parts.size())))
    except Exception:  # noqa: BLE001 - other Column implementations: no caching
        return None


# Trees kept per builder: the oldest leaves first.
_CACHE_SIZE = 256


def memo_column(fn):
    """Cache a Column builder per (input column name, arguments).

    Building a pipeline tree costs thousands of Py4J calls; Column objects are
    immutable JVM expressions and can be shared by every DataFrame of the
    session, so the same (input, policy) is built once.
    """
    cache: dict = {}

    def wrapper(*args, **kw):
        from pyspark import SparkContext

        parts = [_key_part(a) for a in args] + [(k, _key_part(v)) for k, v in sorted(kw.items())]
        if any(p is None or (isinstance(p, tuple) and len(p) == 2 and p[1] is None) for p in parts):
            return fn(*args, **kw)
        sc = SparkContext._active_spark_context
        if sc is None:
            return fn(*args, **kw)
        # The application id changes with every new context (and JVM), unlike id(sc).
        key = (sc.applicationId, sc.startTime, tuple(parts))
        hit = cache.get(key)
        if hit is None:
            if len(cache) >= _CACHE_SIZE:
                del cache[next(iter(cache))]
            hit = cache[key] = fn(*args, **kw)
        return hit

    wrapper.__wrapped__ = fn
    wrapper.__doc__ = fn.__doc__
    wrapper.__name__ = fn.__name__
    return wrapper


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def entity_text(hit: Column, mode) -> Column | None:
    """What a finding keeps of the text it matched.

    ``False``: nothing (default, the audit must not leak what it redacts);
    ``True``: the raw text; ``"sha256"``: its SHA-256 digest (joinable, not readable).
    """
    if mode == "sha256":
        return F.sha2(F.encode(hit, "UTF-8"), 256)
    if mode is True:
        return hit
    if mode in (False, None):
        return None
    raise ValueError(f"include_text must be False, True or 'sha256', not {mode!r}")


def empty_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def span(stage, entity_type, start, end, score, text, masked) -> Column:
    def c(v, t):
        return (v if isinstance(v, Column) else F.lit(v)).cast(t)

    return F.struct(
        c(stage, "string").alias("stage"),
        c(entity_type, "string").alias("entity_type"),
        c(start, "int").alias("start"),
        c(end, "int").alias("end"),
        c(score, "double").alias("score"),
        c(text, "string").alias("text"),
        c(masked, "string").alias("masked"),
    )


#: Stands for a hit while a text is cut at its hits; a private-use character.
MARK = "\ue0f8"


def scan(text: Column, pattern: str) -> Column:
    """``struct<g: gaps, h: hits>`` of one regex over ``text`` (null stays null).

    ``split`` compiles its regex again for every value.  The hits are therefore replaced by MARK, which a plain split
    finds; texts that hold a MARK, and hits of no characters, which ``split`` treats in its own way, go the long way.
    """
    def cut(h):
        plain = F.split(F.regexp_replace(text, pattern, MARK), MARK, -1)
        return F.struct(F.when(text.contains(MARK) | F.array_contains(h, ""), F.split(text, pattern, -1)).otherwise(plain).alias("g"), h.alias("h"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cut)


def with_replacements(gh: Column, rewrite: Callable[[Column], Column]) -> Column:
    """Add ``r``: the rewrite of every hit (null = keep the hit as it is)."""
    return F.struct(
        gh["g"].alias("g"),
        gh["h"].alias("h"),
        F.transform(gh["h"], lambda m: F.coalesce(rewrite(m), m)).alias("r"),
    )


def rebuild(ghr: Column) -> Column:
    """Interleave gaps and rewritten hits back into one string."""
    return F.array_join(
        F.zip_with(ghr["g"], ghr["r"], lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))),
        "",
    )


PREFIX_BLOCK = 128


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0), lambda a, x: a + x)


def prefix_sums(lengths: Column, block: int = PREFIX_BLOCK) -> Column:
    """Inclusive running sums of an ``array<int>``, built from built-ins in O(n*B + (n/B)^2).

    ``aggregate`` with a growing array copies the array at every step (O(n^2));
    summing fixed blocks first keeps long arrays (many hits in one value) linear
    in practice.
    """
    n = F.size(lengths)
    nb = F.floor((n + block - 1) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), nb - 1), lambda b: _sum(F.slice(lengths, b * block + 1, block)))

    def body(bs):
        before = F.transform(F.sequence(F.lit(0), nb - 1), lambda b: _sum(F.slice(bs, 1, b)))

        def with_before(bf):
            def at(x, k):
                b = F.floor(k / block).cast("int")
                return F.element_at(bf, b + 1) + _sum(F.slice(lengths, b * block + 1, k - b * block + 1))

            return F.transform(lengths, at)

        return let(before, with_before)

    return F.when(n == 0, F.array().cast("array<int>")).otherwise(let(blocks, body))


def hit_spans(ghr: Column, make: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """Spans of all hits: ``make(hit, rewrite, start, end)`` -> span struct or null (dropped).

    A running position is folded over (gap, hit) pairs.  ``aggregate`` copies its whole state at every step, so the
    pairs are folded in blocks of PREFIX_BLOCK, each from the length of what is before it.
    """
    def one_block(b):
        skip = b * PREFIX_BLOCK
        before = F.length(F.concat(*[F.array_join(F.slice(ghr[k], 1, skip), "") for k in "gh"]))
        # Fields "0", "1", "2": gap, hit, rewrite.
        triples = F.arrays_zip(*[F.slice(ghr[k], skip + 1, PREFIX_BLOCK) for k in "ghr"])
        init = F.struct(before.alias("pos"), empty_spans().alias("out"))

        def step(acc, x):
            start = acc["pos"] + F.length(x["0"])
            end = start + F.coalesce(F.length(x["1"]), F.lit(0))
            s = make(x["1"], x["2"], start, end)
            out = F.when(x["1"].isNull() | s.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(s)))
            return F.struct(end.alias("pos"), out.alias("out"))

        return F.aggregate(triples, init, step, lambda acc: acc["out"])

    last = F.floor(F.greatest(F.size(ghr["h"]) - 1, F.lit(0)) / PREFIX_BLOCK).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), last), one_block))


def word_offsets(text: Column, pattern: str) -> Column:
    """``array<struct<w, s, e>>`` of every hit with offsets, linear-ish in the number of hits.

    Start of hit ``k`` = running sum of ``len(gap_j) + len(hit_j)`` for ``j < k``
    plus ``len(gap_k)``, from :func:`prefix_sums`.
    """
    def body(gh):
        pair_len = F.zip_with(gh["g"], gh["h"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))

        def with_sums(ps):
            def one(h, k):
                before = F.when(k == 0, F.lit(0)).otherwise(F.element_at(ps, F.greatest(k, F.lit(1))))
                start = before + F.length(F.element_at(gh["g"], k + 1))
                return F.struct(h.alias("w"), start.alias("s"), (start + F.length(h)).alias("e"))

            return F.transform(gh["h"], one)

        return let(prefix_sums(pair_len), with_sums)

    return F.when(text.isNull(), F.array().cast("array<struct<w:string,s:int,e:int>>")).otherwise(
        let(scan(text, pattern), body))


def rewrite_stage(
    text: Column,
    pattern: str,
    rewrite: Callable[[Column], Column],
    make: Callable[[Column, Column, Column, Column], Column] | None,
) -> Column:
    """One regex pass: ``struct<text, spans>``; spans only when ``make`` is given."""

    def body(ghr):
        spans = hit_spans(ghr, make) if make is not None else empty_spans()
        return F.struct(rebuild(ghr).alias("text"), spans.alias("spans"))

    def sole(gh):
        """A value's only hit, as most are, needs no fold."""
        hit, before, after = gh["h"][0], gh["g"][0], gh["g"][1]

        def done(r):
            start = F.length(before)
            spans = empty_spans() if make is None else F.filter(F.array(make(hit, r, start, start + F.length(hit))), lambda s: s.isNotNull())
            return F.struct(F.concat(before, r, after).alias("text"), spans.alias("spans"))

        return let(F.coalesce(rewrite(hit), hit), done)

    def either(gh):
        return F.when((F.size(gh["h"]) == 1) & (F.size(gh["g"]) == 2), sole(gh)).otherwise(let(with_replacements(gh, rewrite), body))

    # One failed find is far cheaper than split + extract + lambdas: most
    # values hold no hit, so they skip the array machinery entirely.
    return F.when(text.rlike(pattern), let(scan(text, pattern), either)).otherwise(
        F.struct(text.alias("text"), empty_spans().alias("spans"))
    )
