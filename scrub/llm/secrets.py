"""Secret scan: three patterns, and a battery of randomness tests over all other long tokens.

A token of letters, digits and base64 signs with digits and letters in it is given the smallest alphabet that holds all its
characters (hex, base32, lower-case alphanumeric, ...).  As places in that alphabet, its characters should be uniform
(chi-squared), without order (Wald-Wolfowitz runs about the middle) and uncorrelated with their neighbours (lag-1
serial correlation) if the token is a random key.  Fisher's method joins the three p-values.

The null is "random"; a token is dismissed as prose, a path or a number scheme when the null is rejected.  Rejections are
controlled by the Benjamini-Hochberg step-up inside strata of token length, since short tokens have little power and would
otherwise set the bar for long ones: of the tokens dismissed in a stratum at most the share Q is expected to be random.
The p-values of the whole corpus enter, as counts on a fixed grid, so the step-up needs one aggregate.  Tokens that
are not dismissed and carry at least MIN_BITS in their alphabet are reported.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrub.llm.common import Scratch, col, map_slices, text_of
from scrub.llm.spans import SPAN, count_of, listed, untouched

KINDS = ("assign", "access", "hex")
#: False dismissals expected among dismissals.
Q = 0.05
#: Least entropy, if random, of a reported token.
MIN_BITS = 80
#: Upper ends of the length strata.
STRATA = (19, 23, 31, 47, 79)
#: Grid of -log10 p: steps of 1/GRID up to GRID_TOP.
GRID, GRID_TOP = 20, 30

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile(
    "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by size of alphabet; a token's is the first that holds it.
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "hex-upper": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "alnum-lower": _DIGITS + _LOWER,
    "alnum-upper": _DIGITS + _UPPER, "alnum": _DIGITS + _LOWER + _UPPER, "base64": _DIGITS + _LOWER + _UPPER + "+/", "base64-url": _DIGITS + _LOWER + _UPPER + "-_",
    "all": _DIGITS + _LOWER + _UPPER + "+/-_",
}
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS.items()]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the patterns: leftmost, non-overlapping for each kind; failing matches are dropped."""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]


def encoding(token: str) -> tuple[int, list[int]]:
    """Size of the smallest alphabet that holds the token, and its characters' places there."""
    have = set(token)
    _, letters, place = next(x for x in _SETS if have <= x[1])
    return len(letters), [place[c] for c in token]


def _two_sided(z: float) -> float:
    return max(1e-300, math.erfc(abs(z) / math.sqrt(2)))


def uniformity_p(places: list[int], size: int) -> float:
    """Upper tail of chi-squared against equal counts, by the cube-root normal approximation."""
    n = len(places)
    counts: dict[int, int] = {}
    for v in places:
        counts[v] = counts.get(v, 0) + 1
    x, k = sum(c * c for c in counts.values()) * size / n - n, size - 1
    z = ((max(x, 0) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return max(1e-300, 0.5 * math.erfc(z / math.sqrt(2)))


def runs_p(places: list[int], size: int) -> float:
    """Wald-Wolfowitz runs of places below and above the alphabet's middle, given how many there are of each."""
    up = [2 * v >= size for v in places]
    n, a = len(up), sum(up)
    b = n - a
    if not a or not b:
        return max(1e-300, 2.0 ** (1 - n))
    runs = 1 + sum(x != y for x, y in zip(up, up[1:]))
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(places: list[int]) -> float:
    """Lag-1 serial correlation."""
    n = len(places)
    mean = sum(places) / n
    d = [v - mean for v in places]
    ss = sum(x * x for x in d)
    if ss == 0:
        return 1e-300
    r = sum(x * y for x, y in zip(d, d[1:])) / ss
    return _two_sided((r + 1 / n) * math.sqrt(n))


def battery_p(token: str) -> float:
    """Fisher's combination of the three tests of "random in its encoding"."""
    size, places = encoding(token)
    x = -sum(map(math.log, (uniformity_p(places, size), runs_p(places, size), serial_p(places))))
    return max(1e-300, math.exp(-x) * (1 + x + x * x / 2))


def stratum(length: int) -> int:
    return next((i for i, top in enumerate(STRATA) if length <= top), len(STRATA))


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[dict]:
    """Tokens with letters and digits of at least MIN_BITS that no base span touches, with their battery."""
    out = []
    free = untouched(taken)
    for m in TOKEN.finditer(text):
        token = m[0]
        if token.isalpha() or token.isdigit() or not any(c in _DIGITS for c in token) or not any(c.isalpha() for c in token):
            continue
        if not free(m.start(), m.end()):
            continue
        size, _ = encoding(token)
        if len(token) * math.log2(size) >= MIN_BITS:
            p = battery_p(token)
            out.append({"start": m.start(), "end": m.end(), "stratum": stratum(len(token)), "g": min(GRID_TOP * GRID, int(-math.log10(p) * GRID))})
    return out


def dismissal_bars(counts: list[tuple[int, int, int]], q: float = Q) -> dict[int, int]:
    """For each stratum the least grid step at which the null is rejected, from (stratum, step, tokens).

    A step's p-values are taken at the step's upper end, so the control holds on the grid as it does off it.
    """
    bars = {}
    for s in {s for s, _, _ in counts}:
        own = sorted(((g, n) for t, g, n in counts if t == s), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for g, n in own:
            seen += n
            if 10 ** (-g / GRID) * total <= q * seen:
                bars[s] = g
    return bars


def _scan():
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        base = [base_spans(t) for t in batch["text"]]
        found = [candidates(t, b) for t, b in zip(batch["text"], base)]
        rows = [[dict(zip(("start", "rank", "end", "kind"), s)) for s in b] for b in base]
        return pd.DataFrame({"doc_id": batch["doc_id"], "base": rows, "found": found})

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """One row per row of `docs`: (doc_id, base, added): spans of the patterns, and random tokens (kind random).

    Null texts count as empty and have no spans.  Texts are scanned whole in one pass; repeated rows get the same
    spans each, and weigh each in the control.  An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    slim = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    rows = scratch.save(map_slices(slim, _scan, f"doc_id {kind}, base {SPAN}, found array<struct<start:int,end:int,stratum:int,g:int>>"))
    steps = rows.select(F.explode("found").alias("c")).groupBy("c.stratum", "c.g").count()
    # At most (strata) x (grid steps) rows.
    bars = dismissal_bars([tuple(r) for r in steps.collect()], q)
    bar = F.create_map(*[F.lit(x) for s in range(len(STRATA) + 1) for x in (s, bars.get(s, GRID * GRID_TOP + 1))])
    kept = F.filter("found", lambda c: c["g"] < F.element_at(bar, c["stratum"]))
    added = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), c["end"].alias("end"), F.lit("random").alias("kind")))
    return rows.select("doc_id", "base", added.alias("added"))


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of `scan_secrets` as counts, a digest of the base spans and one list of all."""
    rows = scan_secrets(docs, id_col, text_col)
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
