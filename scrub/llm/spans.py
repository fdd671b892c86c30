"""Digest columns that the two scanning operators derive from their spans."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span: code points, end exclusive; `rank` orders kinds that start together.
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def untouched(spans: list[tuple[int, int, int, str]]) -> Callable[[int, int], bool]:
    """A test whether a span (start, end) touches none of `spans` (start, rank, end, kind), in O(log n)."""
    order = sorted((s, e) for s, _, e, _ in spans)
    starts, reach, far = [s for s, _ in order], [], 0
    for _, e in order:
        far = max(far, e)
        reach.append(far)

    def free(start: int, end: int) -> bool:
        at = bisect_left(starts, end)
        return at == 0 or reach[at - 1] <= start

    return free
