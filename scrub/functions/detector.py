"""User detection hook: a vectorised Python detector merged into the span arrays.

The only place Python runs per row, and only when a caller plugs one in.  The
function receives a whole Arrow batch as a pandas Series and returns, per
value, a list of ``(entity_type, start, end, score)``; offsets are code points.
"""

from __future__ import annotations

import re
import uuid
from typing import Any, Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETECTION_TYPE = T.ArrayType(T.StructType([
    T.StructField("entity_type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
]))


def detector(fn: Callable[[str], list]) -> Callable[[Column], Column]:
    """Wrap ``fn(text) -> [(entity_type, start, end, score), ...]`` as a pandas UDF.

    A value on which ``fn`` raises yields null (the task goes on); callers treat
    a null result for a non-null text as a failed value, never as "no findings".
    """

    def one(t):
        if t is None:
            return None
        try:
            found = fn(t)
        except Exception:  # noqa: BLE001 - reported per value as a failure
            return None
        return [{"entity_type": e, "start": int(s), "end": int(x), "score": float(sc)} for e, s, x, sc in found]

    @F.pandas_udf(DETECTION_TYPE)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


#: Models a worker process keeps between tasks; the one loaded first leaves first.
MODELS_KEPT = 4
_models: dict[str, Any] = {}


def _model(key: str, setup: Callable[[], Any]):
    """The model of ``key`` in this worker process, set up on first use."""
    if key not in _models:
        while len(_models) >= MODELS_KEPT:
            del _models[next(iter(_models))]
        _models[key] = setup()
    return _models[key]


def _found_or_null(model, predict: Callable, texts: list[str]) -> list:
    """Findings per text; where a batch raises, its texts are tried one by one, and those that still raise are null."""
    try:
        found = predict(model, texts)
    except Exception:  # noqa: BLE001 - reported per value as a failure
        if len(texts) == 1:
            return [None]
        return [x for t in texts for x in _found_or_null(model, predict, [t])]
    if len(found) != len(texts):
        raise ValueError(f"predict returned {len(found)} results for {len(texts)} texts")
    return [[{"entity_type": e, "start": int(s), "end": int(x), "score": float(sc)} for e, s, x, sc in f] for f in found]


def model_detector(setup: Callable[[], Any], predict: Callable[[Any, list[str]], list], batch_size: int = 64) -> Callable[[Column], Column]:
    """A detector backed by a model that is loaded once a worker process and asked in batches.

    ``setup()`` returns the model; it runs on the first task of a worker that needs it, and an error there fails the task.
    ``predict(model, texts)`` gets up to ``batch_size`` non-null texts and returns one list of ``(entity_type, start, end,
    score)`` for each.  As with ``detector``, a text on which it raises yields null and counts as failed; null texts
    yield null and are never handed on.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    key = uuid.uuid4().hex

    @F.pandas_udf(DETECTION_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(asked), batch_size):
                part = asked[at : at + batch_size]
                for i, found in zip(part, _found_or_null(_model(key, setup), predict, [texts.iat[i] for i in part])):
                    out[i] = found
            yield pd.Series(out, dtype=object)

    return run


def regex_detector(pattern: str, entity_type: str, score: float) -> Callable[[Column], Column]:
    """A detector backed by Python ``re`` (compiled once per worker process)."""
    compiled = re.compile(pattern)

    def find(text: str):
        return [(entity_type, m.start(), m.end(), score) for m in compiled.finditer(text)]

    return detector(find)
