"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text has a lookup table over quantile bins.  Tables are learnt by cyclic boosting: round after
round each feature in turn gets a shallow tree, grown on the histogram of gradients over its bins, whose leaf values, shrunk, are
added to its table.  The pairs whose two-dimensional histogram explains most of what is left then get tables of
their own the same way.  A score is the sigmoid of the sum of the tables' entries: bin lookups and additions, vectorised over a
batch.  The model is a few kB; it is fitted on a bounded sample of labelled rows and scores all rows in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrub.llm.common import Scratch, col, fresh, map_slices, slices, small_batches, text_of

#: Most labelled rows that the model is fitted on, those of least hash.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 150, 60, 0.15, 4
#: A document is good from this score on.
THRESHOLD = 0.3

FEATURES = [
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "exclamation", "bar", "symbol", "stop",
    "comma", "high_byte", "control", "distinct_words", "repeated_neighbours", "top_word", "lines_per_word", "distinct_lines",
    "short_words", "capital_words",
]

_CLASS = np.zeros((9, 256))
for _row, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|", b"#$%&*<>=@^~{}[]\\", b".", b",;:", range(128, 256), [*range(9), *range(14, 32), 127])):
    _CLASS[_row, list(_bytes)] = 1


def features(text: str) -> list[float]:
    """FEATURES of a whole text; the empty text has a defined vector too."""
    data = text.encode("utf-8")
    n = max(1, len(data))
    share = (_CLASS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)) / n
    words = data.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = data.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:]))
    upper, digit, exclamation, bar, symbol, stop, comma, high, control = share
    return [
        np.log1p(len(data)), np.log1p(len(words)), float(lengths.mean()), float(min(lengths.max(), 1000)), upper, digit, exclamation, bar, symbol, stop,
        comma, high, control, len(counts) / w, same / w, max(counts.values(), default=0) / w, len(lines) / w, len(set(lines)) / len(lines),
        float((lengths <= 3).mean()), sum(x[:1].isupper() for x in words) / w,
    ]


def feature_matrix(texts: Iterable[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf value of each bin of a best-first regression tree over ordered bins."""
    n = len(grad)
    g, h = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    def split(a, b):
        if b - a < 2:
            return 0.0, None
        m = np.arange(a + 1, b)
        won = gain(a, m) + gain(m, b) - gain(a, b)
        at = int(won.argmax())
        return float(won[at]), int(m[at])

    parts = [(0, n, *split(0, n))]
    while len(parts) < leaves:
        best = max(range(len(parts)), key=lambda i: parts[i][2])
        a, b, won, m = parts[best]
        if m is None or won <= 1e-9:
            break
        parts[best : best + 1] = [(a, m, *split(a, m)), (m, b, *split(m, b))]
    out = np.zeros(n)
    for a, b, _, _ in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _tree2(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Leaf values of a two-level tree over a grid: the better axis first, then each half along the other."""
    best, found = -1.0, np.zeros_like(grad)
    for flip in (False, True):
        g, h = (grad.T, hess.T) if flip else (grad, hess)
        rows = _tree(g.sum(axis=1), h.sum(axis=1), 2)
        out = np.zeros_like(g)
        for v in np.unique(rows):
            at = rows == v
            out[at] = _tree(g[at].sum(axis=0), h[at].sum(axis=0), 2)
        won = float((out * g).sum() - 0.5 * (out**2 * h).sum())
        if won > best:
            best, found = won, out.T if flip else out
    return found


@dataclass
class Gam:
    """Bin edges and lookup tables of a fitted model."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """A model of labels `y` (0 or 1); without rows it scores 0.5, with one label near that label everywhere."""
    n = len(y)
    rate = (y.sum() + 1.0) / (n + 2.0)
    model = Gam(base=float(np.log(rate / (1 - rate))))
    if n == 0:
        return model
    cut = lambda v, bins: np.unique(np.quantile(v, np.arange(1, bins) / bins))
    model.edges = [cut(v, BINS) for v in x.T]
    model.coarse = [cut(v, PAIR_BINS) for v in x.T]
    fine = [np.searchsorted(e, v, side="right") for e, v in zip(model.edges, x.T)]
    rough = [np.searchsorted(e, v, side="right") for e, v in zip(model.coarse, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(n, model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(fine[j], g, len(table)), np.bincount(fine[j], h, len(table)), LEAVES)
            table += step
            total += step[fine[j]]

    def grid(a, b, g, h):
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        cell = rough[a] * shape[1] + rough[b]
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            _, sg, sh = grid(a, b, g, h)
            leaf = _tree2(sg, sh)
            gains.append((float((leaf * sg).sum() - 0.5 * (leaf**2 * sh).sum()), a, b))
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            g, h = slopes()
            cell, sg, sh = grid(a, b, g, h)
            step = RATE * _tree2(sg, sh)
            table += step
            total += step.ravel()[cell]
    return model


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5, and for null ids: never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Gam:
    """Fit on at most `rows` labelled documents that aren't held out, those of least id hash.

    Labels other than 0 and 1 and null labels are left out; of rows that repeat an id the least label and features
    count.  Only texts are inputs.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    key, y = F.col("_key"), F.col("_y")
    known = labels.select(col(id_col).alias("_key"), col(label_col).cast("int").alias("_y")).filter(y.isin(0, 1) & ~held_out(key))
    known = known.groupBy("_key").agg(F.min("_y").alias("_y"))
    draw = F.xxhash64(F.lit(41), key)
    rate = min(1.0, 1.2 * rows / max(1, known.count()))
    chosen = scratch.save(known.filter(draw / 2.0**64 + 0.5 <= rate).orderBy(draw, key).limit(rows))

    def make():
        def run(b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(feature_matrix(b["text"]), columns=FEATURES).assign(y=b["y"].to_numpy(), key=b["key"].to_numpy())

        return run

    texts = docs.select(col(id_col).alias("_id"), text_of(text_col).alias("text"))
    met = texts.join(F.broadcast(chosen), texts["_id"] == chosen["_key"]).select("text", F.col("_y").alias("y"), chosen["_key"].cast("string").alias("key"))
    seen = map_slices(met, make, ", ".join(f"{f} double" for f in FEATURES) + ", y int, key string")
    got = seen.groupBy("key", "y").agg(*[F.min(f).alias(f) for f in FEATURES]).orderBy("key").toPandas()
    return fit(got[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), got["y"].to_numpy(float))


def scored(docs: DataFrame, model: Gam, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with `score_col` (0 to 1) of the whole text; null and empty texts are scored as empty. One pass, no shuffle."""

    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return slices(batches, lambda some: pa.array(model.score(feature_matrix(some.to_pylist()))))

    return docs.withColumn(score_col, run(text_of(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: (doc_id, held_out, score, predicted).

    predicted is 1 where score >= `threshold`.  An empty table of labels gives 0.5 for every document.  Rows that repeat
    an id are scored each by its text; other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col)
    slim = docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), text_of(text_col).alias("text"))
    out = scored(slim, model).drop("text")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents that score below `threshold`, all columns as they were."""
    score = fresh(docs, "_score")
    return scored(docs, train(docs, labels, id_col, text_col), text_col, score).filter(col(score) >= threshold).drop(score)
