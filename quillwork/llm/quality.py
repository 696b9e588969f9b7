"""Quality classifier: a generalised additive model with pairwise interactions (operator 9).

Each text gives a few numbers.  Cyclic boosting fits one shallow tree at a time to one feature (then to one chosen pair
of features) of the logistic loss; the trees of a feature add up to a lookup table over its bins.  A score is the
logistic function of the intercept plus one table entry for each feature and pair, added in numpy for whole batches.

The model is learned from at most `MOST_ROWS` labelled rows, those with the smallest hash of their id, so neither the
sample nor the broadcast tables grow with the corpus.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_append, held_out, table, texts

MOST_ROWS = 12_000
THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "punctuation", "exclamation", "symbols",
    "bars", "beyond_ascii", "distinct_words", "top_word", "repeated_lines", "line_words", "short_words", "capital_words",
)
_UPPER, _LETTERS = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def features(text: bytes | None) -> list[float]:
    """Numbers of one whole text; of a null text as of an empty one."""
    text = text or b""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, size = text.split(), max(1, len(text))
    seen, lines = Counter(words), [x for x in text.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    many = max(1, len(words))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        float(lengths.mean()),
        np.log1p(int(lengths.max())),
        n[_UPPER].sum() / max(1, n[_LETTERS].sum()),
        n[48:58].sum() / size,
        n[_PUNCT].sum() / size,
        n[33] / size,
        (n[35] + n[36] + n[37] + n[38] + n[42]) / size,
        n[124] / size,
        n[128:].sum() / size,
        len(seen) / many,
        max(seen.values(), default=0) / many,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(many / max(1, len(lines))),
        float((lengths <= 3).mean()),
        n[_UPPER].sum() / many,
    ]


@dataclass
class Gam:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, f], "right")]
        for (f, g), values in self.pairs.items():
            a = np.searchsorted(self.pair_edges[f], x[:, f], "right")
            out += values[a, np.searchsorted(self.pair_edges[g], x[:, g], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, at quantiles."""
    values = np.unique(column)
    if len(values) < 2:
        return np.zeros(0)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        return values[values > column.min()]
    return (values[1:] + values[:-1]) / 2


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float, least: float) -> np.ndarray:
    """Newton values by bin of the best tree of at most `leaves` leaves over ordered bins, grown greedily."""
    parts = [(0, len(g))]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            gain = gain_of(a, k) + gain_of(k, b) - gain_of(a, b)
            gain[(ch[k] - ch[a] < least) | (ch[b] - ch[k] < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), (a, b), int(k[gain.argmax()]))
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Newton values of the best two-by-two tree over a grid, and its gain."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(m, 0), 1), ((1, 0), (1, 0))) for m in (g, h))
    best, values = 0.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return values, best
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij"))
    quads = lambda c: (c[i, j], c[-1, j] - c[i, j], c[i, -1] - c[i, j], c[-1, -1] - c[-1, j] - c[i, -1] + c[i, j])
    leaf = [(a, b) for a, b in zip(quads(cg), quads(ch), strict=True)]
    gain = sum(a**2 / (b + l2) for a, b in leaf) - cg[-1, -1] ** 2 / (ch[-1, -1] + l2)
    k = int(gain.argmax())
    v = [a[k] / (b[k] + l2) for a, b in leaf]
    values[: i[k], : j[k]], values[i[k] :, : j[k]], values[: i[k], j[k] :], values[i[k] :, j[k] :] = v
    return values, float(gain[k])


def fit(
    x: np.ndarray, y: np.ndarray, *, bins: int = 32, grid: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8,
    rate: float = 0.15, leaves: int = 3, l2: float = 2.0, least: float = 1.0,
) -> Gam:
    """Cyclic boosting of the logistic loss; without rows of both labels the model is the smoothed share alone."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    model.edges = [_edges(c, bins) for c in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)
    model.pair_edges = [_edges(c, grid) for c in x.T] if len(x) else model.edges
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    rough = [np.searchsorted(e, c, "right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    f = np.full(len(y), model.intercept)

    def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return np.bincount(index, y - p, size), np.bincount(index, p * (1 - p), size)

    for _ in range(rounds):
        for k, values in enumerate(model.tables):
            if len(values) > 1:
                step = rate * _tree(*sums(at[k], len(values)), leaves, l2, least)
                values += step
                f += step[at[k]]
    shape = [len(e) + 1 for e in model.pair_edges]
    flat = lambda a, b: rough[a] * shape[b] + rough[b]
    cells = lambda a, b: (m.reshape(shape[a], shape[b]) for m in sums(flat(a, b), shape[a] * shape[b]))
    ranked = sorted(((_grid_tree(*cells(a, b), l2)[1], a, b) for a in range(len(shape)) for b in range(a)), reverse=True)
    model.pairs = {(a, b): np.zeros((shape[a], shape[b])) for gain, a, b in ranked[:pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (a, b), values in model.pairs.items():
            step = rate * _grid_tree(*cells(a, b), l2)[0]
            values += step
            f += step.ravel()[flat(a, b)]
    return model


def train(
    docs: DataFrame, labels: DataFrame, usable: F.Column, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", most_rows: int = MOST_ROWS,
) -> Gam:
    """Learn `label_col` (0 or 1) from at most `most_rows` labelled rows whose id is usable; null labels teach nothing."""
    rows = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    rows = rows.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    sample = rows.orderBy(F.xxhash64("i", F.lit("quality")), "i", "y").limit(most_rows)
    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(sample), "i")
    found = numbers(found, "t", keep=["i", "y"]).orderBy(F.xxhash64("i", F.lit("rows")), "i", "x").limit(most_rows).toPandas()
    x = np.array(found["x"].tolist()).reshape(len(found), len(FEATURES))
    return fit(x, found["y"].to_numpy(dtype=float))


def numbers(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns with x, the features of each whole text."""

    def start():
        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {"x": pa.array([list(map(float, features(t))) for t in texts(batch.column(0))], pa.list_(pa.float64()))}

        return each

    return arrow_append(docs, [text_col], start, "x array<double>", keep)


def score(docs: DataFrame, model: Gam, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The kept columns of `docs` with the probability of label 1; null and empty texts have one too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            x = np.array([features(t) for t in texts(batch.column(0))]).reshape(batch.num_rows, len(FEATURES))
            return {out: pa.array(model.score(x), pa.float64())}

        return each

    return arrow_append(docs, [text_col], start, f"{out} double", keep)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    rows = score(docs, model, keep=["doc_id"])
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
