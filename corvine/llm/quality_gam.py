"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic gradient boosting gives every feature in turn a shallow tree on its bins; the
trees of a feature add up to one lookup table, and those of a pair of features to a
small grid. A score is then a sum of table entries, for whole batches at once.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.labelled import held_out, sample_ids, training_labels
from corvine.session import materialize

#: Bound of the training sample: documents of either class.
SAMPLE_PER_CLASS = 20_000
BINS = 32
PAIR_BINS = 8
THRESHOLD = 0.5

FEATURES = (
    "log_words",
    "mean_word",
    "distinct_words",
    "distinct_pairs",
    "adjacent_equal",
    "top_word",
    "long_words",
    "upper",
    "digits",
    "symbols",
    "pipes",
    "exclaims",
    "stops",
    "other_bytes",
    "log_lines",
    "distinct_lines",
    "words_per_line",
    "entropy",
)


def text_features(text: str | None) -> list[float]:
    """The features of one whole text; an empty or null one has zeros."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    hist = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = int(hist.sum())
    letters = max(int(hist[65:91].sum() + hist[97:123].sum()), 1)
    p = hist[hist > 0] / size
    chars = sum(map(len, words))
    return [
        float(np.log1p(n)),
        chars / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0,
        sum(map(operator.eq, words, words[1:])) / n,
        max(Counter(words).values()) / n,
        sum(map((15).__lt__, map(len, words))) / n,
        float(hist[65:91].sum()) / letters,
        float(hist[48:58].sum()) / size,
        float(hist[[35, 42, 36, 37, 38, 60, 62, 64, 94, 95, 126]].sum()) / n,
        float(hist[124]) / n,
        float(hist[33] + hist[63]) / n,
        float(hist[46] + hist[44]) / n,
        float(hist[128:].sum()) / size,
        float(np.log1p(len(lines))),
        len(set(lines)) / max(len(lines), 1),
        float(np.log1p(n / max(len(lines), 1))),
        float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class GamModel:
    cuts: list[np.ndarray]
    tables: np.ndarray  # features x BINS
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: np.ndarray  # pairs x PAIR_BINS x PAIR_BINS
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features: bin, look up, add."""
        z = np.full(len(x), self.base)
        for f, cut in enumerate(self.cuts):
            z += self.tables[f][np.searchsorted(cut, x[:, f], side="right")]
        if self.pairs:
            coarse = {f: np.searchsorted(self.pair_cuts[f], x[:, f], side="right") for f in {f for p in self.pairs for f in p}}
            for (a, b), grid in zip(self.pairs, self.grids, strict=True):
                z += grid[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(col: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The leaf value of every bin, of a tree of ``depth`` on ordered bins."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, d: int) -> None:
        sg, sh = g[a:b].sum(), h[a:b].sum()
        if d and b - a > 1:
            lg, lh = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            gain = lg**2 / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg**2 / (sh + ridge)
            gain[(lh < 1) | (sh - lh < 1)] = -1
            k = int(np.argmax(gain))
            if gain[k] > 1e-3:
                grow(a, a + k + 1, d - 1)
                grow(a + k + 1, b, d - 1)
                return
        out[a:b] = sg / (sh + ridge)

    grow(0, len(g), depth)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best pair of one cut on either axis: values of the four quarters and gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a_g, a_h, l_g, l_h = cg[:-1, :-1], ch[:-1, :-1], cg[:-1, -1:], ch[:-1, -1:]
    t_g, t_h = cg[-1:, :-1], ch[-1:, :-1]
    quarters = [(a_g, a_h), (l_g - a_g, l_h - a_h), (t_g - a_g, t_h - a_h), (tg - l_g - t_g + a_g, th - l_h - t_h + a_h)]
    gain = sum(x**2 / (y + ridge) for x, y in quarters) - tg**2 / (th + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [x[i, j] / (y[i, j] + ridge) for x, y in quarters]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.1, depth: int = 2, ridge: float = 1.0) -> GamModel:
    """Boost feature by feature in turn, then the pairs that gain most on what is left."""
    k = x.shape[1]
    share = float(np.average(y, weights=weight)) if len(y) else 0.5
    base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    model = GamModel([np.zeros(0)] * k, np.zeros((k, BINS)), [np.zeros(0)] * k, [], np.zeros((0, PAIR_BINS, PAIR_BINS)), base)
    if not len(y) or y.min() == y.max():
        return model
    model.cuts = [_cuts(x[:, f], BINS) for f in range(k)]
    model.pair_cuts = [_cuts(x[:, f], PAIR_BINS) for f in range(k)]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.cuts)]
    z = np.full(len(y), base)
    for _ in range(rounds):
        for f in range(k):
            p = 1 / (1 + np.exp(-z))
            n = len(model.cuts[f]) + 1
            step = rate * _tree(np.bincount(bins[f], weight * (y - p), n), np.bincount(bins[f], weight * p * (1 - p), n), depth, ridge)
            model.tables[f, :n] += step
            z += step[bins[f]]
    coarse = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.pair_cuts)]
    cells = PAIR_BINS * PAIR_BINS

    def grid(a: int, b: int) -> tuple[np.ndarray, float, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        at = coarse[a] * PAIR_BINS + coarse[b]
        g, h = (np.bincount(at, v, cells).reshape(PAIR_BINS, PAIR_BINS) for v in (weight * (y - p), weight * p * (1 - p)))
        return *_cross(g, h, ridge), at

    gains = sorted(((grid(a, b)[1], a, b) for a, b in combinations(range(k), 2)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:n_pairs] if gain > 1e-3]
    model.grids = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(pair_rounds):
        for i, (a, b) in enumerate(model.pairs):
            values, _, at = grid(a, b)
            model.grids[i] += rate * values
            z += rate * values.ravel()[at]
    return model


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``features``, an array of doubles; a narrow map."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "features")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array([text_features(t.as_py()) for t in b.column(text)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c.name) for c in kept), f], names=[*(c.name for c in kept), "features"])

    fields = [f"`{c.name}` {c.dataType.simpleString()}" for c in kept]
    return docs.select(*[f"`{c.name}`" for c in kept], text).mapInArrow(run, ", ".join([*fields, "features array<double>"]))


def fit_quality(featured: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, label: str = "quality") -> GamModel:
    """Train on the features of at most ``per_class`` labelled rows of either class;
    the classes are weighted back to their shares among all labelled rows."""
    known = training_labels(labels, label)
    ids = sample_ids(known, per_class)
    # At most 2 * per_class rows of 12 bytes: a proven bound.
    got = featured.select("doc_id", "features").join(F.broadcast(ids), "doc_id")
    # One row for each id, however often it repeats.
    got = got.groupBy("doc_id", "y").agg(F.min("features").alias("features")).toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["y"].to_pylist(), got["features"].to_pylist(), strict=True))
    y = np.array([r[1] for r in rows], float)
    x = np.array([r[2] for r in rows], float).reshape(len(rows), len(FEATURES))
    share = known.agg(F.avg("y")).first()[0]
    share = 0.5 if share is None else float(share)
    mine = max(float(y.mean()), 1e-9) if len(y) else 0.5
    return train(x, y, np.where(y > 0, share / mine, (1 - share) / max(1 - mine, 1e-9)))


def score_features(featured: DataFrame, model: GamModel) -> DataFrame:
    """Add score and predicted to rows with ``features``, and drop those."""
    kept = [f for f in featured.schema.fields if f.name not in ("features", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*(b.column(c.name) for c in kept), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*(c.name for c in kept), "score", "predicted"])

    fields = [f"`{c.name}` {c.dataType.simpleString()}" for c in kept]
    return featured.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by a model trained on ``labels``.

    Texts are read once; only ids and features are kept in the shared folder. Null and
    empty texts have zero features. Without labels of both classes every score is the
    labels' base rate (0.5 if there are none); repeated rows get equal scores; an empty
    table gives an empty result.
    """
    featured = materialize(with_features(docs.select("doc_id", "text")), "features")
    scored = score_features(featured, fit_quality(featured, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
