"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins, and cyclic boosting gives the features one after the other a shallow tree on the
residuals, whose leaves add to the feature's lookup table. Then the pairs whose cells explain most of what is left
are boosted the same way on a grid of coarser bins. A document's score is the logistic of the sum of its table
entries, looked up for a batch at once.

Lou et al., "Accurate Intelligible Models with Pairwise Interactions".
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import scratch, table
from .labels import QUALITY_ROWS, held_out, labelled

BINS, CELLS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST = 120, 60, 0.15, 20
NAMES = (
    "bytes", "words", "word_length", "distinct_words", "upper", "lower", "digits", "spaces", "commas_stops", "exclaims", "bars", "signs",
    "other_ascii", "beyond_ascii", "upper_words", "sign_words", "short_words", "longest_word", "line_words", "repeated_lines",
)


def features(text: str | None) -> list[float]:
    """The numbers that a text is judged by; all are 0 for an empty or null text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = list(map(len, words))
    signs = int(h[[35, 36, 37, 38, 42, 43, 61, 64, 94, 95, 126]].sum())  # # $ % & * + = @ ^ _ ~
    upper, lower, digits, spaces = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum()), int(h[9:14].sum() + h[32])
    stops, exclaims, bars, beyond = int(h[44] + h[46]), int(h[33] + h[63]), int(h[124] + h[92] + h[47]), int(h[128:].sum())
    rest = n - upper - lower - digits - spaces - stops - exclaims - bars - beyond - signs
    return [
        np.log1p(n), np.log1p(len(words)), sum(sizes) / k, len(set(words)) / k, upper / n, lower / n, digits / n, spaces / n, stops / n, exclaims / n, bars / n, signs / n,
        rest / n, beyond / n, sum(map(str.isupper, words)) / k, sum(not w[-1].isalnum() and w[-1] not in ",." for w in words) / k, sum(s <= 2 for s in sizes) / k, max(sizes, default=0),
        len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
    ]


@dataclass
class AdditiveModel:
    """Lookup tables of features and of pairs, and the value they add to."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, coarse: bool = False) -> np.ndarray:
        edges = self.coarse if coarse else self.edges
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1) if edges else np.zeros((len(x), 0), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.tables:
            fine, rough = self.bins(x), self.bins(x, True)
            for j, t in enumerate(self.tables):
                out += t[fine[:, j]]
            for (i, j), g in zip(self.pairs, self.grids, strict=True):
                out += g[rough[:, i], rough[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Value by bin of a tree with so many leaves at most, from sums of gradients, weights and rows by bin."""
    cuts = [0, len(g)]
    gain_of = lambda a, b: (g[a:b].sum() ** 2) / (h[a:b].sum() + 1.0)
    for _ in range(leaves - 1):
        best = (1e-6, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            lg, lh, ln = g[a:b].cumsum()[:-1], h[a:b].cumsum()[:-1], n[a:b].cumsum()[:-1]
            tg, th, tn = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
            gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - gain_of(a, b)
            gain = np.where((ln >= LEAST) & (tn - ln >= LEAST), gain, 0)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), a + k + 1), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """The model of rows x and labels y in 0, 1. Without both labels the score is constant; without rows it is 0.5."""
    n = len(y)
    p = (y.sum() + 0.5) / (n + 1)
    model = AdditiveModel(float(np.log(p / (1 - p))))
    if not 0 < y.sum() < n:
        return model
    cut = lambda k: [np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1])) for c in x.T]
    model.edges, model.coarse = cut(BINS), cut(CELLS)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine, rough = model.bins(x), model.bins(x, True)
    out = np.full(n, model.base)
    rows = [np.bincount(fine[:, j], minlength=len(t)) for j, t in enumerate(model.tables)]
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            q = 1 / (1 + np.exp(-out))
            step = RATE * _tree(np.bincount(fine[:, j], y - q, len(t)), np.bincount(fine[:, j], q * (1 - q), len(t)), rows[j])
            t += step
            out += step[fine[:, j]]
    q = 1 / (1 + np.exp(-out))
    worth = []
    for i, j in combinations(range(x.shape[1]), 2):
        cell = rough[:, i] * CELLS + rough[:, j]
        g, h = np.bincount(cell, y - q, CELLS * CELLS), np.bincount(cell, q * (1 - q), CELLS * CELLS)
        worth.append((float((g**2 / (h + 1)).sum()), (i, j)))
    model.pairs = [p for _, p in sorted(worth, reverse=True)[:pairs]]
    model.grids = [np.zeros((CELLS, CELLS)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), grid in zip(model.pairs, model.grids, strict=True):
            q = 1 / (1 + np.exp(-out))
            sums = [np.bincount(rough[:, i] * CELLS + rough[:, j], w, CELLS * CELLS).reshape(CELLS, CELLS) for w in (y - q, q * (1 - q), np.ones(n))]
            # A shallow tree on the pair: the first feature's split, and in each half the second one's.
            half = _tree(*(s.sum(1) for s in sums), leaves=2)
            step = np.zeros_like(grid)
            for v in np.unique(half):
                part = half == v
                step[part] = _tree(*(s[part].sum(0) for s in sums), leaves=2)
            grid += RATE * step
            out += RATE * step[rough[:, i], rough[:, j]]
    return model


def _features(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, rows: int = QUALITY_ROWS) -> AdditiveModel:
    """The model of at most `rows` labelled documents outside the held-out third.

    Null and empty texts measure 0 throughout; an id that repeats counts once (see labelled()); an empty table, or one
    without labels, makes a model that scores every text 0.5. Other columns are not looked at.
    """

    @arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array(list(_features(texts)), pa.list_(pa.float64()))

    got = labelled(docs, labels, "quality", rows).select(F.col("doc_id"), measured(F.col("text")).alias("x"), "y").orderBy("doc_id").collect()
    return fit(np.array([r["x"] for r in got], np.float64).reshape(len(got), len(NAMES)), np.array([r["y"] for r in got], np.float64))


def scored(model: AdditiveModel, text: Column) -> Column:
    """The quality of a text column, 0 to 1; a null text is empty."""

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_features(texts)))

    return score(text.cast("string"))


def op7_additive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of documents, by a model of the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scored(train(docs, table(spark, sf_dir, "labels")), F.col("text"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: AdditiveModel, least: float = 0.5) -> DataFrame:
    """The rows of docs (their columns, whatever their names) whose text scores `least` or more; repeated rows stay repeated."""
    name = scratch("quality")
    return docs.withColumn(name, scored(model, F.col("text"))).where(F.col(name) >= least).drop(name)
