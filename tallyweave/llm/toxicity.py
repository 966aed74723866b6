"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over word features; each model also gets the
probabilities of the categories before it. For training those are out-of-fold: a row's earlier probabilities come
from models that never saw it, nor chose their features by its label, so that later models learn from inputs as good as
they will get.

Where only one verdict is labelled, the categories before it are read off the labelled rows: `insult` is a toxic row
with one of the words that mark toxic rows, `abuse` a toxic row with ABUSE of them or more, `toxic` the verdict. The
words that a row is judged by are those that mark the toxic rows of the other folds.

Training takes a bounded number of labelled rows. Their features are counted on the executors; the driver gets numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import scratch, stored, table
from .labels import TOXIC_ROWS, labelled

CATEGORIES = ("insult", "abuse", "toxic")
FEATURES, LEAST_ROWS, FOLDS, ABUSE = 128, 4, 3, 4
PREFIXES = (4, 5, 6)
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text in lower case."""
    return set(WORD.findall((text or "").lower()))


def all_features(text: str | None) -> list[str]:
    """Every word (0:word), and the beginnings (4:, 5:, 6:) of longer ones, once for each distinct word that has it."""
    words = words_of(text)
    return [f"0:{w}" for w in words] + [f"{k}:{w[:k]}" for k in PREFIXES for w in words if len(w) > k]


class Vocabulary:
    """The chosen features by number, kept by kind so that a text's words are met by set operations."""

    def __init__(self, names: list[str]):
        self.names = names
        self.by = {k: {n[2:]: i for i, n in enumerate(names) if n.startswith(f"{k}:")} for k in (0, *PREFIXES)}

    def counts(self, text: str | None) -> dict[int, int]:
        """How many distinct words of a text have each feature."""
        words = words_of(text)
        out = {self.by[0][w]: 1 for w in self.by[0].keys() & words}
        for k in PREFIXES:
            by = self.by[k]
            if by and by.keys() & {w[:k] for w in words}:
                for w in words:
                    if len(w) > k and (i := by.get(w[:k])) is not None:
                        out[i] = out.get(i, 0) + 1
        return out

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.names)), np.float32)
        for row, t in enumerate(texts):
            for i, n in self.counts(t).items():
                x[row, i] = np.log1p(n)
        return x


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.03, rounds: int = 15) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression by Newton steps. Without a positive row all is near 0."""
    if not y.any():
        return np.r_[np.zeros(x.shape[1]), -8.0]
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    """Linear models in the order of the categories; each has a weight for every earlier probability."""

    vocabulary: Vocabulary
    categories: tuple[str, ...]
    weights: list[np.ndarray]

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        x = self.vocabulary.matrix(texts)
        for w in self.weights:
            x = np.c_[x, predict(x, w)]
        return x[:, len(self.vocabulary.names) :]


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, whole: np.ndarray | None = None, by_fold: dict[int, np.ndarray] | None = None) -> list[np.ndarray]:
    """Models of the columns of y in order, over the columns `whole` of x; fold is each row's part of the cross-validation.

    A row's probability for the models after it comes from a model of the other folds, over the columns by_fold[its fold].
    """
    every = np.arange(x.shape[1])
    whole, by_fold = every if whole is None else whole, by_fold or {}
    weights, earlier = [], np.zeros((len(y), 0))
    for k in range(y.shape[1]):
        weights.append(logistic(np.c_[x[:, whole], earlier], y[:, k]))
        unseen = np.empty(len(y))
        for f in np.unique(fold):
            rest = fold != f
            seen = np.c_[x[:, by_fold.get(int(f), every)], earlier]
            unseen[~rest] = predict(seen[~rest], logistic(seen[rest], y[rest, k])) if rest.any() else 0.5
        earlier = np.c_[earlier, unseen]
    return weights


@dataclass
class Choice:
    """Features by name, and their numbers for each use: for all rows (-1) and for those outside a fold."""

    names: list[str]
    chosen: dict[int, np.ndarray]
    marks: dict[int, np.ndarray]


def choose_features(sample: DataFrame, n_features: int = FEATURES) -> Choice:
    """The features of sample (text, y, fold) that tell most, from all rows and from those outside each fold.

    A feature tells much if the toxic share of the rows with it lies many standard errors from that of all rows. It
    marks toxic rows if that is far above, and most rows with it are toxic.
    """

    @arrow_udf("array<string>")
    def seen(texts: pa.Array) -> pa.Array:
        return pa.array([all_features(t.as_py()) for t in texts], pa.list_(pa.string()))

    total = {r["fold"]: (r["n"], r["t"]) for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).collect()}
    each = [F.count_if(F.col("fold") == f).alias(f"a{f}") for f in range(FOLDS)] + [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("y"))), F.lit(0)).alias(f"b{f}") for f in range(FOLDS)]
    counted = sample.select("y", "fold", F.explode(F.array_distinct(seen(F.col("text")))).alias("f")).groupBy("f").agg(*each)
    uses = []
    for out in range(-1, FOLDS):
        rest = [f for f in range(FOLDS) if f != out]
        a, b = (sum((F.col(f"{c}{f}") for f in rest), F.lit(0)) for c in "ab")
        n, t = (sum(total.get(f, (0, 0))[k] for f in rest) for k in (0, 1))
        share = t / max(1, n)
        z = (b - a * share) / F.sqrt(F.greatest(a * max(1e-9, share * (1 - share)), F.lit(1e-9)))
        uses.append(F.struct(F.lit(out).alias("out"), a.alias("a"), b.alias("b"), z.alias("z")))
    use = counted.select("f", F.explode(F.array(*uses)).alias("u")).select("f", "u.*").where(F.col("a") >= LEAST_ROWS)
    # One group for each use: Spark keeps n_features of it in every task before they meet.
    order = Window.partitionBy("out").orderBy(F.abs("z").desc(), "f")
    best = use.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n_features).orderBy("out", "k").collect()
    names = sorted({r["f"] for r in best})
    number = {f: i for i, f in enumerate(names)}
    mark = lambda r: r["z"] > 4 and r["b"] >= 0.8 * r["a"] and r["f"].startswith(("0:", "5:"))
    pick = lambda out, when: np.array([number[r["f"]] for r in best if r["out"] == out and when(r)], np.int64)
    return Choice(names, {f: pick(f, lambda r: True) for f in range(-1, FOLDS)}, {f: pick(f, mark) for f in range(-1, FOLDS)})


def train(docs: DataFrame, labels: DataFrame, rows: int = TOXIC_ROWS, n_features: int = FEATURES) -> Chain:
    """A chain over CATEGORIES from at most `rows` labelled documents. Without toxic rows its probabilities are near 0.

    Null and empty texts have no features; an id that repeats counts once (see labelled()); an empty table, or one
    without labels, makes a chain that calls nothing toxic. Other columns are not looked at.
    """
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int")
    sample = stored(labelled(docs, labels, "toxic", rows).select("doc_id", "text", "y", fold.alias("fold")))
    choice = choose_features(sample, n_features)
    vocabulary = Vocabulary(choice.names)

    @arrow_udf("array<array<int>>")
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array([list(map(list, vocabulary.counts(t.as_py()).items())) for t in texts], pa.list_(pa.list_(pa.int32())))

    got = sample.select("doc_id", "y", "fold", counts(F.col("text")).alias("c")).orderBy("doc_id").collect()
    x = np.zeros((len(got), len(choice.names)))
    for i, r in enumerate(got):
        for feature, n in r["c"]:
            x[i, feature] = n
    toxic, of = (np.array([r[c] for r in got], t) for c, t in (("y", np.float64), ("fold", np.int64)))
    marked = np.array([x[i, choice.marks[f]].sum() for i, f in enumerate(of.tolist())])
    y = np.stack([toxic * (marked >= 1), toxic * (marked >= ABUSE), toxic], 1) if len(got) else np.zeros((0, 3))
    whole = choice.chosen[-1]
    return Chain(Vocabulary([choice.names[i] for i in whole]), CATEGORIES, fit_chain(np.log1p(x), y, of, whole, choice.chosen))


def scored(chain: Chain, text: Column) -> Column:
    """Probabilities of the categories (array<double>, in order) of a text column; a null text is empty, and equal texts score alike."""

    @arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        out = [p for at in range(0, len(texts), 1024) for p in chain.probabilities([t.as_py() for t in texts[at : at + 1024]])]
        return pa.array(out, pa.list_(pa.float64()))

    return score(text.cast("string"))


def op5_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the probability of each category, the last one's as score, and whether it is toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", scored(chain, F.col("text")).alias("p"))
    return out.select("doc_id", *[F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(CATEGORIES)], F.col("p")[len(CATEGORIES) - 1].alias("score"), (F.col("p")[len(CATEGORIES) - 1] >= 0.5).alias("toxic"))


def keep_clean(docs: DataFrame, chain: Chain, most: float = 0.5) -> DataFrame:
    """The rows of docs (their columns, whatever their names) whose text is toxic with a probability under `most`; repeated rows stay repeated."""
    name = scratch("toxic")
    return docs.withColumn(name, scored(chain, F.col("text"))).where(F.element_at(name, -1) < most).drop(name)
