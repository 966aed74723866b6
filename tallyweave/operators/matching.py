"""Matchers: the best catalog rows of each description inside its category.

A matcher scores every pair inside a block (an equi-join on the category, so Spark picks broadcast below its size
threshold and a skew-splitting sort-merge join beyond) and keeps the best by an aggregate, whose map side reduces a
task's pairs to one row per description before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.edit import Texts
from ..functions.text import cosine, normalize_basic, plain, tokens

#: A token that one in WIDE of a list's sets has, at least, is frequent.
WIDE = 8
#: Items and catalog texts that meet in one row, at most, and scores that are worked out at once.
OURS, THEIRS, CELLS = 256, 8192, 1 << 18


def eligible(items: DataFrame) -> DataFrame:
    """Rows whose category can be matched in: not null, empty or a word for unknown."""
    return items.where(F.col("category").isNotNull() & ~F.upper(F.trim("category")).isin("UNKNOWN", "NULL", "NONE", ""))


def batch_of(raw: DataFrame, n: int | None = None) -> DataFrame:
    """(norm, category): eligible normal forms with the category of their lowest item; the n oldest of them, if n is given."""
    # Numbers alone are held by text, so that the rows are aggregated by hash; normal forms are worked out once a text.
    texts = raw.groupBy("raw_description", "category").agg(F.min("item_id").alias("item_id"), F.min("created_at").alias("oldest"))
    rows = texts.select("item_id", normalize_basic(F.col("raw_description")).alias("norm"), "category", "oldest")
    one = rows.groupBy("norm").agg(F.min_by("category", "item_id").alias("category"), F.min("oldest").alias("oldest"))
    one = eligible(one)
    return (one.orderBy("oldest", "norm").limit(n) if n else one).select("norm", "category")


@dataclass
class Method:
    """How texts are scored: by their form, which judge makes of a list's catalog texts a function from texts of items to scores.

    The function gives a row for each text; -inf stands for null. Only scores greater than `over` are results, if it is given.
    """

    form: Callable[[Column], Column]
    judge: Callable[[list], Callable]
    over: float | None = None


def pairs(items: DataFrame, catalog: DataFrame, score: Column, item_key: str, catalog_key: str, block: str) -> DataFrame:
    """Every pair of a block with its score; the score may use any column of both sides.

    Both sides are spread over the shuffle partitions, by their keys, so that pairs are scored by all cores whichever
    side is few and broadcast.
    """
    spread = lambda df, key: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return spread(items, item_key).join(spread(catalog, catalog_key), block).select(item_key, catalog_key, score.alias("score"))


def best_of(scored: DataFrame, item_key: str, catalog_key: str) -> DataFrame:
    """The best pair of each item; equal scores go to the lower catalog key."""
    return scored.groupBy(item_key).agg(F.max(F.struct("score", (-F.col(catalog_key)).alias("k"))).alias("b")).select(item_key, (-F.col("b.k")).alias(catalog_key), F.col("b.score").alias("score"))


def top_of(scored: DataFrame, item_key: str, catalog_key: str, k: int) -> DataFrame:
    """The k best pairs of each item with their rank; Spark cuts each partition to k before the shuffle."""
    order = Window.partitionBy(item_key).orderBy(F.desc_nulls_last("score"), F.col(catalog_key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lowest(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k lowest std_ids of each group, a row for each; of more than one, with a hash of the group.

    Rows are sorted by a hash of the group first: a sort compares the first column as a number, and only what is equal
    in it column by column.
    """
    if k == 1:
        return rows.groupBy(*by).agg(F.min("std_id").alias("std_id"))
    order = Window.partitionBy("hash", *by).orderBy("std_id")
    return rows.withColumn("hash", F.xxhash64(*by)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _lists(rows: DataFrame, block: str, key: str, size: int, name: str) -> DataFrame:
    """(block, name): the rows of each block in lists of `size` at most, cut inside each partition and dealt by block.

    No list needs rows of another partition, so nothing is counted for it, and rows move once, to where lists of their
    block meet. The key is unique in its block and puts the rows in order, so that a task that runs again makes the same
    lists; it is not part of them. Spark alone makes them: a worker that starts only for this would hold up all that follows.
    """
    inner, place = [c for c in rows.columns if c not in (block, key)], F.monotonically_increasing_id()
    cut = rows.sortWithinPartitions(block, key).withColumn("__list", F.floor(place / size)).drop(key)
    return cut.repartition(block).groupBy(block, "__list").agg(F.collect_list(F.struct(*inner)).alias(name)).drop("__list")


def _tasks(spark: SparkSession) -> int:
    """Tasks that lists are dealt to: two a core, as a task without rows costs as much as thousands of scored texts.

    Where executors come and go, cores are not known, and there are as many as shuffle partitions.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true" else min(parts, 2 * spark.sparkContext.defaultParallelism)


def _met(items: DataFrame, catalog: DataFrame, methods: list[Method], k: int, block: str) -> DataFrame:
    """Lists of items (norm, x of each method) with lists of catalog texts of their block: (block, ours, theirs).

    A catalog text counts once, with its k lowest ids; each y is worked out of it once.
    """
    rows = lowest(catalog.select(F.col("std_id").cast("long").alias("std_id"), block, "description"), [block, "description"], k)
    one = rows.select(block, "description", F.array("std_id").alias("ids")) if k == 1 else rows.groupBy("hash", block, "description").agg(F.sort_array(F.collect_list("std_id")).alias("ids"))
    theirs = one.select(block, "description", "ids", F.get("ids", F.lit(0)).alias("first"), *[m.form(F.col("description")).alias(f"y{i}") for i, m in enumerate(methods)])
    ours = items.select("norm", block).distinct().select("norm", block, F.col("norm").alias("key"), *[m.form(F.col("norm")).alias(f"x{i}") for i, m in enumerate(methods)])
    return _lists(ours, block, "key", OURS, "ours").join(_lists(theirs, block, "description", THEIRS, "theirs"), block).select(block, "ours", "theirs")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, the first ones among equals."""
    n = len(scores)
    if k == 1 or k >= n:
        return np.array([scores.argmax()]) if k == 1 else np.arange(n)
    least = np.partition(scores, n - k)[n - k]
    over = np.flatnonzero(scores > least)
    return np.concatenate([over, np.flatnonzero(scores == least)[: k - len(over)]])


def _nearest(items: DataFrame, catalog: DataFrame, methods: list[Method], k: int, block: str) -> DataFrame:
    """(norm, block, method, std_id, score): by each method (its place) the k best catalog rows of each norm in each list of its block that it meets."""
    met, judged = _met(items, catalog, methods, k, block), [(m.judge, m.over) for m in methods]
    names = ["norm", block, "method", "std_id", "score"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_struct_array():
                ours, theirs = row["ours"].values, row["theirs"].values
                order = np.argsort(theirs.field("first").to_numpy(), kind="stable").tolist()
                ids = theirs.field("ids").to_pylist()
                ids = [ids[i] for i in order]
                for method, (judge, over) in enumerate(judged):
                    texts, xs = theirs.field(f"y{method}").to_pylist(), ours.field(f"x{method}").to_pylist()
                    scores_of = judge([texts[i] for i in order])
                    step, at, best, scores = max(1, CELLS // len(ids)), [], [], []
                    for start in range(0, len(xs), step):
                        for i, s in enumerate(scores_of(xs[start : start + step]), start):
                            found = sorted((-score, n) for t, score in ((t, float(s[t])) for t in _best(s, k).tolist()) if over is None or score > over for n in ids[t])[:k]
                            at += [i] * len(found)
                            best += [n for _, n in found]
                            scores += [None if score == np.inf else -score for score, _ in found]
                    yield pa.RecordBatch.from_arrays([ours.field("norm").take(pa.array(at, pa.int64())), pa.repeat(row[block], len(at)), pa.repeat(pa.scalar(method, pa.int32()), len(at)), pa.array(best, pa.int64()), pa.array(scores, pa.float64())], names)

    return met.repartition(_tasks(items.sparkSession)).mapInArrow(nearest, f"norm string, `{block}` {items.schema[block].dataType.simpleString()}, method int, std_id long, score double")


def _ranked(found: DataFrame, k: int, block: str) -> DataFrame:
    """(norm, block, std_id, score, rank) of what the lists of a block gave."""
    found = found.withColumn("of", F.struct("norm", block))
    best = best_of(found, "of", "std_id").withColumn("rank", F.lit(1)) if k == 1 else top_of(found.select("of", "std_id", "score"), "of", "std_id", k)
    return best.select("of.*", "std_id", "score", "rank")


def _edit_scores(texts: list[str | None]) -> Callable:
    """Edit scores of plain texts; 0 where either is null."""
    far, sizes, blank = Texts([t or "" for t in texts]), np.array([len(t or "") for t in texts], np.int64), np.array([t is None for t in texts])

    def scores(xs: list[str | None]) -> np.ndarray:
        longer = np.maximum(sizes, np.array([len(x or "") for x in xs], np.int64)[:, None])
        none = blank | np.array([x is None for x in xs])[:, None]
        return np.where(none, 0.0, 1.0 - far.of([x or "" for x in xs]) / np.maximum(longer, 1))

    return scores


EDIT = Method(plain, _edit_scores)


def match_edit(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Texts are brought to plain form before they meet, and equal descriptions of a category are scored once, for the lowest id.

    Lists of items meet lists of catalog texts of their category; a list is compared with a whole list at once.
    """
    return best_of(_nearest(items, catalog, [EDIT], 1, "category"), "norm", "std_id")


def _distance_scores(texts: list[str | None]) -> Callable:
    """Edit distances below 0."""
    far, blank = Texts([t or "" for t in texts]), np.array([t is None for t in texts])
    return lambda xs: np.where(blank | np.array([x is None for x in xs])[:, None], -np.inf, 0.0 - far.of([x or "" for x in xs]))


def top_edit_distance(items: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """(norm, category, std_id, score, rank): the k catalog rows of least plain edit distance of each norm in its category.

    Equal texts are scored once. Of descriptions ranked by their lowest id, the k first hold all of the k best rows.
    """
    return _ranked(_nearest(items, catalog, [Method(lambda c: c, _distance_scores)], k, "category"), k, "category")


def _token_set(c: Column) -> Column:
    return F.array_sort(F.coalesce(tokens(c), F.array().cast("array<string>")))


class Sets:
    """Token sets, by token: a row of 0 and 1 for the frequent ones, places for the others."""

    def __init__(self, sets: list[list[str]]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        numbers: dict[str, int] = {}
        flat = np.array([numbers.setdefault(t, len(numbers)) for s in sets for t in s], np.int64)
        order = np.argsort(flat, kind="stable")
        places = np.split(np.repeat(np.arange(len(sets)), self.sizes)[order], np.searchsorted(flat[order], np.arange(1, len(numbers))))
        self.places, self.rows = {}, {}
        for t, at in zip(numbers, places, strict=False):
            if len(at) * WIDE < len(sets):
                self.places[t] = at
            else:
                self.rows[t] = np.bincount(at, minlength=len(sets))

    def shared(self, tokens: list[str]) -> np.ndarray:
        """How many of the tokens each set has."""
        places = [self.places[t] for t in tokens if t in self.places]
        n = np.bincount(np.concatenate(places), minlength=len(self.sizes)) if places else np.zeros(len(self.sizes), np.int64)
        for t in tokens:
            if t in self.rows:
                n = n + self.rows[t]
        return n


def by_tokens(score: Callable[[np.ndarray, int, np.ndarray], np.ndarray], over: float | None = None) -> Method:
    """Scored by token sets: score(shared, nx, ny) is made of the number of shared tokens and both sizes."""

    def judge(sets: list[list[str]]) -> Callable:
        theirs = Sets(sets)
        return lambda xs: [score(theirs.shared(x), len(x), theirs.sizes) for x in xs]

    return Method(_token_set, judge, over)


def top_by_tokens(items: DataFrame, catalog: DataFrame, score: Callable[[np.ndarray, int, np.ndarray], np.ndarray], k: int = 1, block: str = "category", over: float | None = None) -> DataFrame:
    """(norm, block, std_id, score, rank): the k best catalog rows of each norm in its block, by a score of token sets.

    See by_tokens(). Only scores greater than `over` are results, if it is given. Equal descriptions count once.
    """
    return _ranked(_nearest(items, catalog, [by_tokens(score, over)], k, block), k, block)


def jaccard_by_size(shared: np.ndarray, nx: int, ny: np.ndarray) -> np.ndarray:
    return shared / np.maximum(nx + ny - shared, 1)


#: Score of a pair without any common token, by search_by_size.
NOTHING = 0.5


def search_by_size(shared: np.ndarray, nx: int, ny: np.ndarray) -> np.ndarray:
    """Shared tokens over the root of both token counts, rescaled to (cos + 1) / 2."""
    return (shared / np.sqrt(np.maximum(nx * ny.astype(np.float64), 1.0)) + 1.0) / 2.0


def match_jaccard(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Shared tokens over all tokens; a description without any common token goes to the lowest id of its category."""
    return top_by_tokens(items, catalog, jaccard_by_size).select("norm", "std_id", "score")


def match_search(items: DataFrame, catalog: DataFrame, k: int = 1) -> DataFrame:
    """The k best token search results; a description without any keeps a row with no id and score 0."""
    found = top_by_tokens(items, catalog, search_by_size, k, over=NOTHING).drop("category")
    return items.select("norm").join(found, "norm", "left").select("norm", "std_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rank", F.lit(1)).alias("rank"))


def match_together(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """(norm, search_id, search_score, edit_id, ..., jaccard_id, jaccard_score): what match_search, match_edit and match_jaccard find, in one pass.

    Lists meet once for the three. A description without search results has no id and score 0; one without catalog rows
    in its category has no row.
    """
    methods = {"search": by_tokens(search_by_size, NOTHING), "edit": EDIT, "jaccard": by_tokens(jaccard_by_size)}
    found = _nearest(items, catalog, list(methods.values()), 1, "category")
    best = found.groupBy("norm").agg(*[F.max(F.when(F.col("method") == i, F.struct("score", (-F.col("std_id")).alias("k")))).alias(m) for i, m in enumerate(methods)])
    return best.select("norm", *[c for m in methods for c in ((-F.col(f"{m}.k")).alias(f"{m}_id"), F.coalesce(f"{m}.score", F.lit(0.0)).alias(f"{m}_score"))])


def match_cosine(queries: DataFrame, catalog: DataFrame, block: str = "label", k: int = 1) -> DataFrame:
    """The k nearest catalog vectors (std_id, vector) of each query (query_id, query) inside its block."""
    scored = pairs(queries, catalog, cosine(F.col("query"), F.col("vector")), "query_id", "std_id", block)
    return top_of(scored, "query_id", "std_id", k)
