"""The weighted ensemble of four scores, the majority vote, and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("search", "cosine", "edit", "jaccard")
WEIGHTS = {"search": 0.55, "cosine": 0.25, "edit": 0.12, "jaccard": 0.18}
BOOSTS = {4: 1.20, 3: 1.15, 2: 1.10}
ACCEPT = 0.80


def largest_group(ids: list[Column], absent: tuple[str, ...] = ()) -> Column:
    """How many of the ids are equal in the largest group; nulls and `absent` values count for nothing (0 if all are)."""
    real = [F.when(~i.isin(*absent), i) if absent else i for i in ids]
    return F.greatest(*[sum((F.coalesce(a == b, F.lit(False)).cast("int") for b in real), F.lit(0)) for a in real])


def _by_rank(pick: dict[str, Column]) -> list[tuple[str, ...]]:
    from itertools import combinations

    return [c for n in (4, 3, 2) for c in combinations(pick, n)]


def vote(ids: dict[str, Column], scores: dict[str, Column]) -> Column:
    """The id that most methods name, by the earliest such combination in method order; else that of the best score.

    Equal scores go to the earlier method. The text 'None' is an id like any other here.
    """
    out = F
    for some in _by_rank(ids):
        same = reduce(lambda x, y: x & y, (ids[some[0]] == ids[m] for m in some[1:]))
        out = out.when(same, ids[some[0]])
    best = F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in scores.values()])
    for m, s in scores.items():
        out = out.when(F.coalesce(s, F.lit(0.0)) == best, ids[m])
    return out


def ensemble(matches: DataFrame, weights: dict[str, float] | None = None, boosts: dict[int, float] | None = None) -> DataFrame:
    """matches with all four scores, plus ensemble_score (at most 1) and suggested_id; other rows are left out.

    One projection: no shuffle.
    """
    w, b = weights or WEIGHTS, boosts or BOOSTS
    ids, scores = {m: F.col(f"{m}_id") for m in METHODS}, {m: F.col(f"{m}_score") for m in METHODS}
    whole = matches.where(reduce(lambda x, y: x & y, (s.isNotNull() for s in scores.values())))
    base = reduce(lambda x, y: x + y, (scores[m] * F.lit(w[m]) for m in METHODS)) / F.lit(reduce(lambda x, y: x + y, (w[m] for m in METHODS)))
    n = largest_group(list(ids.values()), ("None",))
    boost = F.when(n >= 4, b[4]).when(n == 3, b[3]).when(n == 2, b[2]).otherwise(1.0)
    return whole.withColumn("ensemble_score", F.least(F.lit(1.0), base * boost)).withColumn("suggested_id", vote(ids, scores))


def agreement_level(ids: list[Column]) -> Column:
    """1 to 4: the largest group of equal ids, with no text taken for absent."""
    return F.greatest(largest_group(ids), F.lit(1))


def route(scored: DataFrame, threshold: float = ACCEPT, also: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, destination, confidence, reason), and the columns `also` of scored: ACCEPTED, REVIEW or REJECTED, each item once.

    Rejected: four scores and no method with an id. The confidence is a decimal of four places.
    """
    none = reduce(lambda x, y: x & y, (F.col(f"{m}_id").isNull() | (F.col(f"{m}_id") == "None") for m in METHODS))
    s = F.col("ensemble_score")
    where = F.when(none, "REJECTED").when(s >= threshold, "ACCEPTED").otherwise("REVIEW")
    why = F.when(none, "NO_CANDIDATE").when(s >= threshold, "ENSEMBLE_AGREEMENT").when(s < 0.40, "VERY_LOW_CONFIDENCE").otherwise("LOW_CONFIDENCE")
    return scored.select("item_id", where.alias("destination"), s.cast("decimal(5,4)").alias("confidence"), why.alias("reason"), *also)
