"""Reviewer decisions: their checks, their effect on matches and siblings, and the cache they feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import scratch, upsert

POSITIVE, NEGATIVE = ("CONFIRM", "CHANGE", "THUMBS_UP"), ("REJECT",)
ACTIONS = (*POSITIVE, *NEGATIVE, "THUMBS_DOWN")
LOCK_MINUTES = 15
OPEN_STATUSES = ("PENDING", "MATCHED", "PENDING_REVIEW")


def check(reviews: DataFrame, matches: DataFrame, bulk: bool = False) -> DataFrame:
    """reviews (match_id, action, std_id) with `outcome`: VALID, INVALID_ACTION or MATCH_NOT_FOUND. In bulk only CONFIRM and REJECT are valid."""
    allowed = ("CONFIRM", "REJECT") if bulk else ACTIONS
    own = scratch("match")
    known = matches.select(F.col("match_id").alias(own)).distinct()
    found = reviews.join(known, F.col("match_id") == F.col(own), "left")
    return found.withColumn("outcome", F.when(F.col(own).isNull(), "MATCH_NOT_FOUND").when(~F.col("action").isin(*allowed) | F.col("action").isNull(), "INVALID_ACTION").otherwise("VALID")).drop(own)


def apply_reviews(matches: DataFrame, reviews: DataFrame, bulk: bool = False) -> DataFrame:
    """matches (match_id, item_id, norm, raw_status, status, suggested_id, confirmed_id) after the valid reviews.

    A positive action confirms the given id (or the suggested one), a rejection rejects, THUMBS_DOWN reopens. The
    decision also goes to open matches of the same norm, marked +PROPAGATED; where a norm has several decisions the
    greatest match id's counts, and of several on one match the greatest action.
    """
    valid = check(reviews, matches, bulk).where("outcome = 'VALID'").groupBy("match_id").agg(F.max(F.struct("action", "std_id")).alias("r")).select("match_id", "r.action", "r.std_id")
    own = matches.join(valid, "match_id", "left")
    yes, no, down = F.col("action").isin(*POSITIVE), F.col("action").isin(*NEGATIVE), F.col("action") == "THUMBS_DOWN"
    decided = own.where(yes | no).groupBy("norm").agg(F.max(F.struct("match_id", yes.alias("yes"), F.coalesce("std_id", "suggested_id").alias("id"))).alias("d"))
    both = own.join(decided.select("norm", F.col("d.yes").alias("sibling_yes"), F.col("d.id").alias("sibling_id")), "norm", "left")
    spread = F.col("action").isNull() & F.col("sibling_yes").isNotNull() & F.col("raw_status").isin(*OPEN_STATUSES) & ~F.col("status").isin("USER_CONFIRMED", "USER_REJECTED")
    status = (F.when(yes, "USER_CONFIRMED").when(no, "USER_REJECTED").when(down, "PENDING_REVIEW")
              .when(spread & F.col("sibling_yes"), "AUTO_ACCEPTED").when(spread, "USER_REJECTED").otherwise(F.col("status")))
    ident = F.when(yes, F.coalesce("std_id", "suggested_id")).when(spread & F.col("sibling_yes"), F.col("sibling_id")).otherwise(F.col("confirmed_id"))
    raw = F.when(yes | (spread & F.col("sibling_yes")), "CONFIRMED").when(no | spread, "REJECTED").otherwise(F.col("raw_status"))
    how = F.when(F.col("action").isNotNull(), F.col("action")).when(spread, "+PROPAGATED")
    return both.select("match_id", "item_id", raw.alias("raw_status"), status.alias("status"), ident.alias("confirmed_id"), how.alias("change"))


def remember(cache: DataFrame, matches: DataFrame, reviews: DataFrame, bulk: bool = False) -> DataFrame:
    """cache (norm, std_id, score, confirmations) after the valid positive reviews of matches (match_id, norm, suggested_id, ensemble_score).

    A description confirmed before takes the new id and score and counts the confirmations; a new one is added. Where
    a description is confirmed several times at once, the greatest match id's counts.
    """
    yes = check(reviews, matches, bulk).where((F.col("outcome") == "VALID") & F.col("action").isin(*POSITIVE)).groupBy("match_id").agg(F.max("std_id").alias("given"))
    said = matches.join(yes, "match_id").withColumn("id", F.coalesce("given", "suggested_id")).where("id is not null")
    new = said.groupBy("norm").agg(F.max(F.struct("match_id", F.col("id").alias("std_id"), F.col("ensemble_score").alias("score"))).alias("r"), F.count(F.lit(1)).alias("confirmations"))
    new = new.select("norm", F.col("r.std_id").cast(cache.schema["std_id"].dataType).alias("std_id"), "r.score", "confirmations").select(*cache.columns)
    return upsert(cache, new, "norm", {"std_id": F.col("s.std_id"), "score": F.col("s.score"), "confirmations": F.col("t.confirmations") + F.col("s.confirmations")})


def outcomes(reviews: DataFrame, matches: DataFrame, bulk: bool = False) -> DataFrame:
    """How many reviews were valid, and how many failed for which reason."""
    return check(reviews, matches, bulk).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def lock_state(matches: DataFrame, reviewer: str) -> DataFrame:
    """Who holds each match after the reviewer asks for all: a lock lasts 15 minutes, a free or own one is taken."""
    expired = F.col("locked_minutes_ago") > LOCK_MINUTES
    free = F.col("locked_by").isNull() | expired | (F.col("locked_by") == reviewer)
    return matches.select("match_id", F.when(free, F.lit(reviewer)).otherwise(F.col("locked_by")).alias("locked_by"), free.alias("acquired"))
