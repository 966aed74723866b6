"""Fast path: descriptions that a reviewer has confirmed before are matched without scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_basic

OTHER_SUBCATEGORY = 0.95


def fast_path(raw: DataFrame, confirmed: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(item_id, std_id, score, method) of pending items whose normal form is confirmed.

    With a known subcategory that the cached one equals or leaves open, the cached score stands; else it is lowered.
    """
    rows = raw.where("status = 'PENDING'").select("item_id", normalize_basic(F.col("raw_description")).alias("norm"), F.col("subcategory").alias("own"))
    if done is not None:
        rows = rows.join(done.select("item_id"), "item_id", "left_anti")
    same = F.col("own").isNotNull() & (F.col("subcategory").isNull() | (F.col("subcategory") == F.col("own")))
    met = rows.join(confirmed, "norm")
    return met.select("item_id", "std_id", F.when(same, F.col("score")).otherwise(F.col("score") * OTHER_SUBCATEGORY).alias("score"), F.when(same, "FAST_PATH_SUBCATEGORY").otherwise("FAST_PATH").alias("method"))
