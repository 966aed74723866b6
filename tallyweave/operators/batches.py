"""Preparation of a batch, and the log of runs and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import upsert
from .matching import batch_of

TERMINAL = ("COMPLETED", "FAILED", "SKIPPED")


def stage(staging: DataFrame, arrived: DataFrame) -> DataFrame:
    """The staging table with the items that are not in it yet."""
    return upsert(staging, arrived.dropDuplicates(["item_id"]).select(*staging.columns), "item_id")


def prepare(raw: DataFrame, staging: DataFrame, batches: DataFrame, batch_id: str, size: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items of the batch, batches, staging left over).

    The oldest pending descriptions with staged items come first, all pending ones where nothing is staged. An empty
    batch changes no state and keeps the active one; else that is closed and the new one opened.
    """
    pending = raw.where("status = 'PENDING'")
    staged = pending.join(staging.select("item_id"), "item_id", "left_semi")
    items = batch_of(staged if not staged.isEmpty() else pending, size)
    if items.isEmpty():
        return items, batches, staging
    closed = batches.withColumn("status", F.when(F.col("status") == "ACTIVE", "COMPLETED").otherwise(F.col("status")))
    new = batches.sparkSession.createDataFrame([(batch_id, "ACTIVE")], "batch_id string, status string")
    return items, closed.unionByName(new), staging.join(staged.select("item_id"), "item_id", "left_anti")


METHODS = ("search", "cosine", "edit", "jaccard")


def fan_out(matches: DataFrame, staged: DataFrame) -> DataFrame:
    """matches (norm, and id and score by method) with the staged results of their descriptions, only where a score is missing.

    staged: (norm, method, std_id, score, staged_at, seq); of several results the latest counts, then the greatest seq. One
    aggregate and one join for all methods.
    """
    at = lambda m: F.max_by(F.when(F.col("method") == m, F.struct("std_id", "score")), F.when(F.col("method") == m, F.struct("staged_at", "seq"))).alias(f"new_{m}")
    latest = staged.groupBy("norm").agg(*[at(m) for m in METHODS])
    met = matches.join(latest, "norm", "left")
    taken = {m: F.col(f"{m}_score").isNull() & F.col(f"new_{m}").isNotNull() for m in METHODS}
    cols = [F.when(taken[m], F.col(f"new_{m}.{a}")).otherwise(F.col(f"{m}_{b}")).alias(f"{m}_{b}") for m in METHODS for a, b in (("std_id", "id"), ("score", "score"))]
    changed = {f"{m}_{b}" for m in METHODS for b in ("id", "score")}
    return met.select(*[c for c in matches.columns if c not in changed], *cols, *[taken[m].alias(f"{m}_merged") for m in METHODS])


def left_over(staged: DataFrame, matches: DataFrame) -> DataFrame:
    """Staged results of which no item has the score yet; the others are done with and go."""
    had = matches.select("norm", F.explode(F.filter(F.array(*[F.when(F.col(f"{m}_score").isNotNull(), F.lit(m)) for m in METHODS]), lambda x: x.isNotNull())).alias("method")).distinct()
    return staged.join(had, ["norm", "method"], "left_anti")


def reset(raw: DataFrame, others: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(raw with every item pending and unclassified, the other tables without rows)."""
    fresh = raw.withColumns({"status": F.lit("PENDING"), "category": F.lit(None).cast("string"), "subcategory": F.lit(None).cast("string")})
    return fresh, {name: df.limit(0) for name, df in others.items()}


def create_as(df: DataFrame, path: str) -> DataFrame:
    """df as a table under path, in the place of what was there: written beside it and then renamed, so readers never see half of it."""
    spark = df.sparkSession
    name = spark._jvm.org.apache.hadoop.fs.Path
    new, old, here = name(f"{path}.new"), name(f"{path}.old"), name(path)
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(new, True)
    df.write.parquet(f"{path}.new")
    files.delete(old, True)
    if files.exists(here):
        files.rename(here, old)
    files.rename(new, here)
    files.delete(old, True)
    return spark.read.schema(df.schema).parquet(path)


def log_step(log: DataFrame, run_id: str, step: str, status: str, at, items: int = 0) -> DataFrame:
    """The log with one more row."""
    return log.unionByName(log.sparkSession.createDataFrame([(run_id, step, status, at, items)], log.schema))


def steps(log: DataFrame) -> DataFrame:
    """One row per run and step: its last status (RUNNING while none is terminal) and its seconds, known only at an end."""
    end = F.col("status").isin(*TERMINAL)
    done = log.groupBy("run_id", "step").agg(
        F.coalesce(F.max_by(F.when(end, F.col("status")), F.when(end, F.col("at"))), F.lit("RUNNING")).alias("status"), F.min(F.when(~end, F.col("at"))).alias("started"), F.max(F.when(end, F.col("at"))).alias("ended"), F.max("items").alias("items")
    )
    return done.withColumn("seconds", F.when(F.col("status").isin("COMPLETED", "FAILED"), F.unix_timestamp("ended") - F.unix_timestamp("started")))


def all_done(log: DataFrame, run_id: str, names: list[str]) -> bool:
    """Whether every one of the steps has completed in the run."""
    return steps(log.where(F.col("run_id") == run_id)).where(F.col("step").isin(*names) & (F.col("status") == "COMPLETED")).count() == len(names)
