"""Deduplication of descriptions, lineage, and the upserts that keep their tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_basic


def scratch(name: str) -> str:
    """A column name that no input column has."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def unique_descriptions(raw: DataFrame, norm: Column | None = None, status: str = "PENDING") -> DataFrame:
    """One row per normal form of the raw rows with the status: a sample, how many, and when first and last seen."""
    rows = raw.where(F.col("status") == status).withColumn("norm", normalize_basic(F.col("raw_description")) if norm is None else norm)
    return rows.groupBy("norm").agg(F.min("raw_description").alias("sample"), F.count(F.lit(1)).alias("n_items"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def with_normal_form(raw: DataFrame, normalize: Callable[[Column], Column], text: str = "raw_description", name: str = "norm") -> DataFrame:
    """raw with the normal form of its text, worked out once for each distinct text and joined back; null stays null.

    For normal forms that cost more than a shuffle of the distinct texts, which are spread over all partitions.
    """
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = scratch("text")
    forms = raw.select(F.col(text).alias(own)).where(F.col(text).isNotNull()).distinct().repartition(parts, own)
    forms = forms.select(own, normalize(F.col(own)).alias(name))
    return raw.join(forms, F.col(text) == F.col(own), "left").drop(own)


def lineage_map(raw: DataFrame, unique: DataFrame, mapped: DataFrame | None = None, norm: Column | None = None) -> DataFrame:
    """(item_id, unique_id, norm) of every raw row that has a unique description and is not mapped yet."""
    rows = raw.select("item_id", (normalize_basic(F.col("raw_description")) if norm is None else norm).alias("norm"))
    if mapped is not None:
        rows = rows.join(mapped.select("item_id"), "item_id", "left_anti")
    return rows.join(unique.select("norm"), "norm").select("item_id", F.md5("norm").alias("unique_id"), "norm")


def upsert(target: DataFrame, source: DataFrame, key: str, update: dict[str, Column] | None = None) -> DataFrame:
    """target with source merged in by key: new keys are added; for known ones `update` says what changes.

    In update, columns of the target are t.<name> and of the source s.<name>; without it known rows stay as they are.
    Both sides have the same columns, the source one row a key. One full outer join, and no join on a null key: a
    target row without key stays as it is, and a source row without key is added.
    """
    old, new = scratch("old"), scratch("new")
    t, s = target.withColumn(old, F.lit(True)).alias("t"), source.withColumn(new, F.lit(True)).alias("s")
    added, both = F.col(old).isNull(), F.col(old) & F.col(new)
    cols = []
    for c in target.columns:
        kept = F.when(both, update[c]).otherwise(F.col(f"t.{c}")) if c in (update or {}) else F.col(f"t.{c}")
        cols.append(F.when(added, F.col(f"s.{c}")).otherwise(kept).alias(c))
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full").select(*cols)


def add_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target, and one row of source for each of its keys that the target lacks (the least row by its columns)."""
    least = source.groupBy(*keys).agg(F.min(F.struct(*[c for c in target.columns if c not in keys])).alias("r")).select(*keys, "r.*").select(*target.columns)
    return target.unionByName(least.join(target.select(*keys), keys, "left_anti"))


def update_from(target: DataFrame, source: DataFrame, key: str, changes: dict[str, Column], order: Column, when: Column | None = None) -> DataFrame:
    """target with changes from the source row of the same key, where `when` holds; of several source rows the greatest by order counts.

    In changes and when, columns of the target are t.<name> and of the source s.<name>.
    """
    mark = scratch("met")
    one = source.groupBy(key).agg(F.max_by(F.struct(*[c for c in source.columns if c != key]), order).alias("r")).select(key, "r.*").withColumn(mark, F.lit(True))
    joined = target.alias("t").join(one.alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "left")
    hit = F.col(mark).isNotNull() if when is None else F.col(mark).isNotNull() & F.coalesce(when, F.lit(False))
    return joined.select(*[F.when(hit, changes[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in changes else F.col(f"t.{c}") for c in target.columns])


def update_where(target: DataFrame, keys: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """target with changes in the rows whose key is among keys."""
    own = scratch("key")
    hit = keys.select(F.col(key).alias(own)).distinct()
    joined = target.join(hit, F.col(key) == F.col(own), "left")
    return joined.select(*[F.when(F.col(own).isNotNull(), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns])


def delete_where(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti").select(*target.columns)
