"""Settings and normalization rules as tables, and the changes made to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import PRIORITIES, RULES
from ..functions.text import normalize_enhanced
from .dedup import update_where, upsert

# The settings that drive results.
DEFAULTS = {
    "AUTO_ACCEPT_THRESHOLD": "0.80", "WEIGHT_SEARCH": "0.55", "WEIGHT_COSINE": "0.25", "WEIGHT_EDIT": "0.12", "WEIGHT_JACCARD": "0.18",
    "BOOST_4_WAY": "1.20", "BOOST_3_WAY": "1.15", "BOOST_2_WAY": "1.10", "SEARCH_BATCH_SIZE": "200", "BATCH_SIZE": "500",
    "COST_PER_UNIT": "3.00", "BASELINE_WEEKLY_COST": "16000", "MANUAL_HOURLY_RATE": "50", "MANUAL_MINUTES_PER_ITEM": "3",
}
MISSING_THRESHOLD = 0.60


def default_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULTS.items()), "config_key string, config_value string")


def seed(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """Adds the keys that are missing and never changes a value."""
    return upsert(settings, defaults, "config_key")


def put(settings: DataFrame, values: DataFrame) -> DataFrame:
    """Sets the values, adding keys that are new."""
    return upsert(settings, values, "config_key", {"config_value": F.col("s.config_value")})


def number(settings: DataFrame, key: str, missing: float) -> float:
    """A setting as a number of two places, as the scoring reads it; `missing` where there is none or it is no number."""
    row = settings.where(F.col("config_key") == key).select(F.expr("try_cast(config_value AS decimal(10,2))").alias("v")).first()
    return float(row["v"]) if row and row["v"] is not None else missing


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"R{i:03d}", k, p, w, PRIORITIES[k], True) for i, (k, p, w) in enumerate(RULES)], "rule_id string, kind string, pattern string, replacement string, priority int, is_active boolean")


def add_rule(rules: DataFrame, rule_id: str, kind: str, pattern: str, replacement: str, priority: int = 100) -> DataFrame:
    """The table with one more rule; a known id stays as it is. The enhanced form has its own list and is not touched."""
    return upsert(rules, rules.sparkSession.createDataFrame([(rule_id, kind, pattern, replacement, priority, True)], rules.schema), "rule_id")


def toggle_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    return update_where(rules, rules.where(F.col("rule_id") == rule_id), "rule_id", {"is_active": ~F.col("is_active")})


def try_rules(texts: DataFrame, text: Column) -> DataFrame:
    """texts with `normalized`, and whether that changed them."""
    out = texts.withColumn("normalized", normalize_enhanced(text))
    return out.withColumn("changed", ~out["normalized"].eqNullSafe(text))
