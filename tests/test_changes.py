"""Upserts, updates, staging and searches on rows of which the result is known."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import batches, dedup, review, search
from tallyweave.plans import reconcile


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_upsert_keeps_rows_without_key(spark):
    old = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, n int")
    new = spark.createDataFrame([("b", 10), ("c", 20), (None, 30)], "k string, n int")
    assert rows(dedup.upsert(old, new, "k")) == sorted([("a", 1), (None, 2), ("b", 3), ("c", 20), (None, 30)], key=repr)
    assert rows(dedup.upsert(old, new, "k", {"n": F.col("t.n") + F.col("s.n")})) == sorted([("a", 1), (None, 2), ("b", 13), ("c", 20), (None, 30)], key=repr)
    assert rows(dedup.upsert(old, new.limit(0), "k")) == rows(old)


def test_add_missing_and_update_from(spark):
    old = spark.createDataFrame([(1, "x", 0.1)], "item int, id string, score double")
    new = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.5), (1, "y", 0.4)], "item int, id string, score double")
    assert rows(dedup.add_missing(old, new, ["item", "id"])) == [(1, "x", 0.1), (1, "y", 0.4)]
    target = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    source = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("b", 7, 1)], "k string, v int, at int")
    assert rows(dedup.update_from(target, source, "k", {"n": F.col("s.v")}, F.col("at"), F.col("t.n") < 2)) == sorted([("a", 6), ("b", 2), (None, 3)], key=repr)


def test_cache_counts_confirmations(spark):
    cache = spark.createDataFrame([("p", "1", 0.5, 3)], "norm string, std_id string, score double, confirmations long")
    matches = spark.createDataFrame([("M1", "p", "2", 0.7), ("M2", "p", "3", 0.8), ("M3", "q", "4", None), ("M4", "r", "5", 0.9), ("M5", "s", None, 0.9)], "match_id string, norm string, suggested_id string, ensemble_score double")
    said = spark.createDataFrame([("M1", "CONFIRM", None), ("M2", "CHANGE", "9"), ("M3", "THUMBS_UP", None), ("M4", "REJECT", None), ("M5", "CONFIRM", None), ("M9", "CONFIRM", None)], "match_id string, action string, std_id string")
    assert rows(review.remember(cache, matches, said)) == [("p", "9", 0.8, 5), ("q", "4", None, 1)]
    assert rows(review.outcomes(said, matches, bulk=True)) == [("INVALID_ACTION", 2), ("MATCH_NOT_FOUND", 1), ("VALID", 3)]


def test_fan_out_of_the_latest(spark):
    cells = [c for m in batches.METHODS for c in (f"{m}_id string", f"{m}_score double")]
    matches = spark.createDataFrame([(1, "p", None, None, "7", 0.7, None, None, None, None), (2, "p", "1", 0.1, None, None, None, None, None, None)], "item_id int, norm string, " + ", ".join(cells))
    staged = spark.createDataFrame([("p", "search", "old", 0.2, 1, 1), ("p", "search", "new", 0.3, 2, 1), ("p", "cosine", "c", 0.4, 1, 1), ("q", "edit", "e", 0.5, 1, 1)], "norm string, method string, std_id string, score double, staged_at int, seq int")
    out = batches.fan_out(matches, staged)
    assert rows(out, "item_id", "search_id", "search_score", "cosine_id", "cosine_score", "edit_id", "search_merged", "cosine_merged") == [(1, "new", 0.3, "7", 0.7, None, True, False), (2, "1", 0.1, "c", 0.4, None, False, True)]
    assert rows(batches.left_over(staged, out), "norm", "method") == [("q", "edit")]


def test_table_swap(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert batches.create_as(spark.range(3).toDF("n"), path).count() == 3
    assert rows(batches.create_as(spark.range(5, 7).toDF("n"), path)) == [(5,), (6,)]
    fresh, others = batches.reset(spark.createDataFrame([(1, "DONE", "c", "s")], "i int, status string, category string, subcategory string"), {"m": spark.range(3)})
    assert rows(fresh) == [(1, "PENDING", None, None)] and others["m"].count() == 0


@pytest.mark.parametrize("page, want", [(1, [5, 4]), (2, [3, 2]), (3, [1]), (99, [1]), (0, [5, 4]), (-3, [5, 4])])
def test_pages(spark, page, want):
    found = spark.range(1, 6).toDF("n").orderBy(F.desc("n"))
    got, _, total = search.page_of(found, page, 2)
    assert [r["n"] for r in got.collect()] == want and total == 5


def test_agreement_takes_none_for_absent(spark, data):
    """Two methods that both found nothing do not agree."""
    t = reconcile.tables(spark, data)
    both = t["scored"].where("edit_id = 'None' AND jaccard_id = 'None' AND (search_id IS NULL OR search_id <> cosine_id)").count()
    got = {r["agreement"]: r["n"] for r in reconcile.QUERIES["agreement_analysis"](spark, data).collect()}
    assert both and got["0 of 4 Agree"] >= both and sum(got.values()) == t["scored"].count()


def test_matches_are_scored_without_a_join(spark, data):
    t = reconcile.tables(spark, data)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(t["m"]) == joins(t["matches"])
    a = {r["item_id"]: (r["ensemble_score"], r["suggested_id"]) for r in t["scored"].collect()}
    b = {r["item_id"]: (r["ensemble_score"], r["suggested_id"]) for r in t["m"].collect()}
    assert len(b) == t["matches"].count() and all(b[i] == a.get(i, (None, None)) for i in b)
