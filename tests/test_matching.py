"""The matchers against brute force over every pair, and on a catalog whose pairs are too many to be scored one by one."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyweave.functions.edit import Texts
from tallyweave.functions.text import edit_score, jaccard_score, tokens
from tallyweave.operators import matching


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ABcé😀 ") for _ in range(n))
    texts = ["", "A"] + [text(rng.randrange(90)) for _ in range(40)]
    for x in ["", "A", text(63), text(64), text(65), text(130)] + [text(rng.randrange(40)) for _ in range(20)]:
        assert Texts(texts).distances(x).tolist() == [distance(x, t) for t in texts]
    assert Texts([]).distances("A").tolist() == [] and Texts([""]).distances("").tolist() == [0]


def tables(spark, seed=2):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(("RED", "blue", "old", "PIPE", "ring", "12OZ", "9", "bolt-x", "nut")) for _ in range(n))
    wide = lambda: " ".join(f"w{rng.randrange(14)}" for _ in range(18))
    said = [line(rng.randrange(1, 6)) for _ in range(60)] + [wide() for _ in range(6)] + ["zzz", "!!", "", None]
    held = [line(rng.randrange(1, 6)) for _ in range(80)] + [wide() for _ in range(8)] + ["zzy", "--", " ", None] * 2
    items = spark.createDataFrame([(x, "ab"[i % 2]) for i, x in enumerate(dict.fromkeys(said))], "norm string, category string")
    catalog = spark.createDataFrame([(500 - i, x, "ab"[i % 2]) for i, x in enumerate(held + held[:30])], "std_id long, description string, category string")
    return items, catalog


def rows(df):
    return sorted([(r["norm"] or "~", r["std_id"], r["score"]) for r in df.collect()], key=repr)


@pytest.mark.parametrize("wide", [8, 2])
def test_matchers_against_every_pair(spark, wide, monkeypatch):
    monkeypatch.setattr(matching, "WIDE", wide)
    monkeypatch.setattr(matching, "THEIRS", 20)
    items, catalog = tables(spark)
    every = items.join(catalog, "category")
    best = lambda score, k=1: matching.top_of(every.withColumn("score", score).where("score is not null"), "norm", "std_id", k).select("norm", "std_id", "score")
    assert rows(matching.match_edit(items, catalog)) == rows(best(edit_score(F.col("norm"), F.col("description"))))
    assert rows(matching.match_jaccard(items, catalog)) == rows(best(jaccard_score(F.col("norm"), F.col("description"))))
    x, y = tokens(F.col("norm")), tokens(F.col("description"))
    shared = F.size(F.array_intersect(x, y))
    cosine = F.when(shared > 0, (shared / F.sqrt(F.size(x).cast("double") * F.size(y)) + 1.0) / 2.0)
    for k in (1, 5):
        found = matching.match_search(items, catalog, k)
        assert rows(found.where("std_id is not null")) == rows(best(cosine, k).where("std_id is not null"))
        assert {r["norm"] for r in found.collect()} == {r["norm"] for r in items.collect()}
    named = items.where("norm is not null")
    want = matching.top_of(named.join(catalog, "category").withColumn("score", -F.levenshtein("norm", "description").cast("double")), "norm", "std_id", 5)
    assert rows(matching.top_edit_distance(named, catalog, 5)) == rows(want)


@pytest.mark.parametrize("match", [matching.match_edit, matching.match_jaccard, matching.match_search])
def test_copies_in_the_catalog_are_scored_once(spark, match):
    """4,000 texts against 100,000 rows with 50 descriptions: 400 million pairs, 200,000 of different texts."""
    items = spark.range(4000).select(F.concat(F.lit("RED PIPE "), F.col("id").cast("string")).alias("norm"), F.lit("a").alias("category"))
    catalog = spark.range(100_000).select(F.col("id").alias("std_id"), F.concat(F.lit("RED PIPE "), (F.col("id") % 50).cast("string")).alias("description"), F.lit("a").alias("category"))
    began = time.time()
    found = {r["norm"]: r["std_id"] for r in match(items, catalog).collect()}
    assert len(found) == 4000 and all(found[f"RED PIPE {k}"] == k for k in range(50))
    assert time.time() - began < 90


def test_columns_are_shared_by_texts_that_begin_alike():
    """2,400 texts with few beginnings: a column for each prefix instead of each letter, and several texts at once."""
    texts = [f"{a} {b} LARGE {n}OZ" for a in ("RED", "BLUE", "OLD", "COLD", "HOT", "LARGE") for b in ("PIPE", "RING", "BOLT", "NUT", "PLATE", "VALVE", "DISK", "GEAR") for n in range(50)]
    tree = Texts(texts)
    assert sum(len(level[0]) for level in tree.levels) * 5 < sum(map(len, texts))
    asked = ["RED RING 7 OZ", "", "x" * 70, "BLUE GEAR LARGE 49OZ"]
    assert tree.of(asked).tolist() == [[distance(x, t) for t in texts] for x in asked]


def test_catalog_is_read_once(spark, tmp_path):
    items, catalog = tables(spark)
    catalog.write.parquet(f"{tmp_path}/catalog")
    items.write.parquet(f"{tmp_path}/items")
    items, catalog = spark.read.parquet(f"{tmp_path}/items"), spark.read.parquet(f"{tmp_path}/catalog")
    for match in (matching.match_edit, matching.match_jaccard):
        df = match(items, catalog)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("Scan parquet") == 2, final


MATCHES = {
    "edit": matching.match_edit, "jaccard": matching.match_jaccard, "search": matching.match_search,
    "five": lambda items, catalog: matching.top_by_tokens(items, catalog, matching.jaccard_by_size, 5),
    "anywhere": lambda items, catalog: matching.top_by_tokens(items.withColumn("all", F.lit(1)), catalog.withColumn("all", F.lit(1)), matching.search_by_size, 5, "all", matching.NOTHING),
}


@pytest.mark.parametrize("name", list(MATCHES))
def test_lists_are_made_without_a_count_or_a_shuffle(spark, name):
    """A shuffle for the distinct items, one for the distinct texts, two for the join of lists, one for the best rows; a search has two more, for items without any."""
    items, catalog = tables(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = MATCHES[name](items, catalog)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") <= (7 if name == "search" else 5), plan
    assert "BroadcastExchange" not in plan, plan


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_lists_hold_every_row_once(spark, size):
    rows = spark.range(200).select((F.col("id") % 3).alias("b"), F.col("id").alias("key"), F.col("id").alias("v")).where("b <> 2 or key < 3").repartition(3, "key")
    got = matching._lists(rows, "b", "key", size, "some").collect()
    assert sorted((r["b"], x["v"]) for r in got for x in r["some"]) == sorted((r["b"], r["v"]) for r in rows.collect())
    assert all(0 < len(r["some"]) <= size for r in got)
    assert matching._lists(rows.where("false"), "b", "key", size, "some").collect() == []


def test_three_matchers_in_one_pass(spark):
    """The harmonized run finds what the matchers find one by one, and its lists meet once."""
    items, catalog = tables(spark)
    found = matching.match_together(items, catalog)
    for name, match in (("search", matching.match_search), ("edit", matching.match_edit), ("jaccard", matching.match_jaccard)):
        assert rows(found.select("norm", F.col(f"{name}_id").alias("std_id"), F.col(f"{name}_score").alias("score"))) == rows(match(items, catalog))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow nearest") == 1


def test_few_tasks_start_python(spark):
    """Lists are dealt to two tasks a core, whatever the number of shuffle partitions, and made without Python."""
    items, catalog = tables(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for match in MATCHES.values():
            plan = match(items, catalog)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("MapInArrow") == 1, plan
            assert f"RoundRobinPartitioning({2 * spark.sparkContext.defaultParallelism})" in plan, plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lowest_rows_are_sorted_by_a_number_first(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("std_id"), F.concat(F.lit("a long text "), (F.col("id") % 30).cast("string")).alias("description"), F.lit(1).alias("all"))
    low = matching.lowest(rows, ["all", "description"], 3)
    got = {}
    for r in low.collect():
        got.setdefault(r["description"], set()).add(r["std_id"])
    want = {}
    for r in rows.collect():
        want.setdefault(r["description"], []).append(r["std_id"])
    assert got == {d: set(sorted(v)[:3]) for d, v in want.items()}
    assert "hashpartitioning(hash" in low._jdf.queryExecution().executedPlan().toString()


def test_search_starts_python_in_few_tasks(spark):
    items, catalog = tables(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        parts = matching._nearest(items, catalog, [matching.by_tokens(matching.search_by_size, matching.NOTHING)], 1, "category").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert parts == 2 * spark.sparkContext.defaultParallelism


def test_five_lowest_ids_move_once(spark):
    """The rows that the window left are brought into lists of ids where they are."""
    items, catalog = tables(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = MATCHES["five"](items, catalog)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning(hash") == 1 and plan.count("description") and "Exchange hashpartitioning(category, description" not in plan
