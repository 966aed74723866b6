"""Operators on small rows whose results are known."""

from pyspark.sql import functions as F

from tallyweave.functions.rules import RULES
from tallyweave.functions.text import edit_score, jaccard_score, normalize_basic, normalize_enhanced
from tallyweave.operators import dedup, ensemble, matching, review
from tallyweave.streaming import incremental


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_normal_forms(spark):
    assert len(RULES) == 114
    assert one(spark, "  hello    world ", normalize_basic) == "HELLO WORLD"
    assert one(spark, None, normalize_basic) is None and one(spark, None, normalize_enhanced) is None
    for text, want in {"20 oz": "20OZ", "20OZ": "20OZ", "1.69OZ": "1-69OZ", "12/12OZ": "12PK 12OZ", "DR PEPPER": "DR. PEPPER", "FL CLS": "FL CLASSIC", "FL CLASSIC": "FRITO-LAY CLASSIC", "": ""}.items():
        assert one(spark, text, normalize_enhanced) == want, text


def test_scores_of_blank_texts(spark):
    rows = [(None, "A"), ("", "A"), ("  ", "A"), ("a ", "A"), ("COLA 12", "cola, 12!"), ("!!", "??")]
    got = spark.createDataFrame(rows, "a string, b string").select(edit_score(F.col("a"), F.col("b")).alias("e"), jaccard_score(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r["e"] for r in got][:4] == [0, 0, 0, 1] and [r["j"] for r in got] == [0, 0, 0, 1, 1, 0]


MATCH = "item_id long, search_id string, cosine_id string, edit_id string, jaccard_id string, search_score double, cosine_score double, edit_score double, jaccard_score double"


def test_ensemble_votes_and_routes(spark):
    rows = [
        (1, "a", "a", "a", "a", 1.0, 1.0, 1.0, 1.0), (2, "a", "a", "b", "b", 0.1, 0.1, 0.9, 0.9), (3, "a", "b", "c", "d", 0.5, 0.5, 0.2, 0.1),
        (4, None, None, "None", "None", 0.0, 0.0, 0.0, 0.0), (5, "a", "b", "c", "d", None, 0.5, 0.2, 0.1), (6, None, "b", "None", "None", 0.9, 0.9, 0.9, 0.9),
    ]
    scored = ensemble.ensemble(spark.createDataFrame(rows, MATCH))
    got = {r["item_id"]: r for r in scored.collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert got[1]["ensemble_score"] == 1.0 and got[2]["suggested_id"] == "a" and got[3]["suggested_id"] == "a"
    assert abs(got[2]["ensemble_score"] - 1.1 * (0.08 + 0.27) / 1.1) < 1e-12
    assert got[6]["suggested_id"] == "None" and abs(got[6]["ensemble_score"] - 0.9) < 1e-12
    routed = {r["item_id"]: r["destination"] for r in ensemble.route(scored).collect()}
    assert routed == {1: "ACCEPTED", 2: "REVIEW", 3: "REVIEW", 4: "REJECTED", 6: "ACCEPTED"}


def test_matchers_break_ties_by_id(spark):
    items = spark.createDataFrame([("COLA", "A"), ("TEA", "B"), ("X", "C")], "norm string, category string")
    catalog = spark.createDataFrame([(2, "COLA", "A"), (1, "COLA", "A"), (3, "TEA TIME", "B")], "std_id long, description string, category string")
    assert sorted((r["norm"], r["std_id"]) for r in matching.match_edit(items, catalog).collect()) == [("COLA", 1), ("TEA", 3)]
    found = {r["norm"]: (r["std_id"], r["score"]) for r in matching.match_search(items, catalog).collect()}
    assert found["COLA"] == (1, 1.0) and found["X"] == (None, 0.0)


def test_upserts(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    s = spark.createDataFrame([("b", 5), ("c", 7)], "k string, n int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(dedup.upsert(t, s, "k")) == [("a", 1), ("b", 2), ("c", 7)]
    assert rows(dedup.upsert(t, s, "k", {"n": F.col("t.n") + F.col("s.n")})) == [("a", 1), ("b", 7), ("c", 7)]
    assert rows(dedup.update_where(t, s, "k", {"n": F.lit(0)})) == [("a", 1), ("b", 0)]
    assert rows(dedup.delete_where(t, s, "k")) == [("a", 1)]


def test_reviews_reach_siblings(spark):
    m = spark.createDataFrame(
        [("m1", 1, "N", "PENDING", "PENDING_REVIEW", "s1", None), ("m2", 2, "N", "PENDING", "PENDING_REVIEW", "s2", None), ("m3", 3, "N", "CONFIRMED", "PENDING_REVIEW", "s3", None), ("m4", 4, "Q", "PENDING", "PENDING_REVIEW", "s4", None)],
        "match_id string, item_id int, norm string, raw_status string, status string, suggested_id string, confirmed_id string",
    )
    r = spark.createDataFrame([("m1", "CONFIRM", None), ("m9", "CONFIRM", None), ("m4", "DANCE", None)], "match_id string, action string, std_id string")
    assert sorted((x["match_id"], x["outcome"]) for x in review.check(r, m).collect()) == [("m1", "VALID"), ("m4", "INVALID_ACTION"), ("m9", "MATCH_NOT_FOUND")]
    got = {x["match_id"]: (x["raw_status"], x["status"], x["confirmed_id"], x["change"]) for x in review.apply_reviews(m, r).collect()}
    assert got["m1"] == ("CONFIRMED", "USER_CONFIRMED", "s1", "CONFIRM") and got["m2"] == ("CONFIRMED", "AUTO_ACCEPTED", "s1", "+PROPAGATED")
    assert got["m3"] == ("CONFIRMED", "PENDING_REVIEW", None, None) and got["m4"][1] == "PENDING_REVIEW"


def test_stream_appends_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        incremental.append_new(incremental.changes(spark, f"{tmp_path}/in", rows.schema), "id", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        rows.write.mode("append").parquet(f"{tmp_path}/in")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_pair_score_is_not_shuffled_before_it_is_reduced(spark, data):
    from tallyweave.plans import reconcile

    t = reconcile.tables(spark, data)
    plan = matching.match_edit(t["items"], t["std"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_search_pages(spark):
    from tallyweave.operators.search import Search, found, page_of

    rows = [(i, f"N{i % 5}", f"text {i}", "S1" if i % 2 else "S2", i / 20 if i != 7 else None, 1 + i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "item_id int, norm string, raw_description string, source_system string, ensemble_score double, level int")
    got = found(df, Search(filters={"source_system": "S1", "status": "All"}, sort_by="no_such")).collect()
    assert [r["item_id"] for r in got] == [19, 17, 15, 13, 11] and all(r["duplicates"] == 2 for r in got)
    flat = found(df, Search(grouped=False, text="TEXT 1", agreement=2))
    assert [r["item_id"] for r in flat.collect()] == [19, 16, 13, 10, 1]
    last, page, total = page_of(flat, 9, 2)
    assert (page, total, [r["item_id"] for r in last.collect()]) == (3, 5, [1])


def test_settings_and_rules(spark):
    from tallyweave.operators import settings

    have = spark.createDataFrame([("AUTO_ACCEPT_THRESHOLD", "0.555"), ("ODD", "x")], "config_key string, config_value string")
    seeded = settings.seed(have, settings.default_settings(spark))
    assert seeded.count() == len(settings.DEFAULTS) + 1 and settings.number(seeded, "AUTO_ACCEPT_THRESHOLD", 0) == 0.56
    assert settings.number(seeded, "ODD", 0.6) == 0.6 and settings.number(seeded, "NONE", 0.6) == 0.6
    rules = settings.add_rule(settings.toggle_rule(settings.rule_table(spark), "R000"), "R999", "typo", "A", "B")
    assert rules.count() == 115 and rules.where("not is_active").count() == 1
    got = settings.try_rules(spark.createDataFrame([("20 OZ",), ("PLAIN",)], "t string"), F.col("t")).collect()
    assert [(r["normalized"], r["changed"]) for r in got] == [("20OZ", True), ("PLAIN", False)]


def test_batches_and_steps(spark):
    import datetime as dt

    from tallyweave.operators import batches

    raw = spark.createDataFrame([(1, "a", "A", "PENDING", 3), (2, "b", "A", "PENDING", 1), (3, "c", "A", "DONE", 0)], "item_id long, raw_description string, category string, status string, created_at int")
    state = spark.createDataFrame([("B0", "ACTIVE")], "batch_id string, status string")
    staging = batches.stage(spark.createDataFrame([(1,)], "item_id long"), spark.createDataFrame([(1,), (2,), (2,)], "item_id long"))
    items, after, left = batches.prepare(raw, staging, state, "B1", 1)
    assert [r["norm"] for r in items.collect()] == ["B"] and {tuple(r) for r in after.collect()} == {("B0", "COMPLETED"), ("B1", "ACTIVE")} and left.count() == 0
    none, same, _ = batches.prepare(raw.where("status = 'DONE'"), staging, state, "B2")
    assert none.isEmpty() and same.collect()[0]["status"] == "ACTIVE"
    log = spark.createDataFrame([], "run_id string, step string, status string, at timestamp, items int")
    t = dt.datetime(2024, 1, 1)
    for step, status, s in (("a", "STARTED", 0), ("b", "STARTED", 1), ("a", "COMPLETED", 30)):
        log = batches.log_step(log, "r", step, status, t + dt.timedelta(seconds=s))
    assert {(r["step"], r["status"], r["seconds"]) for r in batches.steps(log).collect()} == {("a", "COMPLETED", 30), ("b", "RUNNING", None)}
    assert batches.all_done(log, "r", ["a"]) and not batches.all_done(log, "r", ["a", "b"])
