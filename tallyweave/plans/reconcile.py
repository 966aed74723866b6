"""The reconciliation queries made of operators, each with SQL that another engine can run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import PRIORITIES, RULES
from ..functions.text import cosine, edit_score, jaccard_score, normalize_basic, normalize_enhanced
from ..operators import batches, dedup, ensemble, fast_path, matching, review, search, settings
from ..sources.fixtures import Tables, V
from ..streaming import incremental
from .views import _LEVEL, DERIVED, NORM, TOLD, VIEWS

#: How Spark makes the derived tables: by the operators where there is one.
MADE = {
    "scored": lambda t: ensemble.ensemble(t["matches"]),
    "m": lambda t: t.sql(DERIVED["m"]),
    "eff": lambda t: t.sql(DERIVED["eff"]),
    "uniq": lambda t: dedup.unique_descriptions(t["raw"]),
    "items": lambda t: matching.batch_of(t["raw"]),
    "routes": lambda t: ensemble.route(t["scored"]),
}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir, MADE)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _nested(text: str) -> str:
    for _, pattern, with_ in RULES:
        text = f"regexp_replace({text}, '{pattern}', '{with_.replace(chr(39), chr(39) * 2)}', 'gi')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


TOKENS = "list_distinct(list_filter(string_split_regex(regexp_replace(upper({x}), '[^A-Za-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> ''))"
_tok = lambda x: TOKENS.replace("{x}", x)
_EDIT = "1.0E0 - levenshtein(upper(trim({a})), upper(trim({b}))) / cast(greatest(length(upper(trim({a}))), length(upper(trim({b}))), 1) AS double)"
_edit = lambda a, b: _EDIT.replace("{a}", a).replace("{b}", b)
_PAIRS = "SELECT i.norm, s.std_id, {score} AS score FROM {{items}} i JOIN {{std}} s ON s.category = i.category"
_top = lambda inner, key, k: f"SELECT {key}, std_id, score FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, std_id) AS k FROM ({inner}) AS p) AS q WHERE k <= {k}"
_JAC = "SELECT norm, std_id, len(list_intersect(x, y)) / cast(greatest(len(list_distinct(list_concat(x, y))), 1) AS double) AS score FROM (SELECT i.norm, i.category, " + _tok("i.norm") + " AS x FROM {items} i) AS a JOIN (SELECT s.std_id, s.category, " + _tok("s.description") + " AS y FROM {std} s) AS b ON a.category = b.category"


def _search(items: str, key: str, block: bool) -> str:
    on = " AND a.category = b.category" if block else ""
    return f"""SELECT a.{key}, b.std_id, (count(*) / sqrt(cast(max(a.n) AS double) * max(b.n)) + 1.0E0) / 2.0E0 AS score FROM (SELECT {key}, category, unnest(t) AS token, len(t) AS n FROM (SELECT {key}, category, {_tok('norm')} AS t FROM {items}) AS u) AS a
        JOIN (SELECT std_id, category, unnest(t) AS token, len(t) AS n FROM (SELECT std_id, category, {_tok('description')} AS t FROM {{std}}) AS v) AS b ON a.token = b.token{on} GROUP BY a.{key}, b.std_id"""


@query(f"SELECT item_id, {NORM} AS norm FROM {{raw}}")
def normalize_basic_query(t):
    return t["raw"].select("item_id", normalize_basic(F.col("raw_description")).alias("norm"))


@query(f"SELECT item_id, {_nested('upper(raw_description)')} AS norm FROM {{raw}}")
def normalize_enhanced_query(t):
    return dedup.with_normal_form(t["raw"].select("item_id", "raw_description"), normalize_enhanced).select("item_id", "norm")


_sql = lambda x: "'" + x.replace("'", "''") + "'"
_RULE_ROWS = "(VALUES " + ", ".join(f"({i}, {_sql(k)}, {_sql(p)}, {_sql(w)}, {PRIORITIES[k]})" for i, (k, p, w) in enumerate(RULES)) + ") AS r(place, kind, pattern, with_, priority)"


@query(f"SELECT kind, count(*) AS n, min(priority) AS priority, count(DISTINCT pattern) AS n_patterns FROM {_RULE_ROWS} GROUP BY kind")
def rule_stats(t):
    rows = t.spark.createDataFrame([(k, p, w, PRIORITIES[k]) for k, p, w in RULES], "kind string, pattern string, with_ string, priority int")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("priority").alias("priority"), F.countDistinct("pattern").alias("n_patterns"))


@query(f"SELECT cast(to_json(list({{'place': place, 'kind': kind, 'pattern': pattern, 'with_': with_}} ORDER BY place)) AS varchar) AS rules FROM {_RULE_ROWS}")
def rules_export(t):
    rows = t.spark.createDataFrame([(i, k, p, w) for i, (k, p, w) in enumerate(RULES)], "place int, kind string, pattern string, with_ string")
    return rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct("place", "kind", "pattern", "with_")))).alias("rules"))


@query("SELECT * FROM {uniq}")
def dedup_unique(t):
    return t["uniq"]


@query(f"SELECT item_id, md5(norm) AS unique_id, norm FROM (SELECT item_id, {NORM} AS norm FROM {{raw}}) AS r WHERE norm IN (SELECT norm FROM {{uniq}}) AND item_id NOT IN (SELECT item_id FROM {{matches}} WHERE status = 'AUTO_ACCEPTED')")
def dedup_map(t):
    return dedup.lineage_map(t["raw"], t["uniq"], t["matches"].where("status = 'AUTO_ACCEPTED'"))


@query(f"""SELECT r.item_id, c.std_id, CASE WHEN r.subcategory IS NOT NULL AND (c.subcategory IS NULL OR c.subcategory = r.subcategory) THEN c.score ELSE c.score * 0.95E0 END AS score,
    CASE WHEN r.subcategory IS NOT NULL AND (c.subcategory IS NULL OR c.subcategory = r.subcategory) THEN 'FAST_PATH_SUBCATEGORY' ELSE 'FAST_PATH' END AS method
    FROM (SELECT item_id, subcategory, {NORM} AS norm FROM {{raw}} WHERE status = 'PENDING') AS r JOIN {{confirmed}} c ON c.norm = r.norm WHERE NOT EXISTS (SELECT 1 FROM {{matches}} m WHERE m.item_id = r.item_id AND m.status = 'AUTO_ACCEPTED')""")
def fast_path_query(t):
    return fast_path.fast_path(t["raw"], t["confirmed"], t["matches"].where("status = 'AUTO_ACCEPTED'"))


@query(f"SELECT r.item_id, {_edit('r.raw_description', 's.description')} AS score FROM {{raw}} r JOIN {{std}} s ON s.std_id = r.true_id")
def edit_score_query(t):
    return t["raw"].join(t["std"], F.col("std_id") == F.col("true_id")).select("item_id", edit_score(F.col("raw_description"), F.col("description")).alias("score"))


@query(f"SELECT item_id, len(list_intersect(x, y)) / cast(len(list_distinct(list_concat(x, y))) AS double) AS score FROM (SELECT r.item_id, {_tok('r.raw_description')} AS x, {_tok('s.description')} AS y FROM {{raw}} r JOIN {{std}} s ON s.std_id = r.true_id) AS p")
def jaccard_score_query(t):
    return t["raw"].join(t["std"], F.col("std_id") == F.col("true_id")).select("item_id", jaccard_score(F.col("raw_description"), F.col("description")).alias("score"))


@query("SELECT i.category, count(*) AS n_pairs, count(DISTINCT i.norm) AS n_items FROM {items} i JOIN {std} s ON s.category = i.category GROUP BY i.category")
def pairs_by_category(t):
    return t["items"].join(t["std"].select("std_id", "category"), "category").groupBy("category").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("norm").alias("n_items"))


@query(_top(_PAIRS.replace("{score}", _edit("i.norm", "s.description")).replace("{{", "{").replace("}}", "}"), "norm", 1))
def edit_top1(t):
    return matching.match_edit(t["items"], t["std"])


@query(_top(_JAC, "norm", 1))
def jaccard_top1(t):
    return matching.match_jaccard(t["items"], t["std"])


_COS = "SELECT q.vec_id AS query_id, c.vec_id AS std_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM {embeddings} q JOIN {embeddings} c ON c.label = q.label AND c.vec_id % 5 <> 0 WHERE q.vec_id % 5 = 0"


def _cosine(t, k):
    e = t["embeddings"]
    queries = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    catalog = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("std_id"), F.col("embedding").alias("vector"), "label")
    found = matching.pairs(queries, catalog, F.round(cosine(F.col("query"), F.col("vector")), 6), "query_id", "std_id", "label")
    return matching.best_of(found, "query_id", "std_id") if k == 1 else matching.top_of(found, "query_id", "std_id", k).drop("rank")


@query(_top(_COS, "query_id", 1))
def cosine_top1(t):
    return _cosine(t, 1)


@query(_top(_COS, "query_id", 5))
def topk_candidates(t):
    return _cosine(t, 5)


@query(f"SELECT i.norm, b.std_id, coalesce(b.score, 0.0E0) AS score FROM {{items}} i LEFT JOIN ({_top(_search('{items}', 'norm', True), 'norm', 1)}) AS b ON b.norm = i.norm")
def search_top1(t):
    return matching.match_search(t["items"], t["std"], 1).drop("rank")


@query(f"SELECT i.norm, b.std_id, coalesce(b.score, 0.0E0) AS score FROM {{items}} i LEFT JOIN ({_top(_search('{items}', 'norm', True), 'norm', 5)}) AS b ON b.norm = i.norm")
def search_topk(t):
    return matching.match_search(t["items"], t["std"], 5).drop("rank")


@query(f"SELECT i.norm, i.category FROM {{items}} i JOIN (SELECT {NORM} AS norm, min(created_at) AS oldest FROM {{raw}} GROUP BY 1) AS o ON o.norm = i.norm ORDER BY o.oldest, i.norm LIMIT 500")
def batch_select(t):
    return matching.batch_of(t["raw"], 500)


@query("SELECT item_id, ensemble_score, suggested_id FROM {scored}")
def ensemble_query(t):
    return t["scored"].select("item_id", "ensemble_score", "suggested_id")


@query(f"SELECT item_id, CASE WHEN search_id IS NULL AND cosine_id IS NULL AND edit_id IS NULL AND jaccard_id IS NULL THEN NULL ELSE {_LEVEL} END AS n FROM {{matches}}")
def signal_agreement(t):
    n = ensemble.largest_group([F.col(f"{m}_id") for m in ensemble.METHODS])
    return t["matches"].select("item_id", F.nullif(n, F.lit(0)).alias("n"))


@query("SELECT item_id, destination, cast(confidence AS double) AS confidence, reason FROM {routes}")
def route_items(t):
    return t["routes"].withColumn("confidence", F.col("confidence").cast("double"))


_FOUR = batches.METHODS
_LATEST = "SELECT norm, method, std_id, score FROM (SELECT *, row_number() OVER (PARTITION BY norm, method ORDER BY staged_at DESC, seq DESC) AS k FROM {staged}) AS z WHERE k = 1"
_WITH_NORM = f"(SELECT m.*, r.norm FROM {{matches}} m JOIN (SELECT item_id, {NORM} AS norm FROM {{raw}}) AS r ON r.item_id = m.item_id)"
_FANNED = "SELECT m.item_id, m.norm, " + ", ".join(f"CASE WHEN m.{k}_score IS NULL AND {k[0]}.norm IS NOT NULL THEN {k[0]}.std_id ELSE m.{k}_id END AS {k}_id, coalesce(m.{k}_score, {k[0]}.score) AS {k}_score, m.{k}_score IS NULL AND {k[0]}.norm IS NOT NULL AS {k}_merged" for k in _FOUR) + f" FROM {_WITH_NORM} AS m " + " ".join(f"LEFT JOIN (SELECT * FROM ({_LATEST}) AS l WHERE method = '{k}') AS {k[0]} ON {k[0]}.norm = m.norm" for k in _FOUR)


def _fanned(t):
    raw = t["raw"].select("item_id", normalize_basic(F.col("raw_description")).alias("norm"))
    own = t["matches"].select("item_id", *[f"{k}_{c}" for k in _FOUR for c in ("id", "score")]).join(raw, "item_id")
    return batches.fan_out(own, t["staged"])


@query(f"SELECT item_id, {', '.join(f'{k}_id, {k}_score' for k in _FOUR)} FROM ({_FANNED}) AS f")
def fanout_scores(t):
    """The latest staged result of a description goes to all of its items, by method, and only where an item has none."""
    return _fanned(t).select("item_id", *[f"{k}_{c}" for k in _FOUR for c in ("id", "score")])


@query(f"SELECT {', '.join(f'(count(*) FILTER ({k}_merged))::bigint AS {k}_merged' for k in _FOUR)}, count(*) FILTER ({' OR '.join(f'{k}_merged' for k in _FOUR)}) AS items FROM ({_FANNED}) AS f")
def fanout_counts(t):
    merged = [F.col(f"{k}_merged") for k in _FOUR]
    return _fanned(t).agg(*[F.count_if(m).alias(f"{k}_merged") for k, m in zip(_FOUR, merged, strict=True)], F.count_if(merged[0] | merged[1] | merged[2] | merged[3]).alias("items"))


@query(f"SELECT s.norm, s.method, s.seq FROM {{staged}} s WHERE NOT EXISTS (SELECT 1 FROM ({_FANNED}) AS f WHERE f.norm = s.norm AND (" + " OR ".join(f"s.method = '{k}' AND f.{k}_score IS NOT NULL" for k in _FOUR) + "))")
def staging_left(t):
    return batches.left_over(t["staged"], _fanned(t)).select("norm", "method", "seq")


def _review_input(t):
    raw = t["raw"].select("item_id", normalize_basic(F.col("raw_description")).alias("norm"), F.col("status").alias("raw_status"))
    return t["m"].select("match_id", "item_id", "status", "suggested_id", "confirmed_id").join(raw, "item_id")


def _reviews(t):
    return t["reviews"].withColumn("std_id", F.lit(None).cast("string"))


def _review_sql(bulk: bool) -> str:
    allowed = "('CONFIRM', 'REJECT')" if bulk else "('CONFIRM', 'CHANGE', 'THUMBS_UP', 'REJECT', 'THUMBS_DOWN')"
    return f"""SELECT match_id, item_id, CASE WHEN yes OR (spread AND sibling_yes) THEN 'CONFIRMED' WHEN no OR spread THEN 'REJECTED' ELSE raw_status END AS raw_status,
        CASE WHEN yes THEN 'USER_CONFIRMED' WHEN no THEN 'USER_REJECTED' WHEN action = 'THUMBS_DOWN' THEN 'PENDING_REVIEW' WHEN spread AND sibling_yes THEN 'AUTO_ACCEPTED' WHEN spread THEN 'USER_REJECTED' ELSE status END AS status,
        CASE WHEN yes THEN suggested_id WHEN spread AND sibling_yes THEN sibling_id ELSE confirmed_id END AS confirmed_id, CASE WHEN action IS NOT NULL THEN action WHEN spread THEN '+PROPAGATED' END AS change
    FROM (SELECT o.*, coalesce(o.action IN ('CONFIRM', 'CHANGE', 'THUMBS_UP'), false) AS yes, coalesce(o.action = 'REJECT', false) AS no, d.sibling_yes, d.sibling_id,
            o.action IS NULL AND d.norm IS NOT NULL AND o.raw_status IN ('PENDING', 'MATCHED', 'PENDING_REVIEW') AND o.status NOT IN ('USER_CONFIRMED', 'USER_REJECTED') AS spread
        FROM own o LEFT JOIN (SELECT norm, action <> 'REJECT' AS sibling_yes, suggested_id AS sibling_id FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY match_id DESC) AS k FROM own WHERE action IN ('CONFIRM', 'CHANGE', 'THUMBS_UP', 'REJECT')) AS z WHERE k = 1) AS d ON d.norm = o.norm) AS x""".replace(
        "own ", f"(SELECT m.match_id, m.item_id, m.status, m.suggested_id, m.confirmed_id, r.norm, r.raw_status, v.action FROM {{m}} m JOIN (SELECT item_id, {NORM} AS norm, status AS raw_status FROM {{raw}}) AS r ON r.item_id = m.item_id LEFT JOIN (SELECT match_id, action FROM {{reviews}} WHERE action IN {allowed}) AS v ON v.match_id = m.match_id) ")


@query(_review_sql(False))
def review_apply(t):
    return review.apply_reviews(_review_input(t), _reviews(t))


@query(_review_sql(True))
def review_bulk(t):
    return review.apply_reviews(_review_input(t), _reviews(t), bulk=True)


@query("SELECT match_id, CASE WHEN locked_by IS NULL OR locked_minutes_ago > 15 OR locked_by = 'rev1' THEN 'rev1' ELSE locked_by END AS locked_by, locked_by IS NULL OR locked_minutes_ago > 15 OR locked_by = 'rev1' AS acquired FROM {matches}")
def lock_state(t):
    return review.lock_state(t["matches"], "rev1")


_OLD = "(SELECT norm, n_items, last_seen FROM {uniq} WHERE length(norm) % 3 <> 0)"
_NEW = f"(SELECT {NORM} AS norm, count(*) AS n_items, max(created_at) AS last_seen FROM {{raw}} WHERE status = 'PENDING_REVIEW' GROUP BY 1)"


def _sides(t):
    old = t["uniq"].where("length(norm) % 3 <> 0").select("norm", "n_items", "last_seen")
    return old, dedup.unique_descriptions(t["raw"], status="PENDING_REVIEW").select("norm", "n_items", "last_seen")


@query(f"SELECT coalesce(t.norm, s.norm) AS norm, coalesce(t.n_items, 0) + coalesce(s.n_items, 0) AS n_items, coalesce(s.last_seen, t.last_seen) AS last_seen FROM {_OLD} AS t FULL JOIN {_NEW} AS s ON s.norm = t.norm")
def merge_accumulate(t):
    return dedup.upsert(*_sides(t), "norm", {"n_items": F.col("t.n_items") + F.col("s.n_items"), "last_seen": F.col("s.last_seen")})


@query(f"SELECT * FROM {_OLD} AS t UNION ALL SELECT s.* FROM {_NEW} AS s WHERE s.norm NOT IN (SELECT norm FROM {_OLD} AS o)")
def merge_insert_only(t):
    return dedup.upsert(*_sides(t), "norm")


_CACHE = "(SELECT norm, cast(std_id AS VC) AS std_id, score, 1::bigint AS confirmations FROM {confirmed})".replace("VC", V)
_SAID = f"""(SELECT norm, std_id, score, n FROM (SELECT r.norm, m.suggested_id AS std_id, m.ensemble_score AS score, count(*) OVER (PARTITION BY r.norm) AS n, row_number() OVER (PARTITION BY r.norm ORDER BY m.match_id DESC) AS k
    FROM {{m}} m JOIN (SELECT item_id, {NORM} AS norm FROM {{raw}}) AS r ON r.item_id = m.item_id WHERE m.suggested_id IS NOT NULL AND m.match_id IN (SELECT match_id FROM {{reviews}} WHERE action IN ('CONFIRM', 'CHANGE', 'THUMBS_UP'))) AS z WHERE k = 1)"""


@query(f"SELECT coalesce(s.norm, c.norm) AS norm, CASE WHEN s.norm IS NULL THEN c.std_id ELSE s.std_id END AS std_id, CASE WHEN s.norm IS NULL THEN c.score ELSE s.score END AS score, coalesce(c.confirmations, 0) + coalesce(s.n, 0) AS confirmations FROM {_CACHE} AS c FULL JOIN {_SAID} AS s ON s.norm = c.norm")
def cache_upsert(t):
    """Confirmed descriptions enter the cache of the fast path, or count once more in it."""
    cache = t["confirmed"].select("norm", F.col("std_id").cast("string").alias("std_id"), "score", F.lit(1).cast("long").alias("confirmations"))
    raw = t["raw"].select("item_id", normalize_basic(F.col("raw_description")).alias("norm"))
    return review.remember(cache, t["m"].join(raw, "item_id"), _reviews(t))


@query("SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM {matches} m WHERE m.match_id = r.match_id) THEN 'MATCH_NOT_FOUND' WHEN r.action IN ('CONFIRM', 'REJECT') THEN 'VALID' ELSE 'INVALID_ACTION' END AS outcome, count(*) AS n FROM {reviews} r GROUP BY 1")
def review_outcomes(t):
    return review.outcomes(_reviews(t), t["matches"], bulk=True)


@query("SELECT config_key, CASE config_key WHEN 'BATCH_SIZE' THEN '200' ELSE config_value END AS config_value FROM {config} UNION ALL SELECT 'SEARCH_BATCH_SIZE', '100'")
def config_upsert(t):
    return settings.put(t["config"], t.spark.createDataFrame([("BATCH_SIZE", "200"), ("SEARCH_BATCH_SIZE", "100")], "config_key string, config_value string"))


_OWN = "SELECT item_id, search_id AS std_id, 'search' AS method, search_score AS score FROM {matches} WHERE search_id IS NOT NULL"
_NEXT = "SELECT item_id, std_id, min(struct_pack(method := method, score := score)) AS r FROM (" + " UNION ALL ".join(f"SELECT item_id, {k}_id AS std_id, '{k}' AS method, {k}_score AS score FROM {{matches}} WHERE {k}_id IS NOT NULL" for k in ("cosine", "edit")) + ") AS z GROUP BY item_id, std_id"


@query(f"{_OWN} UNION ALL SELECT n.item_id, n.std_id, n.r.method, n.r.score FROM ({_NEXT}) AS n WHERE NOT EXISTS (SELECT 1 FROM {{matches}} m WHERE m.item_id = n.item_id AND m.search_id = n.std_id)")
def candidates_merge(t):
    """Candidates by item and catalog row, whatever method found them first."""
    rows = lambda k: t["matches"].where(F.col(f"{k}_id").isNotNull()).select("item_id", F.col(f"{k}_id").alias("std_id"), F.lit(k).alias("method"), F.col(f"{k}_score").alias("score"))
    return dedup.add_missing(rows("search"), rows("cosine").unionByName(rows("edit")), ["item_id", "std_id"])


@query("SELECT r.item_id, CASE WHEN c.norm IS NOT NULL AND r.status = 'PENDING' THEN 'AUTO_ACCEPTED' ELSE r.status END AS status FROM (SELECT item_id, status, NORM AS norm FROM {raw}) AS r LEFT JOIN (SELECT norm FROM {confirmed} WHERE score >= 0.8E0) AS c ON c.norm = r.norm".replace("NORM AS", f"{NORM} AS"))
def update_from_join(t):
    """Pending items of which the description is confirmed are accepted."""
    raw = t["raw"].select("item_id", "status", normalize_basic(F.col("raw_description")).alias("norm"))
    done = dedup.update_from(raw, t["confirmed"].select("norm", "score", "std_id"), "norm", {"status": F.lit("AUTO_ACCEPTED")}, F.col("score"), (F.col("t.status") == "PENDING") & (F.col("s.score") >= 0.8))
    return done.select("item_id", "status")


@query("SELECT task, max(status) AS status, max(seconds) AS seconds FROM (SELECT task, 'FAILED' AS status, max(seconds) AS seconds FROM {tasks} WHERE status = 'FAILED' GROUP BY task UNION ALL SELECT task, 'A' AS status, 0 AS seconds FROM {tasks} GROUP BY task) AS z GROUP BY task")
def update_else_insert(t):
    """The state of each task: changed where there is one, added where not."""
    every, failed = t["tasks"], t["tasks"].where("status = 'FAILED'")
    state = every.select("task").distinct().withColumns({"status": F.lit("A"), "seconds": F.lit(0).cast("long")})
    return dedup.upsert(state, failed.groupBy("task").agg(F.lit("FAILED").alias("status"), F.max("seconds").alias("seconds")), "task", {"status": F.col("s.status"), "seconds": F.col("s.seconds")})


@query("SELECT item_id, 'PENDING' AS status, cast(NULL AS VC) AS category, raw_description FROM {raw}".replace("VC", V))
def reset_items(t):
    fresh, others = batches.reset(t["raw"], {"matches": t["matches"], "confirmed": t["confirmed"]})
    left = others["matches"].select("item_id", "status", F.lit(None).cast("string").alias("category"), F.lit("").alias("raw_description"))
    return fresh.select("item_id", "status", "category", "raw_description").unionByName(left)


@query("SELECT category, count(*) AS n FROM {raw} GROUP BY category UNION ALL SELECT 'second', 1")
def create_table_as(t):
    """A table is made from a query, and then swapped for another one of the same name."""
    path = f"{_folder(t.spark)}/table"
    batches.create_as(t["raw"].groupBy("category").agg(F.count(F.lit(1)).alias("n")).unionByName(t.spark.createDataFrame([("first", 1)], "category string, n long")), path)
    second = t["raw"].groupBy("category").agg(F.count(F.lit(1)).alias("n")).unionByName(t.spark.createDataFrame([("second", 1)], "category string, n long"))
    return batches.create_as(second, path)


@query("SELECT run_id, method, count(*) AS done, round(100.0E0 * count(*) / max(total), 1) AS progress, CASE WHEN count(*) = max(total) THEN 'COMPLETED' ELSE 'RUNNING' END AS status FROM (SELECT r.*, x.total FROM {results} r CROSS JOIN (SELECT count(*) AS total FROM {tests}) AS x WHERE r.run_no = 1 OR r.difficulty <> 'HARD') AS z GROUP BY run_id, method")
def job_tracking(t):
    """Progress of test runs: their results so far of all tests."""
    total = t["tests"].agg(F.count(F.lit(1)).alias("total"))
    so_far = t["results"].where("run_no = 1 OR difficulty <> 'HARD'").groupBy("run_id", "method").agg(F.count(F.lit(1)).alias("done")).crossJoin(F.broadcast(total))
    return so_far.select("run_id", "method", "done", F.round(100.0 * F.col("done") / F.col("total"), 1).alias("progress"), F.when(F.col("done") == F.col("total"), "COMPLETED").otherwise("RUNNING").alias("status"))


_BATCH = f"""(SELECT norm FROM (SELECT norm, min(created_at) AS oldest, max(CASE WHEN k = 1 THEN category END) AS category FROM (SELECT {NORM} AS norm, category, created_at, row_number() OVER (PARTITION BY {NORM} ORDER BY item_id) AS k FROM {{raw}} WHERE status = 'PENDING' AND item_id IN (SELECT seq FROM {{staged}})) AS y GROUP BY norm) AS z
    WHERE category IS NOT NULL AND upper(trim(category)) NOT IN ('UNKNOWN', 'NULL', 'NONE', '') ORDER BY oldest, norm LIMIT 100)"""


def _prepared(t):
    arrived = t["staged"].select(F.col("seq").alias("item_id")).distinct()
    return batches.prepare(t["raw"], arrived, t["batches"].select("batch_id", "status"), "B_NEW", 100)


@query(f"SELECT * FROM {_BATCH} AS b")
def batch_prepare(t):
    """The oldest staged descriptions make a batch."""
    return _prepared(t)[0].select("norm")


@query("SELECT batch_id, CASE status WHEN 'ACTIVE' THEN 'COMPLETED' ELSE status END AS status FROM {batches} UNION ALL SELECT 'B_NEW', 'ACTIVE'")
def batch_states(t):
    return _prepared(t)[1]


_LISTED = f"(SELECT e.item_id, {NORM} AS norm, e.raw_description, e.source_system, e.category, e.effective, e.created_at, e.ensemble_score, {_LEVEL} AS level FROM {{eff}} e)"


def _listed(t):
    ids = [F.col(f"{k}_id") for k in ensemble.METHODS]
    return t["eff"].select("item_id", normalize_basic(F.col("raw_description")).alias("norm"), "raw_description", "source_system", "category", "effective", "created_at", "ensemble_score", ensemble.agreement_level(ids).alias("level"))


_SHOW = ["item_id", "norm", "duplicates", "ensemble_score", "level"]


def _search_sql(where: str, grouped: bool, order: str, size: int, page: str, more: str = "true") -> str:
    cut = "WHERE g = 1" if grouped else ""
    return f"""SELECT {', '.join(_SHOW)} FROM (SELECT *, row_number() OVER (ORDER BY {order}, item_id) AS k, count(*) OVER () AS total FROM (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY norm) AS duplicates, row_number() OVER (PARTITION BY norm ORDER BY {order}, item_id) AS g FROM {_LISTED} AS l WHERE {where}) AS x {cut}) AS y WHERE {more}) AS z
        WHERE k > (least({page}, ceil(total / {size}.0E0)) - 1) * {size} AND k <= least({page}, ceil(total / {size}.0E0)) * {size}"""


def _paged(t, s: search.Search) -> DataFrame:
    return search.page_of(search.found(_listed(t), s), s.page, s.size)[0].select(*_SHOW)


@query(_search_sql("effective = 'PENDING_REVIEW' AND source_system = 'SRC_1'", True, "ensemble_score DESC NULLS LAST", 25, "2", "level = 2"))
def review_list(t):
    """Open items of a source, one of each description, of which two methods agree: the second page."""
    return _paged(t, search.Search({"effective": "PENDING_REVIEW", "source_system": "SRC_1", "category": "All"}, agreement=2, page=2))


@query(_search_sql("raw_description ILIKE '%oz%'", False, "created_at NULLS FIRST", 50, "1000000"))
def search_flat(t):
    """Items by a part of their text, oldest first: a page beyond the last is the last."""
    return _paged(t, search.Search({"effective": None}, text="oz", sort_by="created_at", descending=False, grouped=False, page=1_000_000, size=50))


@query(_search_sql("true", True, "ensemble_score DESC NULLS LAST", 25, "1"))
def search_bad_sort(t):
    """A sort column that is not among the allowed ones falls back to the default, and page 0 is the first."""
    return _paged(t, search.Search(sort_by="1; DROP TABLE x", page=0))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, timestampdiff(DAY, date_trunc('day', ts), date_trunc('day', (SELECT max(ts) FROM {events}))) AS days FROM {events}")
def json_fields(t):
    """A path out of JSON text, and days by their boundaries."""
    last = F.broadcast(t["events"].agg(F.max("ts").alias("last")))
    return t["events"].crossJoin(last).select("event_id", F.get_json_object("props", "$.k").alias("k"), F.datediff("last", "ts").cast("long").alias("days"))


@query("SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM {raw} WHERE source_system = 'SRC_2') THEN 'TOUCHED' ELSE status END AS status FROM {matches}")
def update_where_in(t):
    return dedup.update_where(t["matches"].select("item_id", "status"), t["raw"].where("source_system = 'SRC_2'"), "item_id", {"status": F.lit("TOUCHED")})


@query("SELECT item_id, status FROM {matches} WHERE item_id NOT IN (SELECT item_id FROM {raw} WHERE source_system = 'SRC_2')")
def delete_where_in(t):
    return dedup.delete_where(t["matches"].select("item_id", "status"), t["raw"].where("source_system = 'SRC_2'"), "item_id")


@query("SELECT category, list_sort(list(DISTINCT subcategory)) AS subcategories FROM {std} GROUP BY category")
def taxonomy_arrays(t):
    return t["std"].groupBy("category").agg(F.array_sort(F.collect_set("subcategory")).alias("subcategories"))


@query("SELECT range AS n, 'ITEM-' || lpad(range::VARCHAR, 6, '0') AS code, range % 150 AS template FROM range(10000)")
def row_generator(t):
    return t.spark.range(10000).select(F.col("id").alias("n"), F.concat(F.lit("ITEM-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("code"), (F.col("id") % 150).alias("template"))


@query(f"SELECT r.item_id, 1.0E0 - levenshtein(upper(r.raw_description), s.description) / cast(greatest(length(r.raw_description), length(s.description), 1) AS double) AS similarity FROM {{raw}} r JOIN {{std}} s ON s.std_id = r.true_id")
def similarity_pair(t):
    a, b = F.upper("raw_description"), F.col("description")
    return t["raw"].join(t["std"], F.col("std_id") == F.col("true_id")).select("item_id", (F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))).alias("similarity"))


def _tests(t):
    return matching.eligible(t["tests"]).select("test_id", "category", "expected_id", normalize_basic(F.col("raw_description")).alias("norm"))


_TESTS = f"(SELECT test_id, category, expected_id, {NORM} AS norm FROM {{tests}} WHERE category IS NOT NULL AND category <> 'UNKNOWN')"


def _judge(t, top, by):
    """Of the five best rows of each text, those of each test."""
    top = _tests(t).join(top, by)
    hit = F.col("std_id") == F.col("expected_id")
    return top.groupBy("test_id").agg(F.max(F.when(F.col("rank") == 1, F.col("std_id"))).alias("top1_id"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"), F.max((hit & (F.col("rank") == 1)).cast("int")).alias("top1"), F.max((hit & (F.col("rank") <= 3)).cast("int")).alias("top3"), F.max(hit.cast("int")).alias("top5"))


def _judge_sql(inner: str) -> str:
    return f"""SELECT test_id, max(CASE WHEN k = 1 THEN std_id END) AS top1_id, max(CASE WHEN k = 1 THEN score END) AS top1_score, max(CASE WHEN k = 1 AND hit THEN 1 ELSE 0 END) AS top1, max(CASE WHEN k <= 3 AND hit THEN 1 ELSE 0 END) AS top3, max(CASE WHEN hit THEN 1 ELSE 0 END) AS top5
        FROM (SELECT p.*, p.std_id = x.expected_id AS hit, row_number() OVER (PARTITION BY p.test_id ORDER BY score DESC, p.std_id) AS k FROM ({inner}) AS p JOIN {_TESTS} AS x ON x.test_id = p.test_id) AS q WHERE k <= 5 GROUP BY test_id"""


@query(_judge_sql(f"SELECT i.test_id, s.std_id, -cast(levenshtein(i.norm, s.description) AS double) AS score FROM {_TESTS} AS i JOIN {{std}} s ON s.category = i.category"))
def accuracy_edit(t):
    """Ranked by the plain edit distance."""
    return _judge(t, matching.top_edit_distance(_tests(t), t["std"], 5), ["norm", "category"])


@query(_judge_sql(_JAC.replace("i.norm, i.category", "i.test_id, i.category").replace("SELECT norm, std_id", "SELECT test_id, std_id").replace("{items} i", f"{_TESTS} AS i")))
def accuracy_jaccard(t):
    return _judge(t, matching.top_by_tokens(_tests(t), t["std"], matching.jaccard_by_size, 5), ["norm", "category"])


def _found(t):
    """The five best rows of each normal form in the whole catalog."""
    return matching.top_by_tokens(_tests(t).withColumn("all", F.lit(1)), t["std"].withColumn("all", F.lit(1)), matching.search_by_size, 5, "all", matching.NOTHING).drop("all")


@query(_judge_sql(_search(f"{_TESTS} AS z", "test_id", False)))
def accuracy_search(t):
    """Searched in the whole catalog, not in the category alone."""
    return _judge(t, _found(t), ["norm"])


@query(f"SELECT test_id, std_id, 0.5E0 * (1.0E0 - 0.1E0 * (k - 1)) + 0.5E0 * score AS fused FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, std_id) AS k FROM ({_search(_TESTS + ' AS z', 'test_id', False)}) AS p) AS q WHERE k <= 5")
def accuracy_rank_fusion(t):
    """Half the score of a search rank, half the similarity."""
    return _tests(t).select("test_id", "norm").join(_found(t), "norm").select("test_id", "std_id", (F.lit(0.5) * (F.lit(1.0) - F.lit(0.1) * (F.col("rank") - 1)) + F.lit(0.5) * F.col("score")).alias("fused"))


@query(_judge_sql(_COS.replace("q.vec_id AS query_id", "q.vec_id AS test_id")).replace(_TESTS, "(SELECT vec_id AS test_id, vec_id + 1 AS expected_id FROM {embeddings} WHERE vec_id % 5 = 0)"))
def accuracy_cosine(t):
    e = t["embeddings"]
    queries = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("test_id"), F.col("embedding").alias("query"), "label")
    catalog = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("std_id"), F.col("embedding").alias("vector"), "label")
    top = matching.top_of(matching.pairs(queries, catalog, F.round(cosine(F.col("query"), F.col("vector")), 6), "test_id", "std_id", "label"), "test_id", "std_id", 5)
    hit = F.col("std_id") == F.col("test_id") + 1
    return top.groupBy("test_id").agg(F.max(F.when(F.col("rank") == 1, F.col("std_id"))).alias("top1_id"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"), F.max((hit & (F.col("rank") == 1)).cast("int")).alias("top1"), F.max((hit & (F.col("rank") <= 3)).cast("int")).alias("top3"), F.max(hit.cast("int")).alias("top5"))


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyweave-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _event_files(t) -> tuple[str, DataFrame]:
    folder = _folder(t.spark)
    events = t["events"]
    events.withColumn("part", F.col("event_id") % 4).repartition(4, "part").drop("part").write.parquet(f"{folder}/in")
    return folder, events


@query("SELECT * FROM {events}")
def stream_append(t):
    """All events arrive as files, twice over; each is appended once."""
    folder, events = _event_files(t)
    for again in (False, True):
        if again:
            events.write.mode("append").parquet(f"{folder}/in")
        incremental.append_new(incremental.changes(t.spark, f"{folder}/in", events.schema), "event_id", f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query("SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type")
def stream_counts(t):
    """Running counts by event type, kept by micro-batches of one file."""
    folder, events = _event_files(t)

    def sink(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/counts/{batch}")

    incremental.keep_counts(incremental.changes(t.spark, f"{folder}/in", events.schema, 1), ["event_type"], sink, f"{folder}/state").awaitTermination()
    return t.spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/counts").groupBy("event_type").agg(F.max_by("n", "batch").alias("n"))


_NEAR = _top(_search("{items}", "norm", True), "norm", 1)


@query(f"""SELECT i.norm, n.std_id AS cosine_id, coalesce(n.score, 0.0E0) * 2 - 1 AS cosine_score, e.std_id AS edit_id, e.score AS edit_score, CASE WHEN n.std_id = e.std_id OR coalesce(n.score, 0.0E0) * 2 - 1 >= e.score THEN n.std_id ELSE e.std_id END AS std_id, greatest(coalesce(n.score, 0.0E0) * 2 - 1, e.score) AS score
    FROM {{items}} i LEFT JOIN ({_NEAR}) AS n ON n.norm = i.norm JOIN ({ORACLE['edit_top1']}) AS e ON e.norm = i.norm""")
def stream_match(t):
    """Items arrive in files and are matched by cosine (of token counts) and edit distance as they come.

    The suggestion (std_id, score) is the id both agree on, else that of the higher score; the cosine wins ties.
    """
    folder = _folder(t.spark)
    items = t["items"].repartition(2, "norm")
    items.write.parquet(f"{folder}/in")
    catalog = t["std"].select("std_id", "category", "description")

    def step(batch: DataFrame, n: int) -> None:
        near = matching.match_search(batch, catalog).select("norm", F.col("std_id").alias("cosine_id"), (F.col("score") * 2 - 1).alias("cosine_score"))
        edit = matching.match_edit(batch, catalog).select("norm", F.col("std_id").alias("edit_id"), F.col("score").alias("edit_score"))
        first = F.coalesce(F.col("cosine_id") == F.col("edit_id"), F.lit(False)) | (F.col("cosine_score") >= F.col("edit_score"))
        voted = near.join(edit, "norm").select("*", F.when(first, F.col("cosine_id")).otherwise(F.col("edit_id")).alias("std_id"), F.greatest("cosine_score", "edit_score").alias("score"))
        voted.write.mode("overwrite").parquet(f"{folder}/out/{n}")

    incremental.in_batches(incremental.changes(t.spark, f"{folder}/in", items.schema, 1), step, f"{folder}/state").awaitTermination()
    return t.spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def harmonize(t, batch: int | None = None) -> DataFrame:
    """The whole run: deduplicate, match by four methods in the category, combine, vote, route, and fan out to items.

    Vector similarity of descriptions stands on token-count vectors, as no embedding model is at hand; so the search
    already has the pair and the cosine, and neither is worked out twice.
    """
    raw, std = t["raw"], t["std"]
    items = matching.batch_of(raw, batch)
    found = matching.match_together(items, std).where("norm is not null")
    wide = found.select("norm", F.col("norm").alias("item_id"), *[x for m in ("search", "edit", "jaccard") for x in (F.col(f"{m}_id").cast("string").alias(f"{m}_id"), f"{m}_score")])
    wide = wide.select("*", F.col("search_id").alias("cosine_id"), (F.col("search_score") * 2 - 1).alias("cosine_score"))
    routed = ensemble.route(ensemble.ensemble(wide), also=("norm", "suggested_id", "ensemble_score")).drop("item_id")
    return raw.select("item_id", normalize_basic(F.col("raw_description")).alias("norm")).join(routed, "norm").select("item_id", "suggested_id", F.round("ensemble_score", 9).alias("ensemble_score"), "destination", "reason")


@query(f"""SELECT r.item_id, y.suggested_id, round(y.ensemble_score, 9) AS ensemble_score, y.destination, y.reason FROM (SELECT item_id, {NORM} AS norm FROM {{raw}}) AS r JOIN (
    SELECT *, CASE WHEN ensemble_score >= 0.8E0 THEN 'ACCEPTED' ELSE 'REVIEW' END AS destination, CASE WHEN ensemble_score >= 0.8E0 THEN 'ENSEMBLE_AGREEMENT' WHEN ensemble_score < 0.4E0 THEN 'VERY_LOW_CONFIDENCE' ELSE 'LOW_CONFIDENCE' END AS reason FROM (
    {DERIVED['scored'].replace('{matches}', 'MATCHES')}) AS s) AS y ON y.norm = r.norm""".replace("MATCHES", f"""(SELECT i.norm, cast(a.std_id AS {V}) AS search_id, coalesce(a.score, 0.0E0) AS search_score, cast(a.std_id AS {V}) AS cosine_id, coalesce(a.score, 0.0E0) * 2 - 1 AS cosine_score, cast(b.std_id AS {V}) AS edit_id, b.score AS edit_score, cast(c.std_id AS {V}) AS jaccard_id, c.score AS jaccard_score
    FROM {{items}} i LEFT JOIN ({_top(_search('{items}', 'norm', True), 'norm', 1)}) AS a ON a.norm = i.norm JOIN ({ORACLE['edit_top1']}) AS b ON b.norm = i.norm JOIN ({ORACLE['jaccard_top1']}) AS c ON c.norm = i.norm) AS mm"""))
def harmonize_flagship(t):
    return harmonize(t)


def _view(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables(spark, sf_dir).sql(VIEWS[name])

    run.__name__ = name
    return run


QUERIES = {k.removesuffix("_query"): f for k, f in QUERIES.items()} | {name: _view(name) for name in VIEWS}
ORACLE = {k.removesuffix("_query"): sql for k, sql in ORACLE.items()} | VIEWS | TOLD
