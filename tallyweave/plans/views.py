"""Analytic views and service queries: each one SQL text over named tables, planned by Catalyst."""

from __future__ import annotations

from ..sources.fixtures import TASKS, V

#: Derived tables of matching, for engines without the operators (the operators make them in Spark).
NORM = "upper(trim(regexp_replace(raw_description, '\\s+', ' ', 'g')))"
_ALL = "search_id IS NOT NULL"


def _vote() -> str:
    pairs = {"s": "search_id", "c": "cosine_id", "e": "edit_id", "j": "jaccard_id"}
    whens = [" AND ".join(f"{pairs[c[0]]} = {pairs[x]}" for x in c[1:]) for c in ("scej", "sce", "scj", "sej", "cej", "sc", "se", "sj", "ce", "cj", "ej")]
    firsts = [c[0] for c in ("scej", "sce", "scj", "sej", "cej", "sc", "se", "sj", "ce", "cj", "ej")]
    return " ".join(f"WHEN {w} THEN {pairs[f]}" for w, f in zip(whens, firsts, strict=True))


def _level(guard: bool) -> str:
    """4, 3, 2 or 1 by how many ids agree."""
    v = {k: (f"nullif({k}_id, 'None')" if guard else f"{k}_id") for k in ("search", "cosine", "edit", "jaccard")}
    s, c, e, j = v.values()
    return (f"CASE WHEN {s} = {c} AND {c} = {e} AND {e} = {j} THEN 4 WHEN ({s} = {c} AND {c} = {e}) OR ({s} = {c} AND {c} = {j}) OR ({s} = {e} AND {e} = {j}) OR ({c} = {e} AND {e} = {j}) THEN 3 "
            f"WHEN {s} = {c} OR {s} = {e} OR {s} = {j} OR {c} = {e} OR {c} = {j} OR {e} = {j} THEN 2 ELSE 1 END")  # fmt: skip


DERIVED: dict[str, str] = {
    "scored": f"""SELECT *, least(1.0E0, (search_score * 0.55E0 + cosine_score * 0.25E0 + edit_score * 0.12E0 + jaccard_score * 0.18E0) / (0.55E0 + 0.25E0 + 0.12E0 + 0.18E0)
            * CASE {_level(True)} WHEN 4 THEN 1.2E0 WHEN 3 THEN 1.15E0 WHEN 2 THEN 1.1E0 ELSE 1.0E0 END) AS ensemble_score,
        CASE {_vote()} WHEN search_score >= cosine_score AND search_score >= edit_score AND search_score >= jaccard_score THEN search_id
            WHEN cosine_score >= edit_score AND cosine_score >= jaccard_score THEN cosine_id WHEN edit_score >= jaccard_score THEN edit_id ELSE jaccard_id END AS suggested_id
        FROM {{matches}} WHERE search_score IS NOT NULL AND cosine_score IS NOT NULL AND edit_score IS NOT NULL AND jaccard_score IS NOT NULL""",
    "m": "",
    "eff": """SELECT r.item_id, r.source_system, r.category, r.subcategory, r.raw_description, r.status AS raw_status, m.status AS match_status, r.created_at, r.amount, m.match_id,
            CASE WHEN r.status IN ('AUTO_ACCEPTED', 'CONFIRMED', 'REJECTED') THEN r.status ELSE coalesce(m.status, r.status) END AS effective,
            m.search_score, m.cosine_score, m.edit_score, m.jaccard_score, m.search_id, m.cosine_id, m.edit_id, m.jaccard_id, m.ensemble_score, m.suggested_id, m.confirmed_id
        FROM {raw} r LEFT JOIN {m} m ON m.item_id = r.item_id""",
    "uniq": f"SELECT {NORM} AS norm, min(raw_description) AS sample, count(*) AS n_items, min(created_at) AS first_seen, max(created_at) AS last_seen FROM {{raw}} WHERE status = 'PENDING' GROUP BY 1",
    "items": f"""SELECT norm, category FROM (SELECT {NORM} AS norm, category, row_number() OVER (PARTITION BY {NORM} ORDER BY item_id) AS k FROM {{raw}}) AS x
        WHERE k = 1 AND category IS NOT NULL AND upper(trim(category)) NOT IN ('UNKNOWN', 'NULL', 'NONE', '')""",
    "routes": """SELECT item_id, CASE WHEN none THEN 'REJECTED' WHEN ensemble_score >= 0.8E0 THEN 'ACCEPTED' ELSE 'REVIEW' END AS destination, cast(ensemble_score AS decimal(5, 4)) AS confidence,
            CASE WHEN none THEN 'NO_CANDIDATE' WHEN ensemble_score >= 0.8E0 THEN 'ENSEMBLE_AGREEMENT' WHEN ensemble_score < 0.4E0 THEN 'VERY_LOW_CONFIDENCE' ELSE 'LOW_CONFIDENCE' END AS reason
        FROM (SELECT *, coalesce(search_id, 'None') = 'None' AND coalesce(cosine_id, 'None') = 'None' AND coalesce(edit_id, 'None') = 'None' AND coalesce(jaccard_id, 'None') = 'None' AS none FROM {scored}) AS x""",
}

# The same without leaving rows out: what needs all four scores is null without them. One projection, no join.
_WHOLE = "search_score IS NOT NULL AND cosine_score IS NOT NULL AND edit_score IS NOT NULL AND jaccard_score IS NOT NULL"
_SCORE, _SUGGESTED = (x.strip() for x in DERIVED["scored"].removeprefix("SELECT *, ").split("FROM {matches}")[0].split(" AS ensemble_score,"))
DERIVED["m"] = f"SELECT *, CASE WHEN {_WHOLE} THEN {_SCORE} END AS ensemble_score, CASE WHEN {_WHOLE} THEN {_SUGGESTED.removesuffix('AS suggested_id').strip()} END AS suggested_id FROM {{matches}}"

_BUCKET = "CASE WHEN {x} < 0.5E0 THEN '1: <50%' WHEN {x} < 0.7E0 THEN '2: 50-70%' WHEN {x} < 0.8E0 THEN '3: 70-80%' WHEN {x} < 0.9E0 THEN '4: 80-90%' ELSE '5: 90%+' END"


def _bucket(x: str) -> str:
    return _BUCKET.replace("{x}", x)


def _rate(n: str, of: str) -> str:
    return f"round(cast({n} AS double) / nullif({of}, 0), 6)"


def _pct(n: str, of: str) -> str:
    return f"round({n} * 100.0E0 / nullif({of}, 0), 2)"


def _seconds(a: str, b: str) -> str:
    """Whole seconds from a to b, by the seconds' boundaries between them."""
    return f"timestampdiff(SECOND, date_trunc('second', {a}), date_trunc('second', {b}))"


def _days(a: str, b: str) -> str:
    return f"timestampdiff(DAY, date_trunc('day', {a}), date_trunc('day', {b}))"


def _by_method(*of: str) -> str:
    """For each `of`, that column of the row's method s.method."""
    return ", ".join("CASE s.method " + " ".join(f"WHEN '{k}' THEN {k}_{c}" for k in ("search", "cosine", "edit", "jaccard")) + f" END AS {c}" for c in of)


_METHODS = "(VALUES ('search'), ('cosine'), ('edit'), ('jaccard')) AS s(method)"
_FOUR = ("search", "cosine", "edit", "jaccard")
_FIVE = {k: f"{k}_id" for k in _FOUR} | {"ensemble": "suggested_id"}
_TOPS = (("is_correct", "top1"), ("in_top3", "top3"), ("in_top5", "top5"))
_LAST_RUN = "run_id = (SELECT run_id FROM {results} ORDER BY run_no DESC, run_id LIMIT 1)"
_TODAY = "(SELECT max(created_at) FROM {raw})"
_LEVEL = _level(False)
_BEST = "greatest(coalesce(search_score, 0.0E0), coalesce(cosine_score, 0.0E0), coalesce(edit_score, 0.0E0))"
_PRIMARY = """CASE WHEN coalesce(search_score, 0.0E0) >= coalesce(cosine_score, 0.0E0) AND coalesce(search_score, 0.0E0) >= coalesce(edit_score, 0.0E0) AND coalesce(search_score, 0.0E0) >= coalesce(jaccard_score, 0.0E0) THEN 'SEARCH'
    WHEN coalesce(cosine_score, 0.0E0) >= coalesce(edit_score, 0.0E0) AND coalesce(cosine_score, 0.0E0) >= coalesce(jaccard_score, 0.0E0) THEN 'COSINE' WHEN coalesce(edit_score, 0.0E0) >= coalesce(jaccard_score, 0.0E0) THEN 'EDIT' ELSE 'JACCARD' END"""
_NAMED = "(CASE WHEN search_id = suggested_id THEN 1 ELSE 0 END + CASE WHEN cosine_id = suggested_id THEN 1 ELSE 0 END + CASE WHEN edit_id = suggested_id THEN 1 ELSE 0 END + CASE WHEN jaccard_id = suggested_id THEN 1 ELSE 0 END)"
_SHOWN = "CASE effective WHEN 'USER_CONFIRMED' THEN 'CONFIRMED' ELSE effective END"
_NOW = "(SELECT max(ts) FROM {steps})"

VIEWS: dict[str, str] = {
    # sources, filters
    "scan_filter": "SELECT item_id, raw_description, source_system FROM {raw} WHERE status = 'PENDING'",
    "values_source": "SELECT config_key, config_value FROM {config}",
    "effective_status": "SELECT item_id, raw_status, match_status, effective FROM {eff}",
    "confidence_buckets": f"SELECT item_id, {_bucket('ensemble_score')} AS bucket FROM {{scored}}",
    "eligible_items": "SELECT item_id, category FROM {raw} WHERE category IS NOT NULL AND upper(trim(category)) NOT IN ('UNKNOWN', 'NULL', 'NONE', '')",
    "log_search": "SELECT event_id, step, status FROM {steps} WHERE lower(step) LIKE '%c%' AND status LIKE '%ED'",
    # joins
    "join_inner": "SELECT r.item_id, r.source_system, s.description, s.brand FROM {raw} r JOIN {std} s ON s.std_id = r.true_id",
    "join_left": "SELECT r.item_id, r.status, m.match_id FROM {raw} r LEFT JOIN {matches} m ON m.item_id = r.item_id",
    "join_full": """SELECT coalesce(c.item_id, e.item_id) AS item_id, c.cosine_id, e.edit_id FROM (SELECT item_id, cosine_id FROM {matches} WHERE cosine_score >= 0.5E0) AS c
        FULL JOIN (SELECT item_id, edit_id FROM {matches} WHERE edit_score >= 0.5E0) AS e ON c.item_id = e.item_id""",
    "anti_join": "SELECT item_id FROM {raw} r WHERE NOT EXISTS (SELECT 1 FROM {matches} m WHERE m.item_id = r.item_id)",
    "semi_join": "SELECT item_id, source_system FROM {raw} WHERE item_id IN (SELECT item_id FROM {matches} WHERE status = 'USER_CONFIRMED')",
    "semi_join_exists": "SELECT r.item_id, r.source_system FROM {raw} r WHERE EXISTS (SELECT 1 FROM {matches} m JOIN {std} s ON cast(s.std_id AS " + V + ") = m.confirmed_id WHERE m.item_id = r.item_id AND s.age_days <= 7)",
    "orphan_items": "SELECT count(*) AS orphans FROM {raw} r WHERE r.status = 'PENDING' AND NOT EXISTS (SELECT 1 FROM {matches} m WHERE m.item_id = r.item_id AND m.search_score IS NOT NULL)",
    "reeval_std_change": "SELECT m.item_id, 'PENDING_REVIEW' AS status, concat(coalesce(m.reasoning, ''), ' [RE-EVAL: standard item modified]') AS reasoning FROM {m} m WHERE m.status = 'AUTO_ACCEPTED' AND (m.suggested_id IN (SELECT cast(std_id AS " + V + ") FROM {std} WHERE age_days <= 7) OR m.confirmed_id IN (SELECT cast(std_id AS " + V + ") FROM {std} WHERE age_days <= 7))",
    "log_steps": """SELECT a.run_id, a.step, a.event_id, coalesce(b.status, 'RUNNING') AS status, b.duration_ms FROM {steps} a LEFT JOIN (SELECT run_id, step, max(status) AS status, max(duration_ms) AS duration_ms FROM {steps} WHERE status IN ('COMPLETED', 'FAILED') GROUP BY run_id, step) AS b
        ON b.run_id = a.run_id AND coalesce(b.step, '') = coalesce(a.step, '') WHERE a.status = 'STARTED'""",
    "item_trace": """SELECT item_id, '1_RAW' AS step, raw_description AS detail FROM {raw} UNION ALL SELECT item_id, '2_NORMALIZED', """ + NORM + """ FROM {raw}
        UNION ALL SELECT r.item_id, '3_UNIQUE', concat(u.norm, ' (', cast(u.n_items AS """ + V + """), ' items)') FROM (SELECT item_id, """ + NORM + """ AS norm FROM {raw}) AS r JOIN {uniq} u ON u.norm = r.norm
        UNION ALL SELECT item_id, '4_MATCH', concat(coalesce(suggested_id, 'None'), ', ', status, ', ', coalesce(cast(cast(round(ensemble_score, 4) AS decimal(6, 4)) AS """ + V + """), 'no score')) FROM {m}
        UNION ALL SELECT m.item_id, '5_STANDARD', s.description FROM {m} m JOIN {std} s ON coalesce(m.confirmed_id, m.suggested_id) = cast(s.std_id AS """ + V + ")",
    # aggregates and windows
    "dup_count": f"SELECT item_id, count(*) OVER (PARTITION BY norm) AS duplicates FROM (SELECT item_id, {NORM} AS norm FROM {{raw}}) AS x",
    "dup_distinct": f"SELECT source_system, count(DISTINCT {NORM}) AS n_unique FROM {{raw}} GROUP BY source_system",
    "filter_options": "SELECT DISTINCT 'source' AS kind, source_system AS value FROM {raw} UNION ALL SELECT DISTINCT 'category', category FROM {raw} WHERE category IS NOT NULL UNION ALL SELECT DISTINCT 'status', status FROM {raw}",
    "latency_summary": "SELECT x.*, CASE WHEN total_seconds < 60 THEN concat(cast(total_seconds AS " + V + "), 's') WHEN total_seconds < 3600 THEN concat(cast(cast(round(total_seconds / 60.0E0, 1) AS decimal(9, 1)) AS " + V + "), 'm') ELSE concat(cast(cast(round(total_seconds / 3600.0E0, 1) AS decimal(9, 1)) AS " + V + "), 'h') END AS latency, CASE WHEN failed = 0 THEN 'SUCCESS' ELSE 'PARTIAL_FAILURE' END AS run_status FROM (SELECT date_trunc('minute', ts) AS minute, min(ts) AS started, max(ended) AS ended, " + _seconds("min(ts)", "max(ended)") + " AS total_seconds, " + ", ".join(f"sum(CASE WHEN task = '{t}' THEN seconds ELSE 0 END)::bigint AS {k}_seconds" for t, k in TASKS.items()) + ", count(DISTINCT event_id) AS n_tasks, sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END)::bigint AS failed FROM {tasks} WHERE status IN ('COMPLETED', 'FAILED') GROUP BY 1) AS x",
    "latency_met": "SELECT count(*) AS n_runs, round(avg(seconds), 6) AS mean_seconds, sum(CASE WHEN seconds <= 300 THEN 1 ELSE 0 END)::bigint AS met FROM (SELECT run_id, " + _seconds("min(ts)", "max(ended)") + " AS seconds, max(ended) AS last FROM {tasks} GROUP BY run_id ORDER BY last DESC, run_id LIMIT 10) AS x",
    "methods_tested": "SELECT run_id, array_join(array_sort(collect_set(method)), ', ') AS methods, count(DISTINCT test_id) AS n_tests, count(*) AS n_results FROM {results} GROUP BY run_id",
    "representative_row": f"SELECT norm, item_id, raw_description FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY item_id) AS k FROM (SELECT item_id, raw_description, {NORM} AS norm FROM {{raw}}) AS y) AS x WHERE k = 1",
    "staging_latest": "SELECT run_id, step, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY ts DESC, event_id DESC) AS k FROM {steps}) AS x WHERE k = 1",
    "difficulty_share": "SELECT difficulty, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM {tests} GROUP BY difficulty",
    "distribution_report": "SELECT category, difficulty, count(*) AS n FROM {tests} GROUP BY category, difficulty",
    "ensemble_topn": "SELECT item_id, ensemble_score FROM {scored} ORDER BY ensemble_score DESC, item_id LIMIT 20",
    "signals_pct": f"SELECT primary_source, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT {_PRIMARY} AS primary_source FROM {{matches}}) AS x GROUP BY primary_source",
    # dashboards
    "dashboard_kpis": """SELECT count(*) AS total, sum(CASE WHEN effective = 'AUTO_ACCEPTED' THEN 1 ELSE 0 END)::bigint AS auto_accepted, sum(CASE WHEN effective IN ('CONFIRMED', 'USER_CONFIRMED') THEN 1 ELSE 0 END)::bigint AS confirmed,
        sum(CASE WHEN effective = 'PENDING_REVIEW' THEN 1 ELSE 0 END)::bigint AS pending_review, sum(CASE WHEN effective = 'REJECTED' THEN 1 ELSE 0 END)::bigint AS rejected, sum(CASE WHEN effective = 'PENDING' THEN 1 ELSE 0 END)::bigint AS pending FROM {eff}""",
    "dashboard_sources": f"SELECT source_system, {_SHOWN} AS status, count(*) AS n FROM {{eff}} GROUP BY 1, 2",
    "dashboard_categories": "SELECT t.category, count(e.item_id) AS total, sum(CASE WHEN e.effective IN ('AUTO_ACCEPTED', 'CONFIRMED', 'USER_CONFIRMED') THEN 1 ELSE 0 END)::bigint AS matched FROM (SELECT DISTINCT category FROM {std}) AS t LEFT JOIN {eff} e ON e.category = t.category GROUP BY t.category",
    "confidence_best": f"SELECT {_bucket(_BEST)} AS bucket, count(*) AS n FROM {{matches}} GROUP BY 1",
    "confidence_ensemble": f"SELECT {_bucket('ensemble_score')} AS bucket, count(*) AS n FROM {{scored}} WHERE ensemble_score IS NOT NULL GROUP BY 1",
    "scale": "SELECT r.n AS n_raw, u.n AS n_unique, c.n AS n_cached, round(u.n / cast(r.n AS double), 6) AS dedup_ratio, round(100.0E0 * c.n / nullif(u.n, 0), 6) AS fast_path_pct FROM (SELECT count(*) AS n FROM {raw}) AS r CROSS JOIN (SELECT count(*) AS n FROM {uniq}) AS u CROSS JOIN (SELECT count(*) AS n FROM {confirmed}) AS c",
    "optimization_metrics": "SELECT n, cache_hits, {cache} AS cache_hit_pct, four_way, three_way, two_way, {four} AS four_way_pct, {three} AS three_way_pct, {two} AS two_way_pct, mean_score, four_way_score FROM (SELECT count(*) AS n, sum(CASE WHEN is_cached THEN 1 ELSE 0 END)::bigint AS cache_hits, sum(CASE WHEN level = 4 THEN 1 ELSE 0 END)::bigint AS four_way, sum(CASE WHEN level >= 3 AND whole THEN 1 ELSE 0 END)::bigint AS three_way, sum(CASE WHEN level >= 2 THEN 1 ELSE 0 END)::bigint AS two_way, round(avg(ensemble_score), 4) AS mean_score, round(avg(CASE WHEN level = 4 THEN ensemble_score END), 4) AS four_way_score FROM (SELECT is_cached, {level} AS level, search_id IS NOT NULL AND cosine_id IS NOT NULL AND edit_id IS NOT NULL AND jaccard_id IS NOT NULL AS whole, ensemble_score FROM {{m}} WHERE ensemble_score IS NOT NULL) AS x) AS y".format(level=_LEVEL, cache=_pct("cache_hits", "n"), four=_pct("four_way", "n"), three=_pct("three_way", "n"), two=_pct("two_way", "n")),
    "method_accuracy": "SELECT n AS total_confirmed, " + ", ".join(f"{k}_right, {_pct(f'{k}_right', 'n')} AS {k}_pct, {k}_score" for k in _FIVE) + " FROM (SELECT count(*) AS n, " + ", ".join(f"sum(CASE WHEN {i} = confirmed_id THEN 1 ELSE 0 END)::bigint AS {k}_right, round(avg(CASE WHEN {i} = confirmed_id THEN {k}_score END), 4) AS {k}_score" for k, i in _FIVE.items()) + " FROM {m} WHERE status = 'USER_CONFIRMED' AND confirmed_id IS NOT NULL) AS x",
    "task_metrics": "SELECT event_id, task, status, ts, ended, seconds, CASE WHEN seconds < 60 THEN concat(cast(seconds AS " + V + "), 's') WHEN seconds < 3600 THEN concat(cast(cast(round(seconds / 60.0E0, 1) AS decimal(9, 1)) AS " + V + "), 'm') ELSE concat(cast(cast(round(seconds / 3600.0E0, 1) AS decimal(9, 1)) AS " + V + "), 'h') END AS duration, CASE task " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in TASKS.items()) + " ELSE 'other' END AS kind FROM {tasks}",
    "task_history": "SELECT task, count(*) AS runs, sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END)::bigint AS completed, sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END)::bigint AS failed, max(ended) AS last_ended, round(avg(seconds), 6) AS mean_seconds FROM {tasks} GROUP BY task",
    "task_state": "SELECT task, status, ts, seconds FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts DESC, event_id DESC) AS k FROM {tasks}) AS x WHERE k = 1",
    "phase_status": f"""SELECT b.batch_id, b.created_at AS batch_started, r.total AS raw_items, r.total - r.blocked AS categorized, r.blocked, u.n AS unique_descriptions, p.total AS pipeline_items, p.search_done, p.cosine_done, p.edit_done, p.jaccard_done, p.ensemble_done,
        {", ".join(f"round({k}_done * 100.0E0 / nullif(p.total, 0), 1) AS {k}_pct" for k in (*_FOUR, "ensemble"))}, {", ".join(f"CASE WHEN {k}_done = 0 THEN 'WAITING' WHEN {k}_done >= p.total THEN 'COMPLETE' ELSE 'PROCESSING' END AS {k}_state" for k in _FOUR)},
        CASE WHEN least(search_done, cosine_done, edit_done, jaccard_done) < p.total THEN 'WAITING' WHEN ensemble_done >= p.total THEN 'COMPLETE' ELSE 'PROCESSING' END AS ensemble_state,
        CASE {" ".join(f"WHEN {k}_done < p.total THEN concat('{k} (', cast(p.total - {k}_done AS {V}), ' remaining)')" for k in _FOUR)} END AS waiting_for,
        CASE WHEN p.total = 0 THEN 'EMPTY' WHEN ensemble_done >= p.total THEN 'COMPLETE' WHEN greatest(search_done, cosine_done, edit_done, jaccard_done) = 0 THEN 'NOT_STARTED' ELSE 'PROCESSING' END AS pipeline_state
        FROM (SELECT count(*) AS total, {", ".join(f"count(m.{k}_score) AS {k}_done" for k in (*_FOUR, "ensemble"))} FROM {{m}} m JOIN {{raw}} r ON r.item_id = m.item_id WHERE r.category IS NOT NULL AND upper(r.category) NOT IN ('UNKNOWN', 'NULL', 'NONE', '')) AS p
        CROSS JOIN (SELECT count(*) AS total, count(CASE WHEN category IS NULL OR upper(category) IN ('UNKNOWN', 'NULL', 'NONE', '') THEN 1 END) AS blocked FROM {{raw}}) AS r CROSS JOIN (SELECT count(*) AS n FROM {{uniq}}) AS u
        LEFT JOIN (SELECT batch_id, created_at FROM {{batches}} WHERE status = 'ACTIVE' ORDER BY created_at DESC, batch_id LIMIT 1) AS b ON 1 = 1""",
    "item_stages": f"""SELECT CASE WHEN NOT ({_WHOLE}) THEN '1_SCORES_PENDING' WHEN ensemble_score IS NULL THEN '2_ENSEMBLE_READY' WHEN status NOT IN ('AUTO_ACCEPTED', 'CONFIRMED', 'PENDING_REVIEW', 'REJECTED') THEN '3_SCORED_UNROUTED' WHEN status IN ('AUTO_ACCEPTED', 'CONFIRMED') THEN '4_ROUTED'
        WHEN status = 'PENDING_REVIEW' THEN '4_PENDING_REVIEW' WHEN status = 'REJECTED' THEN '4_REJECTED' ELSE '9_UNKNOWN' END AS stage, count(*) AS n, min(created_at) AS oldest, max(updated_at) AS newest, round(avg({_days('created_at', _TODAY)} * 1440.0E0), 6) AS mean_age_minutes FROM {{m}} GROUP BY 1""",
    "cost_comparison": """SELECT runs, items, items - fast_path AS matched_items, fast_path AS fast_path_items, round(units, 4) AS units, round(spent, 2) AS spent, round(spent / nullif(items, 0), 4) AS cost_per_item, round((manual - spent) / hourly, 1) AS hours_saved,
        round(CASE WHEN spent > 0 THEN (manual - spent) / spent * 100 ELSE 0 END, 0) AS roi_pct, round(manual, 2) AS manual_cost, round(manual - spent, 2) AS savings, round(cast(fast_path AS double) / nullif(items, 0), 4) AS fast_path_ratio, rate, hourly, minutes
        FROM (SELECT t.runs, b.items, f.fast_path, t.units, t.units * c.rate AS spent, c.rate, c.hourly, c.minutes, b.items * (c.minutes / 60.0E0) * c.hourly AS manual FROM (SELECT max(CASE WHEN config_key = 'COST_PER_UNIT' THEN cast(config_value AS double) END) AS rate,
            coalesce(max(CASE WHEN config_key = 'MANUAL_HOURLY_RATE' THEN cast(config_value AS double) END), 50.0E0) AS hourly, coalesce(max(CASE WHEN config_key = 'MANUAL_MINUTES_PER_ITEM' THEN cast(config_value AS double) END), 3.0E0) AS minutes FROM {config}) AS c
        CROSS JOIN (SELECT count(DISTINCT run_id) AS runs, sum(seconds) / 3600.0E0 AS units FROM {tasks} WHERE status = 'COMPLETED') AS t CROSS JOIN (SELECT coalesce(sum(item_count), 0)::bigint AS items FROM {batches} WHERE status = 'COMPLETED') AS b CROSS JOIN (SELECT count(*) AS fast_path FROM {confirmed}) AS f) AS x""",
    "accuracy_latest_run": "SELECT run_id, method, count(*) AS n, sum(CASE WHEN is_correct THEN 1 ELSE 0 END)::bigint AS n_correct FROM {results} WHERE run_id = (SELECT run_id FROM {results} ORDER BY run_no DESC LIMIT 1) GROUP BY run_id, method",
    "accuracy_summary": "SELECT method, count(*) AS n, " + ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)::bigint AS {k}, round(sum(CASE WHEN {c} THEN 1 ELSE 0 END) * 100.0E0 / count(*), 1) AS {k}_pct" for c, k in _TOPS) + f" FROM {{results}} WHERE {_LAST_RUN} GROUP BY method",
    "accuracy_by_difficulty": "SELECT method, difficulty, CASE difficulty WHEN 'EASY' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS place, count(*) AS n, " + ", ".join(f"round(sum(CASE WHEN {c} THEN 1 ELSE 0 END) * 100.0E0 / count(*), 1) AS {k}_pct" for c, k in _TOPS) + f" FROM {{results}} WHERE {_LAST_RUN} GROUP BY method, difficulty",
    "accuracy_failures": f"SELECT r.test_id, r.method, t.difficulty, t.raw_description, t.expected_id, s.description AS actual_match, round(r.top1_score, 3) AS score FROM {{results}} r JOIN {{tests}} t ON t.test_id = r.test_id LEFT JOIN {{std}} s ON s.std_id = r.top1_id WHERE r.{_LAST_RUN} AND NOT r.is_correct",
    "failures_page": f"SELECT r.test_id, r.method, t.difficulty, round(r.top1_score, 3) AS score FROM {{results}} r JOIN {{tests}} t ON t.test_id = r.test_id WHERE r.{_LAST_RUN} AND NOT r.is_correct ORDER BY r.method, t.difficulty, r.test_id LIMIT 20 OFFSET 20",
    "accuracy_report": "SELECT method, difficulty, " + ", ".join(f"round(100.0E0 * avg(CASE WHEN {c} THEN 1.0E0 ELSE 0.0E0 END), 6) AS {n}" for c, n in (("is_correct", "top1_pct"), ("in_top3", "top3_pct"), ("in_top5", "top5_pct"))) + " FROM {results} GROUP BY method, difficulty",
    "accuracy_expected": "SELECT t.test_id, min(s.std_id) AS expected_id FROM {tests} t JOIN {std} x ON x.std_id = t.expected_id JOIN {std} s ON lower(s.description) = lower(x.description) GROUP BY t.test_id",
    "pipeline_stats": f"""SELECT s.metric, CASE s.metric WHEN 'total_raw_items' THEN total WHEN 'total_standard_items' THEN catalog WHEN 'total_matched' THEN matched WHEN 'pending_review' THEN in_review WHEN 'unprocessed' THEN unprocessed WHEN 'mean_confidence' THEN confidence ELSE agreement END AS value FROM (SELECT r.total, r.matched, r.in_review, r.unprocessed, c.n AS catalog, m.confidence, m.agreement FROM (SELECT count(*) AS total, count(CASE WHEN status IN ('AUTO_ACCEPTED', 'CONFIRMED') THEN 1 END) AS matched, count(CASE WHEN status = 'PENDING_REVIEW' THEN 1 END) AS in_review, count(CASE WHEN status = 'PENDING' THEN 1 END) AS unprocessed FROM {{raw}}) AS r
        CROSS JOIN (SELECT count(*) AS n FROM {{std}}) AS c CROSS JOIN (SELECT round(avg(ensemble_score), 4) AS confidence, round(sum(CASE WHEN {_LEVEL} = 4 THEN 1 ELSE 0 END) / cast(nullif(count(*), 0) AS double), 4) AS agreement FROM {{scored}}) AS m) AS x
        CROSS JOIN (VALUES ('total_raw_items'), ('total_standard_items'), ('total_matched'), ('pending_review'), ('unprocessed'), ('mean_confidence'), ('method_agreement_rate')) AS s(metric)""",
    "signal_dominance": f"SELECT {_PRIMARY} AS method, count(*) AS n FROM {{m}} WHERE suggested_id IS NOT NULL GROUP BY 1",
    "signal_alignment": f"SELECT method, count(score) AS n, sum(CASE WHEN id = suggested_id THEN 1 ELSE 0 END)::bigint AS aligned, round(avg(abs(score - ensemble_score)), 6) AS distance FROM (SELECT s.method, {_by_method('id', 'score')}, suggested_id, ensemble_score FROM {{scored}} CROSS JOIN {_METHODS}) AS x GROUP BY method",
    "agreement_hist": f"SELECT {_NAMED} AS named, count(*) AS n FROM {{scored}} GROUP BY 1",
    "agreement_level": f"SELECT item_id, {_LEVEL} AS level FROM {{matches}}",
    "primary_source": f"SELECT item_id, {_PRIMARY} AS method FROM {{matches}}",
    "agreement_analysis": f"SELECT concat(CASE level WHEN 1 THEN '0' ELSE cast(level AS {V}) END, ' of 4 Agree') AS agreement, count(*) AS n, round(avg(ensemble_score), 4) AS confidence FROM (SELECT {_level(True)} AS level, ensemble_score FROM {{scored}}) AS x GROUP BY 1",
    "activity": "SELECT item_id, status, created_at FROM {matches} ORDER BY created_at DESC, item_id DESC LIMIT 20",
    "source_performance": "SELECT r.source_system, count(*) AS n, " + ", ".join(f"round(avg(m.{k}_score), 6) AS {k}_mean" for k in ("search", "cosine", "edit", "jaccard")) + " FROM {raw} r JOIN {matches} m ON m.item_id = r.item_id GROUP BY r.source_system",
    "match_search": f"""SELECT norm, item_id, shown, duplicates, ensemble_score FROM (SELECT *, count(*) OVER (PARTITION BY norm) AS duplicates, row_number() OVER (PARTITION BY norm ORDER BY ensemble_score DESC NULLS LAST, item_id) AS k FROM (SELECT {NORM} AS norm, item_id, {_SHOWN} AS shown, ensemble_score, {_LEVEL} AS level
        FROM {{eff}} WHERE effective = 'PENDING_REVIEW' AND source_system = 'SRC_1') AS x) AS y WHERE k = 1 AND level >= 2 ORDER BY ensemble_score DESC NULLS LAST, norm LIMIT 50 OFFSET 25""",
    "alternatives": f"SELECT item_id, method, id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, method) AS k FROM (SELECT item_id, s.method, {_by_method('id', 'score')} FROM {{matches}} CROSS JOIN {_METHODS}) AS c WHERE id IS NOT NULL AND score IS NOT NULL) AS x WHERE k <= 10",
    "recent_errors": f"SELECT event_id, step, ts FROM {{steps}} WHERE status = 'FAILED' AND ts >= {_NOW} - INTERVAL 7 DAY ORDER BY ts DESC, event_id LIMIT 100",
    "audit_log": "SELECT match_id, status AS action, locked_by AS reviewer, created_at FROM {matches} WHERE status IN ('USER_CONFIRMED', 'USER_REJECTED') ORDER BY created_at DESC, match_id LIMIT 100",
    "step_counts": f"SELECT step, status, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms FROM {{steps}} WHERE ts >= {_NOW} - INTERVAL 1 DAY GROUP BY step, status",
    "classification_progress": "SELECT count(*) AS total, sum(CASE WHEN category IS NULL THEN 0 ELSE 1 END)::bigint AS classified, " + _rate("sum(CASE WHEN category IS NULL THEN 0 ELSE 1 END)", "count(*)") + " AS progress FROM {raw}",
    "test_stats": "SELECT count(*) AS n, count(DISTINCT category) AS n_categories, sum(CASE WHEN difficulty = 'EASY' THEN 1 ELSE 0 END)::bigint AS easy, sum(CASE WHEN difficulty = 'MEDIUM' THEN 1 ELSE 0 END)::bigint AS medium, sum(CASE WHEN difficulty = 'HARD' THEN 1 ELSE 0 END)::bigint AS hard FROM {tests}",
    "pipeline_status": "SELECT status, count(*) AS n, min(created_at) AS oldest FROM {raw} GROUP BY status",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {{{t}}}" for t in ("raw", "std", "matches", "uniq", "confirmed", "steps", "tests")),
    "tasks_done": "SELECT run_id, count(DISTINCT step) AS n_done, count(DISTINCT step) = 4 AS all_done FROM {steps} WHERE status = 'COMPLETED' GROUP BY run_id",
    "parent_status": f"SELECT step, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY ts DESC, event_id DESC) AS k FROM {{steps}} WHERE status IN ('COMPLETED', 'FAILED') AND ts >= {_NOW} - INTERVAL 1 DAY) AS x WHERE k = 1",
    "retention_cleanup": f"SELECT event_id, run_id FROM {{steps}} WHERE ts >= {_NOW} - INTERVAL 7 DAY",
    # re-evaluation
    "reeval_threshold": "SELECT m.item_id, 'PENDING_REVIEW' AS status, CASE WHEN r.status IN ('PENDING', 'PENDING_REVIEW') THEN r.status ELSE 'PENDING_REVIEW' END AS raw_status, concat(coalesce(m.reasoning, ''), ' [RE-EVAL: score below threshold ', c.config_value, ']') AS reasoning FROM {m} m JOIN {raw} r ON r.item_id = m.item_id CROSS JOIN (SELECT config_value FROM {config} WHERE config_key = 'AUTO_ACCEPT_THRESHOLD') AS c WHERE m.status = 'AUTO_ACCEPTED' AND m.ensemble_score < cast(c.config_value AS double)",
    "reeval_thumbs_down": "SELECT m.item_id, 'PENDING_REVIEW' AS status, CASE WHEN r.status IN ('AUTO_ACCEPTED', 'AUTO_MATCHED') THEN 'PENDING_REVIEW' ELSE r.status END AS raw_status, m.reasoning FROM {matches} m JOIN {raw} r ON r.item_id = m.item_id WHERE m.status = 'AUTO_ACCEPTED' AND m.reasoning LIKE '%[RE-EVAL: negative feedback]%'",
    "reeval_audit": "SELECT item_id, created_at, 'PENDING_REVIEW' AS status, concat(coalesce(reasoning, ''), ' [RE-EVAL: periodic audit spot-check]') AS reasoning FROM {matches} WHERE status = 'AUTO_ACCEPTED' ORDER BY created_at, item_id LIMIT 50",
    "reeval_bulk": "SELECT item_id, 'PENDING_REVIEW' AS status, concat(coalesce(reasoning, ''), ' [RE-EVAL: bulk]') AS reasoning, ensemble_score FROM {m} WHERE status = 'AUTO_ACCEPTED' AND ensemble_score IS NOT NULL ORDER BY ensemble_score, item_id LIMIT 200",
    "reeval_reconfirm": "SELECT item_id, CASE WHEN status = 'PENDING_REVIEW' THEN 'USER_CONFIRMED' ELSE status END AS status, CASE WHEN status = 'PENDING_REVIEW' THEN regexp_replace(reasoning, '\\s*\\[RE-EVAL:[^\\]]*\\]', '', 'g') ELSE reasoning END AS reasoning FROM {matches} WHERE reasoning IS NOT NULL",
    "reeval_force": "SELECT item_id, CASE WHEN status IN ('AUTO_ACCEPTED', 'PENDING_REVIEW') THEN 'PENDING' ELSE status END AS status, " + ", ".join(f"CASE WHEN status IN ('AUTO_ACCEPTED', 'PENDING_REVIEW') THEN NULL ELSE {k}_score END AS {k}_score" for k in _FOUR) + " FROM {matches}",
    "early_exit": f"SELECT item_id, (({_LEVEL}) >= 3 AND (search_score + cosine_score + edit_score + jaccard_score) / 4.0E0 >= 0.85E0) OR (({_LEVEL}) >= 2 AND greatest(search_score, cosine_score, edit_score, jaccard_score) >= 0.9E0) AS skip FROM {{scored}}",
    "two_signal_vote": "SELECT item_id, CASE WHEN cosine_id = edit_id THEN cosine_id WHEN coalesce(cosine_score, 0.0E0) >= coalesce(edit_score, 0.0E0) THEN cosine_id ELSE edit_id END AS suggested_id FROM {matches}",
    # classification around given labels
    "classify_validate": "SELECT r.item_id, CASE WHEN r.category IS NULL OR length(r.category) > 50 OR t.category IS NULL THEN 'UNKNOWN' ELSE r.category END AS label FROM {raw} r LEFT JOIN (SELECT DISTINCT category FROM {std}) AS t ON t.category = r.category",
    "classify_sub": "SELECT r.item_id, CASE WHEN length(r.subcategory) <= 100 THEN t.subcategory END AS label FROM {raw} r LEFT JOIN (SELECT DISTINCT category, subcategory FROM {std}) AS t ON t.category = r.category AND t.subcategory = r.subcategory WHERE r.category IS NOT NULL AND r.category <> 'UNKNOWN'",
}


def _unpivoted(where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT *, '{k}' AS method, {k}_id AS id, {k}_score AS score FROM {{m}} {where}" for k in _FOUR)


_AGREE = f"SELECT item_id, max(n) AS n, max(rows_) AS rows_ FROM (SELECT item_id, id, count(id) AS n, count(*) AS rows_ FROM (SELECT item_id, method, CASE WHEN id <> 'None' THEN id END AS id FROM ({_unpivoted()}) AS u) AS v GROUP BY item_id, id) AS w GROUP BY item_id"

#: SQL for the other engine that goes another way than the query: agreement by counting equal ids, and rates by row-wise marks.
TOLD: dict[str, str] = {
    "methods_tested": "SELECT run_id, array_to_string(list_sort(list(DISTINCT method)), ', ') AS methods, count(DISTINCT test_id) AS n_tests, count(*) AS n_results FROM {results} GROUP BY run_id",
    "agreement_analysis": f"SELECT CASE a.n WHEN 4 THEN '4 of 4 Agree' WHEN 3 THEN '3 of 4 Agree' WHEN 2 THEN '2 of 4 Agree' ELSE '0 of 4 Agree' END AS agreement, count(*) AS n, round(avg(s.ensemble_score), 4) AS confidence FROM {{scored}} s JOIN ({_AGREE}) AS a ON a.item_id = s.item_id GROUP BY 1",
    "method_accuracy": "SELECT count(*) FILTER (method = 'search') AS total_confirmed, " + ", ".join(f"(count(*) FILTER (method = '{k}' AND ok))::bigint AS {k}_right, round(100.0E0 * count(*) FILTER (method = '{k}' AND ok) / count(*) FILTER (method = '{k}'), 2) AS {k}_pct, round(avg(score) FILTER (method = '{k}' AND ok), 4) AS {k}_score" for k in _FIVE)
        + " FROM (SELECT method, score, coalesce(id = confirmed_id, false) AS ok FROM (SELECT method, id, score, confirmed_id, status FROM (" + _unpivoted() + ") AS u UNION ALL SELECT 'ensemble', suggested_id, ensemble_score, confirmed_id, status FROM {m}) AS v WHERE status = 'USER_CONFIRMED' AND confirmed_id IS NOT NULL) AS w",
    "signal_alignment": "SELECT method, count(score) AS n, (count(*) FILTER (id = suggested_id))::bigint AS aligned, round(avg(abs(score - ensemble_score)), 6) AS distance FROM (" + _unpivoted("WHERE ensemble_score IS NOT NULL") + ") AS u GROUP BY method",
    "alternatives": "SELECT item_id, method, id, score FROM (" + _unpivoted("") + ") AS u WHERE id IS NOT NULL AND score IS NOT NULL",
}
