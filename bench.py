"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from tallyweave.operators import dedup, ensemble, matching  # noqa: E402
from tallyweave.plans import reconcile  # noqa: E402

BATCH = 500
VIEWS = ("dashboard_kpis", "dashboard_sources", "dashboard_categories", "confidence_ensemble", "optimization_metrics", "method_accuracy", "signal_alignment", "agreement_analysis", "source_performance", "match_search", "latency_summary", "item_stages", "phase_status", "cost_comparison")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(2 * cpus)).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    t = reconcile.tables(spark, sf_dir)
    items = matching.batch_of(t["raw"], BATCH).cache()
    items.count()
    n_pairs = items.join(t["std"], "category").count()
    work = {
        "normalize_dedup": lambda: dedup.unique_descriptions(t["raw"]),
        "normalize_enhanced": lambda: reconcile.QUERIES["normalize_enhanced"](spark, sf_dir),
        "search_batch": lambda: matching.match_search(items, t["std"]),
        "edit_batch": lambda: matching.match_edit(items, t["std"]),
        "jaccard_batch": lambda: matching.match_jaccard(items, t["std"]),
        "cosine": lambda: reconcile.QUERIES["cosine_top1"](spark, sf_dir),
        "fast_path": lambda: reconcile.QUERIES["fast_path"](spark, sf_dir),
        "ensemble_route": lambda: ensemble.route(ensemble.ensemble(t["matches"])),
        "review_bulk": lambda: reconcile.QUERIES["review_bulk"](spark, sf_dir),
        "flagship_batch": lambda: reconcile.harmonize(reconcile.tables(spark, sf_dir), BATCH),
    } | {name: (lambda name=name: reconcile.QUERIES[name](spark, sf_dir)) for name in VIEWS}
    seconds = {}
    for name, make in work.items():
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "driver_memory": "12g", "shuffle_partitions": 2 * cpus, "batch": BATCH, "pairs": n_pairs}))
    spark.stop()


if __name__ == "__main__":
    main()
