"""Headline timings: one JSON line on stdout.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
The flagship runs once to warm up the JVM; each query then runs once for the
record.  Results go to the no-op sink, so every row is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_causal_score", "w1_causal_mean", "w3_local_level_filter", "k1_running_state", "k6_actor_ledger",
    "k14_fact_table", "p9_features", "p16_labels", "v17_split_violations", "a15_shrunk_table", "a16_entity_offsets",
    "j7_prefix_fallback", "m1_nll_multi", "m6_ece", "m7_class_ece", "r3_paired_delta", "l14_tilt", "l15_kappa_curve",
    "l11_lambda_curve",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from foreledger import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("foreledger-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    todo = catalog.queries()
    names = [n for n in (os.environ.get("BENCH_QUERIES", "").split(",")) if n] or HEADLINE
    run = lambda q: q(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    run(todo["flagship_causal_score"])
    for name in names:
        t0 = time.perf_counter()
        run(todo[name])
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    out = {
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "fold_events_per_sec": round(n_events / times["k14_fact_table"]) if "k14_fact_table" in times else None}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
