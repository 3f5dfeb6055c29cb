"""Headline queries over the corpus at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from varscope.plans import corpus  # noqa: E402
from varscope.plans.queries import QUERIES  # noqa: E402
from varscope.session import scratch  # noqa: E402

HEADLINE = (
    "lexical_mask", "ref_locations", "inventory", "inventory_order", "ignore_filter",
    "template_values", "merged", "check", "check_changes", "check_stream", "undescribed",
    "render_template", "cache_keys", "prompts", "resolve_descriptions", "report_json",
    "report_markdown", "prose_controls",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    corpus.corpus_path(spark, sf_dir)
    for table in (corpus.ignore_rules, corpus.changes, corpus.env_templates):
        table(spark, sf_dir)
    rendering = time.perf_counter() - start
    n_files = corpus.keyed_files(spark, sf_dir).count()

    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            with scratch(spark):
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        cold[name], warm[name] = round(times[0], 3), round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, median of warm runs, total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "files": n_files,
                "files_per_sec": {
                    name: round(n_files / warm[name])
                    for name in ("ref_locations", "inventory", "check", "report_json")
                    if name in warm
                },
                "corpus_rendering_sec": round(rendering, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
