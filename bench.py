"""Time the headline jobs: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks import queries  # noqa: E402

HEADLINE = (
    "row_text_lineitem", "profile_features", "profile_values", "seeded_shuffle_rows",
    "random_row_per_trial", "dedup_keep_first", "perturb_values", "row_membership",
    "probe_recognition", "probe_membership", "probe_completion_feature", "probe_classification_shots",
    "decide_words", "decide_completion_feature", "decide_classification", "answer_histogram",
    "scorecard_long", "lexicon_coverage", "corpus_word_scan", "corpus_word_scan_long",
    "corpus_passage_scan", "corpus_row_text_scan", "probe_full_run", "decide_membership", "ranking",
    "corpus_passage_scan_pages", "perturb_skewed", "decide_values_long",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rowecho-bench")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries.queries()
    registered["profile_shape"](spark, sf_dir).collect()  # start the engine before the clock
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name:32}{seconds[name]:8.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
