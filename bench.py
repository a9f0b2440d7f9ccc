"""Time the registered queries: ``BENCH_SF_DIR``, ``BENCH_CPUS``; one JSON line.

Every query runs once to warm up and then ``BENCH_RUNS`` times into a sink that
drops the rows; the median counts. Names on the command line choose queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from silverloop import session  # noqa: E402
from silverloop.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "review_list", "silver_corpus", "gold_join", "augment_replace", "exclude_ids", "split_60_20_20", "class_sample",
    "stratified_split", "seeded_shuffle", "classification_report", "parse_kv_response", "resolve_label", "judge_columns",
    "render_prompt", "sft_records", "sequence_pack", "token_lookup", "masked_mean_pool", "embed_batches", "linear_score",
    "predict_proba", "attention_output", "attention_weights", "sgd_trace", "batch_generate", "debate", "label_incremental",
    "evaluate_capped", "predict_and_score", "fit_logreg", "retrain_eval", "retrain_eval_append", "retrain_eval_stratified",
]


def seconds(spark, query, sf_dir: str) -> float:
    begin = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE
    if chosen == ["all"]:
        chosen = list(QUERIES)
    spark = session.build(f"local[{cpus}]", "bench")
    times = {}
    for name in chosen:
        seconds(spark, QUERIES[name], sf_dir)
        times[name] = round(statistics.median(seconds(spark, QUERIES[name], sf_dir) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
