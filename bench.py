"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "attribute_support", "attribute_statistics", "attribute_support_words", "lexical_variant_key",
    "merge_violations", "validate_open_tags", "validate_captions", "parse_label_json",
    "hash_priority_sample", "map_tags_to_concepts", "diverse_examples", "label_diagnostics",
    "propose_merge_edges", "connected_components", "paired_retrieval", "quality_gates",
    "concept_rollouts", "compositional_ranks", "recall_curve", "group_mean_directions",
    "concept_auroc", "reverse_ridge", "fit_soft_labels", "correlation_matrix", "telemetry_summary",
    "cluster_phrases", "select_concepts", "ingest_annotations_stream", "dictionary_build",
]


def main() -> None:
    from axisframe.plans.catalog import QUERIES
    from axisframe.session import build_session, release

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:
            print(f"{name}: {str(error)[:300]}", file=sys.stderr)
            continue
        seconds[name] = round(time.perf_counter() - start, 3)
        release()
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
