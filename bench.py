"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from sparkweave import plans, registry  # noqa: F401
from sparkweave.session import build_session

HEADLINE = [
    "J03_tfidf_top_k", "J13_open_top_titles", "A15_coverage_at_k", "A02_tfidf_weights", "T12_ngrams", "A06_word_counts", "J21_two_hop_retrieval",
    "V01_mips_top_k", "A11_answer_f1", "A20_binary_metrics", "W03_expanding_yes_no", "X03_best_span_bounded", "J28_ordered_pairs", "B03_clustered_batches",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in HEADLINE:
        once(name)  # warm: code is compiled, pages are cached
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
