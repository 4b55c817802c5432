"""Time the headline queries: one warm-up and one timed run each, written to the noop sink.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import time

from voxtable.plans.catalogue import QUERIES
from voxtable.session import local_session

HEADLINE = [
    "p06_clean", "h04_sentences", "a06_vocabulary", "a07_phrases", "a09_term_frequencies", "a11_cooccurrence",
    "m06_auto_label_corpus_words", "w01_rating_sample", "a12_tfidf_fit", "a12_block_index", "m02_retrieve", "t01_top_k_single",
    "m11_beam_expansion", "j07_term_filter", "a13_fit_summary", "m03_classify", "a14_probability_tables",
    "m07_insights", "j11_sentence_polarity", "m09_viterbi", "a15_hmm_converged", "a17_mean_transitions",
    "m13_analyze_summary",
]


def run(fn, spark, folder: str) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    times = {}
    for name in HEADLINE:
        run(QUERIES[name], spark, folder)
        times[name] = round(run(QUERIES[name], spark, folder), 3)
    sf = folder.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
