"""Headline queries at one scale: one JSON line, median of three warm runs each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from seqspark import get_session, plans

HEADLINE = {
    "vocabulary": "v02_finalize_vocab",
    "encode_report": "v08_encode_report",
    "encode_lines": "v05_encode_lines",
    "token_blocks": "e01_token_blocks",
    "block_targets": "e05_block_targets",
    "complete_blocks": "e02_complete_blocks",
    "masked_example": "e07_masked_example",
    "noise_pipeline": "e19_noise_pipeline",
    "token_budget_batches": "b05_token_budget_batches",
    "collate": "b10_collate",
    "corpus_bleu": "a02_corpus_bleu",
    "property_metrics": "a07_property_metrics",
    "running_average": "a10_running_average",
    "word_stats": "a16_word_stats",
    "beam_candidates": "d01_beam_candidates",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = plans.queries(), {}
    chosen = sys.argv[1:] or list(HEADLINE)
    for name in chosen:
        query, took = queries[HEADLINE.get(name, name)], []
        for i in range(runs + 1):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i or runs == 0:
                took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
