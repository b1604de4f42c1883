"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON. Each query runs once to
warm up and then $BENCH_RUNS times (3); its time is the median. Results are computed in full and thrown away."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINES = ("digest_documents", "digest_pages", "parse_components", "index_keys", "candidate_pairs", "similarity_pairs", "topk_matches", "benchmark_overlap", "clusters", "duplicates", "order_hashes", "chunked_digest")


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from blockprint import queries

    folder, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    for name in HEADLINES:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
    mb = spark.read.parquet(f"{folder}/documents.parquet").select(F.sum(F.octet_length("text"))).first()[0] / 1e6
    pairs = queries.candidate_pairs(spark, folder).count()
    more = {"digest_mb_per_sec": round(mb / times["digest_documents"], 1), "candidate_pairs": pairs, "pairs_per_sec": round(pairs / times["candidate_pairs"])}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf"), **more}))
    spark.stop()


if __name__ == "__main__":
    main()
