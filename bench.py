"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

A small index is built first, as the published rate is that of a long run. Then the index is built once and stored, as in use; queries then run against the stored index. Rates beside the seconds:
documents a second of loading and building, percentiles of query latency.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import functions as F

from skriva.engine import SearchEngine
from skriva.operators import dictionary as D
from skriva.operators import query as Q
from skriva.plans.queries import QUERIES
from skriva.plans.sql import QUERY_TOKENS, SHORT_TOKENS
from skriva.session import get_spark

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = get_spark("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, f, runs=1):
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            f()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took), 4)
        return sorted(took)

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    n = docs.count()
    with tempfile.TemporaryDirectory() as folder:
        small = SearchEngine(spark, f"{folder}/warm-up")  # compiles what is timed; its figures aren't kept
        small.load(docs.limit(300))
        small.build("text")
        engine = SearchEngine(spark, f"{folder}/engine")
        timed("load", lambda: engine.load(docs))
        timed("index_build", lambda: engine.build("text"))
        text, short = " ".join(QUERY_TOKENS), " ".join(SHORT_TOKENS)
        runs = {
            "query_or": lambda: sink(engine.query_or(text, "text")),
            "query_and": lambda: sink(engine.query_and(short, "text")),
            "query_and_k": lambda: sink(engine.query_and_k(text, "text", 0.5)),
            "query_and_k_least": lambda: sink(engine.query_and_k_least(text, "text", 0.5)),
            "query_or_k": lambda: sink(engine.query_or_k(text, "text", 0.5)),
            "query_or_k_least": lambda: sink(engine.query_or_k_least(text, "text", 0.5)),
            "bm25_top20": lambda: Q.top_k(Q.bm25(engine.postings, None, QUERY_TOKENS, field="text"), 20).collect(),
            "token_exact": lambda: D.exact(engine.postings, QUERY_TOKENS[0]).count(),
            "token_prefix": lambda: D.prefix(engine.postings, "re").count(),
            "doc_fetch_by_id": lambda: engine.fetch([3, 5, 8, 13]).collect(),
        }
        for f in runs.values():
            f()
        latency = {name: timed(name, f, RUNS) for name, f in runs.items()}
        postings = engine.postings.filter(F.col("field") == "text").count()
    for name in ("build_postings", "vocab_df", "stem_tokens", "incremental_build", "stream_build_postings"):
        timed(name, lambda: sink(QUERIES[name](spark, FOLDER)))
    both = seconds["load"] + seconds["index_build"]
    print(
        json.dumps(
            {
                "metric": "search_engine_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": FOLDER.rstrip("/").rpartition("sf")[2],
                "docs": n,
                "load_docs_per_s": round(n / seconds["load"]),
                "build_docs_per_s": round(n / seconds["index_build"]),
                "load_and_build_docs_per_s": round(n / both),
                "postings_per_s": round(postings / seconds["index_build"]),
                "latency_worst_s": {k: round(v[-1], 4) for k, v in latency.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
