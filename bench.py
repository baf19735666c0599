"""Benchmark: the batch build and the headline queries on one scale factor.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default the headline set).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query runs its whole plan into the ``noop`` sink (nothing is collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cinegraph.plans import queries as Q  # noqa: E402
from cinegraph.plans.catalog import catalog  # noqa: E402
from cinegraph.session import build_session  # noqa: E402

HEADLINE = [
    "movie_text_vectors", "rating_stats", "canonical_movies", "availability", "movie_tags", "graph_counts",
    "signal_collab", "signal_tags", "signal_genres", "signal_vector",
    "recommend", "recommend_on_provider",
    "search_by_vector", "search_by_text", "movie_detail", "enriched_results",
    "subgraph_edges", "dq_report",
]


def default_driver_memory() -> str:
    """Half of physical memory, between 2 and 16 GB (local mode: the driver is the executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2 ** 30
    except (ValueError, OSError, AttributeError):
        total = 8
    return f"{int(max(2, min(16, total / 2)))}g"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8),
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", default_driver_memory()))
    timings: dict[str, float] = {}

    # JVM warm-up (class loading, first codegen) is reported, not counted in "value".
    t0 = time.time()
    spark.range(100_000).selectExpr("sum(id) AS s").collect()
    warmup = round(time.time() - t0, 3)

    t0 = time.time()
    cat = catalog(spark, sf_dir)
    counts = cat.build_all()
    timings["build"] = round(time.time() - t0, 3)

    for name in names:
        fn = Q.REGISTRY[name]
        t = time.time()
        run(fn(spark, sf_dir))
        timings[name] = round(time.time() - t, 3)

    total = round(sum(timings.values()), 3)
    ratings = counts.get("ratings", 0)
    # only movies with an overview are embedded
    embedded = cat.movies().where("overview IS NOT NULL").count()
    out = {
        "metric": "build_plus_headline_queries_sec",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "cpus": cpus,
        "jvm_warmup_sec": warmup,
        "rows": counts,
        "rates": {
            "build_ratings_per_sec": round(ratings / timings["build"], 1) if timings["build"] else None,
            "embed_movies_per_sec": round(embedded / timings["movie_text_vectors"], 1)
            if timings.get("movie_text_vectors") else None,
            "recommend_seeds_per_sec": round(counts.get("movies", 0) / timings["recommend"], 2)
            if timings.get("recommend") else None,
        },
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
