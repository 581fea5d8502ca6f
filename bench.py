"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from registry.queries import QUERIES  # noqa: E402
from tickertide.session import build_session  # noqa: E402

HEADLINE = [
    "normalize_text",
    "dedup_key",
    "extract_tickers",
    "enrich",
    "score_posts",
    "explode_mentions",
    "rollup_5m",
    "rollup_5m_events",
    "unique_authors",
    "emotion_sums",
    "rollup_to_hour",
    "merge_rollup",
    "insert_if_absent",
    "trending_api",
    "trending_web",
    "movers_api",
    "movers_web",
    "movers_single_scan",
    "dedup_batch_ttl",
    "news_to_raw",
    "social_to_raw",
    "stream_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run(name)  # untimed: class loading and code generation
        seconds[name] = round(run(name), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
