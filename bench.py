"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_QUERIES``
(comma-separated names, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillmesh.plans.catalog import CATALOG  # noqa: E402
from quillmesh.session import get_session  # noqa: E402

HEADLINE = [
    "clean_html", "tokenize_pad", "pack_pair", "history_join", "validate_embed", "validate_rerank",
    "route_and_capability", "token_weights_max", "lexical_weights", "id_to_token", "dense_embed", "sparse_embed",
    "embed_multi_model", "lexical_score_matrix", "rerank_scores", "rerank_fallback", "rewrite_context",
    "retrieve_then_rerank", "serve_embed_rows", "serve_rerank_rows", "compare_dense", "compare_sparse",
    "compare_sparse_long", "compare_scores", "eval_summary", "latency_stats", "drop_warmup", "latency_histogram",
    "embed_stream", "metrics_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(CATALOG) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["request_counter"](spark, folder).collect()  # JVM warm-up
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
