"""Headline-query benchmark.

Runs the headline queries at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is executed to completion with the ``noop`` sink (full
evaluation, no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.registry import load_all  # noqa: E402
from tessera.session import get_spark  # noqa: E402

HEADLINE = [
    "tokenize_offsets", "sentences", "index_stats", "search", "bm25_topk", "phrase_slop",
    "conll_parse", "original_span", "find_mentions", "link_fuzzy", "tagger_eval", "answers",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    spark = get_spark(app="tessera-bench")
    queries, _ = load_all()
    names = [q for q in (only or HEADLINE) if q in queries]
    # warm-up: JVM, codegen caches
    queries["sentences"](spark, sf_dir.replace("sf0.1", "sf0.001")
                         if os.path.exists(sf_dir.replace("sf0.1", "sf0.001")) else sf_dir) \
        .write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
