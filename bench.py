"""Time the headline queries: BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from offerloom.plans import all_queries  # noqa: E402
from offerloom.session import build_session  # noqa: E402

HEADLINE = [
    "nrm3_search_text", "nrm10_unit_price", "bld1_offer_dedup", "bld2_offer_brochure_links", "jn8_radius_join", "geo10_scope_category_counts",
    "bsk2_best_by_category", "bsk7_store_ranking", "mix1_cheapest_split", "tax7_category_offers", "agg4_price_trend", "log1_top_queries",
    "txt2_prefix_search", "txt3_bm25", "cat7_ranking", "src2_flatten_offers", "rep3_download_status",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries().QUERIES
    seconds: dict[str, float] = {}
    for name in [n for n in HEADLINE if n in queries]:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
