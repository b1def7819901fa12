"""Times the headline queries and prints one JSON line.

Each query runs in full and writes to the `noop` sink, so nothing is collected. A first small
query warms the session up and is not timed. Tables that several queries read are built once and timed
as rows of their own: `build_monthly`, and `build_facts` for the versioned daily and monthly tables.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendframe.plans.catalog import load  # noqa: E402
from spendframe.session import local_session  # noqa: E402
from spendframe.sources import sample  # noqa: E402

HEADLINE = [
    "agg_analyze_daily",
    "agg_analyze_monthly",
    "agg_analyze_yearly",
    "agg_analyze_nogran",
    "agg_distinct",
    "agg_monthly_rollup",
    "flt_date_window",
    "flt_project_group",
    "join_account_route",
    "rule_order_stop",
    "rule_match_service_account",
    "snk_replace_changed",
    "uni_build",
    "agg_unified_monthly",
    "bud_usage",
    "rep_number",
    "rep_adjust_order",
    "agg_report_total",
    "lim_page",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["join_account_connect"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}

    def timed(name, run):
        started = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - started, 3)

    timed("build_monthly", lambda: sample.monthly(spark, sf_dir))
    timed("build_facts", lambda: sample.fact_tables(spark, sf_dir))
    for name in sys.argv[1:] or HEADLINE:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
