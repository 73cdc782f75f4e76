"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "rev_kitchen_day", "fact_order", "order_state_history", "dim_customer", "identity_bridge", "sat_order_scd2_two_batches", "menu_cdc_history",
    "pit_menu_join", "sensor_hourly", "delivery_trips", "dq_fact_order", "top_customers",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tidewright.plans.registry import QUERIES
    from tidewright.plans.star import GOLD, LANDED, SILVER, Star
    from tidewright.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()  # warm-up: the session is up
    times = {}

    def timed(name: str, job) -> None:
        began = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - began, 3)

    star = Star(spark, sf)
    # raw records are landed and parsed once and gold is built once, as in a lake; all are part of the total
    timed("land_bronze", lambda: [star.stored(t) for t in LANDED])
    timed("build_silver", lambda: [star.stored(t) for t in SILVER])
    timed("build_gold", lambda: [star.stored(t) for t in GOLD])
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())  # noqa: B023
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
