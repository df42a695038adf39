"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query runs once to warm up and then three times; its figure is the median in seconds, of a full run whose rows go to Spark's noop
sink. ingest_* are points per second through the line-protocol paths, flush_* the seconds of one write of the batch writer's default size.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from chronolake import session
from chronolake.engine import Engine
from chronolake.plans import registry

HEADLINE = [
    "star_time_range",
    "where_and",
    "order_time_desc_limit",
    "distinct_tag",
    "bucket_avg_1h",
    "bucket_count_min_max_1h",
    "bucket_group_tag",
    "bucket_week_lineitem",
    "group_by_tag_only",
    "ohlcv_daily",
    "first_last_by_field",
    "lp_encode",
    "lp_roundtrip",
    "rollup_cascade",
]


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.local_session(cpus, spark__sql__shuffle__partitions=cpus)
    found = {}
    for name in HEADLINE:
        run = lambda q=registry.QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()
        found[name] = round(statistics.median(timed(run) for _ in range(3)), 4)
    with tempfile.TemporaryDirectory() as root:
        engine = Engine(spark, root)
        batch = "\n".join(f"trades,symbol=S{i % 50} price={i % 997}.25,volume={i}i {1_700_000_000_000_000_000 + i * 10**6}" for i in range(20_000))
        many = "\n".join(f"ticks,symbol=S{i % 50} price={i % 997}.25,volume={i}i {1_700_000_000_000_000_000 + i * 10**6}" for i in range(400_000))
        flush = "\n".join(batch.split("\n")[:5000])
        engine.write(batch)
        engine.write(many)
        rates = {
            "ingest_batch_points_s": round(20_000 / statistics.median(timed(lambda: engine.write(batch)) for _ in range(3))),
            "ingest_bulk_points_s": round(400_000 / timed(lambda: engine.write(many))),
            "flush_of_5000_lines_s": round(statistics.median(timed(lambda: engine.write(flush)) for _ in range(5)), 4),
        }
        simple = "SELECT * FROM trades WHERE time >= 1700000000000000000 AND time < 1700000000001000000"
        engine.query_sql(simple)
        found["engine_recent_rows"] = round(statistics.median(timed(lambda: engine.query_sql(simple)) for _ in range(5)), 4)
        daily = "SELECT DATE_BIN(INTERVAL '1 day', time) AS t, AVG(price) AS p FROM ticks GROUP BY DATE_BIN(INTERVAL '1 day', time)"
        engine.query_sql(daily)
        found["engine_daily_average"] = round(statistics.median(timed(lambda: engine.query_sql(daily)) for _ in range(5)), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 4), "unit": "sec", "queries": found, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
