"""Named queries over the driver's tables, each with the SQL that gives the same rows.

Time leaves the engine as ISO text; the SQL builds the same text from the bucket's microseconds.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions import time as times
from chronolake.plans import flux as flux_plans
from chronolake.plans import iql, sql
from chronolake.plans.compile import Compiler, Options
from chronolake.plans.views import measurement
from chronolake.session import table
from chronolake.sources import decode, line_protocol
from chronolake.streaming import rollup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = times.parse_iso("2024-01-20T00:00:00Z")
H, D = times.NANOS["hour"], times.NANOS["day"]


def query(name: str, oracle: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = run, oracle
        return run

    return add


def run_sql(text: str, params: dict[str, Any] | None = None) -> Query:
    """A query of the engine's dialect over the driver's tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = sql.parse(text, params)
        return Compiler(measurement(spark, sf_dir, q.measurement), Options(now_ns=lambda: NOW)).select(q)

    return run


def add(name: str, text: str, oracle: str, params: dict[str, Any] | None = None) -> None:
    query(name, oracle)(run_sql(text, params))


def iso(ts: str) -> str:
    """ISO text of a timestamp in SQL."""
    us = f"(epoch_us({ts}) % 1000000)"
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} = 0 THEN '' "
        f"ELSE '.' || lpad(({us} * 1000)::VARCHAR, 9, '0') END"
    )


def bin_(size_ns: int, ts: str = "ts") -> str:
    """ISO text of the start of a timestamp's bucket in SQL."""
    us = size_ns // 1000
    return f"strftime(make_timestamp((epoch_us({ts}) // {us}) * {us}), '%Y-%m-%dT%H:%M:%S')"


EVENT_ROW = f"SELECT event_id, event_type, props, user_id, value, {iso('ts')} AS time FROM events"

# Scans, filters, order.

add("star_time_range", "SELECT * FROM events WHERE time >= '2024-01-05T00:00:00Z' AND time < '2024-01-12T06:00:00Z'", f"{EVENT_ROW} WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 06:00:00'")
add("star_all", "SELECT * FROM events", EVENT_ROW)
add("iso_time_ns", "SELECT event_id, time FROM events", f"SELECT event_id, {iso('ts')} AS time FROM events")
add("time_equals_ns", "SELECT event_id FROM events WHERE time >= 1704412800000000500 AND time != 1704499200000000001", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00'")
add("time_between", "SELECT event_id, value FROM events WHERE time BETWEEN '2024-01-03' AND '2024-01-04T12:00:00Z'", "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-04 12:00:00'")
add("time_now_minus", "SELECT event_id, value FROM events WHERE time > now() - interval '36 hours' AND time <= now()", "SELECT event_id, value FROM events WHERE ts > TIMESTAMP '2024-01-18 12:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
for op, name in (("=", "eq"), ("!=", "ne")):
    add(f"where_tag_{name}", f"SELECT event_id, event_type FROM events WHERE event_type {op} 'click'", f"SELECT event_id, event_type FROM events WHERE event_type {op} 'click'")
for op, name in ((">", "gt"), ("<", "lt"), (">=", "gte"), ("<=", "lte")):
    add(f"where_num_{name}", f"SELECT event_id, value FROM events WHERE value {op} 25.5", f"SELECT event_id, value FROM events WHERE value {op} 25.5")
add("where_int_as_float", "SELECT event_id, user_id FROM events WHERE user_id = 42.0", "SELECT event_id, user_id FROM events WHERE user_id = 42")
add("where_and", "SELECT event_id, value FROM events WHERE event_type != 'error' AND value > 10 and user_id <= 100", "SELECT event_id, value FROM events WHERE event_type <> 'error' AND value > 10 AND user_id <= 100")
add("where_or_in_between", "SELECT event_id, value FROM events WHERE (event_type IN ('click', 'view') OR user_id = 7) AND value NOT BETWEEN 5 AND 20", "SELECT event_id, value FROM events WHERE (event_type IN ('click', 'view') OR user_id = 7) AND NOT (value >= 5 AND value <= 20)")
add("where_like_null", "SELECT event_id, event_type FROM events WHERE event_type LIKE '%i%' AND value IS NOT NULL AND NOT event_type = 'view'", "SELECT event_id, event_type FROM events WHERE event_type LIKE '%i%' AND value IS NOT NULL AND event_type <> 'view'")
add("where_type_mismatch", "SELECT event_id FROM events WHERE value = '10'", "SELECT event_id FROM events WHERE false")
add("where_type_mismatch_rows", "SELECT event_id FROM events WHERE value != '10'", "SELECT event_id FROM events WHERE value IS NOT NULL")
add("where_type_order", "SELECT event_id FROM events WHERE value < 'a' AND event_type > 5 AND event_type != 3 AND value < true", "SELECT event_id FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL")
add("where_missing_column", "SELECT event_id FROM events WHERE nothing != 'x'", "SELECT event_id FROM events WHERE false")
add("where_missing_column_rows", "SELECT event_id FROM events WHERE nothing != 'x' OR value > 30", "SELECT event_id FROM events WHERE value > 30")
add("where_quoted_operator", "SELECT event_id FROM events WHERE event_type != 'a>b AND c' AND \"event_type\" <> 'view'", "SELECT event_id FROM events WHERE event_type <> 'view'")
add("param_string", "SELECT event_id, event_type FROM events WHERE event_type = $t", "SELECT event_id, event_type FROM events WHERE event_type = 'view'", {"t": "view"})
add("param_int", "SELECT event_id, user_id FROM events WHERE user_id = $u AND event_type != $userx", "SELECT event_id, user_id FROM events WHERE user_id = 11 AND event_type <> 'view'", {"u": 11, "$userx": "view"})
add("param_float", "SELECT event_id, value FROM events WHERE value < $v", "SELECT event_id, value FROM events WHERE value < 3.25", {"v": 3.25})
add("param_bool", "SELECT event_id FROM events WHERE value < $b AND value > 10", "SELECT event_id FROM events WHERE value > 10", {"b": True})
add("param_time", "SELECT event_id FROM events WHERE time >= $start AND time < $stop", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-03 00:00:00'", {"start": "2024-01-02T00:00:00Z", "stop": "2024-01-03T01:00:00+01:00"})
add("order_time_desc_limit", "SELECT * FROM events ORDER BY time DESC LIMIT 100", f"{EVENT_ROW} ORDER BY ts DESC, event_id DESC LIMIT 100")
add("order_time_asc_limit", "SELECT * FROM events WHERE event_type = 'purchase' ORDER BY time ASC LIMIT 50", f"{EVENT_ROW} WHERE event_type = 'purchase' ORDER BY ts, event_id DESC LIMIT 50")
add("order_multi_offset", "SELECT event_id, event_type, value FROM events ORDER BY event_type, value DESC, event_id LIMIT 40 OFFSET 15", "SELECT event_id, event_type, value FROM events ORDER BY event_type, value DESC, event_id LIMIT 40 OFFSET 15")
add("limit_zero", "SELECT event_id FROM events LIMIT 0", "SELECT event_id FROM events LIMIT 0")
add("computed_columns", "SELECT event_id, value * 2 + 1 AS twice, upper(event_type) AS kind FROM events", "SELECT event_id, value * 2 + 1 AS twice, upper(event_type) AS kind FROM events")

# Distinct.

add("distinct_tag", "SELECT DISTINCT event_type FROM events", "SELECT DISTINCT event_type FROM events")
add("distinct_field", "SELECT DISTINCT user_id FROM events", "SELECT DISTINCT user_id FROM events")
add("distinct_limit", "SELECT DISTINCT user_id FROM events LIMIT 7", "SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 7")
add("distinct_where", "SELECT DISTINCT event_type FROM events WHERE value > 30 LIMIT 3", "SELECT DISTINCT event_type FROM events WHERE value > 30 ORDER BY 1 LIMIT 3")
add("distinct_time", "SELECT DISTINCT time FROM events", "SELECT NULL::VARCHAR AS time WHERE false")

# Buckets.

HOUR = "GROUP BY DATE_BIN(INTERVAL '1 hour', time)"
add("bucket_avg_1h", f"SELECT DATE_BIN(INTERVAL '1 hour', time) AS time, AVG(value) AS avg_value FROM events {HOUR}", f"SELECT {bin_(H)} AS time, avg(value) AS avg_value FROM events GROUP BY 1")
add("bucket_sum_1h", f"SELECT DATE_BIN(INTERVAL '1 hour', time) AS time, SUM(value) AS total, SUM(user_id) AS users FROM events {HOUR}", f"SELECT {bin_(H)} AS time, sum(value) AS total, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
add("bucket_count_min_max_1h", f"SELECT DATE_BIN(INTERVAL '1 hour', time) AS time, COUNT(value) AS n, MIN(value) AS lo, MAX(value) AS hi FROM events {HOUR}", f"SELECT {bin_(H)} AS time, count(value) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
add("bucket_min_max_string", "SELECT DATE_BIN(INTERVAL '1 day', time) AS time, MIN(props) AS lo, MAX(props) AS hi FROM events GROUP BY DATE_BIN(INTERVAL '1 day', time)", f"SELECT {bin_(D)} AS time, min(props) AS lo, max(props) AS hi FROM events GROUP BY 1")
add("bucket_week_lineitem", "SELECT DATE_BIN(INTERVAL '7 days', time) AS week, COUNT(l_quantity) AS n, SUM(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY DATE_BIN(INTERVAL '7 days', time)", f"SELECT {bin_(7 * D, 'l_shipdate')} AS week, count(l_quantity) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
CANDLE = "FIRST(value, time) AS open, MAX(value) AS high, MIN(value) AS low, LAST(value, time) AS close, SUM(event_id) AS volume"
CANDLE_SQL = "arg_min(value, (ts, -event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(event_id)::BIGINT AS volume"
add("ohlcv_daily", f"SELECT DATE_BIN(INTERVAL '1 day', time) AS time, {CANDLE} FROM events GROUP BY DATE_BIN(INTERVAL '1 day', time) ORDER BY time ASC", f"SELECT {bin_(D)} AS time, {CANDLE_SQL} FROM events GROUP BY 1")
add("ohlcv_by_tag", f"SELECT DATE_BIN(INTERVAL '6 hours', time) AS time, event_type, {CANDLE} FROM events WHERE value > 1 GROUP BY DATE_BIN(INTERVAL '6 hours', time), event_type", f"SELECT {bin_(6 * H)} AS time, event_type, {CANDLE_SQL} FROM events WHERE value > 1 GROUP BY 1, 2")
add("first_last_default_order", f"SELECT DATE_BIN(INTERVAL '1 hour', time) AS time, FIRST(value) AS a, LAST(value) AS b FROM events {HOUR}", f"SELECT {bin_(H)} AS time, arg_min(value, (ts, -event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events GROUP BY 1")
add("first_last_by_field", "SELECT DATE_BIN(INTERVAL '1 day', time) AS time, FIRST(value, event_id) AS a, LAST(event_type, event_id) AS b FROM events GROUP BY DATE_BIN(INTERVAL '1 day', time)", f"SELECT {bin_(D)} AS time, arg_min(value, event_id) AS a, arg_max(event_type, event_id) AS b FROM events GROUP BY 1")
add("first_last_missing_order", "SELECT DATE_BIN(INTERVAL '1 day', time) AS time, FIRST(value, nothing) AS a, LAST(value, nothing) AS b FROM events GROUP BY DATE_BIN(INTERVAL '1 day', time)", f"SELECT {bin_(D)} AS time, arg_max(value, event_id) AS a, arg_max(value, event_id) AS b FROM events GROUP BY 1")
add("agg_second_argument", f"SELECT DATE_BIN(INTERVAL '1 hour', time) AS time, AVG(value, user_id) AS mean FROM events {HOUR}", f"SELECT {bin_(H)} AS time, avg(value) AS mean FROM events GROUP BY 1")
add("bucket_limit", f"SELECT DATE_BIN(INTERVAL '1 hour', time) AS time, COUNT(value) AS n FROM events {HOUR} ORDER BY time ASC LIMIT 12", f"SELECT {bin_(H)} AS time, count(value) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 12")
add("bucket_order_desc", f"SELECT DATE_BIN(INTERVAL '1 hour', time) AS time, MAX(value) AS hi FROM events {HOUR} ORDER BY time DESC LIMIT 9", f"SELECT {bin_(H)} AS time, max(value) AS hi FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 9")
for unit, text, size in (("seconds", "90 seconds", 90 * 10**9), ("minutes", "15 minutes", 15 * 60 * 10**9), ("hours", "4 HOURS", 4 * H), ("days", "2 Days", 2 * D)):
    add(f"bucket_{unit}", f"SELECT DATE_BIN(INTERVAL '{text}', time) AS time, COUNT(o_totalprice) AS n, MAX(o_totalprice) AS hi FROM orders GROUP BY DATE_BIN(INTERVAL '{text}', time)", f"SELECT {bin_(size, 'o_orderdate')} AS time, count(o_totalprice) AS n, max(o_totalprice) AS hi FROM orders GROUP BY 1")
add("bucket_group_tag", "SELECT DATE_BIN(INTERVAL '1 hour', time) AS time, event_type, COUNT(value) AS n, SUM(value) AS total FROM events GROUP BY DATE_BIN(INTERVAL '1 hour', time), event_type", f"SELECT {bin_(H)} AS time, event_type, count(value) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
add("bucket_alias_no_interval", "SELECT date_bin('5 minutes', time) AS bucket, AVG(value) AS mean FROM events WHERE event_type = 'click' GROUP BY bucket", f"SELECT {bin_(5 * 60 * 10**9)} AS bucket, avg(value) AS mean FROM events WHERE event_type = 'click' GROUP BY 1")
add("group_by_tag_only", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_discount) AS hi, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_discount) AS hi, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1, 2")
add("global_aggregate", "SELECT COUNT(value) AS n, AVG(value) AS mean, MIN(value) AS lo, MAX(value) AS hi FROM events WHERE value > 5", "SELECT count(value) AS n, avg(value) AS mean, min(value) AS lo, max(value) AS hi FROM events WHERE value > 5")
add("empty_aggregate", f"SELECT DATE_BIN(INTERVAL '1 hour', time) AS time, AVG(value) AS mean FROM events WHERE value > 1000000000 {HOUR}", f"SELECT {bin_(H)} AS time, avg(value) AS mean FROM events WHERE false GROUP BY 1")

# The other front-ends.


def run_flux(text: str, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = measurement(spark, sf_dir, name)
        return flux_plans.rows(flux_plans.parse(text), m, NOW, Compiler(m).all_columns(), False)

    return run


FLUX = 'from(bucket: "b") |> range(start: {}) |> filter(fn: (r) => r._measurement == "events") |> filter(fn: (r) => r.event_type == "{}")'
query("flux_filter", f"SELECT *, 'events' AS _measurement FROM ({EVENT_ROW} WHERE event_type = 'view')")(run_flux('from(bucket: "b") |> filter(fn: (r) => r._measurement == "events") |> filter(fn: (r) => r["event_type"] == "view")', "events"))
query("flux_range", f"SELECT *, 'events' AS _measurement FROM ({EVENT_ROW} WHERE ts >= TIMESTAMP '2024-01-18 00:00:00' AND event_type = 'click')")(run_flux(FLUX.format("-48h", "click"), "events"))
query("flux_field_filter", f"SELECT *, 'events' AS _measurement FROM ({EVENT_ROW} WHERE ts >= TIMESTAMP '2024-01-19 00:00:00' AND false)")(run_flux(FLUX.format("-1d", "nothing"), "events"))


@query("iql_mean_time", f"SELECT {bin_(5 * 60 * 10**9)} AS time, avg(value) AS mean FROM events WHERE event_type = 'view' GROUP BY 1")
def _iql_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(iql.to_sql("SELECT mean(value) FROM events WHERE event_type = 'view' GROUP BY time(5m)"))(spark, sf_dir)


# Sources and sinks.


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    fields = {"event_id": (F.col("event_id"), "i"), "value": (F.col("value"), "f"), "props": (F.col("props"), "s")}
    tags = {"event_type": F.col("event_type"), "user_id": F.col("user_id").cast("string")}
    return df.select(F.col("event_id").alias("seq"), line_protocol.encoded("events", tags, fields, times.ns_of(F.col("ts"))).alias("value"))


@query(
    "lp_encode",
    "SELECT event_id AS seq, 'events,event_type=' || event_type || ',user_id=' || user_id || ' event_id=' || event_id || 'i,props=\"' || "
    "replace(props, '\"', '\\\"') || '\" ' || (epoch_us(ts) * 1000) AS value FROM events",
)
def _lp_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    fields = {"event_id": (F.col("event_id"), "i"), "props": (F.col("props"), "s")}
    tags = {"user_id": F.col("user_id").cast("string"), "event_type": F.col("event_type")}
    return df.select(F.col("event_id").alias("seq"), line_protocol.encoded("events", tags, fields, times.ns_of(F.col("ts"))).alias("value"))


@query("lp_roundtrip", f"SELECT event_id, event_type, user_id::VARCHAR AS user_id, value, props, {iso('ts')} AS time FROM events")
def _lp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)  # parsing costs more than moving lines
    points = line_protocol.staged(lines, "nanosecond").where("error is null and measurement = 'events'")
    at = lambda m, k: F.try_element_at(m, F.lit(k)).alias(k)
    return points.select(at("i", "event_id"), at("tags", "event_type"), at("tags", "user_id"), at("f", "value"), at("s", "props"), times.iso(F.col("time_ns")).alias("time"))


@query("json_decode", "SELECT event_id, value, (props->>'k')::BIGINT AS k FROM events")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "value", "props")
    return decode.json_rows(df, "props", "k bigint")


@query("jsonl_roundtrip", "SELECT event_id, event_type, value FROM events")
def _jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    lines = df.select(F.to_json(F.struct("*")).alias("line"))
    return decode.json_rows(lines, "line", "event_id bigint, event_type string, value double")


@query("arrow_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return decode.frame_of_arrow(spark, decode.arrow_body(df))  # 25 rows at any scale


# Rollups: the batch form of what the streaming cascade appends.


@query("rollup_cascade", f"SELECT {bin_(D)} AS time, {CANDLE_SQL} FROM events GROUP BY 1")
def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = rollup.candles(table(spark, sf_dir, "events"), "ts", "value", "event_id", "event_id", "1 hour")
    daily = rollup.larger(rollup.larger(hourly, "4 hours"), "1 day")
    return daily.select(F.date_format("bucket", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "open", "high", "low", "close", "volume")
