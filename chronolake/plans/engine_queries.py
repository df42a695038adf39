"""Named queries that run the engine itself: what is written, deleted, inserted, administered, buffered or decoded is read back and returned.

Each query has a warehouse of its own in the shared folder, or reads one into which all events were written once. Payloads that a
client would hold are made of the nation table, which has 25 rows at any scale; events are written and read by tasks.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake import session, telemetry
from chronolake.engine import Connections, Engine
from chronolake.errors import BufferFull, ConnectionMissing, DecodeError, EngineError, InvalidConfig, NotFound, StatusError, Unsupported, UnsupportedFormat
from chronolake.functions import time as times
from chronolake.model import PROFILES, Config, Point
from chronolake.plans.registry import EVENT_ROW, NOW, QUERIES, bin_, event_lines, iso, query
from chronolake.session import table
from chronolake.sources import decode, line_protocol
from chronolake.streaming import rollup
from chronolake.streaming.batch_writer import BatchWriter

STAMP = 1_700_000_000_123_456_789
DAY = times.DAY


def fresh(spark: SparkSession, profile: str = "v3_enterprise", **options: Any) -> Engine:
    return Engine(spark, f"{session.shared_dir(spark)}/warehouse-{uuid.uuid4().hex}", profile, **{"now_ns": lambda: NOW, **options})


def load_events(engine: Engine, sf_dir: str, database: str | None = None) -> None:
    path = f"{session.shared_dir(engine.spark)}/lines-{uuid.uuid4().hex}"
    event_lines(engine.spark, sf_dir).select("value").write.option("compression", "gzip").text(path)
    engine.write_files(path, database)


_loaded: dict[tuple[str, str], str] = {}


def events(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine on a warehouse that holds all events; opened anew each time. It is only read."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _loaded:
        engine = fresh(spark)
        load_events(engine, sf_dir)
        _loaded[key] = engine.warehouse.root
    return Engine(spark, _loaded[key], "v3_enterprise", now_ns=lambda: NOW)


def nations(spark: SparkSession, sf_dir: str) -> list[Any]:
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows at any scale


def points(spark: SparkSession, sf_dir: str) -> list[Point]:
    return [
        Point(
            "nation stats",
            {"key": r["n_nationkey"], "half": r["n_nationkey"] / 2, "even": r["n_nationkey"] % 2 == 0, "label": f'a "{r["n_name"]}" b\\c', "large": 10**20 + r["n_nationkey"]},
            {"name": f"{r['n_name']} x,y=z", "region": str(r["n_regionkey"])},
            r["n_nationkey"] * DAY + 5,
        )
        for r in nations(spark, sf_dir)
    ]


def lines(spark: SparkSession, sf_dir: str, stamp: Callable[[int], str] = lambda k: f" {k}") -> str:
    return "\n".join(f"n,name={r['n_name']},region={r['n_regionkey']} key={r['n_nationkey']}i{stamp(r['n_nationkey'])}" for r in nations(spark, sf_dir))


def rows(spark: SparkSession, found: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(found, schema)


def values(found: list[tuple], names: str) -> str:
    """SQL of constant rows."""
    text = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in found)
    return f"SELECT * FROM (VALUES {text}) t({names})"


# Writing and scanning.

WRITTEN = f"SELECT event_id, event_type, user_id::VARCHAR AS user_id, value, props, {iso('ts')} AS time FROM events"
POINT_ROWS = (
    "SELECT n_nationkey::BIGINT AS key, n_nationkey / 2 AS half, n_nationkey % 2 = 0 AS even, 'a \"' || n_name || '\" b\\c' AS label, "
    "(100000000000000000000::HUGEINT + n_nationkey)::VARCHAR AS large, n_name || ' x,y=z' AS name, n_regionkey::VARCHAR AS region, "
    "strftime(TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * n_nationkey, '%Y-%m-%dT%H:%M:%S') || '.000000005' AS time FROM nation"
)
LINE_ROWS = "SELECT n_nationkey::BIGINT AS key, n_name AS name, n_regionkey::VARCHAR AS region FROM nation"


@query("write_files_scan", WRITTEN)
def _write_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).frame("SELECT * FROM events")


@query("write_files_time_range", f"{WRITTEN} WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 06:00:00' AND event_type <> 'view'")
def _write_files_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).frame("SELECT * FROM events WHERE time >= '2024-01-05T00:00:00Z' AND time < '2024-01-09T06:00:00Z' AND event_type != 'view'")


def _point_rows(engine: Engine) -> DataFrame:
    return engine.frame('SELECT * FROM "nation stats"').withColumn("large", F.col("large").cast("string"))


@query("write_points", POINT_ROWS)
def _write_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write(points(spark, sf_dir))
    return _point_rows(engine)


@query("write_gzip", POINT_ROWS)
def _write_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write(gzip.compress(line_protocol.encode(points(spark, sf_dir)).encode()))
    return _point_rows(engine)


@query("write_direct", POINT_ROWS)
def _write_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, own = fresh(spark), points(spark, sf_dir)
    engine.write_direct(own[0])
    engine.write_direct(own[1:])
    return _point_rows(engine)


PRECISIONS = {"nanosecond": 1, "microsecond": 10**3, "millisecond": 10**6, "second": 10**9}


@query("write_precisions", "SELECT p AS precision, n_nationkey::BIGINT AS key, n_nationkey::BIGINT * m AS time_ns FROM nation, " + "(" + values(list(PRECISIONS.items()), "p, m") + ")")
def _write_precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, text = fresh(spark), lines(spark, sf_dir)
    out = []
    for name in PRECISIONS:
        engine.write(text, name, precision=name)
        m = engine.measurement("n", name)
        out.append(m.df.select(F.lit(name).alias("precision"), m.field_value("key").alias("key"), "time_ns"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("write_server_time", f"SELECT n_nationkey::BIGINT AS key, '{times.iso_text(STAMP)}' AS time FROM nation")
def _write_server_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark, now_ns=lambda: STAMP)
    engine.write(lines(spark, sf_dir, lambda k: ""))
    return engine.frame("SELECT key, time FROM n")


@query("write_comments_and_blanks", LINE_ROWS)
def _write_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write("# a comment\n\n" + lines(spark, sf_dir).replace("\n", "\r\n \n#n v=1i\n") + "\n\n")
    return engine.frame("SELECT key, name, region FROM n")


@query("write_escapes", "SELECT n_nationkey::BIGINT AS \"k=1\", n_name || ' a,b=c\\' AS \"t x\", 'say \"' || n_name || '\", \\ and = so' AS s FROM nation")
def _write_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write("\n".join(f"a\\ b\\,c,t\\ x={r['n_name']}\\ a\\,b\\=c\\\\ k\\=1={r['n_nationkey']}i,s=\"say \\\"{r['n_name']}\\\", \\\\ and = so\" 7" for r in nations(spark, sf_dir)))
    m = engine.measurement("a b,c")
    return m.df.select(m.field_value("k=1").alias("k=1"), m.tag("t x").alias("t x"), m.field_value("s").alias("s"))


@query("write_twice_keeps_both", "SELECT n_nationkey::BIGINT AS key, 2::BIGINT AS n FROM nation")
def _write_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    for _ in range(2):
        engine.write(lines(spark, sf_dir))
    return engine.frame("SELECT key, COUNT(*) AS n FROM n GROUP BY key")


@query("write_named_once", "SELECT n_nationkey::BIGINT AS key, 1::BIGINT AS n FROM nation")
def _write_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    for _ in range(2):
        engine.write(lines(spark, sf_dir), name="batch 7")
    return engine.frame("SELECT key, COUNT(*) AS n FROM n GROUP BY key")


@query("dedupe_view", "SELECT n_nationkey::BIGINT AS key, n_name AS name, CASE WHEN n_nationkey < 9 THEN 'second' ELSE 'first' END AS written FROM nation")
def _dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write("\n".join(f'{x[: x.rindex(" ")]},written="first"{x[x.rindex(" ") :]}' for x in lines(spark, sf_dir).split("\n")))
    engine.write("\n".join(f'{x[: x.rindex(" ")]},written="second"{x[x.rindex(" ") :]}' for x in lines(spark, sf_dir).split("\n")[:9]))
    return engine.frame("SELECT key, name, written FROM n", dedupe=True)


@query("bucket_before_1970", "SELECT strftime(TIMESTAMP '1970-01-01' - INTERVAL 1 SECOND * (n_nationkey * 7 // 60 * 60), '%Y-%m-%dT%H:%M:%S') AS time, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY 1")
def _before_1970(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets are cut towards the epoch."""
    engine = fresh(spark)
    engine.write(lines(spark, sf_dir, lambda k: f" {-7 * 10**9 * k}"))
    return engine.frame("SELECT DATE_BIN(INTERVAL '1 minute', time) AS time, COUNT(key) AS n, SUM(key) AS total FROM n GROUP BY DATE_BIN(INTERVAL '1 minute', time)")


@query("count_of_missing_values", "SELECT n_nationkey % 3 > 0 AS held, CASE WHEN n_nationkey % 3 > 0 THEN 1::BIGINT END AS n, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey::DOUBLE END AS mean FROM nation")
def _missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket whose points all lack the field."""
    engine = fresh(spark)
    engine.write("\n".join(f"m {'v' if k % 3 else 'w'}={k}i {k * DAY}" for k in (r["n_nationkey"] for r in nations(spark, sf_dir))))
    found = engine.frame("SELECT DATE_BIN(INTERVAL '1 day', time) AS time, COUNT(v) AS n, AVG(v) AS mean, COUNT(w) AS other FROM m GROUP BY DATE_BIN(INTERVAL '1 day', time)")
    return found.select(F.col("other").isNull().alias("held"), "n", "mean")


BAD = [
    ("m", "invalid line protocol"),
    (",t=1 v=1i", "invalid line protocol"),
    ("m,t v=1i", "invalid tag pair"),
    ("m,t= v=1i", "invalid tag pair"),
    ("m v", "invalid field pair"),
    ("m v=xi", "invalid integer field"),
    ("m v=1.2.3", "invalid field value"),
    ('m v="open', "invalid field value"),
    ("m v=1i soon", "invalid timestamp"),
]


@query("write_bad_lines", values([(line, error, 0) for line, error in BAD], "line, error, tables"))
def _write_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, out = fresh(spark), []
    for line, _ in BAD:
        try:
            engine.write(f"{lines(spark, sf_dir)}\n{line}", "bad")
            error = None
        except StatusError as bad:
            error = bad.body
        out.append((line, error, len(engine.query_iql("SHOW MEASUREMENTS ON bad"))))
    return rows(spark, out, "line string, error string, tables int")


@query("compacted_scan", LINE_ROWS)
def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    for line in lines(spark, sf_dir).split("\n"):
        engine.write(line)
    engine.warehouse.compact("default", "n", 1)
    return engine.frame("SELECT key, name, region FROM n")


@query("fields_of_several_kinds", "SELECT n_nationkey::BIGINT AS key, CASE n_nationkey % 4 WHEN 0 THEN 'i' WHEN 1 THEN 'f' WHEN 2 THEN 'b' ELSE 's' END AS kind FROM nation WHERE n_nationkey % 4 <> 1 OR n_nationkey < 9")
def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    value = lambda k: (f"{k}i", f"{k}.5", "true", '"x"')[k % 4]
    engine.write("\n".join(f"m kind=\"{'ifbs'[k % 4]}\",key={k}i,v={value(k)} {k}" for k in (r["n_nationkey"] for r in nations(spark, sf_dir))))
    # numbers < booleans < strings; floats above 9 leave
    return engine.frame("SELECT key, kind FROM m WHERE v >= true OR v = 0 OR kind = 'i' OR v < 9")


# Orders of rows without ORDER BY, streams, transports and formats.


@query("written_order_limit", "SELECT n_nationkey::BIGINT AS key FROM nation ORDER BY n_nationkey DESC LIMIT 10")
def _written_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write(lines(spark, sf_dir, lambda k: " 5"))
    return engine.frame("SELECT key FROM n LIMIT 10", written_order=True)


@query("written_order_rows", "SELECT row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS place, n_nationkey::BIGINT AS key FROM nation")
def _written_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write(lines(spark, sf_dir, lambda k: " 5"))
    return rows(spark, [(k, r["key"]) for k, r in enumerate(engine.query_sql("SELECT * FROM n"))], "place long, key long")


@query("stream_rows", LINE_ROWS)
def _stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write(lines(spark, sf_dir))
    return rows(spark, [(r["key"], r["name"], r["region"]) for r in engine.stream("SELECT * FROM n")], "key long, name string, region string")


@query("stream_errors", values([("swallowed", 0), ("raised", 1)], "kind, n"))
def _stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, raised = fresh(spark), 0
    swallowed = len(list(engine.query_sql_stream("SELECT * FROM nothing", swallow=True)))
    try:
        list(engine.query_sql_stream("SELECT * FROM nothing"))
    except EngineError:
        raised = 1
    return rows(spark, [("swallowed", swallowed), ("raised", raised)], "kind string, n int")


@query("transports_and_formats", "SELECT way, n_nationkey::BIGINT AS key, n_name AS name FROM nation, (VALUES ('rows'), ('arrow'), ('flight')) t(way)")
def _transports(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write(lines(spark, sf_dir))
    text = "SELECT key, name FROM n"
    out = [("rows", r["key"], r["name"]) for r in engine.query_sql(text)]
    for way, found in (("arrow", engine.query_sql(text, format="arrow")), ("flight", engine.query_sql(text, transport="flight"))):
        out += [(way, r["key"], r["name"]) for r in found.to_pylist()]
    return rows(spark, out, "way string, key long, name string")


@query("export_files", "SELECT event_id, value FROM events WHERE value > 30")
def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{session.shared_dir(spark)}/export-{uuid.uuid4().hex}"
    events(spark, sf_dir).export("SELECT event_id, value FROM events WHERE value > 30", path)
    return decode.read(spark, path, "parquet")


# Deleting, inserting, other statements.

LEFT = "SELECT event_id, value, (SELECT count(*) FROM events WHERE {0}) AS affected FROM events WHERE NOT coalesce({0}, false)"


def _deleted(spark: SparkSession, sf_dir: str, where: str, params: dict[str, Any] | None = None) -> DataFrame:
    engine = fresh(spark)
    load_events(engine, sf_dir)
    n = engine.execute_sql(f"DELETE FROM events WHERE {where}", params)["rows_affected"]
    return Engine(spark, engine.warehouse.root).frame("SELECT event_id, value FROM events").withColumn("affected", F.lit(n).cast("long"))


@query("delete_where", LEFT.format("event_type = 'error' AND value > 20"))
def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir, "event_type = 'error' AND value > 20")


@query("delete_time_range", LEFT.format("ts < TIMESTAMP '2024-01-10 12:00:00'"))
def _delete_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir, "time < $until", {"until": "2024-01-10T12:00:00Z"})


@query("delete_all", "SELECT count(*) AS affected, 0::BIGINT AS tables FROM nation")
def _delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write(lines(spark, sf_dir))
    n = engine.execute_sql("DELETE FROM n")["rows_affected"]
    return rows(spark, [(n, len(engine.query_iql("SHOW MEASUREMENTS")))], "affected long, tables long")


@query("insert_select_rollup", f"SELECT {bin_(DAY)} AS time, event_type, avg(value) AS mean, count(value) AS n FROM events GROUP BY 1, 2")
def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    load_events(engine, sf_dir)
    engine.execute_sql("INSERT INTO daily SELECT DATE_BIN(INTERVAL '1 day', time) AS time, event_type, AVG(value) AS mean, COUNT(value) AS n FROM events GROUP BY DATE_BIN(INTERVAL '1 day', time), event_type")
    return engine.frame("SELECT * FROM daily")


@query("insert_select_rows", f"{WRITTEN} WHERE event_type = 'view' AND value > 10")
def _insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    load_events(engine, sf_dir)
    engine.execute_sql("INSERT INTO views SELECT * FROM events WHERE event_type = 'view' AND value > 10")
    return engine.frame("SELECT * FROM views")


@query("other_statements", values([("CREATE TABLE x (y int)", 0), ("DELETE FROM nothing", 0), ("", 0)], "statement, affected"))
def _others(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    return rows(spark, [(s, engine.execute_sql(s)["rows_affected"]) for s in ("CREATE TABLE x (y int)", "DELETE FROM nothing", "")], "statement string, affected int")


ERRORS = [
    ("v3_enterprise", "SELECT * FROM nothing", "TableNotFound"),
    ("v3_enterprise", "SELECT FROM n", "BadRequest"),
    ("v3_enterprise", "SELECT DATE_BIN(INTERVAL '1 lap', time) AS t, AVG(key) AS a FROM n GROUP BY DATE_BIN(INTERVAL '1 lap', time)", "BadRequest"),
    ("v3_enterprise", "SELECT key FROM n WHERE key = $k", "BadRequest"),
    ("v3_core", "DELETE FROM n", "DeleteNotSupported"),
    ("v2", "SELECT * FROM n", "Unsupported"),
]


@query("errors", values(ERRORS, "profile, statement, error"))
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for profile, statement, _ in ERRORS:
        engine, error = fresh(spark, profile), None
        if profile != "v2":
            engine.write(lines(spark, sf_dir))
        try:
            (engine.execute_sql if statement.startswith("DELETE") else engine.query_sql)(statement)
        except EngineError as bad:
            error = type(bad).__name__
        out.append((profile, statement, error))
    return rows(spark, out, "profile string, statement string, error string")


# The other front-ends over the catalog and over several measurements.


def _two(spark: SparkSession, sf_dir: str, profile: str = "v3_enterprise") -> Engine:
    """Nations in one measurement, regions in another, and regions in a second database."""
    engine = fresh(spark, profile)
    for name in ("first", "second") if profile == "v2" else ():
        engine.create_bucket(name)
    regions = "\n".join(f'regions,code={r["r_regionkey"]} title="{r["r_name"]}",key={r["r_regionkey"]}i {NOW - 10**9}' for r in table(spark, sf_dir, "region").collect())  # 5 rows
    engine.write(lines(spark, sf_dir, lambda k: f" {NOW - 10**9 * (k + 1)}") + "\n" + regions, "first")
    engine.write(regions, "second")
    return engine


UNION_ROWS = (
    "SELECT n_nationkey::BIGINT AS key, n_name AS name, n_regionkey::VARCHAR AS region, NULL AS code, NULL AS title, 'n' AS _measurement FROM nation WHERE {0} "
    "UNION ALL SELECT r_regionkey::BIGINT, NULL, NULL, r_regionkey::VARCHAR, r_name, 'regions' FROM region"
)


@query("flux_database_scan", UNION_ROWS.format("n_nationkey < 10"))
def _flux_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir, "v2").flux_frame('from(bucket: "first") |> range(start: -10s)').drop("time")


@query("flux_global_scan", UNION_ROWS.format("true") + " UNION ALL SELECT r_regionkey::BIGINT, NULL, NULL, r_regionkey::VARCHAR, r_name, 'regions' FROM region")
def _flux_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir, "v2").flux_frame("from() |> range(start: -1h)").drop("time")


@query("flux_field_filter_rows", "SELECT r_regionkey::BIGINT AS key, r_name AS title, 'regions' AS _measurement FROM region WHERE r_name = (SELECT min(r_name) FROM region)")
def _flux_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    text = f'from(bucket: "first") |> range(start: -1h) |> filter(fn: (r) => r._measurement == "regions" and r["title"] == "{first}") |> limit(n: 5)'
    return _two(spark, sf_dir, "v2").flux_frame(text).select("key", "title", "_measurement")


@query("flux_warehouse_rows", f"SELECT *, 'events' AS _measurement FROM ({WRITTEN} WHERE ts >= TIMESTAMP '2024-01-18' AND event_type = 'click')")
def _flux_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).flux_frame('from(bucket: "default") |> range(start: -48h) |> filter(fn: (r) => r._measurement == "events") |> filter(fn: (r) => r.event_type == "click")')


def _iql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    found = _two(spark, sf_dir).query_iql(text)
    names = list(found[0])
    return rows(spark, [tuple(r[c] for c in names) for r in found], ", ".join(f"`{c}` string" for c in names))


for _name, _text, _oracle in (
    ("iql_show_databases", "SHOW DATABASES", values([("default",), ("first",), ("second",)], '"iox::database"')),
    ("iql_show_measurements", "SHOW MEASUREMENTS ON first", values([("measurements", "n"), ("measurements", "regions")], '"iox::measurement", name')),
    ("iql_show_measurements_on", 'SHOW MEASUREMENTS ON "second"', values([("measurements", "regions")], '"iox::measurement", name')),
    ("iql_show_tag_keys", "SHOW TAG KEYS ON first FROM n", values([("n", "name"), ("n", "region")], '"iox::measurement", "tagKey"')),
    ("iql_show_all_tag_keys", "SHOW TAG KEYS ON first", values([("n", "name"), ("n", "region"), ("regions", "code")], '"iox::measurement", "tagKey"')),
    ("iql_show_field_keys", "SHOW FIELD KEYS ON first", values([("n", "key"), ("regions", "key"), ("regions", "title")], '"iox::measurement", "fieldKey"')),
):
    query(_name, _oracle)(lambda spark, sf_dir, _text=_text: _iql(spark, sf_dir, _text))


@query("iql_mean_of_fractions", f"SELECT {bin_(1500 * 10**6, 'make_timestamp(n_nationkey * 500000::BIGINT)')} || CASE n_nationkey // 3 % 2 WHEN 1 THEN '.500000000' ELSE '' END AS time, avg(n_nationkey) AS mean FROM nation GROUP BY ALL")
def _iql_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.write(lines(spark, sf_dir, lambda k: f" {k * 500_000_000}"))
    return rows(spark, [(r["time"], r["mean"]) for r in engine.query_iql("SELECT mean(key) FROM n GROUP BY time(1500ms)")], "time string, mean double")


# Administration.


@query("admin_databases", values([("default",), ("written",), ("kept",)], "name"))
def _databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    for name in ("kept", "kept", "gone"):
        engine.create_database(name)
    engine.write(lines(spark, sf_dir), "written")
    engine.delete_database("gone")
    return rows(spark, [(d["name"],) for d in Engine(spark, engine.warehouse.root).list_databases()], "name string")


@query("admin_missing_database", values([("NotFound", 404)], "error, status"))
def _missing_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        fresh(spark).delete_database("nothing")
    except NotFound as error:
        return rows(spark, [(type(error).__name__, error.status)], "error string, status int")
    return rows(spark, [], "error string, status int")


@query("bucket_ids", "SELECT DISTINCT event_type AS name, substr(sha256(event_type), 1, 16) AS id FROM events")
def _bucket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark, "v2")
    for r in events(spark, sf_dir).query_sql("SELECT DISTINCT event_type FROM events"):
        engine.create_bucket(r["event_type"])
    return rows(spark, [(b["name"], b["id"]) for b in engine.list_buckets()], "name string, id string")


@query("admin_buckets", "SELECT n_name AS name, substr(sha256(n_name), 1, 16) AS id FROM nation WHERE n_nationkey NOT IN (3, 4)")
def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, made = fresh(spark, "v2"), []
    for r in nations(spark, sf_dir):
        made.append(engine.create_bucket(r["n_name"]))
    engine.delete_bucket(made[3]["name"])
    engine.delete_bucket(made[4]["id"])
    engine.delete_bucket("nothing")
    return rows(spark, [(b["name"], b["id"]) for b in Engine(spark, engine.warehouse.root, "v2").list_buckets()], "name string, id string")


@query("admin_tokens", values([("reader", 16, True), ("writer", 16, True)], "description, length, hex"))
def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    made = [engine.create_token(name) for name in ("reader", "gone", "writer")]
    engine.delete_token(made[1]["id"])
    kept = Engine(spark, engine.warehouse.root).warehouse.catalog["tokens"]
    right = lambda t: set(t["id"]) <= set("0123456789abcdef") and t["token"].endswith(t["id"]) and len({x["id"] for x in made}) == 3
    return rows(spark, [(t["description"], len(t["id"]), right(t)) for t in kept], "description string, length int, hex boolean")


@query("admin_retention", f"{LINE_ROWS} WHERE n_nationkey <= 6")
def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    engine.create_database("short", "7d")
    engine.write(lines(spark, sf_dir, lambda k: f" {NOW - k * DAY}"), "short")
    engine.apply_retention()
    return engine.frame("SELECT key, name, region FROM n WHERE key < 7", database="short").unionByName(engine.frame("SELECT key, name, region FROM n WHERE key > 7", database="short"))


@query("health", values([("pass", "local")], "status, version"))
def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fresh(spark).health()
    return rows(spark, [(found["status"], found["version"])], "status string, version string")


# The operations of the three profiles.
OPERATIONS = {
    "health": "v2 v3_core v3_enterprise",
    "write": "v2 v3_core v3_enterprise",
    "query_sql": "v3_core v3_enterprise",
    "query_sql_stream": "v3_core v3_enterprise",
    "execute_sql": "v3_core v3_enterprise",
    "query_iql": "v3_core v3_enterprise",
    "query_flux": "v2",
    "create_database": "v3_core v3_enterprise",
    "list_databases": "v3_core v3_enterprise",
    "delete_database": "v3_core v3_enterprise",
    "create_bucket": "v2",
    "list_buckets": "v2",
    "delete_bucket": "v2",
    "create_token": "v3_enterprise",
    "delete_token": "v3_enterprise",
}


@query("profiles", values([(p, o, p in OPERATIONS[o].split()) for p in ("v2", "v3_core", "v3_enterprise") for o in OPERATIONS], "profile, operation, supported"))
def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each profile refuses, by calling it."""
    out = []
    calls = {
        "health": lambda e: e.health(), "write": lambda e: e.write("m v=1i", "own"), "query_sql": lambda e: e.query_sql("SELECT * FROM m"), "query_sql_stream": lambda e: list(e.stream("SELECT * FROM m")),
        "execute_sql": lambda e: e.execute_sql("VACUUM"), "query_iql": lambda e: e.query_iql("SHOW DATABASES"), "query_flux": lambda e: e.query_flux('from(bucket: "own")'),
        "create_database": lambda e: e.create_database("d"), "list_databases": lambda e: e.list_databases(), "delete_database": lambda e: e.delete_database("d"), "create_bucket": lambda e: e.create_bucket("b"),
        "list_buckets": lambda e: e.list_buckets(), "delete_bucket": lambda e: e.delete_bucket("b"), "create_token": lambda e: e.create_token("t"), "delete_token": lambda e: e.delete_token("t"),
    }
    for profile in sorted(PROFILES):
        engine = fresh(spark, profile, databases=["own"], database="own")
        engine.warehouse.append_lines("own", "m v=1i 1", "nanosecond")
        for name in OPERATIONS:
            try:
                calls[name](engine)
                out.append((profile, name, True))
            except Unsupported:
                out.append((profile, name, False))
    return rows(spark, out, "profile string, operation string, supported boolean")


CONFIGS = [("host", True), ("host port", True), ("", False), ("host colour", False), ("host scheme", False), ("host pool_size", False)]


@query("configurations", values(CONFIGS, "given, valid"))
def _configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = {"host": "h", "port": 8181, "colour": "red", "scheme": "ftp", "pool_size": 0}
    out = []
    for given, _ in CONFIGS:
        try:
            Config.validated(**{k: some[k] for k in given.split()})
            out.append((given, True))
        except InvalidConfig:
            out.append((given, False))
    return rows(spark, out, "given string, valid boolean")


@query("connections", f"SELECT 'a' AS connection, key, name, region FROM ({LINE_ROWS}) UNION ALL SELECT 'b', n_nationkey::BIGINT, n_name, n_regionkey::VARCHAR FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'missing', NULL, 'ConnectionMissing', NULL")
def _connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two connections at once, each with its writer and warehouse; one is removed, which flushes it."""
    open_, text = Connections(), lines(spark, sf_dir)
    engines = {}
    for name, own in (("a", text), ("b", "\n".join(text.split("\n")[:5]))):
        engines[name] = open_.add(spark, f"{session.shared_dir(spark)}/warehouse-{uuid.uuid4().hex}", host="h", name=name, writer={"flush_interval_ms": 600_000})
        open_.write(own, name)
    open_.flush("b")
    open_.remove("a")
    open_.remove("b")
    try:
        open_.get("a")
        gone = None
    except ConnectionMissing as error:
        gone = type(error).__name__
    frames = [engine.frame("SELECT key, name, region FROM n").withColumn("connection", F.lit(name)) for name, engine in engines.items()]
    return frames[0].unionByName(frames[1]).unionByName(rows(spark, [("missing", None, gone, None)], "connection string, key long, name string, region string"))


@query("telemetry", values([("write", "start", 0), ("write", "stop", 25), ("query", "start", 0), ("query", "stop", 25), ("query", "start", 0), ("query", "exception", 0)], "kind, phase, n"))
def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, seen, name = fresh(spark), [], uuid.uuid4().hex
    telemetry.attach(name, lambda event, measures, meta: seen.append((*event, int(measures.get("points", measures.get("rows", 0))))))
    try:
        engine.write(lines(spark, sf_dir))
        engine.query_sql("SELECT * FROM n")
        try:
            engine.query_sql("SELECT * FROM")
        except EngineError:
            pass
    finally:
        telemetry.detach(name)
    return rows(spark, seen, "kind string, phase string, n int")


# Buffered writes.


@query("batch_writer_rows", POINT_ROWS)
def _batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh(spark)
    with engine.batch_writer(batch_size=10, flush_interval_ms=600_000) as writer:  # two flushes by size, the rest on closing
        for p in points(spark, sf_dir):
            writer.write(p)
    return _point_rows(engine)


class _Target:
    """A write that answers with errors first."""

    def __init__(self, *errors: Exception):
        self.errors, self.calls = list(errors), 0

    def __call__(self, payload: str, **_: object) -> None:
        self.calls += 1
        if self.errors:
            raise self.errors.pop(0)


class _Status(StatusError):
    def __init__(self, status: int):
        self.status = status
        super().__init__("no")


BATCHES = [("full", 0, 0, 0), ("no sync", 0, 0, 0), ("passes", 1, 1, 0), ("refused", 1, 0, 1), ("retried", 3, 1, 0), ("timer", 1, 1, 0), ("too often", 4, 0, 1)]


@query("batch_writer_outcomes", values(BATCHES, "kind, calls, writes, errors"))
def _batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import time

    out = []

    def run(kind: str, target: _Target, act: Callable[[BatchWriter], None], **options: Any) -> None:
        writer = BatchWriter(target, **{"flush_interval_ms": 600_000, "sleep": lambda s: None, **options})
        try:
            act(writer)
        except (BufferFull, StatusError):
            pass
        stats = writer.stats()
        out.append((kind, target.calls, stats["total_writes"], stats["total_errors"]))
        writer._closed.set()

    def wait(writer: BatchWriter) -> None:
        writer.write("m v=1i")
        for _ in range(500):
            if writer.stats()["total_writes"]:
                return
            time.sleep(0.01)

    run("passes", _Target(), lambda w: w.write_sync("m v=1i"))
    run("retried", _Target(_Status(503), _Status(500)), lambda w: w.write_sync("m v=1i"))
    run("refused", _Target(_Status(400)), lambda w: w.write_sync("m v=1i"))
    run("too often", _Target(*[_Status(500) for _ in range(9)]), lambda w: w.write_sync("m v=1i"))
    run("full", _Target(), lambda w: w.write("\n".join(["m v=1i"] * 21)), batch_size=2)
    run("no sync", _Target(), lambda w: w.write_sync("m v=1i", no_sync=True))
    run("timer", _Target(), wait, flush_interval_ms=20)
    return rows(spark, out, "kind string, calls int, writes int, errors int")


# Decoding.


def _scratch(spark: SparkSession) -> str:
    return f"{session.shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("csv_decode", "SELECT event_id::VARCHAR AS event_id, event_type, user_id::VARCHAR AS user_id FROM events")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    decode.write(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), path, "csv")
    return decode.read(spark, path, "csv")


@query("jsonl_decode", "SELECT event_id, event_type, value, props FROM events")
def _jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    decode.write(table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props"), path, "jsonl", gzip=True)
    return decode.read(spark, path, "jsonl", "event_id long, event_type string, value double, props string")


@query("parquet_decode", EVENT_ROW.replace(f", {iso('ts')} AS time", ""))
def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    decode.write(table(spark, sf_dir, "events").drop("ts"), path, "parquet")
    return decode.read(spark, path, "parquet")


NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _body(spark: SparkSession, sf_dir: str, format: str, body: str | bytes) -> DataFrame:
    found = decode.parse(body, format)
    return rows(spark, [(int(r["n_nationkey"]), r["n_name"], int(r["n_regionkey"])) for r in found], "n_nationkey int, n_name string, n_regionkey int")


@query("json_body", NATION)
def _json_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir, "json", json.dumps([r.asDict() for r in nations(spark, sf_dir)]))


@query("jsonl_body", NATION)
def _jsonl_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir, "jsonl", "\n\n".join(json.dumps(r.asDict()) for r in nations(spark, sf_dir)))


@query("csv_body", NATION)
def _csv_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir, "csv", "\r\n".join(["n_nationkey,n_name,n_regionkey", *[",".join(map(str, r)) for r in nations(spark, sf_dir)]]))


@query("arrow_body_batches", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS n_name, n_regionkey FROM nation")
def _arrow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several record batches with nulls."""
    found = nations(spark, sf_dir)
    held = pa.table({"n_nationkey": pa.array([r[0] for r in found], pa.int32()), "n_name": [r[1] if r[0] % 3 else None for r in found], "n_regionkey": pa.array([r[2] for r in found], pa.int32())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as writer:
        for batch in held.to_batches(max_chunksize=4):
            writer.write_batch(batch)
    return _body(spark, sf_dir, "arrow", sink.getvalue().to_pybytes())


@query("json_single_object", values([("cpu", 1)], "name, n"))
def _json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [(r["name"], r["n"]) for r in decode.parse('{"name": "cpu", "n": 1}', "json")], "name string, n int")


BODIES = [("json", "not json", "json_parse_error"), ("jsonl", '{"a": 1}\n{bad', "jsonl_parse_error"), ("arrow", "junk", "arrow_parse_error"), ("xml", "<a/>", "UnsupportedFormat"), ("parquet", "raw bytes", "passed on"), ("csv", "", "passed on")]


@query("decode_errors", values(BODIES, "format, body, outcome"))
def _decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for format, body, _ in BODIES:
        try:
            found = decode.parse(body, format)
            outcome = "passed on" if found in (body, []) else "?"
        except DecodeError as error:
            outcome = error.kind
        except UnsupportedFormat as error:
            outcome = type(error).__name__
        out.append((format, body, outcome))
    return rows(spark, out, "format string, body string, outcome string")


TIMES = [("2024-01-01T00:00:00Z", 1704067200), ("2024-01-01T02:00:00+02:00", 1704067200), ("2024-01-01T00:00:00", None), ("yesterday", None), ("2024-13-01T00:00:00Z", None)]


@query("time_coercion", values(TIMES, "given, seconds"))
def _time_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode.parse(json.dumps([{"time": given, "other": given} for given, _ in TIMES]), "json")
    return rows(spark, [(r["other"], None if isinstance(r["time"], str) else int(r["time"].timestamp())) for r in found], "given string, seconds int")


# Text and points.


@query("encode_and_parse", POINT_ROWS)
def _encode_and_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_protocol.parse(line_protocol.encode(points(spark, sf_dir)))
    kept = [(r.fields["key"], r.fields["half"], r.fields["even"], r.fields["label"], str(r.fields["large"]), r.tags["name"], r.tags["region"], times.iso_text(r.time_ns)) for r in found if r.measurement == "nation stats"]
    return rows(spark, kept, "key long, half double, even boolean, label string, large string, name string, region string, time string")


# Streaming.


@query(
    "stream_rollup_append",
    f"SELECT {bin_(3600 * 10**9)} AS time, event_type, arg_min(value, (ts, -event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(event_id)::BIGINT AS volume "
    "FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE GROUP BY 1, 2",
)
def _stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a stream that appends each bucket to files when its watermark has closed it."""
    path = _scratch(spark)
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    hourly = rollup.candles(raw, "ts", "value", "event_id", "event_id", "1 hour", ["event_type"], watermark="1 minute")
    rollup.append(hourly, f"{path}/out", f"{path}/state").awaitTermination()
    found = spark.read.schema(hourly.schema).parquet(f"{path}/out")
    return found.select(F.date_format("bucket", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "event_type", "open", "high", "low", "close", "volume")


__all__ = ["QUERIES"]
