"""Writing, deleting, metadata, profiles, pipelines and the batch writer."""

import gzip

import pytest

from chronolake import telemetry
from chronolake.engine import Connections, Engine
from chronolake.errors import BadRequest, BufferFull, ConnectionMissing, DeleteNotSupported, InvalidConfig, NotFound, Unsupported, WriterClosed
from chronolake.model import PROFILES, Config, Point
from chronolake.streaming.batch_writer import BatchWriter

DEL = "cpu,host=web01 value=10i\ncpu,host=web02 value=20i\ncpu,host=web01 value=30i"


def test_delete(engine, spark, root):
    engine.write(DEL)
    assert engine.execute_sql("DELETE FROM cpu WHERE host='web01'") == {"rows_affected": 2}
    assert [r["host"] for r in engine.query_sql("SELECT * FROM cpu")] == ["web02"]
    with pytest.raises(BadRequest):
        engine.execute_sql("DELETE FROM cpu WHERE host ~ 'x'")
    assert engine.execute_sql("DELETE FROM cpu") == {"rows_affected": 1}
    assert engine.query_iql("SHOW MEASUREMENTS") == []
    assert engine.execute_sql("DELETE FROM nothing") == {"rows_affected": 0}
    assert engine.execute_sql("CREATE TABLE x (y int)") == {"rows_affected": 0}
    with pytest.raises(DeleteNotSupported):
        Engine(spark, root + "/core", "v3_core").execute_sql("DELETE FROM cpu")


def test_delete_binds_params(engine):
    engine.write(DEL)
    assert engine.execute_sql("DELETE FROM cpu WHERE value > $v AND host = $h", {"v": 15, "h": "web01"}) == {"rows_affected": 1}


def test_gzip_precision_and_server_time(spark, root):
    e = Engine(spark, root, now_ns=lambda: 1_700_000_000_123_456_789)
    e.write(gzip.compress(b"m v=1i 7"), precision="second")
    e.write("m v=2i 8", precision="millisecond")
    e.write("m v=3i 9", precision="microsecond")
    e.write("m v=4i")
    assert [r["time"] for r in e.query_sql("SELECT * FROM m ORDER BY time ASC")] == ["1970-01-01T00:00:00.000009000", "1970-01-01T00:00:00.008000000", "1970-01-01T00:00:07", "2023-11-14T22:13:20.123456789"]
    with pytest.raises(BadRequest, match="gzip"):
        e.write(b"\x1f\x8bnonsense")


def test_bad_line_writes_nothing(engine):
    with pytest.raises(BadRequest):
        engine.write("m v=1i 1\nthis is not line protocol!!", "fresh")
    assert {"name": "fresh"} not in engine.list_databases()
    assert engine.query_iql("SHOW MEASUREMENTS") == []


def test_tasks_parse_like_the_driver(engine, spark, root, monkeypatch):
    from chronolake.sources import storage

    text = "\n".join(f'm{i % 3},host=h{i % 5} a={i}i,b={i}.5,c="x y{i}",d=true {i}' for i in range(60)) + "\nm0 big=99999999999999999999i 99"
    engine.write(text, "one")
    monkeypatch.setattr(storage, "DRIVER_LINES", 5)
    assert engine.write(text, "two") == 61
    for m in ("m0", "m1", "m2"):
        assert engine.query_sql(f"SELECT * FROM {m}", database="one") == engine.query_sql(f"SELECT * FROM {m}", database="two")
    with pytest.raises(BadRequest, match="integer"):
        engine.write("\n".join(["m v=1i 1"] * 9 + ["m v=xi 2"]), "three")
    path = f"{root}/lines"
    import os

    os.makedirs(path)
    with gzip.open(f"{path}/a.lp.gz", "wt") as f:
        f.write(text)
    assert engine.write_files(path, "four") == 61
    assert engine.query_sql("SELECT * FROM m1 ORDER BY time ASC", database="four") == engine.query_sql("SELECT * FROM m1 ORDER BY time ASC", database="one")


def test_names_differ_by_case(engine):
    engine.write("m,Host=A,host=b V=1i,v=2.5 1\nm,HOST=c v=3.5 2")
    assert engine.query_sql("SELECT * FROM m ORDER BY time ASC")[0] == {"Host": "A", "host": "b", "V": 1, "v": 2.5, "time": "1970-01-01T00:00:00.000000001"}
    assert [r["v"] for r in engine.query_sql("SELECT * FROM m WHERE HOST = 'c'")] == [3.5]
    assert engine.warehouse.tag_keys("default", "m") == ["HOST", "Host", "host"]


def test_insert_rollup(engine):
    engine.write("\n".join(f"raw,host=h{i % 2} v={i}i {i * 600_000_000_000}" for i in range(24)))
    n = engine.execute_sql("INSERT INTO hourly SELECT DATE_BIN(INTERVAL '1 hour', time) AS time, host, AVG(v) AS mean FROM raw GROUP BY DATE_BIN(INTERVAL '1 hour', time), host")
    assert n == {"rows_affected": 8}
    rows = engine.query_sql("SELECT * FROM hourly WHERE host = 'h1' ORDER BY time ASC")
    assert [(r["time"], r["mean"]) for r in rows] == [(f"1970-01-01T0{h}:00:00", 6 * h + 3.0) for h in range(4)]
    assert engine.warehouse.tag_keys("default", "hourly") == ["host"]


def test_databases(engine):
    engine.create_database("a")
    engine.create_database("a")
    engine.write("m v=1i", "b")
    assert [d["name"] for d in engine.list_databases()] == ["a", "b", "default"]
    assert {"iox::database": "b"} in engine.query_iql("SHOW DATABASES")
    engine.delete_database("b")
    with pytest.raises(NotFound):
        engine.delete_database("b")
    engine.create_database("b")
    assert engine.query_iql("show measurements", database="b") == []


def test_catalog_outlives_the_engine(engine, spark, root):
    engine.write("m,t=x v=1i 1")
    again = Engine(spark, root, "v3_core")
    assert again.query_sql("SELECT * FROM m") == engine.query_sql("SELECT * FROM m")


def test_iql(engine):
    engine.write("\n".join(f"cpu,host=a,zone=z v={i}.0 {i * 60_000_000_000}" for i in range(10)))
    assert engine.query_iql("SHOW TAG KEYS FROM cpu") == [{"iox::measurement": "cpu", "tagKey": k} for k in ("host", "zone")]
    assert engine.query_iql('SHOW TAG KEYS FROM "nothing"') == []
    assert engine.query_iql("SHOW FIELD KEYS") == [{"iox::measurement": "cpu", "fieldKey": "v"}]
    rows = engine.query_iql("SELECT mean(v) FROM cpu WHERE host = 'a' GROUP BY time(5m)")
    assert sorted((r["time"], r["mean"]) for r in rows) == [("1970-01-01T00:00:00", 2.0), ("1970-01-01T00:05:00", 7.0)]
    assert len(engine.query_iql("SELECT * FROM cpu")) == 10


def test_flux(spark, root):
    now = 1_700_000_000_000_000_000
    e = Engine(spark, root, "v2", now_ns=lambda: now)
    with pytest.raises(NotFound):
        e.write("cpu v=1i", "fl")
    made = e.create_bucket("fl")
    assert made == e.create_bucket("fl") and len(made["id"]) == 16 and e.list_buckets() == [made]
    e.write(f"cpu,host=new value=1i {now - 5 * 10**9}\ncpu,host=old value=2i {now - 7200 * 10**9}\nmem,host=new used=3.5,value=\"s\" {now - 10**9}", "fl")
    run = lambda more: e.query_flux(f'from(bucket: "fl") {more}')
    of = '|> filter(fn: (r) => r._measurement == "cpu")'
    for start, n in (("-30s", 1), ("-1m", 1), ("-1h", 1), ("-1d", 2)):
        assert len(run(f"|> range(start: {start}) {of}")) == n
    assert len(run(of)) == 2
    assert len(run("")) == 3
    row = run(f'|> range(start: -1h) {of} |> filter(fn: (r) => r["host"] == "new")')[0]
    assert row["_measurement"] == "cpu" and row["value"] == 1
    assert run('|> filter(fn: (r) => r.value == "s")')[0]["used"] == 3.5
    e.delete_bucket("fl")
    e.delete_bucket("fl")
    assert e.list_buckets() == []


def test_profiles(spark, root):
    args = {"write": ("m v=1i",), "query_sql": ("SELECT 1",), "query_iql": ("SHOW DATABASES",), "query_flux": ("",), "execute_sql": ("",)}
    for profile, allowed in PROFILES.items():
        e = Engine(spark, f"{root}/{profile}", profile)
        for op in set().union(*PROFILES.values()) - allowed - {"query_sql_stream"}:
            with pytest.raises(Unsupported):
                getattr(e, op)(*args.get(op, () if op.startswith(("list", "health")) else ("x",)))
        assert e.health() == {"status": "pass", "version": "local"}
    e = Engine(spark, root, "v3_enterprise")
    token = e.create_token("mine")
    assert token["token"] == f"local-token-{token['id']}" and token["description"] == "mine"
    e.delete_token(token["id"])
    e.delete_token(token["id"])


def test_retention(spark, root):
    e = Engine(spark, root, now_ns=lambda: 10 * 86400 * 10**9)
    e.create_database("r", retention="2d")
    e.write("m v=1i 5\nm v=2i 864000000000000", "r")
    assert e.apply_retention() == 1
    assert [r["v"] for r in e.query_sql("SELECT * FROM m", database="r")] == [2]


def test_config_and_connections(spark, root):
    with pytest.raises(InvalidConfig):
        Config.validated(port=1)
    for bad in ({"port": "x"}, {"scheme": "ftp"}, {"pool_size": 0}, {"colour": 1}):
        with pytest.raises(InvalidConfig):
            Config.validated(host="h", **bad)
    assert Config.validated(host="h").url == "https://h:8086"
    c = Connections()
    c.add(spark, root, host="h", name="a", database="db").write("m v=1i")
    assert c.get("a").query_iql("SHOW MEASUREMENTS", database="db")[0]["name"] == "m" and c.config("a").host == "h"
    c.remove("a")
    with pytest.raises(ConnectionMissing):
        c.get("a")


def test_telemetry(engine):
    seen = []
    telemetry.attach("t", lambda e, m, meta: seen.append((e, m)))
    try:
        engine.write("m v=1i 1")
        engine.query_sql("SELECT * FROM m")
        with pytest.raises(BadRequest):
            engine.query_sql("SELECT * FROM m WHERE")
    finally:
        assert telemetry.detach("t") and not telemetry.detach("t")
    assert [e for e, _ in seen] == [("write", "start"), ("write", "stop"), ("query", "start"), ("query", "stop"), ("query", "start"), ("query", "exception")]
    assert seen[1][1]["points"] == 1 and seen[3][1]["rows"] == 1


class Sink:
    def __init__(self, errors=()):
        self.calls, self.errors = [], list(errors)

    def __call__(self, payload, database=None, precision=None, name=None):
        self.calls.append(payload)
        self.names = [*getattr(self, "names", []), name]
        if self.errors:
            raise self.errors.pop(0)


def writer(sink, **options):
    return BatchWriter(sink, **{"flush_interval_ms": 60_000, "sleep": lambda s: None, **options})


def wait(test):
    import time

    for _ in range(200):
        if test():
            return True
        time.sleep(0.01)
    return False


def test_batch_writer_size_timer_and_close():
    sink = Sink()
    with writer(sink, batch_size=3) as w:
        for k in range(3):
            w.write(Point("m", {"v": k}))
        assert wait(lambda: sink.calls == ["m v=0i\nm v=1i\nm v=2i"])
        w.write("m v=9i")
    assert sink.calls[1:] == ["m v=9i"] and w.stats() == {"total_writes": 2, "total_errors": 0, "total_bytes": 26}
    timed = Sink()
    w = writer(timed, flush_interval_ms=20)
    for k in range(2):  # the timer goes on after a flush
        w.write(f"m v={k}i")
        assert wait(lambda: len(timed.calls) == k + 1)  # noqa: B023
    w.close()


def test_batch_writer_full_retry_and_discard():
    w = writer(Sink(), batch_size=1_000_000)
    w.batch_size = 1
    w.write("\n".join(["m v=1i"] * 10))
    with pytest.raises(BufferFull):
        w.write("m v=1i")
    retried = Sink([OSError("x"), OSError("y")])
    w = writer(retried)
    w.write_sync("m v=1i")
    assert len(retried.calls) == 3 and w.stats()["total_writes"] == 1
    dropped = Sink([BadRequest("no")])
    w = writer(dropped)
    with pytest.raises(BadRequest):
        w.write_sync("m v=1i")
    assert len(dropped.calls) == 1 and w.stats()["total_errors"] == 1
    assert len(set(retried.names)) == 1 and retried.names[0]
    failed = Sink([OSError(str(k)) for k in range(9)])
    w = writer(failed, max_retries=2)
    w.write("m v=1i")
    with pytest.raises(OSError):  # the last flush does not fail in silence
        w.close()
    assert len(failed.calls) == 3 and w.stats()["total_errors"] == 1
    with pytest.raises(WriterClosed):
        w.write("m v=1i")


def test_batch_writer_of_engine(engine):
    w = engine.batch_writer(database="bw", flush_interval_ms=60_000)
    w.write([Point("m", {"v": 1.5}, {"t": "x"}, 5)])
    engine.flush()
    assert engine.query_sql("SELECT * FROM m", database="bw") == [{"t": "x", "v": 1.5, "time": "1970-01-01T00:00:00.000000005"}]
    assert engine.stats()["total_writes"] == 1
    engine.close()


# What a crash leaves.


class Crash(BaseException):
    """Not caught by anything that handles errors."""


class Brittle:
    """The warehouse's files, of which the k-th change fails, before or after it is done."""

    def __init__(self, files, k, done):
        self.files, self.left, self.done = files, k, done

    def __getattr__(self, name):
        run = getattr(self.files, name)
        if name not in ("write", "put", "rename", "move", "delete", "make"):
            return run

        def call(*args):
            self.left -= 1
            if self.left < 0 and not self.done:
                raise Crash
            out = run(*args)
            if self.left < 0:
                raise Crash
            return out

        return call


def points(engine, *names):
    out = {}
    for m in names or ("cpu", "mem"):
        try:
            out[m] = sorted((r["host"], r["value"]) for r in engine.query_sql(f"SELECT * FROM {m}"))
        except Exception as error:
            if "table not found" not in str(error):
                raise
            out[m] = []
    return out


BEFORE = "cpu,host=a value=1i 5\ncpu,host=b value=2i 6\ncpu,host=c value=3i 172800000000000\nmem,host=a value=9i 7"
CHANGES = {
    "write": (lambda e: e.write("cpu,host=d value=4i 8\nmem,host=d value=4i 90000000000000\nmem,host=e value=5i 1", name="w1"), {"cpu": [("a", 1), ("b", 2), ("c", 3), ("d", 4)], "mem": [("a", 9), ("d", 4), ("e", 5)]}),
    "delete": (lambda e: e.execute_sql("DELETE FROM cpu WHERE value >= 2"), {"cpu": [("a", 1)], "mem": [("a", 9)]}),
    "delete all": (lambda e: e.execute_sql("DELETE FROM cpu"), {"cpu": [], "mem": [("a", 9)]}),
    "compact": (lambda e: e.warehouse.compact("default", "cpu", 0), {"cpu": [("a", 1), ("b", 2), ("c", 3)], "mem": [("a", 9)]}),
}


@pytest.mark.parametrize("done", [False, True])
@pytest.mark.parametrize("kind", sorted(CHANGES))
def test_a_crash_at_any_step_loses_nothing(spark, root, monkeypatch, kind, done):
    from chronolake.sources import storage

    change, after = CHANGES[kind]
    before = {"cpu": [("a", 1), ("b", 2), ("c", 3)], "mem": [("a", 9)]}
    for k in range(60):
        path = f"{root}/{kind}{k}"
        Engine(spark, path, "v3_enterprise").write(BEFORE)
        engine = Engine(spark, path, "v3_enterprise")
        engine.warehouse.files = Brittle(engine.warehouse.files, k, done)
        try:
            change(engine)
        except Crash:
            found = Engine(spark, path, "v3_enterprise")
            left = points(found)
            assert left in (before, after)
            if kind == "write":  # the same batch again is not stored twice
                change(found)
                assert points(found) == after
                assert points(Engine(spark, path, "v3_enterprise")) == after
            with monkeypatch.context() as m:
                m.setattr(storage, "STALE_S", -5)
                assert not Engine(spark, path).warehouse.files.names(f"{path}/staging")
        else:
            break
    assert 2 < k < 59 and points(engine) == after


def test_a_failed_write_can_be_tried_again(spark, root):
    engine = Engine(spark, root)
    engine.write(BEFORE)
    files = engine.warehouse.files
    for k in range(12):
        engine.warehouse.files = Brittle(files, k, False)
        try:
            engine.write(f"cpu,host=x{k} value=1i 9", name=f"n{k}")
        except Crash:
            engine.warehouse.files = files
            engine.write(f"cpu,host=x{k} value=1i 9", name=f"n{k}")
    assert len(points(engine, "cpu")["cpu"]) == 15


def test_tasks_write_whole_payloads_too(spark, root, monkeypatch):
    from chronolake.sources import storage

    monkeypatch.setattr(storage, "DRIVER_LINES", 2)
    engine = Engine(spark, root)
    for _ in range(2):
        assert engine.write(BEFORE, name="once") == 4
    assert points(engine) == {"cpu": [("a", 1), ("b", 2), ("c", 3)], "mem": [("a", 9)]}
    with pytest.raises(BadRequest):
        engine.write("cpu,host=z value=1i\ncpu,host=z value=1i\nmem,host=z value=x", name="bad")
    assert points(engine)["mem"] == [("a", 9)] and not engine.warehouse.files.names(f"{root}/staging")


def test_compaction(spark, root):
    engine = Engine(spark, root)
    for k in range(20):
        engine.write(f"m,host=h{k % 3} v={k}i {k * 9_000_000_000_000}")
    rows = engine.query_sql("SELECT * FROM m")
    assert [r["v"] for r in rows] == list(reversed(range(20)))  # latest write first
    days = [d for d in engine.warehouse.files.names(f"{root}/default/m") if d.startswith("day=")]
    assert engine.warehouse.compact("default", "m", 1) == len(days) and engine.compact("m") == 0
    assert all(len(engine.warehouse.files.sizes(f"{root}/default/m/{d}")) == 1 for d in days)
    assert engine.query_sql("SELECT * FROM m") == rows == Engine(spark, root).query_sql("SELECT * FROM m")


# What is not understood is refused.


@pytest.mark.parametrize("stage", ["filter(fn: (r) => r.v > 5)", 'filter(fn: (r) => r.host == "a" and r.v > 5)', "aggregateWindow(every: 1h, fn: mean)", "mean()", 'filter(fn: (r) => r.host != "a")', 'filter(fn: (r) => r.host =~ /a/)', "group()"])
def test_flux_refuses_what_it_does_not_know(spark, root, stage):
    engine = Engine(spark, root, "v2")
    engine.create_bucket("b")
    engine.write("m,host=a v=1i", "b")
    with pytest.raises(BadRequest):
        engine.query_flux(f'from(bucket: "b") |> range(start: -1h) |> {stage}')
    assert len(engine.query_flux('from(bucket: "b") |> range(start: -1h) |> filter(fn: (r) => (r._measurement == "m") and r["host"] == "a") |> yield(name: "x")')) == 1


def test_iql_intervals_and_databases(engine):
    engine.write("\n".join(f"m v={k}i {k * 500_000_000}" for k in range(8)))
    assert [r["mean"] for r in sorted(engine.query_iql("SELECT mean(v) FROM m GROUP BY time(1500ms)"), key=lambda r: r["time"])] == [1.0, 4.0, 6.5]
    assert len(engine.query_iql("SELECT mean(v) FROM m GROUP BY time(500ms)")) == 8
    engine.write("other,rack=r v=1i", "second")
    assert [r["name"] for r in engine.query_iql('SHOW MEASUREMENTS ON "second"')] == ["other"] and [r["name"] for r in engine.query_iql("SHOW MEASUREMENTS")] == ["m"]
    assert [r["tagKey"] for r in engine.query_iql("SHOW TAG KEYS ON second FROM other")] == ["rack"] and engine.query_iql("SHOW FIELD KEYS ON second")[0]["fieldKey"] == "v"


def test_a_missing_parameter_is_an_error(engine):
    engine.write(DEL)
    for run in (engine.execute_sql, engine.query_sql):
        with pytest.raises(BadRequest, match="missing parameter"):
            run(("DELETE" if run == engine.execute_sql else "SELECT *") + " FROM cpu WHERE host != $h")
    assert len(engine.query_sql("SELECT * FROM cpu")) == 3


def test_time_as_a_field(engine):
    engine.write("m,host=a time=5i 0\nm,host=b time=9i 172800000000000")
    assert [r["host"] for r in engine.query_sql("SELECT host FROM m WHERE time > 6")] == ["b"]
    assert [r["host"] for r in engine.query_sql("SELECT host FROM m WHERE time < 6")] == ["a"]


def test_insert_refuses_types_that_it_cannot_store(engine):
    engine.write("m v=1i 1\nm v=2.5 2\nm v=true 3")
    with pytest.raises(BadRequest, match="cannot store v"):
        engine.execute_sql("INSERT INTO n SELECT * FROM m")


def test_retention_goes_with_its_database(spark, root):
    e = Engine(spark, root, "v3_core", now_ns=lambda: 10 * 86400 * 10**9)
    e.create_database("d", "1h")
    e.delete_database("d")
    e.write("m v=1i 5", "d")
    assert e.apply_retention() == 0 and len(e.query_sql("SELECT * FROM m", database="d")) == 1


def test_zone_of_the_session_does_not_matter(spark, root):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        e = Engine(spark, root)
        e.write("m v=1i 1700000000000000000")
        assert e.query_sql("SELECT * FROM m WHERE time = '2023-11-14T22:13:20Z'")[0]["time"] == "2023-11-14T22:13:20"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_export_and_unsorted_stream(engine, root):
    engine.write(DEL)
    engine.export("SELECT host, value FROM cpu WHERE value > 10", f"{root}/out")
    assert sorted(r["value"] for r in engine.spark.read.parquet(f"{root}/out").collect()) == [20, 30]
    assert sorted(r["value"] for r in engine.stream("SELECT * FROM cpu")) == [10, 20, 30]
    assert [r["value"] for r in engine.stream("SELECT * FROM cpu", ordered=True)] == [30, 20, 10] == [r["value"] for r in engine.query_sql("SELECT * FROM cpu")]
    table = engine.query_sql("SELECT * FROM cpu", format="arrow")
    assert table["value"].to_pylist() == [30, 20, 10] and sorted(table.column_names) == ["host", "time", "value"]


def test_connections_own_a_writer(spark, root):
    c = Connections()
    c.add(spark, root, host="h", name="a", database="db", writer={"flush_interval_ms": 60_000})
    c.write(Point("m", {"v": 1}), "a")
    assert c.stats("a")["total_writes"] == 0
    c.flush("a")
    assert c.stats("a")["total_writes"] == 1
    c.write("m v=2i", "a")
    engine = c.get("a")
    c.remove("a")
    assert sorted(r["v"] for r in engine.query_sql("SELECT * FROM m")) == [1, 2]


def test_direct_writes_are_compressed_when_long(engine, monkeypatch):
    from chronolake.sources import line_protocol

    seen, unzip = [], line_protocol.unzipped
    monkeypatch.setattr(line_protocol, "unzipped", lambda p: seen.append(p[:2]) or unzip(p))
    assert engine.write_direct(Point("m", {"v": 1})) == 1 and engine.write_direct([Point("m", {"text": "x" * 50}, timestamp=k) for k in range(30)]) == 30
    assert seen == [b"m ", b"\x1f\x8b"]
