"""Scans, filters, order, distinct and aggregates over small measurements."""

import pytest

from chronolake.engine import Engine
from chronolake.errors import BadRequest, TableNotFound
from chronolake.functions import time as times

H = times.NANOS["hour"]
CPU = "cpu,host=web01,region=us-east usage=10i,idle=90i 1000\ncpu,host=web02,region=us-west usage=20i,idle=80i 2000\ncpu,host=web01,region=us-east usage=30i,idle=70i 3000"
TYPED = "m,host=alpha active=true,temp=98.6,count=10i 1000\nm,host=beta active=false,temp=37.2,count=20i 2000\nm,host=gamma active=true,temp=100.1,count=30i 3000"
PRICES = "\n".join(f"prices,symbol={s} price={p} {k}000000000" for k, (s, p) in enumerate([("AAPL", 150.0), ("GOOG", 2800.0), ("AAPL", 151.0), ("MSFT", 300.0), ("GOOG", 2810.0)], 1))
HOURS = "\n".join(f"load,host=web0{1 + k // 3} usage={u}i,idle={100 - u}i {int((k + 0.5) * H)}" for k, u in enumerate([10, 20, 30, 40, 50, 60]))
TRADES = "\n".join(f"trades price={p},volume={v}i {int(t * H)}" for t, p, v in [(1 / 6, 100, 10), (1 / 2, 105, 20), (5 / 6, 102, 15), (7 / 6, 110, 5), (3 / 2, 108, 25), (11 / 6, 112, 30)])
ORDERED = "\n".join(f"ev,type={t} value={v}i,priority={p}i {int(q * H)}" for t, v, p, q in [("a", 100, 3, 0.25), ("b", 200, 1, 0.5), ("c", 300, 2, 0.75)])


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("sql")), "v3_core")
    e.write("\n".join([CPU, TYPED, PRICES, HOURS, TRADES, ORDERED]))
    return e


@pytest.fixture(scope="module")
def strict(data):
    e = Engine(data.spark, data.warehouse.root, "v3_core", strict=True)
    return e


def test_star_rows_latest_write_first(data):
    rows = data.query_sql("SELECT * FROM cpu")
    assert [r["usage"] for r in rows] == [30, 20, 10]
    assert rows[0] == {"host": "web01", "region": "us-east", "usage": 30, "idle": 70, "time": "1970-01-01T00:00:00.000003000"}
    assert "_measurement" not in rows[0]


@pytest.mark.parametrize(
    ("where", "usages"),
    [
        ("host = 'web01'", {10, 30}),
        ('host = "web01"', {10, 30}),
        ("usage > 10", {20, 30}),
        ("usage < 20.5", {10, 20}),
        ("usage >= 20", {20, 30}),
        ("usage <= 20", {10, 20}),
        ("usage != 20", {10, 30}),
        ("usage = 10.0", {10}),
        ("usage = '10'", set()),
        ("usage != '10'", {10, 20, 30}),
        ("usage < 'a'", {10, 20, 30}),
        ("usage > 'a'", set()),
        ("host > 5", {10, 20, 30}),
        ("nothing != 1", set()),
        ("host = web02", {20}),
        ("host='web01' AND usage>10", {30}),
        ("time >= 2000", {20, 30}),
        ("time = '3000'", {30}),
        ("time < '1970-01-01T00:00:00.000002Z'", {10}),
        ("time > 'rubbish'", set()),
        ("time < 'rubbish'", {10, 20, 30}),
        ("host IN ('web02', 'x') OR usage BETWEEN 25 AND 35", {20, 30}),
        ("NOT host LIKE '%2'", {10, 30}),
        ("region IS NOT NULL AND nothing IS NULL", {10, 20, 30}),
        ("host = 'a>b AND c'", set()),
    ],
)
def test_where(data, where, usages):
    assert {r["usage"] for r in data.query_sql(f"SELECT * FROM cpu WHERE {where}")} == usages


def test_booleans_and_floats(data):
    assert {r["host"] for r in data.query_sql("select * from m where active = true")} == {"alpha", "gamma"}
    assert [r["host"] for r in data.query_sql("SELECT * FROM m WHERE temp > 98.6")] == ["gamma"]
    assert {r["host"] for r in data.query_sql("SELECT * FROM m WHERE active < 'x' AND active > 3")} == {"alpha", "beta", "gamma"}
    assert data.query_sql("SELECT DISTINCT active FROM m") == [{"active": False}, {"active": True}]


def test_order_and_limit(data, strict):
    assert [r["usage"] for r in data.query_sql("SELECT * FROM cpu ORDER BY time ASC")] == [10, 20, 30]
    assert [r["usage"] for r in data.query_sql("SELECT * FROM cpu ORDER BY time DESC LIMIT 2")] == [30, 20]
    assert data.query_sql("SELECT * FROM cpu LIMIT 0") == []
    assert len(strict.query_sql("SELECT * FROM cpu LIMIT 0")) == 3
    assert [r["usage"] for r in data.query_sql("SELECT * FROM cpu ORDER BY idle LIMIT 1 OFFSET 1")] == [20]


def test_ties_newest_first(engine):
    engine.write("t v=1i 5\nt v=2i 5")
    engine.write("t v=3i 5")
    for way in ("ASC", "DESC"):
        assert [r["v"] for r in engine.query_sql(f"SELECT * FROM t ORDER BY time {way}")] == [3, 2, 1]
    row = engine.query_sql("SELECT DATE_BIN(INTERVAL '1 hour', time) AS b, FIRST(v) AS f, LAST(v) AS l FROM t GROUP BY DATE_BIN(INTERVAL '1 hour', time)")
    assert (row[0]["f"], row[0]["l"]) == (3, 3)


def test_params_bind_and_never_cut_each_other(data):
    assert len(data.query_sql("SELECT * FROM cpu WHERE host = $h AND usage > $hour", {"h": "web01", "$hour": 5})) == 2
    assert data.query_sql("SELECT * FROM cpu WHERE host = $h", {"h": "x' OR host = 'web01"}) == []
    assert data.query_sql("SELECT * FROM cpu WHERE host = $h", {"h": None}) == []
    assert {r["host"] for r in data.query_sql("SELECT * FROM m WHERE active = $a", {"a": False})} == {"beta"}


def test_distinct(data):
    assert data.query_sql("SELECT DISTINCT symbol FROM prices") == [{"symbol": s} for s in ("AAPL", "GOOG", "MSFT")]
    assert len(data.query_sql("SELECT DISTINCT price FROM prices")) == 5
    assert data.query_sql("SELECT DISTINCT symbol FROM prices WHERE price > 200") == [{"symbol": "GOOG"}, {"symbol": "MSFT"}]
    assert len(data.query_sql("SELECT DISTINCT symbol FROM prices LIMIT 2")) == 2
    assert data.query_sql("SELECT DISTINCT time FROM prices") == []


def binned(e, select, size, more=""):
    return e.query_sql(f"SELECT DATE_BIN(INTERVAL '{size}', time) AS t, {select} FROM load {more} GROUP BY DATE_BIN(INTERVAL '{size}', time) ORDER BY time ASC")


def test_buckets(data):
    assert binned(data, "AVG(usage) AS v", "2 hours") == [{"t": f"1970-01-01T0{h}:00:00", "v": v} for h, v in ((0, 15.0), (2, 35.0), (4, 55.0))]
    assert [r["v"] for r in binned(data, "SUM(usage) AS v", "3 hours")] == [60, 150]
    assert [r["v"] for r in binned(data, "COUNT(usage) AS v", "3 hours")] == [3, 3]
    assert binned(data, "MIN(usage) AS lo, MAX(usage) AS hi", "6 hours")[0] == {"t": "1970-01-01T00:00:00", "lo": 10, "hi": 60}
    assert [r["v"] for r in binned(data, "AVG(usage) AS v", "3 hours", "WHERE host = 'web01'")] == [20.0]
    assert len(binned(data, "COUNT(usage) AS v", "3600 SECONDS")) == 6
    assert [r["n"] for r in binned(data, "COUNT(nothing) AS n", "6 hours")] == [None]


def test_buckets_truncate_before_the_epoch(engine):
    engine.write(f"t v=1i {-H // 2}\nt v=2i {H // 2}")
    q = "SELECT DATE_BIN(INTERVAL '1 hour', time) AS b, COUNT(v) AS n FROM t GROUP BY DATE_BIN(INTERVAL '1 hour', time)"
    assert engine.query_sql(q) == [{"b": "1970-01-01T00:00:00", "n": 2}]
    engine.write("n v=1i -1")
    assert engine.query_sql("SELECT * FROM n")[0]["time"] == "1969-12-31T23:59:59.999999999"


def test_candles(data):
    q = "FIRST(price, time) AS o, MAX(price) AS h, MIN(price) AS l, LAST(price, time) AS c, SUM(volume) AS v"
    rows = data.query_sql(f"SELECT DATE_BIN(INTERVAL '1 hour', time) AS t, {q} FROM trades GROUP BY DATE_BIN(INTERVAL '1 hour', time) ORDER BY time ASC")
    assert [tuple(r.values())[1:] for r in rows] == [(100, 105, 100, 102, 45), (110, 112, 108, 112, 60)]
    one = data.query_sql("SELECT DATE_BIN(INTERVAL '2 hours', time) AS t, FIRST(price) AS a, LAST(price) AS b FROM trades WHERE price > 104 GROUP BY DATE_BIN(INTERVAL '2 hours', time)")
    assert (one[0]["a"], one[0]["b"]) == (105, 112)


def test_first_last_by_field_keep_nulls(data, engine):
    rows = data.query_sql("SELECT DATE_BIN(INTERVAL '1 hour', time) AS t, FIRST(value, priority) AS a, LAST(value, priority) AS b, FIRST(type, nothing) AS c FROM ev GROUP BY DATE_BIN(INTERVAL '1 hour', time)")
    assert (rows[0]["a"], rows[0]["b"], rows[0]["c"]) == (200, 100, "c")
    engine.write("t a=1i 5\nt b=2i 6")
    assert engine.query_sql("SELECT DATE_BIN(INTERVAL '1 day', time) AS t, LAST(a) AS a, LAST(b) AS b FROM t GROUP BY DATE_BIN(INTERVAL '1 day', time)")[0] == {"t": "1970-01-01T00:00:00", "a": None, "b": 2}


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("SELECT AVG(usage) AS a FROM cpu", "GROUP BY"),
        ("SELECT DATE_BIN(INTERVAL '1 hour', time) AS t, COUNT(*) AS n FROM cpu GROUP BY DATE_BIN(INTERVAL '1 hour', time)", "invalid aggregate"),
        ("SELECT host FROM cpu", "unsupported SQL"),
        ("SELECT host, AVG(usage) AS a FROM cpu GROUP BY DATE_BIN(INTERVAL '1 hour', time)", "unsupported column"),
    ],
)
def test_strict_refuses(strict, text, part):
    with pytest.raises(BadRequest, match=part):
        strict.query_sql(text)


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("SELECT DATE_BIN(INTERVAL '1 fortnight', time) AS t, AVG(usage) AS a FROM cpu GROUP BY DATE_BIN(INTERVAL '1 fortnight', time)", "fortnight"),
        ("SELECT DATE_BIN(INTERVAL '0 hours', time) AS t, AVG(usage) AS a FROM cpu GROUP BY DATE_BIN(INTERVAL '0 hours', time)", "interval"),
        ("SELECT DATE_BIN(INTERVAL '1 hour', time) AS t, AVG(usage) AS a FROM cpu GROUP BY DATE_BIN(INTERVAL '2 hours', time)", "differs"),
        ("SELECT AVG(host) AS a, AVG(active) AS b FROM m", "numbers"),
        ("SELEC * FROM cpu", "SELECT expected"),
        ("SELECT * cpu", "FROM"),
        ("SELECT * FROM cpu WHERE", "unsupported"),
        ("SELECT * FROM cpu WHERE host ~ 'x'", "unsupported"),
        ("SELECT * FROM cpu LIMIT x", "LIMIT"),
    ],
)
def test_bad_queries(data, text, part):
    with pytest.raises(BadRequest, match=part):
        data.query_sql(text)


def test_missing_table(data):
    with pytest.raises(TableNotFound):
        data.query_sql("SELECT * FROM nothing")
    with pytest.raises(TableNotFound):
        list(data.query_sql_stream("SELECT * FROM nothing"))
    assert list(data.query_sql_stream("SELECT * FROM nothing", swallow=True)) == []
    assert [r["usage"] for r in data.stream("SELECT * FROM cpu ORDER BY time ASC")] == [10, 20, 30]


def test_superset_groups(data):
    rows = data.query_sql("SELECT date_bin('6 hours', time) AS bucket, host, AVG(usage) AS a FROM load GROUP BY bucket, host ORDER BY host")
    assert [(r["host"], r["a"]) for r in rows] == [("web01", 20.0), ("web02", 50.0)]
    assert data.query_sql("SELECT COUNT(*) AS n, MAX(usage) - MIN(usage) AS d FROM load") == [{"n": 6, "d": 50}]


def test_time_filter_reaches_scan_and_partitions(data):
    plan = data.frame("SELECT * FROM load WHERE time >= '1970-01-01T02:00:00Z' AND host = 'web01'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time_ns" in plan and "EqualTo(`t:h" in plan and "PartitionFilters: [isnotnull(day" in plan


def test_mixed_types_keep_each_value(engine):
    engine.write('mix a=1i 1\nmix a=2.5 2\nmix a="x" 3\nmix a=true 4')
    assert [r["a"] for r in engine.query_sql("SELECT * FROM mix ORDER BY time ASC")] == [1, 2.5, "x", True]
    assert {r["a"] for r in engine.query_sql("SELECT a FROM mix WHERE a > 2")} == {2.5, "x", True}
    q = "SELECT DATE_BIN(INTERVAL '1 day', time) AS t, MIN(a) AS lo, MAX(a) AS hi, COUNT(a) AS n FROM mix GROUP BY DATE_BIN(INTERVAL '1 day', time)"
    assert engine.query_sql(q) == [{"t": "1970-01-01T00:00:00", "lo": 1.0, "hi": "x", "n": 4}]


def test_tag_hides_field_of_same_name(engine):
    engine.write("s,k=tag k=5i 1\ns k=6i 2")
    rows = engine.query_sql("SELECT * FROM s ORDER BY time ASC")
    assert [r["k"] for r in rows] == ["tag", "6"]
    assert len(engine.query_sql("SELECT * FROM s WHERE k = 'tag'")) == 1
    assert len(engine.query_sql("SELECT * FROM s WHERE k > 5")) == 2  # a string comes after any number


def test_everyday_queries(engine):
    """The kinds of query that an application of such a store runs all day."""
    from datetime import UTC, datetime, timedelta

    start = datetime(2024, 1, 1, tzinfo=UTC)
    lines = []
    for k in range(30):
        ns = times.datetime_ns(start + timedelta(minutes=k))
        lines.append(f"candles,symbol=X,timeframe=1m open={k}.0,high={k + 2}.0,low={k - 1}.0,close={k + 1}.0,volume={10**24 + k}i {ns}")
        lines.append(f"prices,symbol=X price={k}.5 {ns}")
    engine.write("\n".join(lines))
    run = engine.query_sql
    latest = run("SELECT * FROM candles WHERE symbol=$s AND timeframe=$tf ORDER BY time DESC LIMIT $n", {"s": "X", "tf": "1m", "n": 3})
    assert [r["open"] for r in latest] == [29, 28, 27] and latest[0]["volume"] == 10**24 + 29
    span = {"s": "X", "tf": "1m", "start": start + timedelta(minutes=5), "end": (start + timedelta(minutes=9)).isoformat()}
    assert len(run("SELECT * FROM candles WHERE symbol=$s AND timeframe=$tf AND time >= $start AND time <= $end", span)) == 5
    assert run("SELECT * FROM prices WHERE symbol=$s ORDER BY time DESC LIMIT 1", {"s": "X"})[0]["price"] == 29.5
    rows = run("SELECT date_bin('5 minutes', time) AS bucket, avg(price) FROM prices WHERE symbol=$s GROUP BY bucket ORDER BY bucket", {"s": "X"})
    assert [(r["bucket"], r["avg"]) for r in rows][:2] == [("2024-01-01T00:00:00", 2.5), ("2024-01-01T00:05:00", 7.5)]
    n = engine.execute_sql("INSERT INTO candles5 SELECT date_bin('5m', time) AS time, symbol, first(open, time) AS open, max(high) AS high, min(low) AS low, last(close, time) AS close FROM candles WHERE timeframe='1m' GROUP BY date_bin('5m', time), symbol")
    assert n == {"rows_affected": 6}
    assert run("SELECT open, high, low, close FROM candles5 ORDER BY time ASC LIMIT 1") == [{"open": 0.0, "high": 6.0, "low": -1.0, "close": 5.0}]
    assert engine.execute_sql("DELETE FROM candles WHERE timeframe='1m' AND time < $cutoff", {"cutoff": start + timedelta(minutes=10)}) == {"rows_affected": 10}
    assert run("SELECT COUNT(*) AS n FROM candles") == [{"n": 20}]
