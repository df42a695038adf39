"""Every named query against its SQL in DuckDB, the streaming cascade, and the decoders."""

import math
import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from chronolake.errors import DecodeError, UnsupportedFormat
from chronolake.plans import engine_queries, registry
from chronolake.sources import decode
from chronolake.streaming import rollup

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("region", "nation", "orders", "lineitem", "events"):
        c.sql(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return c


def key(row):
    return [("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row]


@pytest.mark.parametrize("name", sorted(engine_queries.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DIR)
    wanted = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    cols = sorted(found.columns)
    a = sorted(([r[c] for c in cols] for r in found.collect()), key=key)
    at = [wanted.columns.index(c) for c in cols]
    b = sorted(([r[k] for k in at] for r in wanted.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or isinstance(u, float) and math.isclose(u, v, rel_tol=1e-12) for u, v in zip(x, y)), (x, y)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["time", "open", "high", "low", "close", "volume"] and df.count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_stream_appends_what_the_batch_gives(spark, root):
    df = spark.read.parquet(f"{DIR}/events.parquet")
    points = spark.readStream.schema(df.schema).parquet(f"{DIR}/events*.parquet")
    hourly = rollup.candles(points, "ts", "value", "event_id", "event_id", "1 hour", ["event_type"], watermark="1 minute")
    rollup.append(hourly, f"{root}/out", f"{root}/ck").awaitTermination()
    batch = rollup.candles(df, "ts", "value", "event_id", "event_id", "1 hour", ["event_type"])
    got = spark.read.schema(batch.schema).parquet(f"{root}/out")
    last = df.agg(F.max("ts")).first()[0]
    closed = batch.where(F.col("bucket") + F.expr("interval 1 hour") < F.lit(last) - F.expr("interval 1 minute"))
    assert got.count() >= closed.count() > 0
    assert closed.exceptAll(got).count() == 0


def test_decoders(spark, root):
    assert decode.parse('[{"name":"cpu","value":0.64}]', "json") == [{"name": "cpu", "value": 0.64}]
    assert decode.parse('{"a":1}', "json") == [{"a": 1}]
    assert len(decode.parse('{"a":1}\n{"a":2}\n', "jsonl")) == 2
    assert decode.parse("name,value\ncpu,0.64\nmem,0.85", "csv") == [{"name": "cpu", "value": "0.64"}, {"name": "mem", "value": "0.85"}]
    assert decode.parse("", "csv") == [] and decode.parse(b"raw", "parquet") == b"raw"
    for body, kind in (("not json", "json"), ('{"a":1}\n{bad', "jsonl"), (b"junk", "arrow")):
        with pytest.raises(DecodeError):
            decode.parse(body, kind)
    with pytest.raises(UnsupportedFormat):
        decode.parse("", "xml")
    assert decode.coerced({"time": "2024-01-01T00:00:00Z"})["time"].year == 2024
    assert decode.coerced({"time": "2024-01-01T00:00:00"})["time"] == "2024-01-01T00:00:00"
    table = pa.table({"i": pa.array([1, None], pa.int16()), "t": pa.array([5, 6], pa.timestamp("ns")), "s": ["a", None], "u": pa.array([2**63, 1], pa.uint64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        for batch in table.to_batches(max_chunksize=1):
            w.write_batch(batch)
    assert decode.parse(sink.getvalue().to_pybytes(), "arrow") == [{"i": 1, "t": 5, "s": "a", "u": 2**63}, {"i": None, "t": 6, "s": None, "u": 1}]
    df = spark.range(5).withColumn("s", F.concat(F.lit("x"), "id"))
    for kind in ("json", "jsonl", "csv", "parquet"):
        decode.write(df.coalesce(1), f"{root}/{kind}", kind, gzip=kind != "parquet")
        if kind != "json":
            assert decode.read(spark, f"{root}/{kind}", kind).count() == 5


def test_cascade_of_streams(spark, root):
    df = spark.read.parquet(f"{DIR}/events.parquet")
    points = spark.readStream.schema(df.schema).parquet(f"{DIR}/events*.parquet")
    rollup.cascade(points, root, ["1 hour", "4 hours", "1 day"], "ts", "value", "event_id", "event_id")
    got = spark.read.parquet(f"{root}/1_day")
    daily = rollup.candles(df, "ts", "value", "event_id", "event_id", "1 day")
    assert 0 < got.count() < daily.count()  # what the watermark has not closed yet is missing
    whole = daily.join(got.select("bucket"), "bucket")
    assert whole.exceptAll(got).count() == 0 and got.count() >= daily.count() - 2


def test_entry_without_packages_of_the_optional_operators():
    """The engine's queries stay if a package that only the training-data operators need is missing; other faults are not hidden."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for module in ("ahocorasick", "chronolake.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'ohlcv_daily' in q and 'delete_where' in q and 'pipeline' not in q"
        assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
    assert subprocess.run([sys.executable, "-c", "import sys; sys.modules['pyarrow'] = None; import __spark_entry__"], cwd=root, capture_output=True).returncode != 0
