"""Response bodies: JSON, JSON lines, CSV, Parquet and Arrow to rows or DataFrames, and DataFrames to them."""

from __future__ import annotations

import json
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.errors import DecodeError, UnsupportedFormat

FORMATS = ("json", "jsonl", "csv", "parquet", "arrow")


def parse(body: str | bytes, format: str = "json") -> Any:
    """Rows of a body that fits the driver. CSV values stay strings; Parquet bytes are passed on as they are."""
    if format == "parquet":
        return body
    if format == "arrow":
        return rows_of_arrow(body if isinstance(body, bytes) else body.encode())
    text = body.decode() if isinstance(body, bytes) else body
    if format == "json":
        try:
            found = json.loads(text)
        except ValueError as error:
            raise DecodeError("json_parse_error", str(error)) from error
        return [coerced(r) for r in (found if isinstance(found, list) else [found])]
    if format == "jsonl":
        out = []
        for line in text.split("\n"):
            if line.strip():
                try:
                    out.append(coerced(json.loads(line)))
                except ValueError as error:
                    raise DecodeError("jsonl_parse_error", str(error)) from error
        return out
    if format == "csv":
        lines = [x.rstrip("\r") for x in text.split("\n") if x.strip()]
        if not lines:
            return []
        header = lines[0].split(",")
        return [coerced(dict(zip(header, x.split(",")))) for x in lines[1:]]
    raise UnsupportedFormat(format)


def coerced(row: Any) -> Any:
    """The row with its time, if that is ISO text with a zone, as a datetime."""
    stamp = row.get("time") if isinstance(row, dict) else None
    if isinstance(stamp, str) and ("Z" in stamp or "z" in stamp or "+" in stamp or stamp.count("-") > 2):
        try:
            return {**row, "time": datetime.fromisoformat(stamp.replace("z", "Z"))}
        except ValueError:
            return row
    return row


def arrow_table(body: bytes) -> pa.Table:
    try:
        return pa.ipc.open_stream(body).read_all()
    except (pa.ArrowInvalid, OSError) as error:
        raise DecodeError("arrow_parse_error", str(error)) from error


def rows_of_arrow(body: bytes) -> list[dict]:
    """Rows of an Arrow stream; timestamps are their integers."""
    if not body:
        return []
    table = arrow_table(body)
    cols = [c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in table.columns]
    return pa.Table.from_arrays(cols, names=table.column_names).to_pylist()


def arrow_body(df: DataFrame) -> bytes:
    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def frame_of_arrow(spark: SparkSession, body: bytes) -> DataFrame:
    return spark.createDataFrame(arrow_table(body))


def read(spark: SparkSession, path: str, format: str, schema: str | None = None) -> DataFrame:
    """Files of any number as a DataFrame. A bad JSON line fails the query; CSV columns are strings."""
    if format not in FORMATS or format == "arrow":
        raise UnsupportedFormat(format)
    reader = spark.read.schema(schema) if schema else spark.read
    if format == "json":
        return reader.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if format == "jsonl":
        return reader.option("mode", "FAILFAST").json(path)
    if format == "csv":
        return reader.option("header", True).option("inferSchema", False).csv(path)
    return reader.parquet(path)


def write(df: DataFrame, path: str, format: str, gzip: bool = False) -> None:
    if format not in FORMATS or format == "arrow":
        raise UnsupportedFormat(format)
    writer = df.write.option("compression", "gzip") if gzip else df.write
    {"json": writer.json, "jsonl": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet}[format](path)


def json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A column of JSON text as columns; what does not parse fails the query."""
    parsed = F.from_json(F.col(column), schema, {"mode": "FAILFAST"})
    return df.withColumn("_json", parsed).select(*[c for c in df.columns if c != column], "_json.*")
