"""Line protocol: text to points and points to text, one line at a time or as DataFrames."""

from __future__ import annotations

import gzip
import math
import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.errors import BadRequest, EncodeError
from chronolake.functions.time import datetime_ns
from chronolake.model import Point, Value

PRECISIONS = {"nanosecond": 1, "microsecond": 10**3, "millisecond": 10**6, "second": 10**9}
PRECISIONS |= {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "n": 1, "u": 10**3}
TRUE, FALSE = frozenset({"true", "True", "TRUE"}), frozenset({"false", "False", "FALSE"})
_FLOAT = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_INTEGER = re.compile(r"[+-]?\d+")
LARGEST, MOST_DIGITS = 2**63, 38


class Row(NamedTuple):
    measurement: str
    tags: dict[str, str]
    fields: dict[str, Value]
    time_ns: int | None


def unzipped(payload: bytes | str) -> str:
    """Text of a payload that may be gzip."""
    if isinstance(payload, str):
        return payload
    if payload[:2] == b"\x1f\x8b":
        try:
            payload = gzip.decompress(payload)
        except (OSError, EOFError, ValueError) as error:
            raise BadRequest("invalid gzip payload") from error
    return payload.decode("utf-8")


def lines_of(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip() and not x.startswith("#")]


def _marks(mark: str, quotes: bool) -> re.Pattern[str]:
    """Escaped characters and, if asked for, quoted texts are passed over; group 1 is a mark that counts."""
    quoted = r'"(?:[^"\\]|\\.)*"|' if quotes else ""
    return re.compile(rf"\\.|{quoted}({re.escape(mark)})", re.DOTALL)


_MARKS = {(mark, quotes): _marks(mark, quotes) for mark in " ,=" for quotes in (False, True)}


def _split(text: str, mark: str, quotes: bool = False) -> list[str]:
    """Parts between marks that no backslash precedes and, if asked for, that stand outside double quotes."""
    if "\\" not in text and not (quotes and '"' in text):
        return text.split(mark)
    parts, start = [], 0
    for found in _MARKS[mark, quotes].finditer(text):
        if found[1]:
            parts.append(text[start : found.start()])
            start = found.end()
    parts.append(text[start:])
    return parts


def _plain(text: str, marks: str) -> str:
    """Without the backslashes before these marks."""
    return re.sub(rf"\\([{re.escape(marks)}])", r"\1", text) if "\\" in text else text


def _value(text: str) -> Value:
    last = text[-1:]
    if last == "i":
        if not _INTEGER.fullmatch(text[:-1]):
            raise BadRequest("invalid integer field")
        return int(text[:-1])
    if text[:1] == '"':
        if len(text) < 2 or last != '"':
            raise BadRequest("invalid field value")
        return text[1:-1].replace('\\"', '"').replace("\\\\", "\\")
    if text in TRUE:
        return True
    if text in FALSE:
        return False
    if _FLOAT.fullmatch(text) and math.isfinite(number := float(text)):
        return number
    raise BadRequest("invalid field value")


@lru_cache(maxsize=1 << 16)
def _series(text: str) -> tuple[str, dict[str, str]]:
    """Measurement and tags of a line's first part. Many lines share it; the tags are not to be changed."""
    name, *tags = _split(text, ",")
    if not name:
        raise BadRequest("invalid line protocol")
    own: dict[str, str] = {}
    for tag in tags:
        pair = _split(tag, "=")
        if len(pair) < 2 or not pair[0] or not pair[1]:
            raise BadRequest("invalid tag pair")
        own[_plain(pair[0], " ,=\\")] = _plain("=".join(pair[1:]), " ,=\\")
    return _plain(name.strip('"'), " ,\\"), own


def parse_line(line: str, scale: int = 1) -> Row:
    parts = [p for p in _split(line.strip("\r"), " ", quotes=True) if p]
    if len(parts) < 2:
        raise BadRequest("invalid line protocol")
    name, own = _series(parts[0])
    fields: dict[str, Value] = {}
    for item in _split(parts[1], ",", quotes=True):
        key, mark, value = _halves(item)
        if not mark or not key or not value:
            raise BadRequest("invalid field pair")
        fields[_plain(key, " ,=\\") if "\\" in key else key] = _value(value)
    stamp = None
    if len(parts) > 2:
        if not _INTEGER.fullmatch(parts[2]):
            raise BadRequest("invalid timestamp")
        stamp = int(parts[2]) * scale
        if not -LARGEST <= stamp < LARGEST:
            raise BadRequest("invalid timestamp")
    return Row(name, own, fields, stamp)


def _halves(item: str) -> tuple[str, str, str]:
    if "\\" not in item:
        return item.partition("=")
    key, *rest = _split(item, "=")
    return key, "=" if rest else "", item[len(key) + 1 :]


def parse(text: str, precision: str = "nanosecond") -> list[Row]:
    """All points of a payload; the first bad line fails it."""
    return parse_lines(lines_of(text), precision)


def parse_lines(lines: list[str], precision: str = "nanosecond") -> list[Row]:
    scale = scale_of(precision)
    return [parse_line(x, scale) for x in lines]


#: Bytes from which a payload is compressed.
GZIP_BYTES = 1024


def zipped(payload: str) -> bytes:
    """A payload as it is sent: compressed if it is over GZIP_BYTES long."""
    raw = payload.encode()
    return gzip.compress(raw) if len(raw) > GZIP_BYTES else raw


def scale_of(precision: str) -> int:
    if precision not in PRECISIONS:
        raise BadRequest(f"invalid precision: {precision}")
    return PRECISIONS[precision]


#: A parsed point: one map of fields for each kind, and what was wrong with the line.
STAGED = (
    "measurement string, tags map<string,string>, i map<string,bigint>, d map<string,decimal(38,0)>, f map<string,double>, "
    "b map<string,boolean>, s map<string,string>, time_ns bigint, error string"
)
_STAGED = pa.schema(
    [
        ("seq", pa.int64()),
        ("measurement", pa.string()),
        ("tags", pa.map_(pa.string(), pa.string())),
        ("i", pa.map_(pa.string(), pa.int64())),
        ("d", pa.map_(pa.string(), pa.decimal128(38, 0))),
        ("f", pa.map_(pa.string(), pa.float64())),
        ("b", pa.map_(pa.string(), pa.bool_())),
        ("s", pa.map_(pa.string(), pa.string())),
        ("time_ns", pa.int64()),
        ("error", pa.string()),
    ]
)


def kind_of(value: Value) -> str:
    if isinstance(value, bool):
        return "b"
    if isinstance(value, int):
        if -LARGEST <= value < LARGEST:
            return "i"
        if len(str(abs(value))) > MOST_DIGITS:
            raise BadRequest("invalid integer field")
        return "d"
    return "f" if isinstance(value, float) else "s"


def staged(lines: DataFrame, precision: str) -> DataFrame:
    """lines (seq bigint, value string) to points, in Arrow batches; a bad line gives a row with its error."""
    scale = scale_of(precision)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {name: [] for name in _STAGED.names}
            for seq, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not line or not line.strip() or line.startswith("#"):
                    continue
                cols["seq"].append(seq)
                maps: dict[str, list] = {k: [] for k in "idfbs"}
                try:
                    row = parse_line(line, scale)
                    for key, value in row.fields.items():
                        kind = kind_of(value)
                        maps[kind].append((key, value))
                    error = None
                except BadRequest as bad:
                    row, error = Row("", {}, {}, None), bad.body
                    maps = {k: [] for k in "idfbs"}
                cols["measurement"].append(row.measurement)
                cols["tags"].append(list(row.tags.items()))
                cols["time_ns"].append(row.time_ns)
                cols["error"].append(error)
                for kind, pairs in maps.items():
                    cols[kind].append(pairs)
            yield pa.RecordBatch.from_arrays([_array(cols[f.name], f.type) for f in _STAGED], schema=_STAGED)

    return lines.select(F.col("seq").cast("bigint"), "value").mapInArrow(run, f"seq bigint, {STAGED}")


def _array(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_map(kind) and pa.types.is_decimal(kind.item_type):
        from decimal import Decimal

        values = [[(k, Decimal(v)) for k, v in pairs] for pairs in values]
    return pa.array(values, kind)


# Points to text.


def _escaped(text: str, marks: str) -> str:
    return "".join("\\" + c if c in marks else c for c in text)


def _written(value: Value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}i"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise EncodeError("invalid_field", value)
        text = repr(value)
        return text if "." in text or "e" in text else f"{text}.0"
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def encode(points: Point | list[Point]) -> str:
    """Text of a point, or of several, a line each. Tags are sorted by key."""
    if isinstance(points, list):
        return "\n".join(encode(p) for p in points)
    if not points.measurement:
        raise EncodeError("empty_measurement")
    if not points.fields:
        raise EncodeError("empty_fields")
    head = _escaped(points.measurement, ", \\")
    for key in sorted(points.tags):
        head += f",{_escaped(str(key), ',= ' + chr(92))}={_escaped(str(points.tags[key]), ',= ' + chr(92))}"
    body = ",".join(f"{_escaped(str(k), ',= ' + chr(92))}={_written(v)}" for k, v in points.fields.items())
    stamp = points.timestamp
    if stamp is None:
        return f"{head} {body}"
    if isinstance(stamp, datetime):
        stamp = datetime_ns(stamp)
    if isinstance(stamp, bool) or not isinstance(stamp, int):
        raise EncodeError("invalid_timestamp", stamp)
    return f"{head} {body} {stamp}"


def encoded(measurement: str, tags: dict[str, Column], fields: dict[str, tuple[Column, str]], time_ns: Column) -> Column:
    """Lines as a column, inside generated code. fields: (column, kind); absent tags and fields are left out.

    As encode() does, a float that is no number or infinite fails the query. A row without any field has no line: its column is null.
    """
    if not measurement:
        raise EncodeError("empty_measurement")

    def escaped(col: Column) -> Column:
        return F.regexp_replace(col, r"([,= \\])", r"\\$1")

    def value(col: Column, kind: str) -> Column:
        if kind in "id":
            return F.concat(col.cast("string"), F.lit("i"))
        if kind == "f":
            finite = ~F.isnan(col) & (F.abs(col) < F.lit(math.inf))
            return F.when(col.isNull() | finite, col.cast("string")).otherwise(F.raise_error(F.concat(F.lit("invalid_field: "), col.cast("string"))))
        if kind == "b":
            return col.cast("string")
        return F.concat(F.lit('"'), F.regexp_replace(col, r'(["\\])', r"\\$1"), F.lit('"'))

    name = _escaped(measurement, ", \\")
    own = [F.concat(F.lit(_escaped(k, ",= \\") + "="), escaped(tags[k])) for k in sorted(tags)]
    body = F.concat_ws(",", *[F.concat(F.lit(_escaped(k, ",= \\") + "="), value(*fields[k])) for k in fields])
    return F.when(body != "", F.concat_ws(" ", F.concat_ws(",", F.lit(name), *own), body, time_ns.cast("string")))
