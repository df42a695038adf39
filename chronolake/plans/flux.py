"""The pipeline language: from(bucket:) |> range() |> filter() and a few more stages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.errors import BadRequest
from chronolake.functions import time as times
from chronolake.operators import filters
from chronolake.sources.measurement import Measurement


@dataclass
class Pipeline:
    bucket: str | None = None
    measurement: str | None = None
    start: str | None = None
    stop: str | None = None
    equal: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = None


_CALL = re.compile(r"(\w+)\s*\(", re.DOTALL)
_PAIR = re.compile(r"""r(?:\.(\w+)|\[\s*"([^"]+)"\s*\])\s*==\s*"((?:[^"\\]|\\.)*)\"""")


def _stages(text: str) -> list[tuple[str, str]]:
    """(name, text between the parentheses) of every call on the top level."""
    out, at = [], 0
    while found := _CALL.search(text, at):
        depth, k, quoted = 1, found.end(), False
        while k < len(text) and depth:
            c = text[k]
            if c == '"' and text[k - 1] != "\\":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
            k += 1
        out.append((found[1], text[found.end() : k - 1]))
        at = k
    return out


def _equal(body: str) -> Iterator[tuple[str, str]]:
    """(key, value) of the comparisons that a filter joins by `and`; whatever else stands in it is refused."""
    found = re.fullmatch(r"\s*fn\s*:\s*\(\s*r\s*\)\s*=>\s*(.+)", body, re.DOTALL)
    if not found:
        raise BadRequest(f"unsupported filter: {body.strip()}")
    own = re.sub(r"^\{\s*return\b(.*)\}$", r"\1", found[1].strip(), flags=re.DOTALL)
    at = 0
    while True:
        pair = re.compile(rf"[\s(]*{_PAIR.pattern}[\s)]*").match(own, at)
        if not pair:
            raise BadRequest(f"unsupported filter: {own[at:].strip()}")
        yield pair[1] or pair[2], pair[3].replace('\\"', '"')
        at = pair.end()
        if at == len(own):
            return
        joined = re.compile(r"and\b").match(own, at)
        if not joined:
            raise BadRequest(f"unsupported filter: {own[at:].strip()}")
        at = joined.end()


def parse(text: str) -> Pipeline:
    """Of each filter, all comparisons joined by `and` hold. yield() changes nothing; other stages and comparisons are refused."""
    p = Pipeline()
    for name, body in _stages(text):
        if name == "from":
            found = re.search(r'bucket\s*:\s*"([^"]*)"', body)
            p.bucket = found[1] if found else None
        elif name == "range":
            for key in ("start", "stop"):
                found = re.search(rf"\b{key}\s*:\s*([^,\s]+)", body)
                if found:
                    setattr(p, key, found[1])
        elif name == "filter":
            for key, value in _equal(body):
                if key == "_measurement":
                    p.measurement = value
                else:
                    p.equal.append((key, value))
        elif name == "limit":
            found = re.search(r"\bn\s*:\s*(\d+)", body)
            p.limit = int(found[1]) if found else None
        elif name != "yield":
            raise BadRequest(f"unsupported stage: {name}")
    return p


def moment(text: str, now_ns: int) -> int:
    if re.fullmatch(r"[+-]\d+[a-z]+", text):
        return now_ns + times.duration_ns(text)
    if text == "now()":
        return now_ns
    found = times.parse_iso(text.strip('"'))
    if found is None and text.isdigit():
        found = int(text) * 10**9
    if found is None:
        raise BadRequest(f"invalid time in range: {text}")
    return found


def condition(p: Pipeline, m: Measurement, now_ns: int) -> Column | None:
    parts = []
    if p.start:
        parts.append(filters.time(m, ">=", moment(p.start, now_ns)))
    if p.stop:
        parts.append(filters.time(m, "<", moment(p.stop, now_ns)))
    for key, value in p.equal:
        own = []
        if key in m.tags:
            own.append(m.tag(key) == value)
        if key in m.fields and "s" in m.fields[key]:
            own.append(m.of_class(key, "string") == value)
        parts.append(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), own) if own else F.lit(False))
    return reduce(lambda a, b: a & b, parts) if parts else None


def rows(p: Pipeline, m: Measurement, now_ns: int, columns: list[Column], written_order: bool) -> DataFrame:
    df = m.df
    if m.day and p.start:
        df = df.where(F.col(m.day) >= F.date_from_unix_date(F.lit(moment(p.start, now_ns) // times.DAY)))
    found = condition(p, m, now_ns)
    if found is not None:
        df = df.where(found)
    if written_order:
        df = df.orderBy(*m.written_order())
    if p.limit is not None:
        df = df.limit(p.limit)
    return df.select(*columns, F.lit(m.name).alias("_measurement"))
