"""The warehouse: a catalog of databases, buckets, tokens and measurements, and one Parquet table per measurement.

A measurement's table is wide, one column per tag and per field and kind of value, partitioned by day, so that filters on tags,
fields and time reach the scan. _seq numbers the points in the order of writing. The catalog keeps each table's columns; a scan
gives that schema, so that files written before a column existed need no rewriting.

Every change is whole. New files are written to a staging folder, where no scan looks. Then one new version of the catalog, a
numbered file that exists as a whole or not at all, tells the change and the steps that move the files to their places. The steps can be
repeated: whoever opens a warehouse first does those that a dead writer has left. A write may carry a name; one that the catalog knows is not done again.

One writer at a time may change a warehouse; readers see whole files only.
"""

from __future__ import annotations

import hashlib
import io
import json
import secrets
import threading
import time
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, datetime, timedelta
from decimal import Decimal
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolake.errors import BadRequest, NotFound, TableNotFound
from chronolake.functions import time as times
from chronolake.sources import line_protocol
from chronolake.sources.files import Files
from chronolake.sources.measurement import KINDS, Measurement, ident

ARROW = {"i": pa.int64(), "d": pa.decimal128(38, 0), "f": pa.float64(), "b": pa.bool_(), "s": pa.string()}
TYPES = {"i": "bigint", "d": "decimal(38,0)", "f": "double", "b": "boolean", "s": "string"}
#: Lines up to which a payload is parsed on the driver; beyond, by tasks.
DRIVER_LINES = 20_000
#: Bits that Spark's increasing ids use within a partition.
SEQ_BITS = 33
#: Rows of a day that one task writes in a large append, and names of writes that the catalog remembers.
TASK_ROWS, REMEMBERED = 5_000_000, 1000
#: Seconds after which staged files are a dead writer's.
STALE_S = 3600
#: Files of a day from which compact() rewrites it, and bytes of a file that it makes.
MOST_FILES, FILE_BYTES = 16, 128 << 20


def folder(name: str) -> str:
    return quote(name, safe="-") or "%"


def column(kind: str, name: str) -> str:
    """The table's column of a tag (kind t) or field. Spark takes names without regard to case, so that capitals are told apart by a checksum."""
    lower = name.lower()
    return f"{kind}:{name}" if name == lower else f"{kind}:{lower}#{zlib.crc32(name.encode()):08x}"


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, databases: list[str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)
        self.lock = threading.RLock()
        self._scans: dict[tuple[str, str], Measurement] = {}  # until the table changes: its files are listed once
        self.files.make(f"{self.root}/catalog")
        self.version, self.catalog = 0, None
        found = sorted((int(n[:-5]) for n in self.files.names(f"{self.root}/catalog") if n.endswith(".json")), reverse=True)
        if found:
            self.version, self.catalog = found[0], json.loads(self.files.read(self._catalog_file(found[0])))
        else:
            self.catalog = {"databases": ["default"], "buckets": [], "tokens": [], "tables": {}}
        self._redo()
        for name in self.files.names(f"{self.root}/staging", older_s=STALE_S):
            self.files.delete(f"{self.root}/staging/{name}")
        for name in databases or []:
            self.create_database(name)
        if not found:
            self._save()

    def _catalog_file(self, version: int) -> str:
        return f"{self.root}/catalog/{version:012d}.json"

    def _save(self) -> None:
        """Writes the next version of the catalog, which counts from then on, and deletes the one before the last."""
        self.files.write(self._catalog_file(self.version + 1), json.dumps(self.catalog))
        self.version += 1
        self.files.delete(self._catalog_file(self.version - 2))

    def _redo(self) -> None:
        """Does the steps that the catalog tells, those done already included, and forgets them.

        A file that has been moved is not there to be moved again, so that moves may be told on until the next version; other steps may not.
        """
        steps = self.catalog.get("steps", [])
        for kind, path, new in steps:
            if kind == "delete":
                self.files.delete(path)
            elif self.files.exists(path):  # else it has been moved
                if kind == "replace":
                    self.files.delete(new)
                self.files.move(path, new)
        self.catalog["steps"] = []
        if any(kind != "move" for kind, *_ in steps):
            self._save()

    @contextmanager
    def _change(self) -> Iterator[None]:
        """A change of the warehouse: what is not committed is as if it had not been begun."""
        with self.lock:
            self._redo()
            before, version = json.dumps(self.catalog), self.version
            try:
                yield
            except BaseException:
                if self.version == version:
                    self.catalog = json.loads(before)
                    self._scans.clear()
                raise

    def _commit(self, steps: list[tuple[str, str, str]]) -> None:
        """Makes the changed catalog count, and with it the steps: delete a path, move a file or folder to a new path, or replace one there."""
        self.catalog["steps"] = [list(x) for x in steps]
        self._save()
        self._redo()

    def _staged(self) -> str:
        return f"{self.root}/staging/{uuid.uuid4().hex}"

    def _arrivals(self, staged: str, database: str, measurement: str) -> list[tuple[str, str, str]]:
        """Steps that move the files of a staged table, day by day, into the table."""
        path = self._where(database, measurement)
        return [
            ("move", f"{staged}/{day}/{name}", f"{path}/{day}/{name}")
            for day in self.files.names(staged)
            if day.startswith("day=")
            for name in self.files.names(f"{staged}/{day}")
            if name.endswith(".parquet")
        ]

    def _known(self, name: str | None) -> bool:
        """Whether a write of this name has been done; else it is noted as done, which counts with the next version of the catalog."""
        if name is None:
            return False
        done = self.catalog.setdefault("writes", [])
        if name in done:
            return True
        self.catalog["writes"] = [*done, name][-REMEMBERED:]
        return False

    # Namespaces and tokens.

    def create_database(self, name: str, retention: str | None = None) -> None:
        with self._change():
            if name not in self.catalog["databases"]:
                self.catalog["databases"].append(name)
            if retention:
                self.catalog.setdefault("retention", {})[name] = times.duration_ns(retention)
            self._save()

    def delete_database(self, name: str) -> None:
        with self._change():
            if name not in self.catalog["databases"]:
                raise NotFound(f"database not found: {name}")
            self.catalog["databases"].remove(name)
            self._drop(name)

    def create_bucket(self, name: str, retention: str | None = None) -> dict:
        with self._change():
            if name not in self.catalog["buckets"]:
                self.catalog["buckets"].append(name)
            if retention:
                self.catalog.setdefault("retention", {})[name] = times.duration_ns(retention)
            self._save()
        return {"id": bucket_id(name), "name": name}

    def delete_bucket(self, name: str) -> None:
        """By name or id; a bucket that is not there is no error."""
        with self._change():
            gone = [b for b in self.catalog["buckets"] if name in (b, bucket_id(b))]
            self.catalog["buckets"] = [b for b in self.catalog["buckets"] if b not in gone]
            for b in gone:
                if b not in self.catalog["databases"]:
                    self._drop(b)
            self._save()

    def _drop(self, name: str) -> None:
        """A namespace's tables, files and retention go."""
        self.catalog["tables"].pop(name, None)
        self.catalog.get("retention", {}).pop(name, None)
        self._scans.clear()
        self._commit([("delete", f"{self.root}/{folder(name)}", "")])

    def create_token(self, description: str) -> dict:
        name = secrets.token_hex(8)
        token = {"id": name, "token": f"local-token-{name}", "description": description}
        with self._change():
            self.catalog["tokens"].append(token)
            self._save()
        return dict(token)

    def delete_token(self, name: str) -> None:
        with self._change():
            self.catalog["tokens"] = [t for t in self.catalog["tokens"] if t["id"] != name]
            self._save()

    # Tables.

    def tables(self, database: str) -> dict[str, dict]:
        return self.catalog["tables"].get(database, {})

    def _where(self, database: str, measurement: str) -> str:
        return f"{self.root}/{folder(database)}/{folder(measurement)}"

    def tag_keys(self, database: str, measurement: str) -> list[str]:
        return sorted(self.tables(database).get(measurement, {}).get("tags", []))

    def schema(self, table: dict) -> T.StructType:
        cols = [(column("t", t), "string") for t in table["tags"]]
        cols += [(column(k, name), TYPES[k]) for name, kinds in table["fields"].items() for k in kinds]
        out = T.StructType()
        for name, kind in [("time_ns", "bigint"), ("_seq", "bigint"), *cols, ("day", "date")]:
            out = out.add(name, "long" if kind == "bigint" else kind)
        return out

    def scan(self, database: str, measurement: str) -> Measurement:
        table = self.tables(database).get(measurement)
        if table is None:
            raise TableNotFound(measurement)
        if (database, measurement) in self._scans:
            return self._scans[database, measurement]
        df = self.spark.read.schema(self.schema(table)).parquet(self._where(database, measurement))
        fields = {name: {k: column(k, name) for k in kinds} for name, kinds in table["fields"].items()}
        found = Measurement(measurement, df, {t: column("t", t) for t in table["tags"]}, fields, day="day")
        self._scans[database, measurement] = found
        return found

    def _grow(self, database: str, measurement: str, tags: list[str], fields: dict[str, list[str]]) -> None:
        self._scans.pop((database, measurement), None)
        table = self.catalog["tables"].setdefault(database, {}).setdefault(measurement, {"tags": [], "fields": {}})
        table["tags"] = sorted({*table["tags"], *tags})
        for name, kinds in fields.items():
            table["fields"][name] = "".join(k for k in KINDS if k in table["fields"].get(name, "") or k in kinds)

    def _seq(self, span: int) -> int:
        at = self.catalog.get("seq", 0)
        self.catalog["seq"] = at + span
        return at

    def append_lines(self, database: str, text: str, precision: str, now_ns: int | None = None, name: str | None = None) -> int:
        """Parses a payload and appends its points; nothing is written if any line is bad, or if a write of this name was done before."""
        lines = line_protocol.lines_of(text)
        now = time.time_ns() if now_ns is None else now_ns
        if len(lines) <= DRIVER_LINES:
            return self._append_rows(database, line_protocol.parse_lines(lines, precision), now, name)
        rows = self.spark.createDataFrame(pa.table({"seq": pa.array(range(len(lines)), pa.int64()), "value": pa.array(lines, pa.string())}))
        return self.append_frame(database, rows, precision, now, name)

    def _append_rows(self, database: str, rows: list[line_protocol.Row], now: int, name: str | None) -> int:
        """Points that the driver has parsed: a file for each measurement and day, without a Spark job."""
        groups: dict[tuple[str, int], list[tuple[int, line_protocol.Row, int]]] = {}
        for k, row in enumerate(rows):
            stamp = now if row.time_ns is None else row.time_ns
            groups.setdefault((row.measurement, stamp // times.DAY), []).append((k, row, stamp))
        with self._change():
            if self._known(name):
                return len(rows)
            base, staged, steps = self._seq(len(rows)), self._staged(), []
            for at, ((measurement, day), own) in enumerate(groups.items()):
                tags, fields, table = _arrow(own, base)
                sink = io.BytesIO()
                pq.write_table(table, sink, compression="snappy")
                self.files.put(f"{staged}/{at}.parquet", sink.getvalue())
                date = (datetime(1970, 1, 1) + timedelta(days=day)).strftime("%Y-%m-%d")
                steps.append(("move", f"{staged}/{at}.parquet", f"{self._where(database, measurement)}/day={date}/{uuid.uuid4().hex}.parquet"))
                self._grow(database, measurement, tags, fields)
            self._commit(steps)
            self.files.delete(staged)
        return len(rows)

    def append_frame(self, database: str, lines: DataFrame, precision: str, now: int, name: str | None = None) -> int:
        """lines (seq, value) of any number: parsed once by tasks into a staged table, a folder for each measurement, and dealt to days from there."""
        staged = self._staged()
        with self._change():
            if self._known(name):
                return lines.count()
            try:
                parsed = line_protocol.staged(lines, precision).withColumn("time_ns", F.coalesce("time_ns", F.lit(now)))
                parsed.write.partitionBy("measurement").parquet(f"{staged}/points")
                return self._append_points(database, self.spark.read.schema(parsed.schema).parquet(f"{staged}/points"), staged)
            finally:
                if not self.catalog.get("steps"):
                    self.files.delete(staged)

    def _append_points(self, database: str, points: DataFrame, staged: str) -> int:
        def marked(column: str, mark: str) -> Column:
            return F.transform(F.map_keys(column), lambda key: F.concat(F.lit(mark), key))

        keys = [marked("tags", "t"), *[marked(c, c) for c in KINDS]]
        # One row per measurement, key and kind: as many as the tables get columns. The same pass finds the first bad line.
        per_key = points.select("measurement", "seq", "error", F.explode_outer(F.concat(*keys)).alias("key"))
        found = per_key.groupBy("measurement", "key").agg(F.max("seq").alias("top"), F.min(F.when(F.col("error").isNotNull(), F.struct("seq", "error"))).alias("bad")).collect()
        bad = min((r["bad"] for r in found if r["bad"] is not None), default=None)
        if bad:
            raise BadRequest(bad["error"])
        columns: dict[str, set[str]] = {}
        for r in found:
            columns.setdefault(r["measurement"], set()).add(r["key"])
        n = points.count()
        base, steps = self._seq(max((r["top"] for r in found), default=0) + 1), []
        tasks = max(1, -(-n // TASK_ROWS))
        for at, (measurement, own) in enumerate(columns.items()):
            tags = sorted(k[1:] for k in own if k[0] == "t")
            fields: dict[str, list[str]] = {}
            for k in sorted(own):
                if k[0] != "t":
                    fields.setdefault(k[1:], []).append(k[0])
            cols = ["time_ns", (F.col("seq") + base).alias("_seq")]
            cols += [F.try_element_at("tags", F.lit(t)).alias(column("t", t)) for t in tags]
            cols += [F.try_element_at(k, F.lit(f)).alias(column(k, f)) for f, kinds in fields.items() for k in kinds]
            self._write(points.where(F.col("measurement") == measurement).select(*cols), f"{staged}/{at}", tasks)
            steps += self._arrivals(f"{staged}/{at}", database, measurement)
            self._grow(database, measurement, tags, fields)
        self._commit(steps)
        return n

    def append_files(self, database: str, path: str, precision: str, now_ns: int | None = None, name: str | None = None) -> int:
        """Line-protocol files, plain or gzip, read by tasks. Points keep the order of their files and lines."""
        lines = self.spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), "value")
        return self.append_frame(database, lines, precision, time.time_ns() if now_ns is None else now_ns, name)

    def append_table(self, database: str, measurement: str, df: DataFrame, tags: list[str], fields: dict[str, str]) -> int:
        """A DataFrame with time_ns, tag and field columns; fields: name to kind. Returns its rows, which the staged files tell."""
        with self._change():
            base, staged = self._seq(1 << (SEQ_BITS + 20)), self._staged()
            own = df.select(
                "time_ns",
                (F.monotonically_increasing_id() + base).alias("_seq"),
                *[F.col(ident(t)).cast("string").alias(column("t", t)) for t in tags],
                *[F.col(ident(f)).cast(TYPES[k]).alias(column(k, f)) for f, k in fields.items()],
            )
            self._write(own, staged)
            steps = self._arrivals(staged, database, measurement)
            n = self.spark.read.schema("time_ns long").parquet(staged).count() if steps else 0
            self._grow(database, measurement, tags, {f: [k] for f, k in fields.items()})
            self._commit(steps)
            self.files.delete(staged)
        return n

    @staticmethod
    def _write(df: DataFrame, path: str, tasks: int | None = None) -> None:
        """Writes points by day. Each day is clustered in one task, or in several by a hash of the write's number, so that a day gets few files."""
        day = F.call_function("div", F.col("time_ns") - F.pmod("time_ns", F.lit(times.DAY)), F.lit(times.DAY))
        dated = df.withColumn("day", F.date_from_unix_date(day.cast("int")))
        keys = ["day"] if tasks in (None, 1) else ["day", F.pmod(F.xxhash64("_seq"), F.lit(tasks))]
        dated.repartition(*keys).write.partitionBy("day").parquet(path)

    def delete_where(self, database: str, measurement: str, doomed: Column | None) -> int:
        """Deletes the rows for which doomed is true (None: all); rewrites only the days that hold such rows."""
        with self._change():
            m = self.scan(database, measurement)
            if doomed is None:
                n = m.df.count()
                self._forget(database, measurement)
                return n
            hit = F.coalesce(doomed, F.lit(False))
            days = m.df.groupBy("day").agg(F.count_if(hit).alias("gone"), F.count(F.lit(1)).alias("all")).where("gone > 0").collect()
            n = sum(r["gone"] for r in days)
            if not n:
                return 0
            kept = [r["day"] for r in days if r["gone"] < r["all"]]
            self._replace(database, measurement, [r["day"] for r in days], m.df.where(F.col("day").isin(kept)).where(~hit) if kept else None)
            if not any(x.startswith("day=") for x in self.files.names(self._where(database, measurement))):
                self._forget(database, measurement)
            return n

    def _replace(self, database: str, measurement: str, days: list[date], rows: DataFrame | None, tasks: int = 1) -> None:
        """Puts rows (None: none) in the place of whole days."""
        path, staged, steps = self._where(database, measurement), self._staged(), []
        if rows is not None:
            self._write(rows.drop("day"), staged, tasks)
        new = set(self.files.names(staged))
        for day in days:
            steps.append(("replace", f"{staged}/day={day}", f"{path}/day={day}") if f"day={day}" in new else ("delete", f"{path}/day={day}", ""))
        self._commit(steps)
        self.files.delete(staged)
        self._scans.pop((database, measurement), None)
        self.spark.catalog.refreshByPath(path)

    def compact(self, database: str, measurement: str, most_files: int = MOST_FILES) -> int:
        """Rewrites the days of a table that stand in over most_files files to files of about FILE_BYTES; returns how many days."""
        with self._change():
            m, path = self.scan(database, measurement), self._where(database, measurement)
            sizes = {day: self.files.sizes(f"{path}/{day}") for day in self.files.names(path) if day.startswith("day=")}
            many = {date.fromisoformat(day[4:]): s for day, s in sizes.items() if len(s) > most_files}
            if many:
                self._replace(database, measurement, list(many), m.df.where(F.col("day").isin(list(many))), max(-(-sum(s) // FILE_BYTES) for s in many.values()))
            return len(many)

    def _forget(self, database: str, measurement: str) -> None:
        self._scans.pop((database, measurement), None)
        self.catalog["tables"].get(database, {}).pop(measurement, None)
        self._commit([("delete", self._where(database, measurement), "")])

    def apply_retention(self, now_ns: int | None = None) -> int:
        """Drops the points that are older than their database's or bucket's retention; returns how many."""
        now, n = time.time_ns() if now_ns is None else now_ns, 0
        for database, keep in list(self.catalog.get("retention", {}).items()):
            for measurement in list(self.tables(database)):
                n += self.delete_where(database, measurement, F.col("time_ns") < F.lit(now - keep))
        return n


def _arrow(own: list[tuple[int, line_protocol.Row, int]], base: int) -> tuple[list[str], dict[str, list[str]], pa.Table]:
    """Tags, fields with their kinds, and the table of some parsed points (place in the payload, point, time)."""
    tags = sorted({t for _, r, _ in own for t in r.tags})
    found: dict[str, list] = {}
    for at, (_, r, _) in enumerate(own):
        for key, value in r.fields.items():
            if key not in found:
                found[key] = [None] * len(own)
            found[key][at] = value
    values: dict[tuple[str, str], list] = {}
    for key, col in found.items():
        types = set(map(type, col)) - {type(None)}
        if types <= {float} or types <= {str} or types <= {bool}:
            values[key, line_protocol.kind_of(next(iter(types))())] = col
            continue
        for at, value in enumerate(col):
            if value is not None:
                values.setdefault((key, line_protocol.kind_of(value)), [None] * len(own))[at] = value
    cols = {"time_ns": pa.array([stamp for _, _, stamp in own], pa.int64()), "_seq": pa.array([k + base for k, _, _ in own], pa.int64())}
    for t in tags:
        cols[column("t", t)] = pa.array([r.tags.get(t) for _, r, _ in own], pa.string())
    fields: dict[str, list[str]] = {}
    for key, kind in sorted(values):
        col = values[key, kind]
        cols[column(kind, key)] = pa.array([None if v is None else Decimal(v) for v in col] if kind == "d" else col, ARROW[kind])
        fields.setdefault(key, []).append(kind)
    return tags, fields, pa.table(cols)


def bucket_id(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:16]
