"""The engine: one warehouse under one profile, and the named connections to engines."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake import session, telemetry
from chronolake.errors import BadRequest, ConnectionMissing, DeleteNotSupported, EngineError, NoDatabase, NotFound, TableNotFound
from chronolake.functions import time as times
from chronolake.model import PROFILES, Config, Point, Value, require, supports
from chronolake.plans import flux, iql, sql
from chronolake.plans.compile import Compiler, Options
from chronolake.sources import decode, line_protocol
from chronolake.sources.measurement import Measurement
from chronolake.sources.storage import Warehouse
from chronolake.streaming.batch_writer import BatchWriter

Row = dict[str, Any]
#: Column of the order of writing next to a result that is sorted by it.
WRITTEN = "\0written"


class Engine:
    """All operations of a connection. Each checks the profile; what it lacks raises Unsupported.

    strict refuses, and reads, queries as the dialect's narrow form does; now_ns gives the clock.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        profile: str = "v3_core",
        databases: list[str] | None = None,
        database: str = "default",
        strict: bool = False,
        now_ns: Callable[[], int] = time.time_ns,
    ):
        if profile not in PROFILES:
            raise ValueError(f"unknown profile: {profile}")
        session.prepare(spark)
        self.spark, self.profile, self.database, self.strict, self.now_ns = spark, profile, database, strict, now_ns
        self.warehouse = Warehouse(spark, root, databases)
        self.views: dict[str, Measurement] = {}
        self._writer: BatchWriter | None = None

    def supports(self, operation: str) -> bool:
        return supports(self.profile, operation)

    # Writing.

    @staticmethod
    def point(measurement: str, fields: dict[str, Value], tags: dict[str, str] | None = None, timestamp: Any = None) -> Point:
        return Point(measurement, fields, tags or {}, timestamp)

    def _namespace(self, name: str | None) -> str:
        own = name or self.database
        if not own:
            raise NoDatabase("no database is given")
        return own

    def write(self, payload: str | bytes | Point | list[Point], database: str | None = None, precision: str = "nanosecond", name: str | None = None) -> int:
        """Writes line protocol, plain or gzip, or points; returns the number of points. A bad line writes nothing, nor does a write whose name was used before."""
        require(self.profile, "write")
        own = self._namespace(database)
        if isinstance(payload, Point | list):
            payload = line_protocol.encode(payload)
        with telemetry.span("write", database=own) as measures:
            text = line_protocol.unzipped(payload)
            self._writable(own)
            n = self.warehouse.append_lines(own, text, precision, self.now_ns(), name)
            self._auto_create(own)
            measures["points"], measures["bytes"] = n, len(payload)
        return n

    def write_direct(self, points: Point | list[Point] | str, database: str | None = None, precision: str = "nanosecond") -> int:
        """Writes points or lines at once, as a payload that is compressed if it is long."""
        return self.write(line_protocol.zipped(points if isinstance(points, str) else line_protocol.encode(points)), database, precision)

    def compact(self, measurement: str, database: str | None = None) -> int:
        """Puts the many small files of frequent writes together; returns the number of days rewritten."""
        return self.warehouse.compact(self._namespace(database), measurement)

    def write_files(self, path: str, database: str | None = None, precision: str = "nanosecond") -> int:
        """Writes line-protocol files, read by tasks in parallel."""
        require(self.profile, "write")
        name = self._namespace(database)
        self._writable(name)
        with telemetry.span("write", database=name) as measures:
            measures["points"] = n = self.warehouse.append_files(name, path, precision, self.now_ns())
            self._auto_create(name)
        return n

    def _writable(self, name: str) -> None:
        known = self.warehouse.catalog["databases"] + (self.warehouse.catalog["buckets"] if self.profile == "v2" else [])
        if self.profile == "v2" and name not in known:
            raise NotFound("database not found")

    def _auto_create(self, name: str) -> None:
        if self.profile != "v2" and name not in self.warehouse.catalog["databases"]:
            self.warehouse.create_database(name)

    def batch_writer(self, **options: Any) -> BatchWriter:
        """A buffered writer to this engine; flush() and stats() of the engine are those of the last one made."""
        self._writer = BatchWriter(self.write, **options)
        return self._writer

    @property
    def writer(self) -> BatchWriter:
        return self._writer or self.batch_writer()

    def flush(self) -> None:
        if self._writer is not None:
            self._writer.flush()

    def stats(self) -> dict[str, int]:
        return self._writer.stats() if self._writer else {"total_writes": 0, "total_errors": 0, "total_bytes": 0}

    # Reading.

    def measurement(self, name: str, database: str | None = None) -> Measurement:
        if name in self.views:
            return self.views[name]
        return self.warehouse.scan(self._namespace(database), name)

    def add_view(self, m: Measurement) -> None:
        """Lets queries read a table as a measurement."""
        self.views[m.name] = m

    def frame(self, text: str, params: dict[str, Any] | None = None, database: str | None = None, written_order: bool = False, dedupe: bool = False) -> DataFrame:
        """A query as a DataFrame. Only written_order sorts rows that no ORDER BY sorts. dedupe: of points with the same tags and time, the one written last."""
        q = sql.parse(text, params)
        if not isinstance(q, sql.Select):
            raise BadRequest("unsupported SQL: SELECT expected")
        return self._compiled(q, database, written_order, dedupe=dedupe)

    def _compiled(self, q: sql.Select, database: str | None, written_order: bool, written: str | None = None, dedupe: bool = False) -> DataFrame:
        m = self.measurement(q.measurement, database)
        return Compiler(m.latest() if dedupe else m, Options(self.strict, written_order, self.now_ns, written)).select(q)

    def query_sql(self, text: str, params: dict[str, Any] | None = None, database: str | None = None, format: str = "rows", transport: str = "http") -> Any:
        """Rows as dicts; or an Arrow table with format arrow or transport flight."""
        require(self.profile, "query_sql")
        return self._run(text, params, database, "arrow" if transport == "flight" else format)

    def _run(self, text: str, params: dict[str, Any] | None, database: str | None, format: str) -> Any:
        with telemetry.span("query", text=text) as measures:
            q = sql.parse(text, params)
            if not isinstance(q, sql.Select):
                raise BadRequest("unsupported SQL: SELECT expected")
            # Without ORDER BY, rows come latest write first; unless a LIMIT needs that order, they are sorted here, not by a shuffle of the table.
            plain = not (q.order or q.distinct or q.limit is not None or q.offset or _aggregated(q))
            df = self._compiled(q, database, not plain, WRITTEN if plain else None)
            sort = WRITTEN in df.columns
            if format == "arrow":
                table = df.toArrow()
                return table.sort_by([(WRITTEN, "descending")]).drop_columns([WRITTEN]) if sort else table
            found = df.collect()
            if sort:
                found.sort(key=lambda r: r[WRITTEN], reverse=True)
            rows = shown(found, sparse=not _aggregated(q))
            if sort:
                for r in rows:
                    del r[WRITTEN]
            measures["rows"] = len(rows)
            return rows

    def export(self, text: str, path: str, format: str = "parquet", params: dict[str, Any] | None = None, database: str | None = None) -> None:
        """Writes a query's rows to files, by tasks: for results that do not fit the driver. They are sorted only by an ORDER BY."""
        require(self.profile, "query_sql")
        decode.write(self.frame(text, params, database), path, format)

    def query_sql_stream(self, text: str, params: dict[str, Any] | None = None, database: str | None = None, swallow: bool = False, ordered: bool = False) -> Iterator[Row]:
        """Rows one by one, a partition at a time. swallow: an error gives no rows. ordered: without ORDER BY too, latest write first, by a sort of the table."""
        require(self.profile, "query_sql_stream")
        sparse = None
        try:
            q = sql.parse(text, params)
            df = self.frame(text, params, database, written_order=ordered or isinstance(q, sql.Select) and q.limit is not None)
            sparse = not _aggregated(q)
            for row in df.toLocalIterator(prefetchPartitions=True):
                yield from shown([row], sparse)
        except EngineError:
            if not swallow:
                raise

    stream = query_sql_stream

    def execute_sql(self, text: str, params: dict[str, Any] | None = None, database: str | None = None) -> dict[str, int]:
        """DELETE and INSERT INTO ... SELECT; any other statement changes nothing."""
        require(self.profile, "execute_sql")
        if text.strip()[:6].upper() not in ("DELETE", "INSERT"):
            return {"rows_affected": 0}
        q = sql.parse(text, params)
        if isinstance(q, sql.Delete):
            return {"rows_affected": self._delete(q, database)}
        return {"rows_affected": self._insert(q, database)}

    def _delete(self, q: sql.Delete, database: str | None) -> int:
        if self.profile != "v3_enterprise":
            raise DeleteNotSupported("DELETE needs the enterprise profile")
        name = self._namespace(database)
        try:
            m = self.warehouse.scan(name, q.measurement)
        except TableNotFound:
            return 0
        doomed = None if q.where is None else Compiler(m, Options(now_ns=self.now_ns)).condition(q.where)
        return self.warehouse.delete_where(name, q.measurement, doomed)

    def _insert(self, q: sql.Insert, database: str | None) -> int:
        name = self._namespace(database)
        df = self._compiled(q.select, database, False)
        source = self.measurement(q.select.measurement, database)
        if not q.select.items:
            df = Compiler(source, Options(now_ns=self.now_ns)).select(q.select)
        stamp = next((i.alias or "date_bin" for i in q.select.items if isinstance(i.expr, sql.Call) and i.expr.name == "DATE_BIN"), "time")
        if stamp not in df.columns:
            raise BadRequest("INSERT needs a time: select time or DATE_BIN")
        parsed = F.col(stamp)
        seconds = F.unix_seconds(F.substring(parsed, 1, 19).cast("timestamp"))
        rest = F.when(F.length(parsed) > 20, F.substring(parsed, 21, 9).cast("bigint")).otherwise(F.lit(0))
        plain = {i.alias or i.expr.name: i.expr.name for i in q.select.items if isinstance(i.expr, sql.Name)}
        tags = [c for c in df.columns if c != stamp and plain.get(c, c) in source.tags]
        kinds = {"bigint": "i", "int": "i", "double": "f", "boolean": "b", "string": "s", "decimal(38,0)": "d"}
        fields = {c: kinds[t] for c, t in df.dtypes if c != stamp and c not in tags and t in kinds}
        other = [f"{c} ({t})" for c, t in df.dtypes if c != stamp and c not in tags and t not in kinds]
        if other:
            raise BadRequest(f"INSERT cannot store {', '.join(other)}")
        rows = df.withColumn("time_ns", seconds * F.lit(10**9) + rest)
        n = self.warehouse.append_table(name, q.measurement, rows.select("time_ns", *[F.col(f"`{c}`") for c in (*tags, *fields)]), tags, fields)
        self._auto_create(name)
        return n

    def query_iql(self, text: str, params: dict[str, Any] | None = None, database: str | None = None) -> list[Row]:
        require(self.profile, "query_iql")
        shown_now = iql.show(text)
        if shown_now is None:
            return self._run(iql.to_sql(text), params, database, "rows")
        name = self._namespace(shown_now.database or database)
        if shown_now.what == "databases":
            return [{"iox::database": d} for d in sorted(self.warehouse.catalog["databases"])]
        if shown_now.what == "measurements":
            return [{"iox::measurement": "measurements", "name": m} for m in sorted(self.warehouse.tables(name))]
        own = [shown_now.measurement] if shown_now.measurement else sorted(self.warehouse.tables(name))
        if shown_now.what == "tag keys":
            return [{"iox::measurement": m, "tagKey": k} for m in own for k in self.warehouse.tag_keys(name, m)]
        fields = lambda m: sorted(self.warehouse.tables(name).get(m, {}).get("fields", {}))
        return [{"iox::measurement": m, "fieldKey": k} for m in own for k in fields(m)]

    def flux_frames(self, text: str, written_order: bool = False) -> list[DataFrame]:
        """A pipeline's rows, a DataFrame for each measurement that it reads."""
        p = flux.parse(text)
        wanted = [p.bucket] if p.bucket else list(self.warehouse.catalog["tables"])
        now, out = self.now_ns(), []
        for database in wanted:
            for name in [p.measurement] if p.measurement else sorted(self.warehouse.tables(database)):
                try:
                    m = self.views[name] if name in self.views else self.warehouse.scan(database, name)
                except TableNotFound:
                    continue
                out.append(flux.rows(p, m, now, Compiler(m).all_columns(), written_order))
        return out

    def query_flux(self, text: str) -> list[Row]:
        require(self.profile, "query_flux")
        with telemetry.span("query", text=text) as measures:
            df = self.flux_frame(text, written_order=True)
            rows = [] if df is None else shown(df.collect(), sparse=True)
            measures["rows"] = len(rows)
            return rows

    def flux_frame(self, text: str, written_order: bool = False) -> DataFrame | None:
        """The rows of all measurements that a pipeline reads, a column for each of their tags and fields; None without any."""
        frames = self.flux_frames(text, written_order)
        types: dict[str, set[str]] = {}
        for f in frames:
            for c, t in f.dtypes:
                types.setdefault(c, set()).add(t)
        mixed = [c for c, t in types.items() if len(t) > 1]
        frames = [f.withColumns({c: F.col(f"`{c}`").cast("variant") for c in mixed if c in f.columns}) for f in frames]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    # Administration.

    def create_database(self, name: str, retention: str | None = None) -> None:
        require(self.profile, "create_database")
        self.warehouse.create_database(name, retention)

    def list_databases(self) -> list[Row]:
        require(self.profile, "list_databases")
        return [{"name": d} for d in sorted(self.warehouse.catalog["databases"])]

    def delete_database(self, name: str) -> None:
        require(self.profile, "delete_database")
        self.warehouse.delete_database(name)

    def create_bucket(self, name: str, retention: str | None = None) -> Row:
        require(self.profile, "create_bucket")
        return self.warehouse.create_bucket(name, retention)

    def list_buckets(self) -> list[Row]:
        require(self.profile, "list_buckets")
        from chronolake.sources.storage import bucket_id

        return [{"id": bucket_id(b), "name": b} for b in sorted(self.warehouse.catalog["buckets"])]

    def delete_bucket(self, name: str) -> None:
        require(self.profile, "delete_bucket")
        self.warehouse.delete_bucket(name)

    def create_token(self, description: str = "") -> Row:
        require(self.profile, "create_token")
        return self.warehouse.create_token(description)

    def delete_token(self, name: str) -> None:
        require(self.profile, "delete_token")
        self.warehouse.delete_token(name)

    def apply_retention(self) -> int:
        return self.warehouse.apply_retention(self.now_ns())

    def health(self) -> Row:
        require(self.profile, "health")
        self.spark.sql("select 1").collect()
        return {"status": "pass", "version": "local"}

    def close(self) -> None:
        if self._writer is not None:
            self._writer.close()


def _aggregated(q: Any) -> bool:
    from chronolake.operators import aggregates

    return bool(isinstance(q, sql.Select) and (q.group or any(aggregates.within(i.expr) for i in q.items)))


def shown(rows: list, sparse: bool) -> list[Row]:
    """Rows as dicts; sparse leaves out what a point does not have. Variants and whole decimals become plain values."""
    from decimal import Decimal

    from pyspark.sql.types import VariantVal

    def plain(v: Any) -> Any:
        if isinstance(v, VariantVal):
            return v.toPython()
        return int(v) if isinstance(v, Decimal) else v

    return [{k: plain(v) for k, v in r.asDict().items() if v is not None or not sparse} for r in rows]


class Connections:
    """Named engines."""

    def __init__(self) -> None:
        self._open: dict[str, tuple[Config, Engine]] = {}

    def add(self, spark: SparkSession, root: str, profile: str = "v3_core", writer: dict[str, Any] | None = None, **options: Any) -> Engine:
        """Opens a connection with a batch writer of its own; writer: the batch writer's options."""
        config = Config.validated(**options)
        if config.name in self._open:
            raise ValueError(f"connection {config.name!r} is open already")
        engine = Engine(spark, root, profile, database=config.database or "default")
        engine.batch_writer(**{"database": config.database, **(writer or {})})
        self._open[config.name] = config, engine
        return engine

    def get(self, name: str = "default") -> Engine:
        if name not in self._open:
            raise ConnectionMissing(name)
        return self._open[name][1]

    def config(self, name: str = "default") -> Config:
        if name not in self._open:
            raise ConnectionMissing(name)
        return self._open[name][0]

    def write(self, points: Point | list[Point] | str, name: str = "default") -> None:
        """Adds points to the buffer of a connection."""
        self.get(name).writer.write(points)

    def flush(self, name: str = "default") -> None:
        self.get(name).flush()

    def stats(self, name: str = "default") -> dict[str, int]:
        return self.get(name).stats()

    def remove(self, name: str) -> None:
        """Flushes and closes a connection; it is gone even if the flush fails, which is raised."""
        engine = self.get(name)
        del self._open[name]
        engine.close()


__all__ = ["Connections", "Engine", "shown", "times"]
