"""Helpers that the operators share: table access, shared folders, lineage cuts and size-checked joins."""

from __future__ import annotations

import atexit
import ctypes
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolake.session import shared_dir

#: Characters that part words, as a regular expression class of Java, RE2 and Python.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


_scratched: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; sweep() removes it."""
    return _noted(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def _noted(path: str) -> str:
    if not _scratched:
        atexit.register(_sweep_at_exit)
    _scratched.append(path)
    return path


def mark() -> int:
    """How many intermediate tables there are by now: those that come later are what sweep(since=) deletes."""
    return len(_scratched)


def sweep(spark: SparkSession, since: int = 0, keep: Iterable[str] = ()) -> None:
    """Deletes the intermediate tables and checkpoints of this process, but for those kept: to be called when no result is read from them any more."""
    kept = [path for path in _scratched[since:] if path in keep]
    for path in _scratched[since:]:
        if path not in kept:
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    _scratched[since:] = kept


def _sweep_at_exit() -> None:
    """What nobody has swept goes with the process, if its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            sweep(spark)
        except Exception as error:  # the session may stop meanwhile; files that stay do no harm
            print(f"intermediate tables are left: {error}", file=sys.stderr)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    out = df.checkpoint(eager=True)
    held = out._jdf.queryExecution().logical()
    if held.nodeName().startswith("Scan ExistingRDD") or held.getClass().getSimpleName() == "LogicalRDD":
        path = held.rdd().getCheckpointFile()
        if path.isDefined():
            _noted(path.get())
    return out


def store(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as Parquet: smaller, and later reads take single columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 16 << 20


def _bytes(name: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return sum((_bytes(name[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(name), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(name), F.lit(0)).cast("long") * 8 + 8
    return F.lit(8).cast("long")


def small(df: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """df with a broadcast hint if its values take at most so many bytes; else as it is, for a shuffled join. df should be stored: it is read for this."""
    size = df.select(_bytes(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema).alias("n")).agg(F.sum("n")).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most_bytes is None else most_bytes) else df


#: Keys that are joined map-side at most: those of which each holds over 1/HEAVY of the rows.
HEAVY = 4096


def join_by_key(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row per key, whose column `count` tells how many rows (of `total`) have the key; that column goes.

    Rows of a key that holds over 1/HEAVY of all are joined map-side with that key's row, HEAVY rows at most; all others meet in a shuffle,
    where no key is large. how: inner or left_semi, or left for rows whose key may be missing from the table.
    """
    frequent = F.col(count) * HEAVY > F.lit(total)
    heavy = cut(table.where(frequent).drop(count))
    light = table.where(~frequent).drop(count)
    one = rows.join(F.broadcast(heavy), key, "inner" if how == "left" else how)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return one.unionByName(rest.select(one.columns))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """Rows kept from every kind of training: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def frugal() -> None:
    """Lets a Python worker give freed memory back: blocks over 1 MB are mapped apart, and unmapped when they go (glibc only)."""
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD


#: Rows whose texts a Python worker holds as objects at once; Spark's own batches hold many more.
SLICE = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices, which share their memory."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)


def with_score(docs: DataFrame, text_col: str, name: str, scores: Callable[[pa.Array], object]) -> DataFrame:
    """docs with a double column made from whole texts, batch by batch; a column of that name is replaced."""
    kept = docs.drop(name)
    schema = kept.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for b in sliced(batches):
            made = pa.array(scores(b.column(b.schema.get_field_index(text_col))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, name])

    return kept.mapInArrow(run, schema)
