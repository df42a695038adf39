"""Rollups with Structured Streaming: raw points to candles, and candles to larger candles.

Buckets are event-time windows: for times since 1970 they are those of DATE_BIN. Points later than the watermark are dropped, in
contrast to a batch rollup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronolake.sources.files import Files


def candles(points: DataFrame, stamp: str, value: str, volume: str, seq: str, size: str, keys: list[str] | None = None, watermark: str | None = None) -> DataFrame:
    """bucket, keys, open, high, low, close, volume; works on a stream (give a watermark) and on a table."""
    df = points.withColumn("_at", F.col(stamp).cast("timestamp"))
    if watermark:
        df = df.withWatermark("_at", watermark)
    order = F.struct(F.col("_at"), F.col(seq))
    first = F.struct(F.col("_at"), -F.col(seq))
    return (
        df.groupBy(F.window("_at", size).alias("w"), *(keys or []))
        .agg(
            F.min_by(value, first).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, order).alias("close"),
            F.sum(volume).alias("volume"),
        )
        .select(F.col("w.start").alias("bucket"), *(keys or []), "open", "high", "low", "close", "volume")
    )


def larger(candles_: DataFrame, size: str, keys: list[str] | None = None, watermark: str | None = None) -> DataFrame:
    """Candles of a larger size from smaller ones: the next level of the cascade."""
    df = candles_.withWatermark("bucket", watermark) if watermark else candles_
    return (
        df.groupBy(F.window("bucket", size).alias("w"), *(keys or []))
        .agg(
            F.min_by("open", "bucket").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "bucket").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(F.col("w.start").alias("bucket"), *(keys or []), "open", "high", "low", "close", "volume")
    )


def averages(points: DataFrame, stamp: str, value: str, size: str, keys: list[str] | None = None, watermark: str | None = None) -> DataFrame:
    """bucket, keys, n, mean, lo and hi of a value."""
    df = points.withColumn("_at", F.col(stamp).cast("timestamp"))
    if watermark:
        df = df.withWatermark("_at", watermark)
    made: list[Column] = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi")]
    return df.groupBy(F.window("_at", size).alias("w"), *(keys or [])).agg(*made).select(F.col("w.start").alias("bucket"), *(keys or []), "n", "mean", "lo", "hi")


def append(rollup: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "1 second") -> StreamingQuery:
    """Appends buckets to Parquet as soon as the watermark has closed them."""
    writer = rollup.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def cascade(
    points: DataFrame,
    root: str,
    sizes: list[str],
    stamp: str,
    value: str,
    volume: str,
    seq: str,
    keys: list[str] | None = None,
    watermark: str = "1 minute",
    available_now: bool = True,
) -> list[StreamingQuery]:
    """Ticks to candles of the first size, those to candles of the next, and so on, each a table under root.

    Every level is a query of its own that reads the table of the level before, so that levels fail and go on apart. With
    available_now each level runs to its end before the next begins; else all keep running.
    """
    spark, out = points.sparkSession, []
    for level, size in enumerate(sizes):
        path, name = f"{root}/{size.replace(' ', '_')}", f"{root}/checkpoints/{level}"
        if level == 0:
            frame = candles(points, stamp, value, volume, seq, size, keys, watermark)
            schema = frame.schema
        else:
            source = spark.readStream.schema(schema).parquet(f"{root}/{sizes[level - 1].replace(' ', '_')}")
            frame = larger(source, size, keys, watermark)
        out.append(append(frame, path, name, available_now))
        if available_now:
            out[-1].awaitTermination()
        else:
            Files(spark, root).make(path)  # the next level needs a folder to watch
    return out
