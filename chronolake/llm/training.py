"""The bounded, seeded choice of labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm import common


def labelled_sample(labels: DataFrame, label: str, most_rows: int) -> DataFrame:
    """doc_id, y and fold (1 to 4) of at most most_rows labelled rows, none of them held out, in the order of a hash.

    Rows without an id or a label are left out; of rows that repeat an id, the larger label counts.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~common.held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    fold = (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).select("doc_id", "y", fold.alias("fold"))
