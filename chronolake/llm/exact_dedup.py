"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (Spark's own frequent-items aggregate, the Karp-Schenker-Papadimitriou form of
it) over the digests of all texts names at most `counters` digests, among them every one that holds
more than 1/counters of the rows. Their exact counts and winners are found with partial aggregation,
so that even one digest with all rows sends one row per task. The verified winners, never more than
`counters` rows, are broadcast, and rows of these digests are settled map-side. All others meet in an
ordinary shuffle by digest, where no group can hold more than 1/counters of the rows.

Cases: a null text counts as empty; empty and blank-only texts are one group. A null id loses against
any other id. Rows that repeat an id and a text are the same document and are all marked alike. An empty table
gives no rows. Further columns are ignored, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.llm import common


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points of the original text) and digest (SHA-256 of the text without blanks)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(text).alias("n_chars"),
        F.sha2(F.regexp_replace(text, common.BLANK + "+", ""), 256).alias("digest"),
    )


def heavy_hitters(rows: DataFrame, counters: int) -> DataFrame:
    """digest, keep_id and group_size of the digests that hold over 1/counters of the rows; at most `counters` rows."""
    named = rows.freqItems(["digest"], 1.0 / counters).select(F.explode("digest_freqItems").alias("digest"))
    total = rows.count()
    smaller = F.bitwise_not("doc_id")  # the larger, the smaller the id; defined for every long
    exact = (
        rows.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.max_by("doc_id", F.struct("n_chars", smaller)).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return exact.where((F.col("group_size") * counters > F.lit(total)) & (F.col("group_size") > 1)).select("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the text without blanks)."""
    rows = common.cut(digests(docs, id_col, text_col))
    heavy = common.cut(heavy_hitters(rows, counters))
    settled = rows.join(F.broadcast(heavy), "digest").select("doc_id", "digest", "keep_id", "group_size")
    group = Window.partitionBy("digest")
    best = group.orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"))
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "doc_id", "digest", F.first("doc_id").over(best).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    return settled.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
  FROM documents
), k AS (
  SELECT doc_id, digest,
         first_value(doc_id) OVER (PARTITION BY digest ORDER BY n DESC, doc_id ASC) AS keep_id,
         count(*) OVER (PARTITION BY digest) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, digest AS text_sha256 FROM k
"""
