"""Mixing sources to target weights by capped water-filling.

Each source has a weight; together the sources share the size of the whole corpus. A source may be
repeated `max_epochs` times at most: sources above that are clamped and what they leave is dealt to the others in
proportion to their weights, until none is above. The loop carries two numbers, the clamped size C and
the free weight W; a source s is clamped as soon as w_s (T - C) / W exceeds max_epochs S_s, in exact integers.

A source's target is then met by whole repetitions of all its documents and a seeded fraction of one
more: the documents in the order of a seeded hash, while a document's midpoint lies within the missing
size. The cut is found without ordering a whole source in one task: sizes are summed per slice of the hash,
only the slice that holds the cut is ordered, and its rows are few.

Cases: null and blank texts have size 0 and take nothing; null is a source of its own, last in order; a
null id hashes as the text 'null'; rows that repeat an id are separate rows next to each other in the order, a tie
broken by size. An empty table gives no rows. Other columns are ignored or, in mix(), kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.llm import common

#: Numbers that place() gives: 0 to PLACES - 1.
PLACES = 1 << 52
#: Rows in a hash slice, and the most slices of one source.
SLICE_ROWS, MAX_SLICES = 256, 2048


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, seed: int) -> Column:
    """A seeded 52-bit number from the id, the same in any SQL engine that has SHA-256."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        place(F.col(id_col), seed).alias("place"),
    )


def targets(rows: DataFrame, max_epochs: int, cycle: int) -> DataFrame:
    """One row per source: source, n_rows, source_size, weight and target. Sources by code point, null last, weigh 1..cycle, repeating."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    sources = common.cut(
        rows.groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
        .withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("long"))
    )
    clamped = lambda free, weight: F.expr(
        f"cast(weight as decimal(38,0)) * {free} > cast(source_size as decimal(38,0)) * {max_epochs * weight}"
    )
    total, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    free, all_weight = int(total), int(weight)
    weight = all_weight
    while weight:
        above = sources.where(clamped(free, weight)).agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
        )
        size, taken = (int(x) for x in above.first())
        state = int(total) - max_epochs * size, all_weight - taken
        if state == (free, weight):
            break
        free, weight = state
    if weight:
        target = F.when(clamped(free, weight), F.col("source_size") * F.lit(max_epochs).cast("double")).otherwise(
            (F.col("weight") * F.lit(free)).cast("double") / F.lit(float(weight))
        )
    else:
        target = F.col("source_size") * F.lit(max_epochs).cast("double")
    return sources.withColumn("target", target)


def plan(
    docs: DataFrame, seed: int = 17, max_epochs: int = 3, cycle: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """The sized rows; one row per source with source_size, target, whole and cut.

    A row is taken `whole` times, and once more if its slice of the hash stands before its source's cut_slice, or if its (place, doc_id,
    size) is no later than the source's cut (null: none is).
    """
    rows = common.cut(sized(docs, seed, id_col, text_col, source_col))
    per_source = targets(rows, max_epochs, cycle).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    )
    per_source = common.cut(
        per_source.withColumn("missing", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")).withColumn(
            "slices", F.least(F.lit(MAX_SLICES), F.ceil(F.col("n_rows") / SLICE_ROWS)).cast("long")
        )
    )
    wide = joined(rows, per_source).withColumn("slice", F.expr(f"place * slices div {PLACES}"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        wide.groupBy("source", "slice", "missing")
        .agg(F.sum("size").alias("slice_size"))
        .withColumn("base", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    )
    # The last slice that begins within the missing size holds the cut; slices before it are taken whole.
    last = sums.where(F.col("base") <= F.col("missing")).groupBy("source").agg(F.max("slice").alias("cut_slice"), F.max_by("base", "slice").alias("base"))
    last = common.cut(last.withColumnRenamed("source", "cut_source"))
    inside = wide.join(
        common.small(last), F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("slice") == F.col("cut_slice"))
    )
    order = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))
    taken = inside.withColumn("ahead", ahead).where(F.col("ahead") + F.col("size") / 2.0 <= F.col("missing"))
    cuts = taken.groupBy("source").agg(F.max(F.struct("place", "doc_id", "size")).alias("cut"))
    edge = last.select(F.col("cut_source").alias("s"), "cut_slice")
    out = (
        per_source.join(cuts.withColumnRenamed("source", "c"), F.col("source").eqNullSafe(F.col("c")), "left")
        .join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        .select("source", "source_size", "target", "whole", "slices", "cut", "cut_slice")
    )
    return rows, common.cut(out)


def joined(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows with their source's columns; the table of sources is broadcast as long as it is small."""
    return rows.withColumnRenamed("source", "of").join(common.small(per_source), F.col("of").eqNullSafe(F.col("source"))).drop("of")


def repetitions(at: Column, doc_id: Column, size: Column, prefix: str = "") -> Column:
    """Repetitions of a row with this place, from its source's columns."""
    source = lambda name: F.col(prefix + name)
    own = F.struct(at.alias("place"), doc_id.alias("doc_id"), size.alias("size"))
    slice_before = F.call_function("div", at * source("slices"), F.lit(PLACES)) < source("cut_slice")
    return source("whole") + (F.coalesce(slice_before, F.lit(False)) | F.coalesce(own <= source("cut"), F.lit(False))).cast("long")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, reps (repetitions the mix takes), taken = size * reps."""
    rows, per_source = plan(docs, **options)
    reps = repetitions(F.col("place"), F.col("doc_id"), F.col("size"))
    return joined(rows, per_source).withColumn("reps", reps).select("doc_id", "size", "source_size", "target", "reps", (F.col("size") * F.col("reps")).alias("taken"))


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Nothing but the table of sources is joined, so that texts are not shuffled."""
    _, per_source = plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    own, nth = common.fresh("mix", docs), common.fresh("nth", docs)
    table = per_source.select(F.struct(*per_source.columns).alias(own))
    wide = docs.join(common.small(table), F.col(source_col).cast("string").eqNullSafe(F.col(f"{own}.source")))
    reps = repetitions(place(F.col(id_col), seed), F.col(id_col), word_count(F.col(text_col)), f"{own}.")
    return wide.withColumn(nth, F.explode(F.array_repeat(F.lit(0), reps.cast("int")))).drop(own, nth)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM d GROUP BY source
), o AS (
  -- by the size a unit of weight may bring at most, clamped sources come first
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS all_weight,
         coalesce(sum(source_size) OVER w, 0)::BIGINT AS size_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  -- the first source in that order that need not be clamped sets the level
  SELECT arg_min(total - 3 * size_before, weight_before) AS free, min(all_weight - weight_before) FILTER (
           WHERE weight_before = (SELECT min(weight_before) FROM o
             WHERE weight::HUGEINT * (total - 3 * size_before) <= 3::HUGEINT * source_size * (all_weight - weight_before))) AS weight
  FROM o WHERE weight::HUGEINT * (total - 3 * size_before) <= 3::HUGEINT * source_size * (all_weight - weight_before)
), t AS (
  SELECT s.source, s.source_size,
         CASE WHEN s.weight::HUGEINT * level.free > 3::HUGEINT * s.source_size * level.weight THEN s.source_size * 3.0::DOUBLE
              ELSE (s.weight * level.free)::DOUBLE / level.weight::DOUBLE END AS target
  FROM s, level
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole,
         e.target - (e.whole * e.source_size)::DOUBLE AS missing,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN ahead + size / 2.0::DOUBLE <= missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
