"""Corpus pipeline: five stages, each over all that the one before has kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents,
the last one with shard and slot too. run() applies them to the documents of a folder and keeps each stage's rows in the shared
folder, so that a lost executor costs one stage's tasks only; what a stage needed itself is deleted as soon as its rows are kept.

Cases: null and empty texts are not toxic, link with nothing, meet no benchmark item, count no words and so leave with the
mix when their source takes no whole repetition of them; null ids link with nothing. Rows that repeat an id are one document for the
join: they stay or go together, and go if any of their texts links with a document of a smaller id; all other stages judge each row
alone. Empty tables pass as such. Other columns travel along, but columns named shard and slot give way to the last stage's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake import session
from chronolake.llm import common, decontamination, jaccard_join, mixing, sharding, toxicity

ORACLE_SQL = None  # a classifier and edit distances have no SQL; tests hold the stages against brute force

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepared(stage: Stage) -> Stage:
    """A stage that sets what the session needs first."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session.prepare(spark)
        return stage(spark, docs, sf_dir)

    return call


@prepared
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = toxicity.fit(docs, common.labels(spark, sf_dir))
    name = common.fresh("toxicity", docs)
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


@prepared
def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id."""
    groups = jaccard_join.jaccard_components(docs)
    gone = common.cut(groups.where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(common.small(gone), "doc_id", "left_anti").select(docs.columns)


@prepared
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, common.benchmark(spark, sf_dir))


@prepared
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


@prepared
def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard (0 to 15, of equal bytes) and slot, read from the shards' files."""
    docs = docs.drop("shard", "slot")
    files = sharding.resharded(docs, common.scratch(spark, "shards"), sharding.OLD_SHARDS, sharding.NEW_SHARDS)
    return files.select("doc.*", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", deal_to_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    begun = common.mark()
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        path = common.scratch(spark, name.replace(" ", "-"))
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        common.sweep(spark, since=begun, keep=[path])
    return STAGES[-1][1](spark, docs, sf_dir)
