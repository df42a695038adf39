"""The helpers that the operators share."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolake.llm import common


def broadcasts(df):
    return df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast")


@pytest.mark.parametrize("how", ["inner", "left_semi", "left"])
@pytest.mark.parametrize("heavy", [4, 4096])
def test_join_by_key(spark, monkeypatch, how, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    keys = [0] * 400 + [1] * 30 + list(range(2, 40)) + [99, None]
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, n long")
    counts = Counter(k for k in keys if k is not None and k != 99)
    table = spark.createDataFrame([(k, c, f"v{k}") for k, c in counts.items()], "k long, c long, v string")
    got = common.join_by_key(rows, table.drop("v") if how == "left_semi" else table, "k", "c", len(keys), how)
    assert "c" not in got.columns
    found = sorted((r["n"], r["k"], None if how == "left_semi" else r["v"]) for r in got.collect())
    want = [(n, k, None if how == "left_semi" or k not in counts else f"v{k}") for n, k in enumerate(keys) if how == "left" or k in counts]
    assert found == sorted(want)


def test_small_counts_bytes(spark):
    df = spark.createDataFrame([(k, "x" * 100, [1, 2, 3], ("yy", k)) for k in range(10)], "k long, s string, a array<long>, t struct<u:string,v:long>")
    size = 10 * (8 + 108 + 32 + 10 + 8)
    assert broadcasts(common.small(df, size)) == 1 and broadcasts(common.small(df, size - 1)) == 0
    assert broadcasts(common.small(df.where("false"), 0)) == 1
    nulls = spark.createDataFrame([(None, None, None, None)], df.schema)
    assert broadcasts(common.small(nulls, 100)) == 1


def test_fresh_names(spark):
    df = spark.range(1).select(F.lit(1).alias("mix"), F.lit(2).alias("MIX_"))
    assert common.fresh("mix", df) == "mix__" and common.fresh("other", df) == "other"


def test_sweep_keeps_what_it_is_told_to(spark):
    begun = common.mark()
    kept, gone = common.store(spark.range(3), "kept"), common.store(spark.range(4), "gone")
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    cut = common.cut(spark.range(5).groupBy().count())
    assert cut.count() == 1 and common.mark() == begun + 3
    common.sweep(spark, since=begun, keep=[p for p in common._scratched if p.endswith(path.rsplit("/", 1)[1])])
    assert kept.count() == 3 and common.mark() == begun + 1
    with pytest.raises(Exception):  # noqa: B017
        gone.count()
    common.sweep(spark, since=begun)
