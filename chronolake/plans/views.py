"""The driver's tables as measurements."""

from __future__ import annotations

from pyspark.sql import SparkSession

from chronolake.session import table
from chronolake.sources.measurement import Measurement, view

ROLES = {
    "events": ("ts", ["event_type", "user_id"], ["value", "event_id", "props"], "event_id"),
    "orders": ("o_orderdate", ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey", "o_orderkey"], "o_orderkey"),
    "lineitem": ("l_shipdate", ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"], None),
}


def measurement(spark: SparkSession, sf_dir: str, name: str) -> Measurement:
    stamp, tags, fields, seq = ROLES[name]
    df = table(spark, sf_dir, name)
    # Tags are strings; a numeric key is read as a field, so that filters on it reach the scan as numbers.
    own = [t for t in tags if dict(df.dtypes)[t] == "string"]
    return view(name, df, stamp, own, fields + [t for t in tags if t not in own], seq)
