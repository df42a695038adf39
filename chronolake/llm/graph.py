"""Connected components of large graphs: local union-find, then alternating large and small stars over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm import common


class Forest:
    """Union-find over numbers; the smallest of a tree is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = parent.setdefault(x, x)
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


#: Nodes that a task's forest holds before it is given out.
MOST_NODES = 1_000_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars, forest after forest: no more rows than these have nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def stars() -> Iterator[pa.RecordBatch]:
            found = np.array(forest.stars(), np.int64).reshape(-1, 2)
            forest.parent.clear()
            for lo in range(0, len(found), 50_000):
                part = found[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])

        for b in batches:
            for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                forest.join(a, z)
            if len(forest.parent) > MOST_NODES:
                yield from stars()
        yield from stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (u, v) that isn't alone.

    The least neighbours are stored before they are joined, so that both sides of that join are plain shuffles, which adaptive
    execution splits where a node has very many neighbours.
    """
    # Stored first, as edges often come out of Python code: a task would otherwise keep two Python workers busy at once.
    now = common.cut(_contracted(common.store(edges.where("u <> v"), "edges")).distinct())
    size = now.count()
    for _ in range(most_rounds if size else 0):
        # Large star: every node's larger neighbours go to its smallest neighbour or itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: a node and its smaller neighbours, which are few by now, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        before, now = now, common.cut(small.distinct())
        was, size = size, now.count()
        if was == size and now.join(before, ["u", "v"], "left_anti").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if size:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
