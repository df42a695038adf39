"""Resharding by minimum-cost flow: new capacities are met by moving the fewest bytes out of the old shards.

Every old shard supplies its bytes and every new shard takes its capacity; a byte that stays costs 0, a byte that moves
costs 1. Successive shortest paths solve this on the driver: its size is that of the shard counts, not of the data. The flow
out of an old shard becomes a sequence of byte ranges, first the one that stays.

A shard is stored in blocks, a folder each: parts of it by a hash of id and checksum, of a bounded number of bytes however large the shard is.
Within a block, documents stand by id. A block that lies in one range stays or moves as a whole; one that holds an end of a
range is split, and a document goes where its midpoint lies, so that a shard misses its capacity by half a document at each end of a
range. Only blocks that move or are split are read and written again; all others stay as they are. A manifest lists the blocks that count, each with
the slot of its first document: it is replaced after the new blocks are written and before the old ones are deleted, so that a
job that dies leaves the old shards or the new ones.

Law: `bytes`.

Cases: a null text has no bytes, but every document counts one more; a null id stands first in its block; rows that
repeat an id are separate documents, by text checksum and size. An empty table gives no rows and no blocks. Other columns travel
along and may have any name: they stand in a struct.
"""

from __future__ import annotations

import json
from collections import deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolake.llm import common
from chronolake.sources.files import Files

#: Parts of a table whose bytes are counted apart, over all its shards; blocks are made of them. The driver holds a row for each.
PARTS = 1 << 16
#: Most bytes of a block, least bytes, and blocks that a shard has between these bounds.
MOST_BYTES, LEAST_BYTES, BLOCKS = 64 << 20, 64 << 10, 16


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from i to j that empties every supply within the capacities at least cost, by successive shortest paths."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities cannot hold the supplies")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Bellman-Ford with a queue over the residual graph: sources are 0..n-1, sinks n..n+m-1.
        far = [0 if i < n and left[i] else float("inf") for i in range(n + m)]
        back: list[int | None] = [None] * (n + m)
        queue = deque(i for i in range(n) if left[i])
        waiting = set(queue)
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            if u < n:
                steps = [(n + j, cost[u][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                if far[u] + c < far[v]:
                    far[v], back[v] = far[u] + c, u
                    if v not in waiting:
                        waiting.add(v)
                        queue.append(v)
        end = min((n + j for j in range(m) if room[j]), key=lambda v: far[v])
        path = [end]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for u, v in zip(path, path[1:]):
            if u >= n:
                amount = min(amount, flow[v][u - n])
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return flow


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


class Block(NamedTuple):
    """A block of a shard: its first document's slot, its documents and their bytes."""

    shard: int
    block: int
    base: int
    rows: int
    bytes: int


class Piece(NamedTuple):
    """Documents of a block whose midpoints, taken twice, lie from `begin` to `end`: a block of a new shard. `first` documents of `ahead` bytes stand before."""

    shard: int
    block: int
    begin: int
    end: int
    first: int
    ahead: int
    new_shard: int
    new_block: int


class Layout:
    """Documents in shards under a path of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, columns: T.StructType, n_shards: int, version: int, blocks: list[Block]):
        self.spark, self.path, self.columns, self.n_shards, self.version, self.blocks = spark, path, columns, n_shards, version, blocks

    @property
    def sizes(self) -> list[int]:
        out = [0] * self.n_shards
        for b in self.blocks:
            out[b.shard] += b.bytes
        return out

    def _files(self, some: list[tuple[int, int]] | None = None) -> DataFrame:
        """The rows of the blocks' files: doc, size, crc, nth, at, shard, block."""
        root = f"{self.path}/blocks"
        paths = [root] if some is None else [f"{root}/shard={s}/block={b}" for s, b in some]
        schema = T.StructType().add("doc", self.columns)
        for name, kind in (("size", "long"), ("crc", "long"), ("nth", "long"), ("at", "long"), ("shard", "integer"), ("block", "integer")):
            schema = schema.add(name, kind)
        if not self.blocks or not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    def read(self) -> DataFrame:
        """doc (a struct of the documents' columns), shard, slot, size and crc of every document."""
        listed = self.spark.createDataFrame([(b.shard, b.block, b.base) for b in self.blocks], "shard int, block int, base long")
        joined = self._files().join(F.broadcast(listed), ["shard", "block"])  # PARTS rows and the split blocks' at most
        return joined.select("doc", "shard", (F.col("base") + F.col("nth")).alias("slot"), "size", "crc")

    def _save(self) -> None:
        """Writes the manifest; it counts as soon as it is complete. Its row without a shard tells the number of shards and the columns."""
        kept = json.dumps(self.columns.jsonValue())
        rows = [(*b, None) for b in self.blocks] + [(None, self.n_shards, None, None, None, kept)]
        frame = self.spark.createDataFrame(rows, "shard int, block int, base long, rows long, bytes long, columns string")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{self.version}")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Layout:
        """What the last complete manifest lists."""
        files = Files(spark, path)
        done = [int(v) for v in files.names(f"{path}/manifests") if files.exists(f"{path}/manifests/{v}/_SUCCESS")]
        rows = spark.read.parquet(f"{path}/manifests/{max(done)}").orderBy(F.asc_nulls_first("shard"), "block").collect()
        columns = T.StructType.fromJson(json.loads(rows[0]["columns"]))
        return Layout(spark, path, columns, rows[0]["block"], max(done), [Block(*r[:5]) for r in rows[1:]])

    @staticmethod
    def write(docs: DataFrame, path: str, shard: Column, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> Layout:
        """Writes docs, a shard of 0 to n_shards - 1 for each row."""
        spark, text = docs.sparkSession, F.col(text_col)
        crc = F.coalesce(F.crc32(text), F.lit(0))
        part = F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(max(1, PARTS // n_shards))).cast("int")
        wide = docs.select(
            F.struct(*docs.columns).alias("doc"), size_of(text).alias("size"), crc.alias("crc"), shard.cast("int").alias("shard"), part.alias("part"), F.col(id_col).alias("id")
        )
        sums = wide.groupBy("shard", "part").agg(F.sum("size").alias("bytes")).orderBy("shard", "part").collect()
        total = sum(r["bytes"] for r in sums)
        most, placed, now = min(MOST_BYTES, max(LEAST_BYTES, total // (n_shards * BLOCKS))), [], (-1, 0, 0)
        for r in sums:
            at, block, held = now
            if r["shard"] != at:
                block, held = 0, 0
            elif held and held + r["bytes"] > most:
                block, held = block + 1, 0
            now = r["shard"], block, held + r["bytes"]
            placed.append((r["shard"], r["part"], block))
        layout = Layout(spark, path, docs.schema, n_shards, 0, [])
        if placed:
            table = spark.createDataFrame(placed, "shard int, part int, block int")
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len({(s, b) for s, _, b in placed}))
            own = Window.partitionBy("shard", "block").orderBy(F.asc_nulls_first("id"), "crc", "size")
            rows = (
                wide.join(F.broadcast(table), ["shard", "part"])  # PARTS rows at most
                .repartition(tasks, "shard", "block")
                .withColumn("nth", F.row_number().over(own).cast("long") - 1)
                .withColumn("at", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
            )
            rows.select("doc", "size", "crc", "nth", "at", "shard", "block").write.partitionBy("shard", "block").parquet(f"{path}/blocks")
            found = spark.read.schema("size long, shard int, block int").parquet(f"{path}/blocks")
            layout.blocks = _based({(r["shard"], r["block"]): (r["rows"], r["bytes"]) for r in found.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()})
        layout._save()
        return layout


def _based(found: dict[tuple[int, int], tuple[int, int]]) -> list[Block]:
    """Blocks in the order of their numbers, each with the slot of its first document."""
    out: list[Block] = []
    for (shard, block), (rows, size) in sorted(found.items()):
        before = out[-1] if out and out[-1].shard == shard else None
        out.append(Block(shard, block, before.base + before.rows if before else 0, rows, size))
    return out


class Resharding:
    """A solved plan. moves[i][j]: bytes that go from old shard i to new shard j."""

    def __init__(self, layout: Layout, n_new: int, capacity: list[int] | None = None):
        self.layout, self.n_new = layout, n_new
        self.capacity = capacity or even(sum(layout.sizes), n_new)
        cost = [[int(i != j) for j in range(n_new)] for i in range(layout.n_shards)]
        self.moves = min_cost_flow(layout.sizes, self.capacity, cost)
        self.stay: list[Block] = []
        self.whole: list[tuple[Block, int]] = []  # with its new shard
        self.split: list[tuple[Block, list[tuple[int, int, int]]]] = []  # with (begin, end, new shard) in bytes of the block
        ranges = {}
        for i in range(layout.n_shards):
            at, ranges[i] = 0, []
            for j in sorted(range(n_new), key=lambda j: (j != i, j)):
                if self.moves[i][j]:
                    ranges[i].append((at, at + self.moves[i][j], j))
                    at += self.moves[i][j]
        ahead = [0] * layout.n_shards
        for b in layout.blocks:
            start, end = ahead[b.shard], ahead[b.shard] + b.bytes
            ahead[b.shard] = end
            own = [(max(a, start) - start, min(z, end) - start, j) for a, z, j in ranges[b.shard] if a < end and z > start]
            if len(own) > 1:
                self.split.append((b, own))
            elif own[0][2] == b.shard:
                self.stay.append(b)
            else:
                self.whole.append((b, own[0][2]))

    @property
    def moved_bytes(self) -> int:
        return sum(x for i, row in enumerate(self.moves) for j, x in enumerate(row) if i != j)

    @property
    def affected(self) -> list[Block]:
        """The blocks that are written again, under another shard or in pieces."""
        return [b for b, _ in self.whole] + [b for b, _ in self.split]

    def rewrite(self) -> Layout:
        """Writes the affected blocks anew, replaces the manifest and deletes the blocks that it no longer lists."""
        layout, spark = self.layout, self.layout.spark
        free = 1 + max((b.block for b in layout.blocks), default=0)
        pieces, found = [], {(b.shard, b.block): (b.rows, b.bytes) for b in self.stay}
        for b, shard in self.whole:
            pieces.append(Piece(b.shard, b.block, -1, 2 * b.bytes + 1, 0, 0, shard, free))
            found[shard, free] = b.rows, b.bytes
            free += 1
        counts = self._counted()
        for b, own in self.split:
            first = ahead = 0
            for k, (begin, end, shard) in enumerate(self._twice(b, own)):
                rows, size = counts.get((b.shard, b.block, k), (0, 0))
                if rows:
                    pieces.append(Piece(b.shard, b.block, begin, end, first, ahead, shard, free))
                    found[shard, free] = rows, size
                    first, ahead, free = first + rows, ahead + size, free + 1
        new = Layout(spark, layout.path, layout.columns, self.n_new, layout.version + 1, _based(found))
        if pieces:
            kinds = "shard int, block int, begin long, end long, first long, ahead long, new_shard int, new_block int"
            table = F.broadcast(spark.createDataFrame(pieces, kinds))  # as many rows as blocks and range ends
            rows = layout._files([(b.shard, b.block) for b in self.affected]).join(table, ["shard", "block"]).where(self._inside())
            nth, at = (F.col("nth") - F.col("first")).alias("nth"), (F.col("at") - F.col("ahead")).alias("at")
            moved = rows.select("doc", "size", "crc", nth, at, F.col("new_shard").alias("shard"), F.col("new_block").alias("block"))
            moved.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("shard", "block").parquet(f"{layout.path}/blocks")
        new._save()
        files = Files(spark, layout.path)
        for b in self.affected:
            files.delete(f"{layout.path}/blocks/shard={b.shard}/block={b.block}")
        return new

    @staticmethod
    def _twice(b: Block, own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The ranges by twice a midpoint, the first and the last one open to the block's ends."""
        last = len(own) - 1
        return [(2 * begin if k else -1, 2 * end if k < last else 2 * b.bytes + 1, shard) for k, (begin, end, shard) in enumerate(own)]

    @staticmethod
    def _inside() -> Column:
        twice = 2 * F.col("at") + F.col("size")
        return (twice >= F.col("begin")) & (twice < F.col("end"))

    def _counted(self) -> dict[tuple[int, int, int], tuple[int, int]]:
        """Rows and bytes of each piece of the split blocks, of which there are no more than range ends."""
        if not self.split:
            return {}
        table = [(b.shard, b.block, k, begin, end) for b, own in self.split for k, (begin, end, _) in enumerate(self._twice(b, own))]
        parts = F.broadcast(self.layout.spark.createDataFrame(table, "shard int, block int, k int, begin long, end long"))
        rows = self.layout._files([(b.shard, b.block) for b, _ in self.split]).select("shard", "block", "at", "size").join(parts, ["shard", "block"])
        counted = rows.where(self._inside()).groupBy("shard", "block", "k").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
        return {(r["shard"], r["block"], r["k"]): (r["rows"], r["bytes"]) for r in counted.collect()}


def by_id(doc_id: Column, n_shards: int) -> Column:
    """The layout before: a document's shard by the checksum of its id."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n_shards)).cast("int")


def resharded(docs: DataFrame, path: str, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of n_old shards by id, resharded to n_new even ones and read back: doc, shard, slot, size, crc."""
    layout = Layout.write(docs, path, by_id(F.col(id_col), n_old), n_old, id_col, text_col)
    return Resharding(layout, n_new).rewrite().read()


#: Shards of the query's documents before and after.
OLD_SHARDS, NEW_SHARDS = 12, 16


def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return resharded(docs, common.scratch(spark, "shards"), OLD_SHARDS, NEW_SHARDS).select(
        F.col("doc.doc_id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
