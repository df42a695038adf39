"""Substring deduplication by repeated-phrase automata.

A window is `window` consecutive words of a document. Words that a window covers go if the same word sequence also starts in a
document of a smaller id.

1. Anchors. The hash of every run of window // 2 words is taken, and of each window the least of its runs' hashes: equal windows
   have equal anchors, and a document has few. Anchors that two documents share are found by one aggregation; those that very many share
   are then marked map-side.
2. Segments. Runs of windows with shared anchors are cut out of the documents; all that could recur stands in them.
3. Confirmed passages. The 128-bit hashes of the segments' windows are aggregated to the first and last document that has them;
   windows of two documents or more are put together, in their first document, to passages as long as possible.
4. Sharded automata. The documents are dealt to shards of bounded bytes, a task each; a shard gets the passages that have an anchor in common
   with its documents, once each. If these are many, the shard is worked on in several loads, each a task with a part of the passages. A load
   cuts its passages into blocks of half a window and compiles an Aho-Corasick automaton over word numbers. Every window of a passage holds
   a whole block.
5. Location. Each load streams its shard's segments through its automaton. The windows around a hit are looked up, by their 128-bit hashes,
   among the load's windows; those that a smaller document has go.

Words are known by 64-bit hashes and windows by two hashes of these; they are not compared with the text.

Cases: null and empty texts have no words; a text shorter than a window keeps all; rows with a null id neither lose words nor take
any from others; rows that repeat an id are each judged against smaller ids only. Texts are read whole; a document is worked on as a
whole, in about 60 bytes of memory for each of its text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import common, textops

WINDOW = 50
#: Segment bytes of a shard, and the most shards; beyond, shards grow. Passage bytes of a load.
SHARD_BYTES, MOST_SHARDS, LOAD_BYTES = 4 << 20, 100_000, 8 << 20
#: Bytes up to which lists of anchors and ranges are broadcast.
BROADCAST_BYTES = 32 << 20


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """Of each window, the least hash of its runs of half as many words."""
    half = window // 2
    if len(words) < window:
        return np.zeros(0, np.uint64)
    start = np.arange(len(words) - half + 1)
    return least(textops.run_hashes(words, start, start + half), window - half + 1)


def window_keys(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window."""
    start = np.arange(max(0, len(words) - window + 1))
    other = textops.mix(words ^ np.uint64(0x5851F42D4C957F2D))
    return textops.run_hashes(words, start, start + window), textops.run_hashes(other, start, start + window)


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _documents_anchors(rows: DataFrame, window: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.frugal()
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for at, to, w in textops.steps(b.column(1)):
                for k in range(to - at):
                    if w.first[k + 1] - w.first[k] >= window and ids[at + k] is not None:
                        own = np.unique(anchors(w.hashes[w.first[k] : w.first[k + 1]], window))
                        out.append((ids[at + k], textops.signed(own)))
            yield _batch(schema, out)

    return common.store(rows.mapInArrow(run, "doc_id long, h array<long>"), "anchors")


def _segments(rows: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """doc_id, th (hash of the text), start (word), text: what could recur."""
    lists = common.small(shared, BROADCAST_BYTES)
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("text", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.frugal()
        for b in batches:
            ids, hashes, lists, out = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), []
            for at, to, w in textops.steps(b.column(1)):
                for k in range(to - at):
                    a, z = w.first[k], w.first[k + 1]
                    own = anchors(w.hashes[a:z], window)
                    known = lists[at + k].values.to_numpy().view(np.uint64)
                    for s, e in runs(np.isin(own, known)):
                        piece = w.data[w.starts[a + s] : w.ends[a + e + window - 2]].tobytes()
                        out.append((ids[at + k], hashes[at + k], s, b" ".join(piece.split()).decode()))
            yield _batch(schema, out)

    joined = rows.join(lists, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("th"), "h")
    return common.store(joined.mapInArrow(run, "doc_id long, th long, start long, text string"), "segments")


def _recurring(segments: DataFrame, window: int) -> DataFrame:
    """doc_id and keys: the windows that the document is the first of several to have."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.frugal()
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, to, w in textops.steps(b.column(1)):
                one, two, owner = [], [], []
                for k in range(to - at):
                    k1, k2 = window_keys(w.hashes[w.first[k] : w.first[k + 1]], window)
                    k1, where = np.unique(k1, return_index=True)
                    one.append(k1)
                    two.append(k2[where])
                    owner.append(np.full(len(k1), ids[at + k], np.int64))
                cols = [textops.signed(np.concatenate(one)), textops.signed(np.concatenate(two)), np.concatenate(owner)]
                for lo in range(0, len(cols[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in cols], schema=schema)

    found = segments.select("doc_id", "text").mapInArrow(run, "k1 long, k2 long, doc_id long")
    first = found.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id < last")
    return first.groupBy("doc_id").agg(F.collect_list("k1").alias("keys"))


def _passages(segments: DataFrame, recurring: DataFrame, window: int) -> DataFrame:
    """pid, first (document), text and anchors of the confirmed passages."""
    schema = pa.schema([("pid", pa.binary()), ("first", pa.int64()), ("text", pa.large_string()), ("h", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.frugal()
        for b in batches:
            ids, lists, out = b.column(0).to_pylist(), b.column(2), []
            for at, to, w in textops.steps(b.column(1)):
                for k in range(to - at):
                    a, z = w.first[k], w.first[k + 1]
                    words = w.hashes[a:z]
                    known = lists[at + k].values.to_numpy().view(np.uint64)
                    own = anchors(words, window)
                    for s, e in runs(np.isin(window_keys(words, window)[0], known)):
                        text = w.data[w.starts[a + s] : w.ends[a + e + window - 2]].tobytes()
                        name = hashlib.blake2b(text, digest_size=16, key=str(ids[at + k]).encode()).digest()
                        out.append((name, ids[at + k], text.decode(), textops.signed(np.unique(own[s:e]))))
            yield _batch(schema, out)

    joined = segments.join(recurring, "doc_id").select("doc_id", "text", "keys")
    made = joined.mapInArrow(run, "pid binary, first long, text string, h array<long>")
    return common.store(made, "passages")


class Automaton:
    """Aho-Corasick over the word numbers of a load's passages, and their windows' hashes with the smallest document that has each.

    A pattern is a block of half a window; it tells where windows are worth looking up.
    """

    def __init__(self, window: int):
        self.window, self.half = window, window // 2
        self._blocks: set[tuple[int, ...]] = set()
        self._windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._compiled = None

    @staticmethod
    def numbers(words: np.ndarray) -> tuple[int, ...]:
        return tuple((words >> np.uint64(32)).tolist())

    def add(self, first: int, words: np.ndarray) -> None:
        numbers = self.numbers(words)
        self._blocks.update(numbers[o : o + self.half] for o in range(0, len(words) - self.half + 1, self.half))
        one, two = window_keys(words, self.window)
        self._windows.append((one, two, np.full(len(one), first, np.int64)))

    def _compile(self) -> None:
        self._compiled = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block in self._blocks:
            self._compiled.add_word(block, True)
        self._compiled.make_automaton()
        self._blocks.clear()
        one, two, first = (np.concatenate(x) for x in zip(*self._windows))
        self._windows.clear()
        order = np.lexsort((first, two, one))
        one, two, first = one[order], two[order], first[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        self._one, self._two, self._first = one[new], two[new], first[new]
        # Windows that share their first hash only: one in all but freak cases.
        self._alike = int(np.diff(np.flatnonzero(np.concatenate([[True], self._one[1:] != self._one[:-1], [True]]))).max())

    def removed(self, doc_id: int, words: np.ndarray) -> np.ndarray:
        """Which words a recurring window covers that starts in a smaller document."""
        n, window = len(words), self.window
        gone = np.zeros(n, bool)
        if self._compiled is None and self._blocks:
            self._compile()
        if self._compiled is None or n < window:
            return gone
        ends = np.fromiter((end for end, _ in self._compiled.iter(self.numbers(words))), np.int64)
        if not len(ends):
            return gone
        # A hit lies in the windows that begin up to window - half words before it.
        near = np.zeros(n + 1, np.int64)
        begin = ends - self.half + 1
        np.add.at(near, np.maximum(begin - (window - self.half), 0), 1)
        np.add.at(near, np.minimum(begin + 1, n), -1)
        start = np.flatnonzero(near.cumsum()[: n - window + 1] > 0)
        one, two = window_keys(words, window)
        at, found = np.searchsorted(self._one, one[start]), np.zeros(len(start), bool)
        for k in range(self._alike):
            spot = np.minimum(at + k, len(self._one) - 1)
            found |= (self._one[spot] == one[start]) & (self._two[spot] == two[start]) & (self._first[spot] < doc_id)
        cover = np.zeros(n + 1, np.int64)
        cover[start[found]] += 1
        cover[start[found] + window] -= 1
        return cover.cumsum()[:n] > 0


def _located(segments: DataFrame, shared: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """doc_id, th and ranges (start, end of words) to remove."""
    spark = segments.sparkSession
    total = segments.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-int(total) // SHARD_BYTES)))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    # Both sides are stored, so that adaptive execution can split an anchor that very many passages or shards have.
    wanted = common.store(shared.select(shard.alias("shard"), F.explode("h").alias("h")).distinct(), "wanted")
    uses = passages.select("pid", F.octet_length("text").alias("size"), F.explode("h").alias("h"))
    dealt = common.store(wanted.join(uses, "h").select("shard", "pid", "size").distinct(), "dealt")
    # One row per load; the loads of a shard have consecutive numbers.
    loads = F.greatest(F.lit(1), F.ceil(F.sum("size") / LOAD_BYTES)).cast("int")
    counted = {r["shard"]: r["loads"] for r in dealt.groupBy("shard").agg(loads.alias("loads")).collect()}
    table, n = [], 0
    for k in range(shards):
        if k in counted:  # no passage recurs in the others
            table.append((k, n, counted[k]))
            n += counted[k]
    if not table:
        return spark.createDataFrame([], "doc_id long, th long, ranges array<struct<start:bigint,end:bigint>>")
    numbered = F.broadcast(spark.createDataFrame(table, "shard int, load int, loads int"))  # MOST_SHARDS rows at most
    spot = (F.col("load") + F.pmod(F.xxhash64("pid"), F.col("loads"))).cast("int")
    none = F.lit(0).cast("long")
    known = (
        dealt.join(passages.dropDuplicates(["pid"]).drop("h"), "pid")
        .join(numbered, "shard")
        .select(spot.alias("load"), F.lit(0).alias("kind"), F.col("first").alias("doc_id"), none.alias("th"), none.alias("start"), "text")
    )
    each = F.explode(F.sequence(F.col("load"), F.col("load") + F.col("loads") - 1))
    own = segments.withColumn("shard", shard).join(numbered, "shard").select(each.alias("load"), F.lit(1).alias("kind"), "doc_id", "th", "start", "text")
    both = known.unionByName(own).repartitionById(n, "load").sortWithinPartitions("load", "kind")
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.frugal()
        now, automaton = None, None
        for b in batches:
            load, kind, ids, th, first = (b.column(k).to_pylist() for k in range(5))
            out = []
            for at, to, w in textops.steps(b.column(5)):
                for k in range(at, to):
                    if load[k] != now:
                        now, automaton = load[k], Automaton(window)
                    words = w.hashes[w.first[k - at] : w.first[k - at + 1]]
                    if kind[k] == 0:
                        automaton.add(ids[k], words)
                    else:
                        out += [(ids[k], th[k], first[k] + s, first[k] + e) for s, e in runs(automaton.removed(ids[k], words))]
            yield _batch(schema, out)

    found = both.mapInArrow(run, "doc_id long, th long, start long, end long")
    return common.cut(found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("ranges")))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    exploded = _documents_anchors(rows, window).select("doc_id", F.explode("h").alias("h"))
    found = exploded.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("rows"))
    recur = common.cut(found.where("lo < hi").select("h", "rows"))
    total = recur.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    marked = common.join_by_key(exploded, recur, "h", "rows", total, "left_semi")
    shared = common.store(marked.groupBy("doc_id").agg(F.collect_set("h").alias("h")), "shared-anchors")
    segments = _segments(rows, shared, window)
    passages = _passages(segments, _recurring(segments, window), window)
    ranges = _located(segments, shared, passages, window)
    lists = common.small(ranges, BROADCAST_BYTES)
    joined = rows.withColumn("th", F.xxhash64("text")).join(lists, ["doc_id", "th"], "left").select("doc_id", "text", "ranges")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.large_string())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.frugal()
        for b in common.sliced(batches):
            out = []
            for d, t, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if own:
                    keep = np.ones(n, bool)
                    for r in own:
                        keep[r["start"] : r["end"]] = False
                    words = [words[k] for k in np.flatnonzero(keep)]
                out.append((d, n, n - len(words), b" ".join(words).decode()))
            yield _batch(schema, out)

    return joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(common.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT r, doc_id, k, array_to_string(w[k + 1 : k + 50], ' ') AS s FROM (SELECT *, unnest(range(greatest(len(w) - 49, 0))) AS k FROM d)
), first AS (
  SELECT s, min(doc_id) AS lo FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT r, k + unnest(range(50)) AS pos FROM win JOIN first USING (s) WHERE lo < doc_id
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, pos) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
