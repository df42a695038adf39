"""Exact n-gram Jaccard join with set-relation skipping, and the components of its links.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets link when their Jaccard similarity reaches the
threshold. The join is exact; what it skips cannot link:

1. One pass makes every set's size and 128-bit key, and counts all shingles in a table by hash cell, whose size follows the input's
   up to 2**24 cells. Sets with equal keys are one class, of which the smallest id stands for all; keys that hold many rows are joined
   map-side. Up to the join, classes go by 64 bits of their key, not by an id, as an id may have several sets; two keys that share these
   bits only meet needlessly.
2. Shingles are ordered by the count of their cell, then by hash; any common order is right, and this one puts frequent shingles
   last. Two linked sets of sizes n and m have at least l of their first n - ceil(t n) + l (m - ceil(t m) + l) shingles in
   common. These prefixes, with l = size // 10, meet in one shuffle by shingle; a set whose prefix has fewer than l shingles that
   any other set's prefix has is settled: it links with nothing. Shingles of hot cells need no meeting, they count as common.
3. Sets that remain are dealt to bands of length, each set to its own and the next longer one, so that linked sets share the longer
   one's band. Within a band, sets are tied by stars around each common prefix shingle; the components of these ties are groups that hold all
   links. Groups are joined one by one. In a group of over `BLOCK` sets, each set is first held against one of them, by the group's
   smallest hash; those that link with it are of one component and need no comparison among themselves. The group is dealt in blocks,
   and only pairs of blocks of which one holds other sets are joined, each apart, so that no task has to hold more than two blocks.
4. Within a group, sets are taken by size. An index on prefix shingles holds, for each list, blocks of positions with the largest
   number of shingles that can follow; blocks that cannot reach the needed overlap are skipped (index-level skipping). The overlaps of a set
   with all others are derived from those of the most similar set computed before, by the lists of the shingles in which the two
   differ only (answer-level skipping); without a similar one they are computed anew.

Only a spanning forest of each group's links leaves it, and components are made of these.

Words and shingles are known by 64-bit hashes, which are not compared with the text: two shingles of one document fall together with
a chance of their number squared over 2**65, under 10**-9 for 100,000 words, which would make its set smaller by one.

Cases: null texts and texts without words have the empty set, which links with nothing; with fewer words than a shingle, the
whole sequence is the only one. Texts are read whole. Rows that repeat an id are one document, linked by any of its texts. Rows with
a null id link with nothing and have a null component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.llm import common, graph, textops

SHINGLE, PERCENT = 5, 75
#: Cells of the frequency table, by the input: so many bytes of text a cell, at least and at most so many cells. Parts of the table.
CELL_BYTES, LEAST_BITS, MOST_BITS, PARTS = 512, 20, 24, 64
#: A cell is hot when its count is over this and over so many times the mean.
HOT, HOT_MEANS = 1000, 8
#: Sets of a group that one task joins at once.
BLOCK = 1000
#: Times that settled sets are looked for among those that remain.
PRUNINGS = 3
#: Positions in a block of an index list.
POSITIONS = 8
#: Parts in which a large group is held against its first set.
SALTS = 32


def _needed(n: np.ndarray | int, percent: int):
    return -(-np.asarray(n) * percent // 100)


def _bits(rows: DataFrame) -> int:
    """Bits of a cell's number, by the bytes of all texts."""
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (int(total) // CELL_BYTES).bit_length()))


def _cells(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    """The first 64 bits of a set's key, as _short_column gives them."""
    return int.from_bytes(key[:8], "big", signed=True)


def _short_column(key: str) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted set) of every text."""
    for at, to, words in textops.steps(texts, lower=True):
        for k in range(to - at):
            yield at + k, np.unique(textops.shingle_hashes(words.hashes[words.first[k] : words.first[k + 1]], size))


def _summaries(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, key) of a document, and (part, counts) of the frequency table from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.frugal()
        counts, tokens, held = np.zeros(1 << bits, np.uint32), [], 0
        names = ["doc_id", "n", "key", "part", "counts"]

        def add() -> None:
            if tokens:
                counts[:] += np.bincount(np.concatenate(tokens), minlength=1 << bits).astype(np.uint32)
                tokens.clear()

        for b in batches:
            n, keys = [], []
            for _, s in _sets(b.column(1), size):
                n.append(len(s))
                keys.append(_key(s))
                tokens.append(_cells(s, bits))
                held += len(s)
                if held > 1 << bits - 2:
                    add()
                    held = 0
            none = pa.nulls(len(b), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), none, pa.nulls(len(b), pa.binary())], names=names)
        add()
        for part, own in enumerate(np.split(counts, PARTS)):
            if own.any():
                held = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([part], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())]
                yield pa.RecordBatch.from_arrays(held, names=names)

    return common.store(rows.mapInArrow(run, "doc_id long, n long, key binary, part int, counts binary"), "jaccard-sets")


def _frequencies(summaries: DataFrame, bits: int) -> np.ndarray:
    """The summed table: 2**bits counts, the largest 2**32 - 1."""
    cells = (1 << bits) // PARTS

    def add(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint64)
        for b in batches:
            for c in b.column(1).to_pylist():
                total += np.frombuffer(zlib.decompress(c), np.uint32)
        total = np.minimum(total, 2**32 - 1).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    rows = summaries.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    table = np.zeros((PARTS, cells), np.uint32)
    for r in rows:
        table[r["part"]] = np.frombuffer(r["counts"], "<u4")
    return table.ravel()


def _prefixes(rows: DataFrame, size: int, percent: int, table, bits: int) -> DataFrame:
    """token, short, n, hot: the prefixes' shingles and the set's size. A set that a task has met already is not given twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.frugal()
        counts = table.value
        limit = max(HOT, int(HOT_MEANS * counts.mean()))
        met: set[int] = set()
        for b in batches:
            ids = b.column(0).to_pylist()
            tokens, owners, sizes = [], [], []

            def flush() -> pa.RecordBatch:
                t = np.concatenate(tokens)
                lengths = [len(x) for x in tokens]
                out = pa.RecordBatch.from_arrays(
                    [pa.array(textops.signed(t)), pa.array(np.repeat(np.array(owners, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(counts[_cells(t, bits)] > limit)],
                    names=["token", "short", "n", "hot"],
                )
                tokens.clear(), owners.clear(), sizes.clear()
                return out

            for k, s in _sets(b.column(1), size):
                n = len(s)
                if not n or ids[k] is None:
                    continue
                short = _short(_key(s))
                if short in met:
                    continue
                if len(met) < 200_000:
                    met.add(short)
                length = n - int(_needed(n, percent)) + max(1, n // 10)
                order = np.lexsort((s, counts[_cells(s, bits)]))
                tokens.append(s[order[:length]])
                owners.append(short)
                sizes.append(n)
                if len(owners) == 1024:
                    yield flush()
            if owners:
                yield flush()

    return rows.mapInArrow(run, "token long, short long, n int, hot boolean")


def _enough(rows: DataFrame, percent: int, *keys: str) -> DataFrame:
    """The sets (by keys) with as many common prefix shingles as a link needs."""
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.first("n") * percent / 100) / 10))
    return common.cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"), least.alias("least")).where("have >= least").select(*keys))


def _groups(prefixes: DataFrame, percent: int) -> DataFrame:
    """short and grp of all sets that may link with another; a set may be in two groups."""
    own = Window.partitionBy("token")
    cold = prefixes.where("not hot").select("token", "short", "n", F.min("short").over(own).alias("lo"), F.max("short").over(own).alias("hi"))
    met = common.store(cold.where("lo <> hi").select("token", "short", "n").unionByName(prefixes.where("hot").select("token", "short", "n")), "jaccard-met")
    # Most sets are settled here, so that what follows moves little.
    live = met.join(common.small(_enough(met, percent, "short")), "short", "left_semi").distinct()
    # A step of the bands is a little longer than the largest ratio of linked sizes, whatever way logarithms are rounded.
    step = math.log(max(100 / percent * (1 + 1e-9), 1.05))
    home = F.floor(F.log("n") / step).cast("int")
    live = common.cut(live.select("token", "short", "n", home.alias("home"), F.explode(F.array(home, home + 1)).alias("band")))
    for _ in range(PRUNINGS):
        # Shingles that only one set of a band is left with are no longer common, which settles further sets; so do shingles that only
        # sets of the band before have, which meet there.
        live = live.join(common.small(_enough(live, percent, "short", "band")), ["short", "band"], "left_semi")
        pivots = live.groupBy("token", "band").agg(F.min("short").alias("v"), F.max("short").alias("most"), F.max("home").alias("top"))
        pivots = common.cut(pivots.where("v < most and top = band").select("token", "band", "v"))
        tied = common.cut(live.join(pivots, ["token", "band"]).select("token", "short", "n", "home", "band", "v"))
        live = tied.drop("v")
    # The nodes are sets in a band; two that share a hash would only be one group.
    node = lambda c: F.xxhash64(c, "band")
    stars = graph.components(tied.where("short <> v").select(node("short").alias("u"), node("v").alias("v")).distinct())
    nodes = tied.select("short", node("short").alias("node")).distinct()
    grouped = nodes.join(stars, "node", "left").select("short", F.coalesce("component", "node").alias("grp"))
    return common.cut(grouped.distinct())


def join_group(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> graph.Forest:
    """Exact links between the sets of one group, as a forest over their ids."""
    forest = graph.Forest()
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), ids[k]))
    ids, sets = [ids[k] for k in order], [sets[k] for k in order]
    g = len(sets)
    if g < 2:
        return forest
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(g), sizes)
    distinct, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(inverse, minlength=len(distinct))
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, df))] = np.arange(len(distinct))  # rarest first
    by_rank = np.argsort(rank[inverse], kind="stable")
    lists = owner[by_rank]
    start = np.concatenate([[0], np.cumsum(np.sort(df))])  # df ascends with rank
    ends = np.cumsum(sizes)
    tokens = [np.sort(rank[inverse[e - n : e]]) for e, n in zip(ends, sizes)]
    alone = int((df == 1).sum())  # ranks under this occur in one set

    def counted(some: np.ndarray) -> np.ndarray:
        some = some[some >= alone]
        if not len(some):
            return np.zeros(g, np.int32)
        at = np.concatenate([lists[start[t] : start[t + 1]] for t in some])
        return np.bincount(at, minlength=g).astype(np.int32)

    # Index lists of prefix shingles: token -> position block -> [largest remaining size, sets].
    index: dict[int, dict[int, list]] = {}
    answers = np.zeros((g, g), np.int32) if g <= 2 * BLOCK else None
    for x in range(g):
        n, own = int(sizes[x]), tokens[x]
        need = int(_needed(n, percent))
        prefix = own[: n - need + 1]
        candidates: set[int] = set()
        for p, t in enumerate(prefix):
            if n - p < need:
                break
            if t < alone:
                continue
            for block in index.get(t, {}).values():
                if block[0] >= need:  # else no set of the block can overlap enough
                    candidates.update(block[1])
        if candidates:
            near = np.fromiter(candidates, np.int64, len(candidates))
            near = near[sizes[near] * 100 >= percent * n]
            if len(near):
                if answers is not None:
                    like = int(near[answers[near, x].argmax()])
                    shared = int(answers[like, x])
                    if 2 * shared > n and answers[like].any():
                        other = tokens[like]
                        overlap = answers[like] + counted(np.setdiff1d(own, other, True)) - counted(np.setdiff1d(other, own, True))
                        overlap[like] = shared  # its own shingles that no other set has are in no list
                        overlap[x] = n
                    else:
                        overlap = counted(own)
                    answers[x] = overlap
                else:
                    overlap = counted(own)
                both = overlap[near]
                for y in near[100 * both >= percent * (n + sizes[near] - both)]:
                    forest.join(ids[x], ids[int(y)])
        if answers is not None and not answers[x].any():
            answers[x] = counted(own)
        for p, t in enumerate(prefix):
            if t >= alone:
                block = index.setdefault(t, {}).setdefault(p // POSITIONS, [0, []])
                block[0] = max(block[0], n - p)
                block[1].append(x)
    return forest


def _core(sets: DataFrame, percent: int) -> DataFrame:
    """grp, short, doc_id and first (an id) of the sets of large groups that link with their group's first set, that set included."""
    some = sets.groupBy("grp").agg(F.min_by(F.struct("doc_id", "tokens"), F.xxhash64("short")).alias("p"))
    firsts = common.cut(some.select("grp", F.col("p.doc_id").alias("first"), F.col("p.tokens").alias("other")))
    # A group is dealt to SALTS tasks, with a copy of its first set each: few rows, as the groups are large.
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = sets.withColumn("salt", F.pmod(F.xxhash64("short", F.lit(1)), F.lit(SALTS)).cast("int"))
    both = F.size(F.array_intersect("tokens", "other"))
    linked = both * 100 >= (F.size("tokens") + F.size("other") - both) * percent
    return salted.join(firsts, ["grp", "salt"]).where(linked).select("grp", "short", "doc_id", "first")


def _dealt(sets: DataFrame, core: DataFrame) -> DataFrame:
    """Sets of large groups, a copy for each pair of blocks in which they are to be compared. Blocks of the core come first; two of them make no pair."""
    marked = sets.join(core.select("grp", "short", F.lit(1).alias("core")).distinct(), ["grp", "short"], "left").withColumn("core", F.coalesce("core", F.lit(0)))
    blocks = lambda kind: F.ceil(F.count_if(F.col("core") == kind) / BLOCK).cast("int")
    counts = common.cut(marked.select("grp", "short", "core").distinct().groupBy("grp").agg(blocks(1).alias("inner"), blocks(0).alias("outer")))
    placed = marked.join(common.small(counts), "grp")
    spot = lambda n: F.pmod(F.xxhash64("short"), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(F.col("core") == 1, spot(F.col("inner"))).otherwise(F.col("inner") + spot(F.col("outer")))
    total = F.col("inner") + F.col("outer")
    from_ = F.when(F.col("core") == 1, F.col("inner")).otherwise(F.lit(0))
    others = F.when(from_ < total, F.sequence(from_, total - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(others, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return placed.select("grp", F.explode(pairs).alias("pair"), "doc_id", "short", "tokens")


def _links(rows: DataFrame, groups: DataFrame, least: DataFrame, size: int, percent: int) -> DataFrame:
    """u, v: stars of the ids whose sets link, within groups or pairs of their blocks. least: doc_id and short of each set's smallest id."""
    large = common.cut(groups.groupBy("grp").count().where(F.col("count") > BLOCK).select("grp", F.lit(True).alias("large")))
    placed = groups.join(common.small(large), "grp", "left").select("short", "grp", F.coalesce("large", F.lit(False)).alias("large"))
    named = common.cut(least.join(common.small(common.cut(placed)), "short").distinct())
    chosen = rows.join(common.small(named), "doc_id").select("doc_id", "text", "grp", "large", "short")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.frugal()
        for b in common.sliced(batches):
            # Each of an id's texts meets each of its classes: only its own is kept.
            shorts = b.column(4).to_pylist()
            own = [(k, textops.signed(s)) for k, s in _sets(b.column(1), size) if _short(_key(s)) == shorts[k]]
            kept = b.select(["doc_id", "grp", "large", "short"]).take(pa.array([k for k, _ in own], pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([s for _, s in own], pa.list_(pa.int64()))], names=["doc_id", "grp", "large", "short", "tokens"])

    sets = chosen.mapInArrow(make, "doc_id long, grp long, large boolean, short long, tokens array<long>")
    alone = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")).alias("pair")
    direct = None
    if large.isEmpty():
        dealt = sets.select("grp", alone, "doc_id", "short", "tokens")
    else:
        sets = common.store(sets, "jaccard-tokens")
        core = common.cut(_core(sets.where("large"), percent))
        direct = core.where("doc_id <> first").select(F.greatest("doc_id", "first").alias("u"), F.least("doc_id", "first").alias("v"))
        dealt = sets.where("not large").select("grp", alone, "doc_id", "short", "tokens").unionByName(_dealt(sets.where("large"), core))
    dealt = dealt.select("grp", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "doc_id", "short", "tokens")
    dealt = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "doc_id", "short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.frugal()
        now, last, ids, sets, out = None, None, [], [], []

        def done() -> None:
            # An id's several texts are several sets; equal sets are one class and come once.
            out.extend(join_group(ids, sets, percent).stars())
            ids.clear()
            sets.clear()

        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            lists = b.column(5)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for k, (key, d, short) in enumerate(zip(keys, b.column(3).to_pylist(), b.column(4).to_pylist())):
                if key != now and ids:
                    done()
                if (key, d, short) == last:
                    continue  # a row that repeats an id and its text
                now, last = key, (key, d, short)
                ids.append(d)
                sets.append(flat[offsets[k] : offsets[k + 1]].copy())
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v"])
                out.clear()
        if ids:
            done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v"])

    found = dealt.mapInArrow(run, "u long, v long")
    return found if direct is None else found.unionByName(direct)


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id (smallest id with an equal set), component_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = _bits(rows)
    summaries = _summaries(rows, size, bits)
    own = summaries.where("part is null")
    is_real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    real = own.where(is_real).select("doc_id", "n", "key")
    least = common.cut(real.groupBy("key").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("rows")))
    total = least.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    named = common.join_by_key(real, least, "key", "rows", total).select("doc_id", "n", "class", _short_column("key").alias("short"))
    with_class = common.cut(named.unionByName(own.where(~F.coalesce(is_real, F.lit(False))).select("doc_id", "n", F.lit(None).cast("long").alias("class"), F.lit(None).cast("long").alias("short"))))
    table = rows.sparkSession.sparkContext.broadcast(_frequencies(summaries, bits))
    groups = _groups(_prefixes(rows, size, percent, table, bits), percent)
    same = with_class.where("class <> doc_id").select(F.col("doc_id").alias("u"), F.col("class").alias("v"))
    leaders = with_class.where("class = doc_id").select("doc_id", "short")
    parts = graph.components(_links(rows, groups, leaders, size, percent).unionByName(same))
    return with_class.join(parts, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.documents(spark, sf_dir))


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS s
  FROM (SELECT *, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS k FROM d)
), sets AS (
  SELECT d.doc_id, count(s) AS n, string_agg(s, chr(10) ORDER BY s) AS whole FROM d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id
), classes AS (
  SELECT doc_id, n, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY whole) END AS class_id FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS node FROM sets UNION SELECT doc_id, b FROM reach JOIN both_ways ON node = a
)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, any_value(class_id) AS class_id, min(node) AS component_id
FROM reach JOIN classes USING (doc_id) GROUP BY doc_id
"""
