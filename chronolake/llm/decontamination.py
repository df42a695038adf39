"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are brought to their words (runs of letters, digits and underscores, in lower case), with one space between
words and at both ends. An item of m characters is met by a text that has a part within k = floor(rate * m) edits of it. One rule
holds for all lengths; a part that begins or ends within a word of the text lacks the item's space there, which counts as an edit. The item is cut into
k + 1 pieces; k edits leave at least one piece whole, so that exact hits of pieces, found by one Aho-Corasick pass over each whole text, are
all places to look at. There, Myers' bit-parallel algorithm finds the least edit distance of the item to any part of the text.

Items are read in blocks of at most `block_chars` characters, one pass over the texts for each block, whose results are stored before the
next block is read: a benchmark of the usual size is one block, and a larger one needs more passes, never more memory. A worker process
builds a block's automaton once.

Cases: null and empty texts and texts without words meet nothing; items with a null text or without words are left out, a null item id is
reported as null. Texts are searched whole. Equal items are reported each. Rows that repeat an id give rows each. Empty
tables give no rows. Other columns are ignored, or kept by clean().
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import common

RATE, BLOCK_CHARS = 0.08, 8_000_000
_WORDS = re.compile(r"\w+")


def normal(text: str) -> str:
    """The words of a text, a space before, between and after them; empty without words."""
    found = " ".join(_WORDS.findall(text.lower()))
    return f" {found} " if found else ""


def _last_null(item_id: int | None) -> tuple[bool, int]:
    """A sort key of ids, nulls last."""
    return item_id is None, item_id or 0


class Pattern:
    """An item, its error budget and the bit masks of its characters."""

    def __init__(self, item_id: int | None, text: str, rate: float):
        self.item_id, self.text = item_id, text
        self.budget = math.floor(rate * len(text) + 1e-9)
        self._masks: dict[str, int] | None = None
        self._reversed: dict[str, int] | None = None

    def pieces(self) -> list[tuple[int, str]]:
        n, m = self.budget + 1, len(self.text)
        cuts = [m * k // n for k in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _mask(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for k, c in enumerate(text):
            out[c] = out.get(c, 0) | 1 << k
        return out

    def best(self, text: str) -> tuple[int, int, int]:
        """Least distance of the item to any part of text, with that part's start and end."""
        if self._masks is None:
            self._masks, self._reversed = self._mask(self.text), self._mask(self.text[::-1])
        distance, end = nearest(self._masks, len(self.text), text)
        _, length = nearest(self._reversed, len(self.text), text[:end][::-1], anchored=True)
        return distance, end - length, end


def nearest(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Myers' algorithm: the least distance between the pattern and a part of text that ends at the place returned.

    The part may begin anywhere, or at the start of text if anchored. Of equal distances, the first end counts.
    """
    ones, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best, at = m, 0
    carry = 1 if anchored else 0
    for place, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (ones & ~(horizontal | plus))
        down = plus & horizontal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up, down = (up << 1 | carry) & ones, (down << 1) & ones
        plus, minus = down | (ones & ~(vertical | up)), up & vertical
        if score < best:
            best, at = score, place
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.patterns = [Pattern(i, t, rate) for i, t in items if t]
        self.automaton = ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.patterns):
            for offset, piece in p.pieces():
                by_piece.setdefault(piece, []).append((k, offset))
        for piece, uses in by_piece.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if by_piece:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, start, end) of the nearest place of each item that the text meets, in the normalised text."""
        if not self.patterns or not text:
            return []
        places: dict[int, set[int]] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for k, offset in uses:
                places.setdefault(k, set()).add(end + 1 - length - offset)
        out = []
        for k, starts in places.items():
            p = self.patterns[k]
            m, budget = len(p.text), p.budget
            at = text.find(p.text)
            if at >= 0:
                out.append((p.item_id, 0, at, at + m))
                continue
            # Places close to each other share a window.
            best: tuple[int, int, int] | None = None
            lo = hi = -1
            windows = []
            for s in sorted(starts):
                a, b = max(0, s - budget), min(len(text), s + m + budget)
                if a <= hi and hi >= 0 and b - lo <= 4 * m:
                    hi = max(hi, b)
                else:
                    if hi >= 0:
                        windows.append((lo, hi))
                    lo, hi = a, b
            windows.append((lo, hi))
            for a, b in windows:
                distance, start, end = p.best(text[a:b])
                if distance <= budget and (best is None or distance < best[0]):
                    best = distance, a + start, a + end
            if best is not None:
                out.append((p.item_id, *best))
        return sorted(out, key=lambda hit: (_last_null(hit[0]), *hit[1:]))


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks that are bounded by their characters: first ids and lengths are summed, then block after block is read."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * int(total) // block_chars)) if total > block_chars else 1
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted(((r["item_id"], normal(r["text"])) for r in own), key=lambda i: (_last_null(i[0]), i[1]))


_matchers: dict[str, Matcher] = {}


def _matcher(name: str, some: list[tuple[int | None, str]], rate: float) -> Matcher:
    """The block's matcher, built once in a worker process, which keeps that of one block."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(some, rate)
    return _matchers[name]


def _block_by_block(items: DataFrame, block_chars: int, once: Callable[[DataFrame | None, list], DataFrame]) -> DataFrame:
    """once(what the blocks before gave, block) for every block; with several, each result is stored, so that no plan holds two blocks."""
    made, last = None, None
    for some in blocks(items, "item_id", "text", block_chars):
        if last is not None:
            made = common.store(once(made, last), "decontaminated")
        last = some
    return once(made, last) if made is None else common.store(once(made, last), "decontaminated")


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, start, end (characters of the normalised text)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def once(before: DataFrame | None, some: list[tuple[int | None, str]]) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, some, rate)
            for b in common.sliced(batches):
                out = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for hit in matcher.find(normal(t))]
                cols = list(zip(*out)) or [()] * 5
                names = ["doc_id", "item_id", "distance", "start", "end"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        found = rows.mapInArrow(run, "doc_id long, item_id long, distance int, start long, end long")
        return found if before is None else before.unionByName(found)

    return _block_by_block(items, block_chars, once)


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, text_col: str = "text") -> DataFrame:
    """The rows of docs whose texts meet no item."""

    def once(before: DataFrame | None, some: list[tuple[int | None, str]]) -> DataFrame:
        name = uuid.uuid4().hex

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.frugal()
            matcher = _matcher(name, some, rate)
            for b in common.sliced(batches):
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([not t or not matcher.find(normal(t)) for t in texts], pa.bool_()))

        return (docs if before is None else before).mapInArrow(keep, docs.schema)

    return _block_by_block(items, block_chars, once)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.documents(spark, sf_dir), common.benchmark(spark, sf_dir))
