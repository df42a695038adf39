"""Token-ID output in Re-Pair compressed shard files, and random access into them.

Documents are range-partitioned by id and encoded in ascending order; every `shard_ids` ids or so (at a document's end)
make a shard. A shard is compressed by grammar: frequent pairs of neighbouring ids are replaced by new symbols (nonterminals),
round after round, until no pair occurs `least` times; a pair met so often saves more symbols than its rule takes. Pairs are counted
exactly, without overlap. A round replaces all pairs that come near the most frequent one; where two of them overlap, the more
frequent one wins and the other waits for the next round. A shard file holds the rules, the length that each symbol expands to, the
final sequence and the documents' ends, so that any range of ids is decoded without expanding what stands before it.

Format of a shard's payload (little-endian): magic b"RPR2"; uint32 counts of documents, terminals, rules and symbols in the
sequence; uint64 number of ids; uint8 bit widths of terminals, symbols, lengths and ends; the documents' ids as int64 and null
marks as uint8; then, each in its width, lowest bit first and filled up to whole bytes: the documents' ends, the terminals (the
distinct ids, ascending; symbols number them from 0), the rules as pairs of symbols (numbered on from the terminals), the rules'
expansion lengths, the sequence. Payloads stand in Parquet, one row each, so that only tasks that succeed leave files and any store works.

The tokenizer is the tokenizers library with a vocabulary file that is given by path. Most text is words parted by single
spaces: pre-tokenisation cuts there in any case, so that each word with the space before it is encoded once by the library and
its ids are remembered. Words are found by a hash and then compared in full. Texts with any other white space, texts with a word whose
hash another word has, and all texts of a tokenizer that does not part lines go to the library as a whole.

Cases: null and empty texts have only the end id; texts of any length are encoded whole; null ids come first; rows that repeat
an id follow each other in the order of the text's hash; an empty table gives no rows. Other columns are ignored. A document is worked
on as a whole: a task needs about 60 bytes of memory for each byte of its longest text.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.llm import common, textops

MAGIC, HEAD = b"RPR2", "<IIIIQBBBB"
SHARD_IDS = 1 << 18
END_ID = 2
#: Occurrences that a rule needs: it takes two symbols and a length, and saves a symbol each time.
LEAST = 4
#: A round replaces the pairs that occur at least one NEARth as often as the most frequent one.
NEAR = 8
#: Bits of the hash cells by which places of chosen pairs are looked up before they are compared.
CELL_BITS = 16
#: Bytes of text up to which the session's number of shuffle partitions is enough; more get partitions of so many bytes.
PART_BYTES = 512 << 20
#: Words whose ids an encoder remembers.
REMEMBERED = 700_000
#: Bytes of text that are encoded at once: a batch of the session's size, as a rule.
STEP_BYTES = 4 << 20
#: Words that the library gets as one text.
WORDS_A_TEXT = 512


_first_of_space = np.zeros(256, bool)
_first_of_space[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def odd_places(data: np.ndarray) -> np.ndarray:
    """Where bytes may begin a white-space character other than those that part words here."""
    at = np.flatnonzero(_first_of_space[data])
    if not len(at):
        return at
    more = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = more[at], more[at + 1], more[at + 2]
    odd = (a < 0x80) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    odd |= (a == 0xE2) & ((b == 0x81) & (c == 0x9F) | (b == 0x80) & ((c <= 0x8A) | (c >= 0xA8) & (c <= 0xAF)))
    return at[odd]


class Encoder:
    """Ids of many texts at once. A word, with what stands before it, is encoded by the library the first time it is met.

    What is known stands in one array of ids, with a start and a size for each word, found by the word's hash. A word's first and last
    eight bytes and its length stand there too: they tell words of up to 16 bytes apart, longer ones are kept as bytes.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; threads of the library would each hold caches
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.tokenizer.encode_special_tokens = True
        ids = self._library("\n").tolist()
        self.break_id = ids[0] if len(ids) == 1 else None  # None: texts are not taken apart
        self._begin()

    def _library(self, *texts: str) -> np.ndarray:
        # encode_batch_fast leaves out character offsets; the ids are those of encode_batch.
        return np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)])

    def _begin(self) -> None:
        self.rows: dict[int, int] = {}
        self.long: dict[int, bytes] = {}
        self.n_rows, self.n_ids = 0, 0
        self.start, self.size, self.uses, self.form = (np.zeros(1 << 16, np.int64) for _ in range(4))
        self.head, self.tail = (np.zeros(1 << 16, np.uint64) for _ in range(2))
        self.ids = np.zeros(1 << 20, np.uint32)
        self._add(np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64))

    def _forget(self) -> None:
        """Keeps the words that were met in two steps or more, if these are few enough."""
        known, long, start, size, ids, form, head, tail = self.rows, self.long, self.start, self.size, self.ids, self.form, self.head, self.tail
        often = {k: row for k, row in known.items() if self.uses[row] > 1}
        self._begin()
        if len(often) <= REMEMBERED // 2:
            rows = np.fromiter(often.values(), np.int64, len(often))
            reach = size[rows].cumsum()
            parts = ids[np.arange(int(reach[-1]) if len(rows) else 0) + np.repeat(start[rows] - (reach - size[rows]), size[rows])]
            row = self._add(parts, reach - size[rows], size[rows])
            own = slice(row, row + len(rows))
            self.form[own], self.head[own], self.tail[own] = form[rows], head[rows], tail[rows]
            self.rows = dict(zip(often, range(row, row + len(rows))))
            self.long = {new: long[old] for new, old in zip(self.rows.values(), rows.tolist()) if old in long}

    def _add(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> int:
        """Keeps ids and the parts of them that start and size tell; returns the first part's row."""
        row, n, m = self.n_rows, len(start), len(ids)
        while row + n > len(self.start):
            self.start, self.size, self.uses, self.form, self.head, self.tail = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.uses, self.form, self.head, self.tail)
            )
        while self.n_ids + m > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.n_ids : self.n_ids + m] = ids
        self.start[row : row + n], self.size[row : row + n], self.uses[row : row + n] = start + self.n_ids, size, 0
        self.n_rows, self.n_ids = row + n, self.n_ids + m
        return row

    def _learn(self, words: list[bytes], kind: np.ndarray) -> int | None:
        """Rows of words before which stand nothing (kind 0), a space (1) or a line break (2); None if lines are not parted.

        A line break is an id of its own between words. So many are encoded as one text, a line break before each, and taken apart there.
        """
        marked = [b"\n " + w if k == 1 else b"\n" + w for w, k in zip(words, kind.tolist())]
        ids = self._library(*[b"".join(marked[k : k + WORDS_A_TEXT]).decode() for k in range(0, len(marked), WORDS_A_TEXT)])
        breaks = np.flatnonzero(ids == self.break_id)
        if len(breaks) != len(words):
            return None
        start = breaks + (kind != 2)
        return self._add(ids, start, np.append(breaks[1:], len(ids)) - start)

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
        """The row of each word; or, of a word whose hash another word has, its mark; or neither if lines are not parted."""
        key = textops.mix(hashes ^ (kind.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        head, tail = _ends(data, starts, ends)
        form = (ends - starts) * 4 + kind
        distinct, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        rows = np.array([self.rows.get(k, -1) for k in distinct.tolist()], np.int64)
        found = np.flatnonzero(rows >= 0)
        at, own = rows[found], where[found]
        unlike = np.zeros(len(distinct), bool)
        unlike[found] = (self.form[at] != form[own]) | (self.head[at] != head[own]) | (self.tail[at] != tail[own])
        for k in found[form[own] >= 17 * 4].tolist():
            unlike[k] |= self.long.get(int(rows[k])) != data[starts[where[k]] : ends[where[k]]].tobytes()
        first = where[inverse]
        odd = unlike[inverse] | (form != form[first]) | (head != head[first]) | (tail != tail[first])
        long = np.flatnonzero((form >= 17 * 4) & (first != np.arange(len(first))))
        for k in long[~_same(data, starts[long], ends[long], starts[first[long]])].tolist():
            odd[k] = True
        if odd.any():
            return None, odd
        if len(new := np.flatnonzero(rows < 0)):
            own = where[new]
            words = [data[a:z].tobytes() for a, z in zip(starts[own].tolist(), ends[own].tolist())]
            row = self._learn(words, kind[own])
            if row is None:
                return None, None
            rows[new] = np.arange(row, row + len(new))
            self.form[row : row + len(new)], self.head[row : row + len(new)], self.tail[row : row + len(new)] = form[own], head[own], tail[own]
            self.rows.update(zip(distinct[new].tolist(), range(row, row + len(new))))
            self.long.update((row + k, w) for k, w in enumerate(words) if len(w) > 16)
        self.uses[rows] += 1
        return rows[inverse], None

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts, each with the end id, and how many each has), until all texts are through."""
        for at, to, w in textops.steps(texts, step=STEP_BYTES):
            if self.n_rows > REMEMBERED:
                self._forget()
            n, offsets, first = to - at, w.offsets, w.first
            before = np.concatenate([[0], w.ends[:-1]]) if len(w.ends) else w.ends
            opening = first[:-1][first[:-1] < first[1:]]
            before[opening] = offsets[:-1][first[:-1] < first[1:]]
            gap = w.starts - before
            mark = w.data[np.maximum(w.starts - 1, 0)]
            kind = np.where(gap == 0, 0, np.where(mark == 0x20, 1, 2))
            right = (gap == 1) & ((mark == 0x20) | (mark == 0x0A))
            right[opening] = gap[opening] == 0
            owner = np.repeat(np.arange(n), np.diff(first))
            plain = np.full(n, self.break_id is not None)
            plain[owner[~right]] = False
            plain[np.searchsorted(offsets, odd_places(w.data), "right") - 1] = False
            last = np.zeros(n, np.int64)
            some = first[1:] > first[:-1]
            last[some] = w.ends[first[1:][some] - 1]
            plain &= np.where(some, last, offsets[:-1]) == offsets[1:]
            while True:
                used = np.flatnonzero(plain[owner])
                items, odd = self._known(w.data, w.starts[used], w.ends[used], kind[used], w.hashes[used])
                if items is not None:
                    break
                if odd is None:
                    self.break_id = None
                plain[owner[used if odd is None else used[odd]]] = False
            # The texts' items: their words, or one item that holds a whole text, and the end.
            spot = np.searchsorted(used, first[1:])
            for k in np.flatnonzero(~plain)[::-1].tolist():
                ids = self._library(w.text(k).decode())
                items = np.insert(items, spot[k], self._add(ids, np.zeros(1, np.int64), np.array([len(ids)])))
            spot = spot + (~plain).cumsum()
            items = np.insert(items, spot, 0)
            size = self.size[items]
            reach = size.cumsum()
            flat = self.ids[np.arange(int(reach[-1])) + np.repeat(self.start[items] - (reach - size), size)]
            yield flat, np.diff(reach[spot + np.arange(n)], prepend=0)


def _ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of words as numbers; shorter words are filled up with zeros."""
    size = np.minimum(ends - starts, 8)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    mask = np.uint64(2**64 - 1) >> ((8 - size) * 8).astype(np.uint64)
    return tuple(np.ascontiguousarray(eight[at]).view("<u8").ravel() & mask for at in (starts, ends - size))


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each of the words equals the one of its length that begins at the other place."""
    size = ends - starts
    reach = size.cumsum()
    along = np.arange(int(reach[-1]) if len(size) else 0) - np.repeat(reach - size, size)
    alike = data[np.repeat(starts, size) + along] == data[np.minimum(np.repeat(others, size) + along, len(data) - 1)]
    return np.bincount(np.repeat(np.arange(len(size)), size)[~alike], minlength=len(size)) == 0


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    """One encoder in a worker process: what it remembers serves the tasks that come later."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _cell(pair: np.ndarray) -> np.ndarray:
    if pair.dtype == np.uint32:
        return pair * np.uint32(0x9E3779B1) >> np.uint32(32 - CELL_BITS)
    return (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELL_BITS)).astype(np.intp)


def repair(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terminals (distinct ids), the rules (n, 2) and the final sequence, in which no pair occurs `least` times.

    Symbols stay at their places, linked to their neighbours, so that a round looks only at places where a frequent pair may have
    come up: those with a new symbol and what the round before has left. When these are exhausted, all places are looked at again.
    """
    known = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    known[ids] = True
    terminals = np.flatnonzero(known).astype(np.uint32)
    number = np.zeros(len(known), np.uint32)
    number[terminals] = np.arange(len(terminals), dtype=np.uint32)
    seq, symbols, rules = number[ids], len(terminals), []
    alive, marks = np.ones(len(seq), bool), np.zeros(1 << CELL_BITS, bool)
    want, open = 0, None
    while True:
        if open is None:
            seq = seq[alive]
            n = len(seq)
            alive = np.ones(n, bool)
            if n < 2:
                break
            after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
            at = np.arange(n - 1, dtype=np.int32)
            left, right = seq[:-1], seq[1:]
        else:
            open.sort()
            at = open[np.r_[True, open[1:] != open[:-1]]] if len(open) else open
            at = at[(at >= 0) & alive[at]]
            at = at[after[at] < n]
            left, right = seq[at], seq[after[at]]
        # Of a run of one symbol, every other pair counts, from the left.
        same, odd = np.flatnonzero(left == right), at[:0]
        if len(same) > 1:
            begin = np.maximum.accumulate(np.where(np.r_[True, after[at[same[:-1]]] != at[same[1:]]], np.arange(len(same)), 0))
            skipped = same[(np.arange(len(same)) - begin) % 2 == 1]
            if len(skipped):
                odd, counts = at[skipped], np.ones(len(at), bool)
                counts[skipped] = False
                at, left, right = at[counts], left[counts], right[counts]
        pair = left << np.uint32(16) | right if symbols <= 1 << 16 else left.astype(np.uint64) << np.uint64(32) | right
        order = np.sort(pair)
        edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1], [True]])) if len(order) else np.zeros(1, np.intp)
        count = np.diff(edge)
        top = int(count.max()) if len(count) else 0
        if open is None:
            want = max(least, top // NEAR)
        if top < want:
            if want == least:
                break
            open = None
            continue
        pick = np.flatnonzero(count >= want)
        pairs, count = order[edge[pick]], count[pick]
        marks[:] = False
        marks[_cell(pairs)] = True
        hit = np.flatnonzero(marks[_cell(pair)])
        at, pair = at[hit], pair[hit]
        which = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        right = pairs[which] == pair
        at, which = at[right], which[right]
        rank = np.empty(len(pairs), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(pairs))
        # Of places that overlap, the one of the more frequent pair is taken.
        place, near = rank[which], after[at[:-1]] == at[1:]
        taken = np.ones(len(at), bool)
        taken[1:] &= ~(near & (place[1:] > place[:-1]))
        taken[:-1] &= ~(near & (place[:-1] > place[1:]))
        made = np.bincount(which[taken], minlength=len(pairs)) >= least  # the most frequent pair loses no place, so that every round makes a rule
        taken &= made[which]
        half, chosen = np.uint64(16 if pairs.dtype == np.uint32 else 32), pairs[made].astype(np.uint64)
        rules.append(np.stack([chosen >> half, chosen & ((np.uint64(1) << half) - np.uint64(1))], 1).astype(np.uint32))
        new, rest = at[taken], at[~taken]
        seq[new] = (np.cumsum(made) - 1 + symbols).astype(np.uint32)[which[taken]]
        symbols += len(chosen)
        gone = after[new]
        alive[gone] = False
        behind = after[gone]
        after[new] = behind
        inner = behind < n
        before[behind[inner]] = new[inner]
        open = np.concatenate([before[new], new, rest, odd])
    return terminals, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), seq[alive]


def _levels(rules: np.ndarray, first: int) -> np.ndarray:
    """How deep each rule goes; it holds only symbols of lower levels."""
    level = np.zeros(first + len(rules), np.int64)
    while True:
        now = level[rules].max(1, initial=0) + 1
        if (now == level[first:]).all():
            return now
        level[first:] = now


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    size = np.ones(first + len(rules), np.int64)
    level = _levels(rules, first)
    for k in range(1, int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        size[first + own] = size[rules[own]].sum(1)
    return size[first:]


def _width(values: np.ndarray) -> int:
    return max(1, int(values.max()).bit_length()) if len(values) else 1


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Numbers under 2**width, at most 64 bits each, lowest bit first."""
    kind, size = ("<u4", 4) if width <= 32 else ("<u8", 8)
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), size)
    return np.packbits(np.unpackbits(raw, axis=1, count=width, bitorder="little").ravel(), bitorder="little").tobytes()


def unpack_bits(raw: memoryview, n: int, width: int) -> np.ndarray:
    kind, most = ("<u4", 32) if width <= 32 else ("<u8", 64)
    bits = np.zeros((n, most), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view(kind).ravel()


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, least: int = LEAST) -> bytes:
    terminals, rules, seq = repair(ids, least)
    lengths = expansion_lengths(rules, len(terminals))
    parts = [(terminals, _width(terminals)), (seq, max(1, (len(terminals) + len(rules) - 1).bit_length())), (lengths, _width(lengths)), (ends, _width(ends))]
    (_, wide), (_, symbol), (_, length), (_, end) = parts
    head = MAGIC + struct.pack(HEAD, len(doc_ids), len(terminals), len(rules), len(seq), len(ids), wide, symbol, length, end)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes()
    return head + names + pack_bits(ends, end) + pack_bits(terminals, wide) + pack_bits(rules.ravel(), symbol) + pack_bits(lengths, length) + pack_bits(seq, symbol)


class Shard:
    """A shard file's content, with random access by position of an id."""

    def __init__(self, payload: bytes):
        payload = memoryview(payload)
        if bytes(payload[:4]) != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, self.first, rules, symbols, self.n_ids, wide, symbol, length, end = struct.unpack_from(HEAD, payload, 4)
        at = 4 + struct.calcsize(HEAD)
        names, nulls = np.frombuffer(payload, "<i8", docs, at), np.frombuffer(payload, "u1", docs, at + 8 * docs)
        at += 9 * docs
        self.doc_ids = [None if z else int(d) for d, z in zip(names, nulls)]

        def take(n: int, width: int) -> np.ndarray:
            nonlocal at
            size = -(-n * width // 8)
            at += size
            return unpack_bits(payload[at - size : at], n, width)

        self.ends = take(docs, end).astype(np.int64)
        self.terminals = take(self.first, wide)
        self.rules = take(2 * rules, symbol).reshape(-1, 2)
        self.lengths = take(rules, length).astype(np.int64)
        self.seq = take(symbols, symbol)
        self._size = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        self._reach: np.ndarray | None = None
        self._expansions: tuple[np.ndarray, np.ndarray] | None = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        while (made := symbols >= self.first).any():
            out = np.empty(len(symbols) + int(made.sum()), np.uint32)
            at = np.arange(len(symbols)) + np.r_[0, made.cumsum()[:-1]]
            pair = self.rules[symbols[made] - self.first]
            out[at[~made]] = symbols[~made]
            out[at[made]], out[at[made] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return self.terminals[symbols]

    def _copied(self, symbols: np.ndarray, copies: np.ndarray, begin: np.ndarray) -> np.ndarray:
        own = self._size[symbols]
        reach = own.cumsum()
        return copies[np.arange(int(reach[-1]) if len(reach) else 0) + np.repeat(begin[symbols] - (reach - own), own)]

    def _flat(self, symbols: np.ndarray) -> np.ndarray:
        """Like _expand(), by copying from the expansions of all symbols, which are made level by level."""
        if self._expansions is None:
            level = np.concatenate([np.zeros(self.first, np.int64), _levels(self.rules, self.first)])
            order = np.argsort(level, kind="stable")
            begin = np.empty(len(level), np.int64)
            begin[order] = self._size[order].cumsum() - self._size[order]
            copies = np.empty(int(self._size.sum()), np.uint32)
            copies[: self.first] = self.terminals
            edge = np.searchsorted(level[order], np.arange(1, int(level.max(initial=0)) + 2))
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own = order[a:z]
                made = self._copied(self.rules[own - self.first].ravel(), copies, begin)
                copies[begin[own[0]] : begin[own[0]] + len(made)] = made
            self._expansions = copies, begin
        return self._copied(symbols, *self._expansions)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from start to end, expanding only the symbols that cover them."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        if start == 0 and end == self.n_ids:
            return self._flat(self.seq)
        if self._reach is None:
            self._reach = self._size[self.seq].cumsum()
        a, b = np.searchsorted(self._reach, start, "right"), np.searchsorted(self._reach, end - 1, "right") + 1
        skipped = int(self._reach[a - 1]) if a else 0
        expand = self._flat if end - start > len(self.rules) else self._expand
        return expand(self.seq[a:b])[start - skipped : end - skipped]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> str:
    """Writes shards under path: part (from 0, in ascending order of ids), nth (in its part), n_ids and payload.

    parts: range partitions; as many as the session's shuffle partitions, or more if these would hold over PART_BYTES of text each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    if parts is None:
        total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, end_id)
        held: list[np.ndarray] = []
        sizes: list[int] = []
        names: list[int | None] = []
        nth = total = part = 0

        def shard() -> pa.RecordBatch:
            nonlocal nth, total
            ids, ends = np.concatenate(held), np.cumsum(sizes)
            out = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "n_ids": [len(ids)], "payload": pa.array([pack(names, ends, ids)], pa.binary())}
            )
            held.clear(), names.clear(), sizes.clear()
            nth, total = nth + 1, 0
            return out

        for b in batches:
            if not len(b):
                continue
            part, own, at = b.column(2)[0].as_py(), b.column(0).to_pylist(), 0
            for flat, lengths in encoder.encode(b.column(1)):
                begin = done = 0
                for n in lengths.tolist():
                    names.append(own[at])
                    sizes.append(n)
                    at, done, total = at + 1, done + n, total + n
                    if total >= shard_ids:
                        held.append(flat[begin:done])
                        begin = done
                        yield shard()
                if done > begin:
                    held.append(flat[begin:done])
        if held:
            yield shard()

    dealt.mapInArrow(encode, "part int, nth int, n_ids long, payload binary").write.parquet(path)
    return path


SCHEMA = "part int, nth int, n_ids long, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files under path: doc_id, start (ids before it), n_tokens, ids_crc32."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    ahead = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per part for the first sum; as many rows as shards, without their payloads, for the second.
    bases = sums.select("part", ahead.alias("base"))
    starts = common.cut(files.select("part", "nth", within.alias("within")).join(bases, "part").select("part", "nth", (F.col("base") + F.col("within")).alias("base")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                shard = Shard(b.column(2)[k].as_buffer())
                ids = shard.ids().astype("<u4", copy=False)
                cuts = np.r_[0, shard.ends]
                sums = [zlib.crc32(ids[a:z]) for a, z in zip(cuts[:-1], cuts[1:])]
                n = len(sums)
                same = [pa.array(np.full(n, b.column(c)[k].as_py(), np.int32)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(shard.doc_ids, pa.int64()), pa.array(cuts[:-1]), pa.array(np.diff(cuts)), pa.array(sums, pa.int64())],
                    names=["part", "nth", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = files.select("part", "nth", "payload").mapInArrow(decode, "part int, nth int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(common.small(starts), ["part", "nth"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.scratch(spark, "tokens")
    write(common.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)
