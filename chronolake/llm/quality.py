"""Quality classifier: a byte-level convolutional network in numpy.

The whole document, as UTF-8 bytes, is cut into overlapping chunks; the overlap is the filter width less one, so that every
window of the document lies in exactly one chunk. Learned filters run over each chunk and are max-pooled
there; a document's features are the largest and the mean chunk value of every filter, over all its chunks. A hidden layer combines
them into one probability.

A filter of width k over one-hot bytes is k look-up tables of 256 values, so that the convolution is k gathers and
additions. Training is plain Adam on the logistic loss over labelled documents, of which every chunk is read, as in scoring: at most
`most_rows` documents, in the order of a hash of the id, that have at most `most_bytes` of text together; a document that does not fit
any more is passed over (documented bounds). Rows whose crc32 of the id divides by 5 are never learned from.

Cases: null and empty texts are one chunk of padding and get a score like any other; texts of any length are read in
blocks of bounded memory; without labels of both classes the score is the labels' mean, or 0.5 without any. Repeated rows
get equal scores; empty tables give no rows. Labels without a document and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import common
from chronolake.llm.training import labelled_sample

WIDTH, FILTERS, CHUNK, HIDDEN = 6, 16, 128, 16
#: Chunks that are convolved at once.
BLOCK = 256


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK + WIDTH - 1) bytes; zeros stand after the end."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(raw) // CHUNK))
    padded = np.zeros(n * CHUNK + WIDTH - 1, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[::CHUNK]


class ByteNet:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.w1 = rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)
        self.constant: float | None = None

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.tables, self.w1, self.b1, self.w2, self.b2]

    def pooled(self, c: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest value of each filter in each chunk, at least 0, and where it stands."""
        out = np.empty((len(c), FILTERS), np.float32)
        at = np.empty((len(c), FILTERS), np.int64) if where else None
        for k in range(0, len(c), BLOCK):
            part = c[k : k + BLOCK]
            z = self.tables[0][part[:, :CHUNK]]
            for j in range(1, WIDTH):
                z += self.tables[j][part[:, j : j + CHUNK]]
            if where:
                at[k : k + BLOCK] = z.argmax(1)
            out[k : k + BLOCK] = z.max(1)
        return np.maximum(out, 0), at

    def features(self, c: np.ndarray) -> np.ndarray:
        """The largest and the mean chunk value of each filter, over all chunks."""
        pooled = self.pooled(c)[0]
        return np.concatenate([pooled.max(0), pooled.mean(0)])

    def _head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w1 + self.b1)
        return h, 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2[0], -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        rows = [self.features(chunks(t)) for t in texts]
        return self._head(np.stack(rows))[1].astype(float) if rows else np.zeros(0)

    def gradients(self, all_chunks: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean logistic loss of some documents, one for each of the weights."""
        c, counts = np.concatenate(all_chunks), np.array([len(x) for x in all_chunks])
        starts = np.concatenate([[0], counts.cumsum()[:-1]])
        pooled, at = self.pooled(c, where=True)
        top = np.maximum.reduceat(pooled, starts)
        x = np.concatenate([top, np.add.reduceat(pooled, starts) / counts[:, None].astype(np.float32)], 1)
        h, p = self._head(x)
        d = ((p - y) / len(y)).astype(np.float32)
        dh = d[:, None] * self.w2 * (1 - h * h)
        dx = dh @ self.w1.T
        doc = np.repeat(np.arange(len(y)), counts)
        largest = pooled == top[doc]
        dm = dx[doc, FILTERS:] / counts[doc, None] + dx[doc, :FILTERS] * largest / np.add.reduceat(largest, starts, dtype=np.float32)[doc]
        dm *= pooled > 0
        g = np.zeros_like(self.tables)
        f, rows = np.broadcast_to(np.arange(FILTERS), at.shape), np.arange(len(c))[:, None]
        for j in range(WIDTH):
            np.add.at(g[j], (c[rows, at + j], f), dm)
        return [g, x.T @ dh, dh.sum(0), h.T @ d, d.sum(keepdims=True)]

    def fit(self, all_chunks: list[np.ndarray], y: np.ndarray, epochs: int, rate: float = 0.004, batch: int = 64, seed: int = 7) -> ByteNet:
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                step += 1
                for w, gw, m, v in zip(self.weights, self.gradients([all_chunks[i] for i in own], y[own]), first, second):
                    m += 0.1 * (gw - m)
                    v += 0.001 * (gw * gw - v)
                    w -= (rate * (0.3 if epoch > 0.6 * epochs else 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 4_000, most_bytes: int = 64 << 20, epochs: int = 14) -> ByteNet:
    """Learns from whole texts of at most most_rows labelled documents and most_bytes together, which come to the driver."""
    sample = labelled_sample(labels, "quality", most_rows)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id")
    sized = common.cut(rows.select("doc_id", "y", "text", F.xxhash64("doc_id").alias("at"), F.xxhash64("text").alias("th"), F.octet_length("text").alias("size")))
    room, chosen = most_bytes, []
    for r in sorted(sized.select("at", "doc_id", "th", "size").collect()):  # rows that repeat an id and its text count once
        if r["size"] <= room and tuple(r) not in chosen[-1:]:
            room -= r["size"]
            chosen.append(tuple(r))
    picked = docs.sparkSession.createDataFrame(chosen, "at long, doc_id long, th long, size int").select("doc_id", "th")
    got = sized.join(F.broadcast(picked), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).orderBy("at", "doc_id", "th").select("y", "text").collect()
    return ByteNet().fit([chunks(r["text"]) for r in got], np.array([r["y"] for r in got], np.float32), epochs)


def score(docs: DataFrame, model: ByteNet, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores (double, 0 to 1)."""
    return common.with_score(docs, text_col, name, lambda texts: model.score(texts.to_pylist()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, common.labels(spark, sf_dir))
    return score(docs, model).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
