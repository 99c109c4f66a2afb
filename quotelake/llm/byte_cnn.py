"""A byte-level convolutional network for text quality, in numpy.

Filters of a few bytes slide over the whole document. The document is cut into
chunks that overlap by a filter's length less one, so that no window is missed; each
filter's maximum in a chunk counts. Mean, maximum and minimum of these over the
chunks go through one hidden layer into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 6  # bytes of a filter
FILTERS = 16
HIDDEN = 16
STRIDE = 250  # bytes from one chunk to the next
BLOCK = 200 * STRIDE  # positions evaluated at once
SAMPLE = 3000  # labelled documents to learn from
SAMPLE_BYTES = 1 << 18  # of a text that is learned from
EPOCHS = 6
BATCH = 32
RATE = 0.01
THRESHOLD = 0.3


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first chunk of each text): every text starts after WIDTH - 1 zeros at a multiple of STRIDE.

    So the windows that run over the end of a text meet zeros only.
    """
    chunks = np.array([(WIDTH - 1 + len(t)) // STRIDE + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(chunks)])
    buffer = np.zeros(starts[-1] * STRIDE + WIDTH - 1, np.uint8)
    for t, s in zip(texts, starts[:-1].tolist()):
        buffer[s * STRIDE + WIDTH - 1:s * STRIDE + WIDTH - 1 + len(t)] = np.frombuffer(t, np.uint8)
    return buffer, starts


def pooled(chunks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean, maximum and minimum over the chunks of each text."""
    at = starts[:-1]
    return np.hstack([np.add.reduceat(chunks, at) / np.diff(starts)[:, None], np.maximum.reduceat(chunks, at),
                      np.minimum.reduceat(chunks, at)])


class ByteCnn:
    """Parameters, learning and scoring."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, 0.2, (3 * FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 0.2, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.pairs = None

    def _head(self, features):
        hidden = np.maximum(features @ self.p["w1"] + self.p["b1"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.p["w2"] + self.p["b2"], -30, 30)))

    def chunk_maxima(self, buffer: np.ndarray, n_chunks: int, where: bool = False):
        """Each filter's maximum in each chunk after ReLU, and with `where` its position."""
        if self.pairs is None:  # two bytes at a time: fewer look-ups
            t = self.p["filters"]
            self.pairs = [(t[j][:, None] + t[j + 1][None]).reshape(-1, FILTERS) for j in range(0, WIDTH, 2)]
        out = np.empty((n_chunks, FILTERS), np.float32)
        at = np.empty((n_chunks, FILTERS), np.int64) if where else None
        for a in range(0, n_chunks * STRIDE, BLOCK):
            b = min(a + BLOCK, n_chunks * STRIDE)
            near = buffer[a:b + WIDTH].astype(np.int32)
            codes = near[:-1] * 256 + near[1:]
            conv = self.pairs[0].take(codes[:b - a], 0)
            for k in range(1, len(self.pairs)):
                conv += self.pairs[k].take(codes[2 * k:b - a + 2 * k], 0)
            conv = conv.reshape(-1, STRIDE, FILTERS)
            out[a // STRIDE:b // STRIDE] = conv.max(1)
            if where:
                at[a // STRIDE:b // STRIDE] = conv.argmax(1)
        out += self.p["bias"]
        return np.maximum(out, 0, out=out), at

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities that texts are good. Whole texts, long ones block by block."""
        if not texts:
            return np.zeros(0)
        buffer, starts = layout(texts)
        chunks, _ = self.chunk_maxima(buffer, int(starts[-1]))
        return self._head(pooled(chunks, starts))[1].astype(np.float64)

    def _gradients(self, texts, labels):
        buffer, starts = layout(texts)
        n = int(starts[-1])
        chunks, at = self.chunk_maxima(buffer, n, True)
        features = pooled(chunks, starts)
        hidden, out = self._head(features)
        g = {}
        d_out = ((out - labels) / len(labels)).astype(np.float32)
        g["w2"], g["b2"] = hidden.T @ d_out, d_out.sum(keepdims=True)
        d_hidden = np.outer(d_out, self.p["w2"]) * (hidden > 0)
        g["w1"], g["b1"] = features.T @ d_hidden, d_hidden.sum(0)
        mean, top, low = np.hsplit(d_hidden @ self.p["w1"].T, 3)
        text = np.repeat(np.arange(len(texts)), np.diff(starts))
        d_chunk = mean[text] / np.diff(starts)[text][:, None]
        for part, grad in ((features[:, FILTERS:2 * FILTERS], top), (features[:, 2 * FILTERS:], low)):
            hit = chunks == part[text]
            d_chunk += grad[text] * hit / np.add.reduceat(hit, starts[:-1])[text]
        d_chunk *= chunks > 0
        g["bias"] = d_chunk.sum(0)
        where = at + (np.arange(n) * STRIDE)[:, None]
        column = np.broadcast_to(np.arange(FILTERS), where.shape)
        g["filters"] = np.stack([np.bincount(
            (buffer[where + j].astype(np.int64) * FILTERS + column).ravel(), d_chunk.ravel(), 256 * FILTERS)
            .reshape(256, FILTERS) for j in range(WIDTH)])
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> ByteCnn:
        """Adam on the logistic loss. With no texts the scores stay near one half; with one label they tend to it."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                rows, step = order[i:i + BATCH], step + 1
                for k, g in self._gradients([texts[r] for r in rows], labels[rows]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= (RATE * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-6)).astype(np.float32)
                self.pairs = None
        return self


def held_out(doc_id):
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> ByteCnn:
    """A network learned from at most `sample` labelled rows outside the held-out fold.

    The rows with the smallest hashes of their ids, so the choice depends neither on order nor
    on partitions, and their whole texts. Contradictory labels of an id count as 1; of several texts of an id the one with the
    smallest hash is taken; a text of more than `most` bytes is not learned from. So the driver holds `sample` * `most`
    bytes at most. Nulls among ids or labels are no labels; a null text is empty.
    """
    chosen = (labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_label"))
              .where(F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
              .groupBy("_id").agg(F.max("_label").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
                        ).where(F.octet_length("_text") <= most)
    # the chosen ids are at most `sample` rows, so they go to the texts
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(
        F.first("_label").alias("_label"), F.min_by("_text", F.xxhash64("_text")).alias("_text")).toArrow().sort_by("_id")
    text = [t.encode() for t in rows["_text"].to_pylist()]
    return ByteCnn().fit(text, rows["_label"].to_numpy().astype(np.float32))


def score_quality(docs: DataFrame, model: ByteCnn, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Whole texts; no other column is an input.

    A null text counts as empty and gets the score of an empty text; repeated rows are scored each, an
    empty table gives no rows. One pass, no shuffle; the parameters travel with the task.
    """

    def score(batches):
        for batch in batches:
            text = [(t or "").encode() for t in batch.column(2).to_pylist()]
            parts, start, size = [], 0, 0
            for i, t in enumerate(text):
                size += len(t)
                if size > 4_000_000 or i == len(text) - 1:
                    parts.append(model.score(text[start:i + 1]))
                    start, size = i + 1, 0
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    ids = F.col(id_col).cast("bigint")
    texts = docs.select(ids.alias("doc_id"), held_out(ids).alias("held_out"), F.col(text_col).alias("text"))
    return texts.mapInArrow(score, "doc_id BIGINT, held_out BOOLEAN, score DOUBLE, predicted INT")
