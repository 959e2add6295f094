"""Quality classifier: a byte-level convolutional network in numpy.

``FILTERS`` filters of ``WIDTH`` bytes slide over the UTF-8 bytes of a text. A text is covered by chunks of ``CHUNK`` bytes
that overlap by WIDTH - 1, so every window lies in one chunk; each filter's response passes a ReLU and is max-pooled in each
chunk. The largest and the mean of the chunks' maxima are combined by a logistic layer into one probability. A filter over
one-hot bytes is a table lookup; two neighbouring tables are joined into one over byte pairs, so a response is WIDTH / 2 reads.

The network is fitted on the driver on a bounded random sample of the labelled rows that are not held out: about ``SAMPLE``
rows, none of more than ``LONGEST`` characters. Scoring reads every text whole, in stretches of bounded memory.

Defined cases: a null text is an empty one; texts shorter than a filter are padded with zero bytes; with no labelled row, or
with one label only, the score is the share of label 1 (0.5 with no row); labels that are null or of no document teach nothing.
Repeated rows get equal scores; labels, language, source and doc_id are never inputs. Further columns stay, but for one named like
the output, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

FILTERS, WIDTH, CHUNK = 24, 6, 512
SAMPLE, LONGEST = 4000, 20_000
EPOCHS, BATCH, RATE, SEED = 6, 16, 0.02, 7
THRESHOLD = 0.3
#: Positions that are convolved at once.
STRETCH = 128 * CHUNK


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.constant: float | None = None
        self.pairs: list[np.ndarray] | None = None

    def params(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.weight, self.offset]

    def joined(self) -> list[np.ndarray]:
        """For scoring: the tables of positions 2k and 2k+1 as one over byte pairs, 65,536 rows each."""
        if self.pairs is None:
            self.pairs = [(self.table[k][:, None, :] + self.table[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]
        return self.pairs

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at every window of ``data`` (at least WIDTH bytes)."""
        n = len(data) - WIDTH + 1
        pair = data[:-1].astype(np.int32) << 8 | data[1:]
        out = self.joined()[0].take(pair[:n], axis=0)
        for k in range(1, WIDTH // 2):
            out += self.joined()[k].take(pair[2 * k : 2 * k + n], axis=0)
        return out

    def pooled(self, text: str | None) -> np.ndarray:
        """Max-pooled responses of each chunk of the whole text."""
        data = as_bytes(text)
        out = []
        for k in range(0, len(data) - WIDTH + 1, STRETCH):
            r = self.responses(data[k : k + STRETCH + WIDTH - 1])
            out.append(np.maximum.reduceat(r, np.arange(0, len(r), CHUNK), axis=0))
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        m = self.pooled(text)
        return float(sigmoid(np.concatenate([m.max(axis=0), m.mean(axis=0)]) @ self.weight + self.offset[0]))

    def gradient(self, data: np.ndarray, label: int, grads: list[np.ndarray]) -> float:
        """Adds one text's gradient to ``grads``; only the windows that won a chunk take part. Returns the loss."""
        n = len(data) - WIDTH + 1
        r = self.table[0].take(data[:n], axis=0)
        for k in range(1, WIDTH):
            r += self.table[k].take(data[k : k + n], axis=0)
        starts = np.arange(0, n, CHUNK)
        at = np.stack([s + r[s : s + CHUNK].argmax(axis=0) for s in starts])
        z = np.take_along_axis(r, at, axis=0) + self.bias
        m = np.maximum(z, 0)
        top = m.argmax(axis=0)
        f = np.concatenate([m.max(axis=0), m.mean(axis=0)])
        p = float(sigmoid(f @ self.weight + self.offset[0]))
        d = p - label
        back = np.tile(self.weight[FILTERS:] * d / len(m), (len(m), 1))
        back[top, np.arange(FILTERS)] += self.weight[:FILTERS] * d
        back *= z > 0
        each = np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(WIDTH):
            np.add.at(grads[0][k], (data[at + k], each), back)
        grads[1] += back.sum(axis=0)
        grads[2] += f * d
        grads[3] += d
        return -np.log(max(1e-7, p if label else 1 - p))


def as_bytes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return data if len(data) >= WIDTH else np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted by Adam on whole texts."""
    net = Network(seed)
    if len(set(labels)) < 2:
        net.constant = float(np.mean(labels)) if labels else 0.5
        return net
    data, rng = [as_bytes(t) for t in texts], np.random.default_rng(seed)
    first, second = ([np.zeros(p.shape) for p in net.params()] for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), BATCH):
            grads = [np.zeros(p.shape, np.float32) for p in net.params()]
            part = order[k : k + BATCH]
            for x in part:
                net.gradient(data[x], labels[x], grads)
            step += 1
            for p, g, a, b in zip(net.params(), grads, first, second, strict=True):
                g = g / len(part)
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p -= (RATE * (1 - epoch / epochs) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Network:
    """A network for ``target`` from about ``sample`` labelled rows of ``docs`` that are not held out, at random by doc_id.

    A document with several labels counts once, with its largest, and so does one of several rows, with the text that sorts first.
    The sample's rows are chosen by a 64-bit hash before the join, so that only about ``sample`` texts reach the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
    n = known.count()
    if n > sample:
        known = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 1) < F.lit((sample << 63) // n))
    # at most about ``sample`` rows of two numbers
    rows = docs.where(F.length("text") <= LONGEST).select("doc_id", "text").join(F.broadcast(known), "doc_id")
    got = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("doc_id").collect()
    return train([r["text"] for r in got], [int(r["label"] > 0) for r in got])


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability of label 1."""
    net.pairs = None

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([net.score(t) for t in s], index=s.index, dtype=float)

    return docs.withColumn(out, F.pandas_udf(run, "double")(F.coalesce(F.col(text), F.lit(""))))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
