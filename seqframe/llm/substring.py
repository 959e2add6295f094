"""Exact removal of long repeated passages, found by difference-cover anchors.

A window is ``LENGTH`` consecutive words of one document. ``COVER`` is a difference cover modulo ``PERIOD``: whatever two
positions are compared, some shift below PERIOD takes both to positions whose remainders lie in COVER. So two equal windows
share an equal anchor, a run of LENGTH - PERIOD + 1 words that starts at a cover position in both, and only the windows at
cover positions (5 of 21) are hashed and dealt over the cluster. Where an anchor occurs again, it is extended: the windows
that hold it are compared whole, by 96 bits of two independent rolling hashes.

No pairs are made. A task first marks the anchors (or windows) that occur again within what it holds, and only one of each
goes on, marked or not; so a passage that a third of the documents share sends at most one row from each block of a task
to the place where its occurrences meet, and every other row is already known to be repeated.

A row is named by its doc_id where these are unique, else by a running number in a written copy of the rows. Texts are shuffled
once, by that name. Defined cases: null and empty texts have no words; documents shorter than a window lose nothing; copies and
repeated rows of LENGTH words or more lose everything; a null doc_id is kept; an empty table gives no rows. Words are taken
unchanged; texts are read whole, and a task holds some numbers for each word of the one it works on. Only doc_id and text are read,
whatever else there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

LENGTH = 35
#: A perfect difference set modulo 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Odd multipliers of the two rolling hashes and their seeds.
BASES, SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (1, 2)
#: Rows that a task gathers before it marks repeats among them.
GATHER = 1 << 20
MEMO_SIZE = 300_000
ROW_SCHEMA = "g long, g2 int, rid long, pos int, known boolean"


class Words(dict):
    """Hash of a word, remembered while there is room."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w, self.seed)
        if len(self) < MEMO_SIZE:
            self[w] = h
        return h


class Rolling:
    """Hashes of runs of words: differences of prefix sums of a polynomial, taken back to exponent 0 and mixed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.cumprod(np.array([1] + [b] * (size - 1), np.uint64), dtype=np.uint64) for b in (self.base, self.inverse))

    def runs(self, words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        self._powers(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=sums[1:])
        return mix((sums[starts + length] - sums[starts]) * self.down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Gatherer:
    """Rows (hash, second hash, document, position); repeats among those held are marked, and one of each stays to meet others.

    Marked rows get a group of their own, so that in the shuffle only unmarked ones and one of each marked kind meet.
    """

    def __init__(self):
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, h: np.ndarray, h2: np.ndarray, rid: int, pos: np.ndarray) -> None:
        if len(h):
            self.parts.append((h, h2.astype(np.uint32), np.full(len(h), rid, np.int64), pos.astype(np.int32)))
            self.n += len(h)

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        h, h2, rid, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = np.lexsort((h2, h))
        h, h2, rid, pos = h[order], h2[order], rid[order], pos[order]
        same = (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])
        later = np.concatenate([[False], same])
        known = later | np.concatenate([same, [False]])
        own = mix(rid.view(np.uint64) * np.uint64(BASES[0]) + pos.astype(np.uint64))
        g, g2 = np.where(later, own, h).view(np.int64), np.where(later, np.uint32(0), h2).view(np.int32)
        for k in range(0, len(g), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(g[s]), pa.array(g2[s]), pa.array(rid[s]), pa.array(pos[s]), pa.array(known[s])], names=["g", "g2", "rid", "pos", "known"])


def _gathered(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]):
    """A mapInArrow function of one that yields (hash, second hash, rid, positions) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gatherer()
        for row in rows(batches):
            held.add(*row)
            if held.n >= GATHER:
                yield from held.out()
        yield from held.out()

    return run


def _anchors(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    size = length - PERIOD + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memo, rolling = Words(SEEDS[0]), Rolling(BASES[0])
        for b in batches:
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text"), strict=True):
                words = split(text.as_py())
                if len(words) < length:
                    continue
                h = np.array([memo[w] for w in words], np.uint64)
                last = len(words) - size
                starts = np.concatenate([np.arange(c, last + 1, PERIOD) for c in COVER])
                got = rolling.runs(h, starts, size)
                yield got, np.zeros(len(got), np.uint64), rid, starts

    return rows


def _windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    size = length - PERIOD + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memos, rolls = [Words(s) for s in SEEDS], [Rolling(b) for b in BASES]
        for b in batches:
            for rid, text, at in zip(b.column("rid").to_pylist(), b.column("text"), b.column("at"), strict=True):
                if not at.is_valid:
                    continue
                words = split(text.as_py())
                starts = np.asarray(at.values.to_numpy(zero_copy_only=False), np.int64)
                # a window holds an anchor if it starts up to length - size words before it
                mark = np.zeros(len(words) + 2, np.int64)
                np.add.at(mark, np.maximum(starts - (length - size), 0), 1)
                np.add.at(mark, starts + 1, -1)
                pos = np.flatnonzero(np.cumsum(mark)[: max(0, len(words) - length + 1)] > 0)
                if len(pos):
                    h, h2 = (r.runs(np.array([m[w] for w in words], np.uint64), pos, length) for m, r in zip(memos, rolls, strict=True))
                    yield h, h2, rid, pos

    return rows


def _meet(rows: DataFrame) -> DataFrame:
    """rid, at: positions of each document that are known to be repeated or whose group has several rows.

    A group has at most one row from each block of each task.
    """
    n = F.count("*").over(W.partitionBy("g", "g2"))
    return rows.withColumn("n", n).where(F.col("known") | (F.col("n") > 1)).groupBy("rid").agg(F.collect_list("pos").alias("at"))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, rid, text; rid is doc_id itself where it names every row, and then no further column."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, some, distinct = rows.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == some == distinct:
        return rows.select(F.col("doc_id").alias("rid"), "text")
    return cut(rows.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text"), "substring-named")


def _flagged(named: DataFrame, length: int) -> DataFrame:
    """``named`` with ``at``: the starts of every window of ``length`` words whose word sequence also starts anywhere else.

    Both joins deal texts out by rid in the same way, so Spark does it once and reads it twice; rows without an anchor leave
    in the task that would cut them into windows, as a filter would make the two differ.
    """
    if length < PERIOD + 4:
        raise ValueError(f"windows of at least {PERIOD + 4} words are needed")
    anchors = cut(_meet(named.select("rid", "text").mapInArrow(_gathered(_anchors(length)), ROW_SCHEMA)), "substring-anchors")
    windows = _meet(named.join(anchors, "rid", "left").mapInArrow(_gathered(_windows(length)), ROW_SCHEMA))
    return named.join(windows, "rid", "left")


def kept_words(words: list[bytes], at: np.ndarray, length: int = LENGTH) -> list[bytes]:
    """The words that no window starting at ``at`` covers."""
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, np.minimum(at + length, len(words)), -1)
    gone = np.cumsum(mark)[: len(words)] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def remove(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by one space)."""
    flagged = _flagged(_named(docs), length)
    key = "doc_id" if "doc_id" in flagged.columns else "rid"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digest, kept_text = [], [], [], []
            for text, at in zip(b.column("text"), b.column("at"), strict=True):
                words = split(text.as_py())
                kept = words
                if at.is_valid and len(at):
                    kept = kept_words(words, np.asarray(at.values.to_numpy(zero_copy_only=False), np.int64), length)
                joined = b" ".join(kept)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(sha256(joined).hexdigest())
                kept_text.append(joined.decode("utf-8", "surrogatepass") if texts else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return flagged.select(F.col(key).alias("doc_id"), "text", "at").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
