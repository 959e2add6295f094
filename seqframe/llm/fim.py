"""Fill-in-middle transformation with a learned rank index over the boundaries of code points.

A text is UTF-8; where its code points begin rises almost linearly with their number. Straight segments are fitted to all
boundary offsets (a cone of slopes that keeps every offset within ``BOUND``, narrowed until it is empty), and what is left of
each offset is stored in a byte. A cut at a code point is predicted from its segment and set right by the stored rest, so it is
exact for any text, and the text is cut as bytes.

A document's draws are the groups of eight digits of the hex SHA-256 of ``salt``, a colon and its id. The text keeps its form
(``plain``) if it is empty or holds a sentinel, or if h3 % 100 >= ``rate``; otherwise it is ``spm`` if h4 % 100 < ``spm``, else
``psm``. Rows are transformed where they lie, without a shuffle; memory follows the longest text of a batch.

Defined cases: a null text is an empty one; a text that is empty, holds a sentinel, or has a null id is plain; a prefix, middle
or suffix may be empty. Repeated rows get equal results; texts of any length are worked on whole. Further columns stay, but for
those named like an output, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM = 90, 20
#: An offset lies at most this far, in bytes, from its segment (before rounding).
BOUND = 30
#: Offsets that a segment's cone is narrowed by at once: at first, and at most.
STEP, STEPS = 512, 1 << 16


class RankIndex:
    """Number of a code point -> byte where it begins; the number of code points -> length in bytes."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        offsets = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        self.n = len(offsets) - 1
        self.starts, self.bases, self.slopes = _segments(offsets)
        self.rest = (offsets - self._predicted(np.arange(len(offsets)))).astype(np.int8)

    def _predicted(self, k: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.starts, k, "right") - 1
        return self.bases[s] + np.rint(self.slopes[s] * (k - self.starts[s])).astype(np.int64)

    def offsets(self, cuts: list[int]) -> list[int]:
        """The bytes where these code points begin."""
        k = np.array(cuts)
        return (self._predicted(k) + self.rest[k]).tolist()


def _segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First code point, its offset and the slope of each segment."""
    starts, slopes, at = [], [], 0
    while at < len(offsets):
        low, high, k, step = -np.inf, np.inf, 1, STEP
        while at + k < len(offsets):
            y = offsets[at + k : at + k + step] - offsets[at]
            x = np.arange(k, k + len(y))
            lows = np.maximum(np.maximum.accumulate((y - BOUND) / x), low)
            highs = np.minimum(np.minimum.accumulate((y + BOUND) / x), high)
            held = int(np.searchsorted(lows > highs, True))  # the cone is empty from the first that does not fit
            if held:
                low, high = lows[held - 1], highs[held - 1]
                k += held
            if held < len(y):
                break
            step = min(2 * step, STEPS)
        starts.append(at)
        slopes.append((low + high) / 2 if k > 1 else 0.0)
        at += k
    starts = np.array(starts)
    return starts, offsets[starts], np.array(slopes)


def transformed(text: bytes, key: str | None, salt: str = "1", rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and the output, in UTF-8, of one text."""
    index = RankIndex(text)
    n, sentinels = index.n, [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    if key is None or not text or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    digits = sha256(f"{salt}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    if h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index.offsets([first, second])
    prefix, middle, suffix = sentinels[0] + text[:a], sentinels[2] + text[a:b], sentinels[1] + text[b:]
    if h4 % 100 < spm:
        return n, "spm", first, second - first, suffix + prefix + middle
    return n, "psm", first, second - first, prefix + suffix + middle


OUTPUTS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salt: str = "1", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with n (code points), form, prefix_chars and middle_chars (null if plain) and output, the transformed text."""
    key, names = unused(docs, "_key"), [f.name for f in OUTPUTS]
    rows = docs.select("*", F.col(id_col).cast("string").alias(key), F.coalesce(F.col(text), F.lit("")).alias(key + "t"))
    kept = [c for c in docs.columns if c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary())
            found = [transformed(t.as_py(), k.as_py(), salt, rate, spm) for k, t in zip(b.column(b.num_columns - 2), texts)]
            n, form, first, middle, output = zip(*found) if found else ((),) * 5
            new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k, c in enumerate(b.schema.names) if c in kept), *new], names=[*kept, *names])

    return rows.select(*kept, key, key + "t").mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + OUTPUTS))


def restore(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone: no sentinel overlaps itself or is in a text that has been cut."""
    before = lambda of, sign: F.split_part(of, F.lit(sign), F.lit(1))
    after = lambda of, sign: F.split_part(of, F.lit(sign), F.lit(2))
    bare = lambda of: F.substring(of, 4, 2**31 - 1)
    of_psm = F.concat(bare(before(output, SUFFIX)), after(after(output, SUFFIX), MIDDLE), before(after(output, SUFFIX), MIDDLE))
    of_spm = F.concat(before(after(output, PREFIX), MIDDLE), after(after(output, PREFIX), MIDDLE), bare(before(output, PREFIX)))
    return F.when(form == "psm", of_psm).when(form == "spm", of_spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text restored from it."""
    back = restore(F.col("output"), F.col("form"))
    return transform(docs.select("doc_id", "text")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
