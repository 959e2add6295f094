"""Where elements lie in their sequences: an index of seeds, and verification in the chunk.

A seed is a minimizer: of each window of neighbouring k-mers the one with the least hash, the leftmost of equals. What a window
selects depends on its letters alone, so an element that occurs in a sequence has the seeds of its windows there too. Of an
element's seeds the rarest in its sequence is looked up; each place that it has gives one place where the element may begin, and
only there the letters are compared. Work follows the letters and the elements, not their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from .intervals import chunks

#: Elements of a class have at least so many letters: a power of two up to this. Their k-mers have half as many, up to ``LONGEST_SEED``.
LONGEST_CLASS, LONGEST_SEED = 256, 24
#: Odd factors of a hash of 64 bits.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SEEDS = "seqname string, class int, code long, at long"
KEY = ["seqname", "seq"]


def seeds_of(text: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places (from 0) of the seeds of all windows of ``least`` letters; none if the text is shorter."""
    k = max(1, min(least // 2, LONGEST_SEED))
    window, n = least - k + 1, len(text) - k + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for j in range(k):
        code = code * STEP + letters[j : j + n]
    code = (code ^ (code >> np.uint64(31))) * MIX
    code ^= code >> np.uint64(29)
    value, place, span = code, np.arange(n), 1
    while span < window:
        s = min(span, window - span)
        right = value[s:] < value[:-s]
        value, place = np.where(right, value[s:], value[:-s]), np.where(right, place[s:], place[:-s])
        span += s
    place = np.unique(place)
    return code[place].view(np.int64), place


def _class(length: Column) -> Column:
    """The greatest power of two that is no greater than ``length`` and ``LONGEST_CLASS``."""
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.least(length, F.lit(LONGEST_CLASS)))) - 1)


def _seeds(rows: DataFrame, classes: list[int] | None = None) -> DataFrame:
    """SEEDS, and seq for elements: of rows (seqname, text, begin) for all ``classes``; of rows (seqname, text, class) for their own."""
    own = classes is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text, third in zip(*(b.column(k).to_pylist() for k in range(3))):
                for c in [third] if own else classes:
                    code, at = seeds_of(text, c)
                    n = len(code)
                    cols = [pa.array([name] * n, pa.string()), pa.array([c] * n, pa.int32()), pa.array(code, pa.int64()), pa.array(at + (0 if own else third), pa.int64())]
                    names = ["seqname", "class", "code", "at"]
                    if own:
                        cols, names = [*cols, pa.array([text] * n, pa.string())], [*names, "seq"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, SEEDS + ", seq string" * own)


def first_places(elements: DataFrame, seqs: DataFrame, size: int = 1 << 20, longest: int = 1 << 16) -> DataFrame:
    """seqname, seq, start: of distinct elements (seqname, seq) whose sequence is there, the first place, from 1, or 0.

    ``seqs`` are whole (seq_id, seq) or in pieces (seq_id, chunk_start, chunk). Elements have at most ``longest`` letters. An empty
    element is at place 1.
    """
    scanned = chunks(seqs, size, LONGEST_CLASS - 1).select(F.col("seq_id").alias("seqname"), "chunk", F.col("chunk_start").cast("long").alias("begin"))
    names = scanned.where("begin = 1").select("seqname").distinct()
    wanted = elements.select(*KEY).where("seq is not null").distinct().join(names, "seqname", "left_semi").withColumn("class", _class(F.length("seq")))
    # few bytes, but much work: dealt out
    wanted = settled(wanted.repartition(2 * seqs.sparkSession.sparkContext.defaultParallelism, *KEY))
    classes = sorted(r["class"] for r in wanted.where("seq <> ''").select("class").distinct().collect())
    index = _seeds(wanted.where("seq <> ''").select("seqname", "seq", "class"))
    of = ["seqname", "class", "code"]
    # only seeds that some element has are kept
    places = settled(_seeds(scanned, classes).join(index.select(*of).distinct(), of, "left_semi"))
    often = places.groupBy(*of).agg(F.count("*").alias("n"))
    # an element all of whose windows have a seed there may be there; a seed that is not there tells that it is not
    ranked = index.join(often, of, "left").groupBy(*KEY).agg(F.min_by(F.struct("class", "code", "at", F.coalesce("n", F.lit(0)).alias("n")), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("x"))
    chosen = ranked.where("x.n > 0").select(*KEY, "x.class", "x.code", F.col("x.at").alias("within"))
    found = chosen.join(places, of).select(*KEY, (F.col("at") - F.col("within")).alias("start")).where("start >= 1").distinct()
    found = found.withColumn("chunk_no", F.floor((F.col("start") - 1) / size))
    texts = chunks(seqs, size, longest).select(F.col("seq_id").alias("seqname"), F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_start", "chunk")
    here = F.substr("chunk", (F.col("start") - F.col("chunk_start") + 1).cast("int"), F.length("seq")) == F.col("seq")
    first = found.join(texts, ["seqname", "chunk_no"]).where(here).groupBy(*KEY).agg(F.min("start").alias("start"))
    return wanted.select(*KEY).join(first, KEY, "left").select(*KEY, F.when(F.col("seq") == "", F.lit(1)).otherwise(F.coalesce("start", F.lit(0))).cast("long").alias("start"))
