"""Phrase collocation mining: FM-indexes over word ids, extended word by word in both directions.

Texts, A-Z lower-cased, are cut into pieces and words. A task joins the words of a language's texts, as ids with separators
between pieces, until a shard of about ``SHARD`` symbols is full, and writes its FM-index: the Burrows-Wheeler transforms of
the shard read forwards and backwards, sorted by the first ``longest`` symbols only, which is as deep as any interval here. An
n-gram is an interval of equal size in each of the two. The rows of its interval in the transform of the text read backwards
hold the words that follow it; grouped by word they give all right extensions with their counts, and the intervals of the longer
n-grams in both indexes, by ranks and by the words before. Left extensions are the same with the two indexes' parts exchanged.

Length grows by one in each round. Counts are summed across shards; a phrase of ``least`` occurrences or more gets an id, and
only its intervals go back to their shards to be extended, to the right and to the left in turn. A longer phrase is emitted only
where its first and its last words are such phrases too, so what is shuffled is a row for each shard and frequent pair of parts. No text and no count
of single occurrences passes through one task or the driver; a hot word or phrase is one row for each shard.

Defined cases: a null text is an empty one; a null language is ``und``; doc_id plays no part, so repeated rows count as often as
they stand; pieces of any length are never cut. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Symbols of a shard: words and separators. A task holds at most four times as many, of all its languages, and one text.
SHARD = 1 << 21
#: Bytes that end a piece, and the tab, which parts words as a space does.
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b"."
TABLE = bytes.maketrans(ENDS + b"\t", MARK * len(ENDS) + b" ")
INDEX = "shard long, lang string, words array<string>, starts array<int>, sizes array<int>, forwards binary, backwards binary"
#: An n-gram's intervals in a shard, of ``size`` rows from ``forth`` in the forward index and from ``back`` in the other.
SPAN = ["shard", "forth", "back", "size"]


class Shard:
    """The words of one language that a task has gathered."""

    def __init__(self):
        self.ids: dict[bytes, int] = defaultdict(count(1).__next__, {MARK: 0})
        self.parts, self.size = [np.zeros(1, np.int32)], 1

    def add(self, text: bytes) -> None:
        words = text.lower().translate(TABLE).replace(MARK, b" . ").split()
        part = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        self.parts += [part, np.zeros(1, np.int32)]
        self.size += len(part) + 1

    def index(self, longest: int) -> dict:
        """Words by id, starts and sizes of their intervals, and the two transforms."""
        text = np.concatenate(self.parts)
        text = text[np.append(True, (text[1:] != 0) | (text[:-1] != 0))]
        sizes = np.bincount(text, minlength=len(self.ids))
        forth, back = _sorted(text, longest, -1), _sorted(text, longest, 1)
        pack = lambda x: zstandard.ZstdCompressor(level=1).compress(x.astype(np.int32).tobytes())
        return {"words": list(self.ids)[1:], "starts": (np.cumsum(sizes) - sizes)[1:], "sizes": sizes[1:], "forwards": pack(text[forth - 1]), "backwards": pack(text[(back + 1) % len(text)])}


def _sorted(text: np.ndarray, depth: int, step: int) -> np.ndarray:
    """Positions in the order of the ``depth`` symbols that begin there: to the right if ``step`` is -1, else to the left."""
    key, bound = text.astype(np.int64), int(text.max()) + 1
    width = bound
    for k in range(1, depth):
        if bound > (1 << 63) // width:
            seen, key = np.unique(key, return_inverse=True)
            bound = len(seen)
        key = key * width + np.roll(text, step * k)
        bound *= width
    return np.argsort(key, kind="stable")


def index(docs: DataFrame, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """The table of FM-indexes, one row for each shard, written to the shared folder."""
    shard_size = SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, number = {}, count(TaskContext.get().partitionId() << 32)

        def closed(name: str) -> pa.RecordBatch:
            x = open_.pop(name).index(longest)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), kind)
            words = pa.array(x["words"], pa.binary()).view(pa.string())
            lists = [one(x[c], pa.array(x[c], pa.int32())) for c in ("starts", "sizes")]
            cols = [pa.array([next(number)], pa.int64()), pa.array([name]), one(x["words"], words), *lists, pa.array([x["forwards"]]), pa.array([x["backwards"]])]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "lang", "words", "starts", "sizes", "forwards", "backwards"])

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                shard = open_.setdefault(name, Shard())
                shard.add(t.as_py())
                if shard.size >= shard_size:
                    yield closed(name)
                elif sum(s.size for s in open_.values()) >= 4 * shard_size:
                    yield closed(max(open_, key=lambda s: open_[s].size))
        for name in list(open_):
            yield closed(name)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.coalesce(F.col(text), F.lit("")))
    return cut(rows.mapInArrow(run, INDEX), "phrases-index")


def _extended(bwt: np.ndarray, own: np.ndarray, other: np.ndarray, size: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, ...]:
    """All extensions by one word of n-grams with intervals ``own`` in this transform's index and ``other`` in the opposite one:
    number of the n-gram, the phrase that the extension has at its other end, and own, other and size of the extension. Of these,
    those whose other end is none of the given phrases are left out, and so are separators."""
    before = np.cumsum(size) - size
    which = np.repeat(np.arange(len(size)), size)
    key = which << 32 | bwt[np.repeat(own - before, size) + np.arange(len(which))]
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    found, n = key[first], np.diff(np.append(first, len(key)))
    gram, word = found >> 32, found & 0xFFFFFFFF
    wide = other[gram] + first - before[gram]
    # rows of this word before the interval, behind the words that sort before it: where the longer n-gram begins
    ranks = bwt.astype(np.int64) << 32
    ranks += np.arange(len(bwt))
    ranks.sort()
    at = np.searchsorted(ranks, word << 32 | own[gram])
    order = np.argsort(own, kind="stable")
    holder = order[np.maximum(np.searchsorted(own[order], at, "right") - 1, 0)] if len(own) else gram
    held = (word > 0) & (at >= own[holder]) & (at < own[holder] + size[holder])
    return gram[held], phrase[holder[held]], at[held], wide[held], n[held]


def extend(indexes: DataFrame, spans: DataFrame, right: bool) -> DataFrame:
    """SPAN, first, last of the phrases one word longer than those of ``spans`` (SPAN, phrase): ids of their first and last words' phrases."""
    transform = "backwards" if right else "forwards"
    own, other = ("back", "forth") if right else ("forth", "back")

    def run(key: tuple, shard: pa.Table, rows: pa.Table) -> pa.Table:
        col = lambda c: rows.column(c).to_numpy().astype(np.int64)
        names, kinds = [*SPAN, "first", "last"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        if not rows.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        bwt = np.frombuffer(zstandard.decompress(shard.column(transform)[0].as_py()), np.int32)
        gram, end, at, wide, n = _extended(bwt, col(own), col(other), col("size"), col("phrase"))
        whole = col("phrase")[gram]
        ends, spots = ((whole, end), (wide, at)) if right else ((end, whole), (at, wide))
        values = [np.full(len(n), key[0].as_py()), *spots, n, *ends]
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    sides = indexes.select("shard", transform).groupBy("shard"), spans.select(*SPAN, "phrase").groupBy("shard")
    return sides[0].cogroup(sides[1]).applyInArrow(run, "shard long, forth int, back int, size int, first long, last long")


def _frequent(rows: DataFrame, key: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """Phrases (key, f, phrase: an id) of at least ``least`` occurrences, and their rows (SPAN, phrase and more); both are written.

    A phrase's id is the number of its first row where its rows meet for their sum, so they are not joined with their phrases again.
    """
    own = W.partitionBy(*key)
    held = rows.withColumn("f", F.sum(F.col("size").cast("long")).over(own)).where(F.col("f") >= least).withColumn("row", F.monotonically_increasing_id())
    held = held.withColumn("phrase", F.min("row").over(own))
    # key and f stand in a phrase's first row only
    held = cut(held.select(*SPAN, "phrase", *[F.when(F.col("row") == F.col("phrase"), F.col(c)).alias(c) for c in (*key, "f")]), "phrases-held")
    return cut(held.where("f is not null").select(*key, "f", "phrase"), "phrases-found"), held


def ngrams(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words and ``least`` occurrences, and (lang, n), the word occurrences of each language.

    Phrases are lang, words (how many), text, f, heads and tails (occurrences of their first and last 1, 2, ... words), and left and
    right: the most occurrences of a phrase that is longer by one word on that side, null if none has ``least``.
    """
    shards = index(docs, longest, text, lang)
    sizes = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    total = cut(shards.groupBy("lang").agg(F.sum(sizes).alias("n")).where("n > 0"), "phrases-n")
    one = shards.select("shard", "lang", F.explode(F.arrays_zip("words", "starts", "sizes")).alias("x"))
    rows = one.select("shard", F.col("x.starts").alias("forth"), F.col("x.starts").alias("back"), F.col("x.sizes").alias("size"), "lang", F.col("x.words").alias("text"))
    found, spans = _frequent(rows, ["lang", "text"], least)
    level = found.select("phrase", "lang", "text", F.col("text").alias("tail"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    out = []
    for words in range(1, longest + 1):
        if words == longest:
            out.append(_sided(level, None, words))
            break
        rows = extend(shards, spans, right=words % 2 == 1)
        if words + 1 < longest:
            found, more = _frequent(rows, ["first", "last"], least)
        else:
            sums = rows.groupBy("first", "last").agg(F.sum(F.col("size").cast("long")).alias("f")).where(F.col("f") >= least)
            found, more = cut(sums.withColumn("phrase", F.monotonically_increasing_id()), "phrases-found"), None
        drop(spans)
        spans = more
        out.append(_sided(level, found, words))
        a, b = level.alias("a"), level.alias("b")
        joined = found.alias("x").join(a, F.col("x.first") == F.col("a.phrase")).join(b, F.col("x.last") == F.col("b.phrase"))
        longer = lambda side, c: F.concat(F.col(f"{side}.{c}"), F.array("x.f")).alias(c)
        level = cut(joined.select("x.phrase", "a.lang", F.concat_ws(" ", "a.text", "b.tail").alias("text"), "b.tail", "x.f", longer("a", "heads"), longer("b", "tails")), "phrases-level")
    drop(shards)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every, total


def _sided(level: DataFrame, longer: DataFrame | None, words: int) -> DataFrame:
    """Phrases of one length with left and right."""
    if longer is None:
        rows = level.withColumn("left", F.lit(None).cast("long")).withColumn("right", F.lit(None).cast("long"))
    else:
        most = lambda end, side: longer.groupBy(F.col(end).alias("phrase")).agg(F.max("f").alias(side))
        rows = level.join(most("last", "left"), "phrase", "left").join(most("first", "right"), "phrase", "left")
    return rows.select("lang", F.lit(words).alias("words"), "text", "f", "heads", "tails", "left", "right")


def _quotient(a: Column, l: Column, r: Column) -> Column:
    """floor(10^6 a a / (l r)), exact for counts below 10^15; it is at most 10^6, as l and r are at least a."""
    d = lambda x: x.cast("decimal(15,0)")
    return F.call_function("div", d(a) * d(a) * F.lit(1_000_000).cast("decimal(7,0)"), d(l) * d(r))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to ``longest`` words that no longer one of at least ``share`` percent of their occurrences holds, and (lang, n).

    Phrases are lang, phrase, words, a, l, r, score: of the cuts in two parts with l and r occurrences the one of lowest score counts,
    of these the first. A phrase within one longer by several words lies within one longer by one, which is no rarer.
    """
    rows, total = ngrams(docs, longest, least, text, lang)
    longer = F.coalesce(F.greatest("left", "right"), F.lit(0))
    rows = rows.where("words > 1").where(100 * longer < share * F.col("f"))

    def at(k: Column) -> Column:
        l, r = F.element_at("heads", k), F.element_at("tails", F.col("words") - k)
        return F.struct(_quotient(F.col("f"), l, r).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    least_cut = F.array_min(F.transform(F.sequence(F.lit(1), F.col("words") - 1), at))
    rows = rows.withColumn("cut", least_cut)
    return rows.select("lang", F.col("text").alias("phrase"), "words", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"), total


def report(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    rows, total = collocations(docs)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
