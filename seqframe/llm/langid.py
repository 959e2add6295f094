"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (1 to 4 letters, words padded with ``_``), counted over every
training document; a document is given to the language whose profile is nearest by the out-of-place measure: the sum, over
the document's own ``DOC_PROFILE`` most frequent n-grams, known or not, of how far each one's rank is from its rank in the
profile, or ``PROFILE``, the largest distance, if the profile lacks it. Equally frequent n-grams rank in the order of their
code points. In training, Spark counts words before they are cut into n-grams, so that work follows distinct words, and takes
the first ``PROFILE`` n-grams of each language and salt before those of each language, so that no task ranks a language alone.
Only the profiles (languages x ``PROFILE`` rows) reach the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0, all others get a learned language: where all
distances tie, as for a text of unknown n-grams, the language that sorts first. Rows whose language is null teach nothing; if
there is nothing to learn from, every text is ``und``. Texts are read whole, very long words too, in stretches of bounded
memory but for the text itself; an empty table gives no rows. Repeated rows get equal results; other columns are never looked
at, and stay, but for those named like an output, which are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, unused

#: Sizes of n-grams run from 1 to 4: the masks and the packing in ``counted`` are written for these.
SIZES, PROFILE, DOC_PROFILE = (1, 2, 3, 4), 400, 300
UNKNOWN = "und"
_words = regex.compile(r"\p{L}+").findall
#: Fixed value: an odd multiplier that spreads the keys of n-grams.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
PAD = ord("_")
#: Word counts that a training task holds before it gives them out; starts of n-grams in a piece of a word.
HELD_WORDS, PIECE = 100_000, 256
#: Parts that the n-grams of a language are ranked in before they meet.
SALTS = 16
#: Letters of a text whose n-grams are counted at once; distinct letters that packed n-grams can tell apart.
STRETCH, ALPHABET = 1 << 20, (1 << 16) - 1


def words(text: str) -> Counter:
    return Counter(_words(text.lower()))


def grams(word: str) -> list[str]:
    padded = f"_{word}_"
    return [g for n in SIZES for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) != "_"]


def pieces(word: str) -> list[tuple[str, int]]:
    """The padded word in pieces, each with the number of its n-grams' starts; a piece goes on to the end of its last n-gram."""
    padded = f"_{word}_"
    return [(padded[k : k + PIECE + SIZES[-1] - 1], min(PIECE, len(padded) - k)) for k in range(0, len(padded), PIECE)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of each language over many rows, given out whenever many have gathered."""
    held: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, p, k, n) for lang, c in held.items() for w, n in c.items() for p, k in pieces(w)]
        held.clear()
        cols = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "piece", "starts", "n"])

    for b in batches:
        for text, lang in zip(b.column(0), b.column(1), strict=True):
            held.setdefault(lang.as_py(), Counter()).update(words(text.as_py() or ""))
        if sum(map(len, held.values())) > HELD_WORDS:
            yield out()
    yield out()


def _grams(piece: F.Column, begin: F.Column, k: int) -> F.Column:
    """The k-grams of a piece; null for a shorter one."""
    last = F.least(begin, F.length(piece) - (k - 1))
    return F.transform(F.when(last >= 1, F.sequence(F.lit(1), last)), lambda i: piece.substr(i, F.lit(k)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, dict[str, int]]:
    """Profiles (language -> n-gram -> rank) of all rows of ``docs`` with a language. Driver: languages x ``size`` rows."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.mapInArrow(_count_words, "lang string, piece string, starts int, n long").groupBy("lang", "piece", "starts").agg(F.sum("n").alias("n"))
    cut = F.filter(F.flatten(F.array_compact(F.array(*[_grams(F.col("piece"), F.col("starts"), k) for k in SIZES]))), lambda g: g != "_")
    total = counts.select("lang", "n", F.explode(cut).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = total.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        total = total.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, dict[str, int]] = {}
    for r in total.select("lang", "gram", "rank").collect():
        profiles.setdefault(r["lang"], {})[r["gram"]] = r["rank"] - 1
    return dict(sorted(profiles.items()))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    known = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
        known[m.start() : m.end()] = True
    return known


def stream(text: str) -> np.ndarray | None:
    """The code points of a text's words with a pad before, between and after them; None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = np.full(int(keep.sum()) + 1 + bool(letter[-1]), PAD, np.uint32)
    x[1 : len(x) - bool(letter[-1])] = np.where(letter, points, PAD)[keep]
    return x


def runs(packed: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, in order, and how often each is there, or the sum of its weights."""
    if not len(packed):
        return packed, np.zeros(0, np.int64)
    if weight is None:
        packed = np.sort(packed)
        first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        return packed[first], np.diff(first, append=len(packed))
    order = np.argsort(packed, kind="stable")
    packed = packed[order]
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    return packed[first], np.add.reduceat(weight[order], first)


def counted(x: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a stream of numbers from 1 to ``ALPHABET`` and their counts. An n-gram is packed into 64 bits, its first
    letter highest, so that packed n-grams sort as their letters do."""
    parts = []
    for k in range(0, len(x), STRETCH):
        y = x[k : k + STRETCH + SIZES[-1] - 1].astype(np.uint64)
        is_pad, inner, found, h = y == pad, y[1:-1] == pad, [], np.zeros(len(y), np.uint64)
        for n in SIZES:
            if n > len(y):
                break
            h = h[: len(y) - n + 1] | y[n - 1 :] << np.uint64(64 - 16 * n)
            # a pad may stand at a window's ends, not within; a lone pad is no n-gram, nor are two of them
            wrong = is_pad if n == 1 else is_pad[:-1] & is_pad[1:] if n == 2 else inner if n == 3 else inner[:-1] | inner[1:]
            found.append(h[:STRETCH][~wrong[:STRETCH]])
        parts.append(runs(np.concatenate(found)))
    if len(parts) == 1:
        return parts[0]
    return runs(*(np.concatenate(c) for c in zip(*parts, strict=True)))


class Scorer:
    """Out-of-place distances of documents to fitted profiles."""

    def __init__(self, profiles: dict[str, dict[str, int]]):
        self.langs = sorted(profiles)
        known = sorted({g for p in profiles.values() for g in p})
        number = {g: k for k, g in enumerate(known)}
        #: Rank of every known n-gram in each profile; -1 where it is absent; the last row is that of any other n-gram.
        self.ranks = np.full((len(known) + 1, len(self.langs)), -1, np.int64)
        for k, name in enumerate(self.langs):
            for g, r in profiles[name].items():
                self.ranks[number[g], k] = r
        points = np.array([[*map(ord, g), 0, 0, 0][: SIZES[-1]] for g in known], np.uint64).reshape(-1, SIZES[-1])
        key = self.key(points)
        order = np.argsort(key)
        #: The known n-grams in the order of their keys, and behind them one of no letter.
        self.keys, self.points, self.order = key[order], np.concatenate([points[order], np.zeros((1, SIZES[-1]), np.uint64)]), np.append(order, len(known))
        if len(np.unique(key)) < len(key):
            raise ValueError("two n-grams have one key")
        self.place = np.zeros(0x110000, np.uint16)

    @staticmethod
    def key(points: np.ndarray) -> np.ndarray:
        """A number for each row of code points: where to look, no proof that two rows are equal."""
        return (points << np.array([42, 21, 0, 0], np.uint64)).sum(axis=1, dtype=np.uint64) ^ points[:, 3] * SPREAD

    def top(self, text: str) -> np.ndarray | None:
        """The most frequent n-grams of the text as rows of code points, zeros behind the shorter ones; equally frequent ones in the
        order of their code points. None without a letter."""
        x = stream(text)
        if x is None:
            return None
        alphabet = runs(x)[0]
        if len(alphabet) > ALPHABET:
            count = Counter()
            for w, n in words(text).items():
                for g in grams(w):
                    count[g] += n
            top = sorted(count, key=lambda g: (-count[g], g))[:DOC_PROFILE]
            return np.array([[*map(ord, g), 0, 0, 0][: SIZES[-1]] for g in top], np.uint64)
        self.place[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint16)
        packed, n = counted(self.place[x], int(self.place[PAD]))
        if len(n) > DOC_PROFILE:
            least = np.partition(n, len(n) - DOC_PROFILE)[len(n) - DOC_PROFILE]
            some = np.flatnonzero(n > least)
            at = np.sort(np.concatenate([some, np.flatnonzero(n == least)[: DOC_PROFILE - len(some)]]))
            packed, n = packed[at], n[at]
        packed = packed[np.argsort(-n, kind="stable")]
        return np.concatenate([[0], alphabet]).astype(np.uint64)[packed[:, None] >> np.array([48, 32, 16, 0], np.uint64) & np.uint64(0xFFFF)]

    def numbers(self, top: np.ndarray) -> np.ndarray:
        """Of each n-gram, its number among the known ones, or how many these are."""
        at = np.searchsorted(self.keys, self.key(top))
        return np.where((self.points[at] == top).all(axis=1), self.order[at], len(self.keys))

    def score(self, text: str | None) -> tuple[str, float]:
        top = self.top(text or "") if self.langs else None
        if top is None:
            return UNKNOWN, 0.0
        ranks = self.ranks[self.numbers(top)]
        distance = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        rest = np.delete(distance, best)
        worst = PROFILE * len(top)
        score = 1 - distance[best] / worst if not len(rest) else 0.5 + 0.5 * (rest.min() - distance[best]) / max(1, rest.min())
        return self.langs[best], float(min(1.0, max(0.0, score)))


def predict(docs: DataFrame, profiles: dict[str, dict[str, int]], text: str = "text", out: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the language and the score, from the text alone."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(profiles)
        for s in it:
            yield pd.DataFrame([scorer.score(t) for t in s], columns=["lang", "score"], index=s.index).astype({"lang": object, "score": float})

    named = F.pandas_udf(run, "lang string, score double")
    both = unused(docs, "lang_and_score")
    return docs.withColumn(both, named(F.col(text))).withColumns({out: F.col(f"{both}.lang"), score: F.col(f"{both}.score")}).drop(both)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    profiles = fit(docs.where(~held_out()))
    scored = predict(docs.select("doc_id", "text"), profiles)
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` whose text is in a language: rows that come out as ``und`` go, the others keep their columns."""
    profiles = fit(docs.where(~held_out()))
    lang, score = unused(docs, "lang_known"), unused(docs, "score_known")
    return predict(docs, profiles, out=lang, score=score).where(F.col(lang) != UNKNOWN).select(docs.columns)
