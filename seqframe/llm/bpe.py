"""BPE encoding and decoding with a public vocabulary file.

The text is normalised and split as the vocabulary's file says (NFC, white space collapsed, lower case per character, then
letters, single numbers, runs of other signs and English contractions); every piece is merged with a priority queue of merge
ranks over a doubly linked list of symbols. Entries of the queue that name a symbol which has since been merged are stale and
are skipped. Decoding joins vocabulary strings as the library does for a file without a decoder: one space between them.

Defined cases: a null text is an empty one; an empty text has no ids and decodes to an empty text; the strings of special
tokens inside a text are those tokens; texts of any length are processed whole, piece by piece. Repeated rows get equal
results and a null doc_id stays; further columns stay untouched, and input columns named like an output are replaced by it; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of Unicode, the pieces of the vocabulary's pre-tokenizer, the byte alphabet's printable ranges.
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
PRINTABLE = ((33, 126), (161, 172), (174, 255))
#: A worker keeps the ids of so many words and pieces up to this length.
MEMO_LENGTH, MEMO_WORDS, MEMO_PIECES = 64, 250_000, 250_000
#: str.split() takes these four separators for white space, which the vocabulary's pre-tokenizer does not.
NOT_SPACE, SPACES = regex.compile("[\x1c-\x1f]").search, regex.compile(f"[^{SPACE}]+").findall


class Memo:
    """Results of short keys, kept until there are ``size`` of them; frequent ones come early."""

    def __init__(self, size: int):
        self.size, self.kept = size, {}

    def put(self, key: str, value):
        if len(key) <= MEMO_LENGTH and len(self.kept) < self.size:
            self.kept[key] = value
        return value


class Bpe:
    """Encoder and decoder of one vocabulary file; one instance lives in each Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        self.vocab = j["model"]["vocab"]
        self.suffix = j["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.token}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        #: (left id, right id) as one number -> rank and merged id as one number, so that comparing numbers compares ranks.
        self.merge = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        shown = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
        letters = {b: chr(b) for b in shown}
        letters |= {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in letters)}
        self.first = [self.vocab[letters[b]] for b in range(256)]
        self.last = [self.vocab[letters[b] + self.suffix] for b in range(256)]
        self.pieces = regex.compile(PIECE).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo, self.words = Memo(MEMO_PIECES), Memo(MEMO_WORDS)

    def merged(self, piece: str) -> list[int]:
        """Ids of one piece: the lowest-ranked, leftmost pair first, until no pair can be merged."""
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n, merge = len(ids), self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        best = [merge(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]  # of the pair that starts here; -1: none
        queue = [v * n + k for k, v in enumerate(best) if v >= 0]
        best.append(-1)
        heapq.heapify(queue)
        gone = [False] * n
        while queue:
            v, k = divmod(heapq.heappop(queue), n)
            if best[k] != v:
                continue
            r = after[k]
            ids[k], gone[r], best[r] = v & 0xFFFFF, True, -1
            after[k] = s = after[r]
            best[k] = -1
            if s < n:
                before[s] = k
                best[k] = v = merge(ids[k] << 20 | ids[s], -1)
                if v >= 0:
                    heapq.heappush(queue, v * n + k)
            if (p := before[k]) >= 0:
                best[p] = v = merge(ids[p] << 20 | ids[k], -1)
                if v >= 0:
                    heapq.heappush(queue, v * n + p)
        return [i for i, x in zip(ids, gone) if not x]

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece, kept for the next time."""
        return self.memo.kept.get(piece) or self.memo.put(piece, self.merged(piece))

    def word(self, word: str) -> list[int]:
        """Ids of a run without white space. No piece, composition or case rule reaches over white space."""
        part = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        return self.words.put(word, [i for p in self.pieces(part) for i in self.piece(p)])

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.words.kept.get
        for n, part in enumerate(self.specials.split(text or "") if self.specials and "<|" in (text or "") else [text or ""]):
            if n % 2:
                out.append(self.special[part])
                continue
            for w in SPACES(part) if NOT_SPACE(part) else part.split():
                ids = known(w)
                out += self.word(w) if ids is None else ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, joined as the library does."""
        return " ".join(map(self.token.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the encoded text, and ``n_tokens``. The vocabulary's path must be readable by every executor."""

    run = F.pandas_udf(_series_encoder(vocab_path), T.ArrayType(T.IntegerType()))
    return docs.withColumn(ids, run(F.coalesce(F.col(text), F.lit("")))).withColumn("n_tokens", F.size(ids).cast("long"))


def _series_encoder(vocab_path: str):
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(vocab_path)
        for s in it:
            yield s.map(bpe.encode)

    return run


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the vocabulary strings of ``ids``; a null list decodes to an empty text."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(vocab_path)
        for s in it:
            yield s.map(lambda x: bpe.decode(list(x)))

    return df.withColumn(out, F.pandas_udf(run, "string")(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def encode_digest(docs: DataFrame, vocab_path: str, ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids, made in one pass.

    Rows stream through in Arrow batches; memory follows the longest text of a batch.
    """
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for b in batches:
            n, one, back, lists = [], [], [], []
            for text in b.column(1):
                found = bpe.encode(text.as_py())
                n.append(len(found))
                one.append(sha256(bpe.joined(found).encode()).hexdigest())
                back.append(sha256(bpe.decode(found).encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    lists.append(np.array(found, np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols, names = [*cols, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
