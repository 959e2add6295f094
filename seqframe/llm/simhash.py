"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are a ring of 8 segments of 8 bits. If two fingerprints differ in at most 3 bits, some segment i
starts a chain whose every prefix of l segments differs in at most floor(3 l / 8) bits: segments i and i+1 are equal, the
next three differ in at most one bit together, and so on round the ring. Hence at least four of the chain's first five
segments are equal, and the index key is (i, the segment left out, those four segments): 24 rows of 32 key bits for each
distinct fingerprint. A pair that meets on a key must pass the whole chain, then the full Hamming check, and is emitted only
at the first chain and the first segment left out that fit, so once.

Copies share a fingerprint and are aggregated away first. A key with more than ``HOT`` distinct fingerprints is dealt in
blocks: each pair of blocks is searched in one task of bounded size, which returns a spanning forest of its links rather than
all pairs, so components lose no link. Components are found by star rounds on links between distinct fingerprints.

Defined cases: null and empty texts and those without words have fingerprint zero, which links like any other; fewer than
three words are one shingle; a null doc_id keeps its row and fingerprint and takes the component of its fingerprint; repeated
rows stay; texts are read whole, a very long one in strides; an empty table gives no rows. Further columns stay, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, row_name, sized, unused

SEED, MAX_BITS, SEGMENTS = 42, 3, 8
#: More distinct fingerprints than this on one key are searched in blocks of BLOCK.
HOT, BLOCK = 128, 2048
#: Bytes of a row's name in memory.
NAME_BYTES = 64
#: Shingles whose bits are counted at once.
STRIDE = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats included, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for k in range(0, n, STRIDE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + STRIDE], ends[k : k + STRIDE])], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield pd.Series(np.array([fingerprint(t) for t in s], np.uint64).view(np.int64), index=s.index)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with ``out``: the fingerprint as a signed long."""
    return docs.withColumn(out, F.pandas_udf(_fingerprints, "long")(F.col(text)))


def _byte(k: int, of: str = "fp") -> str:
    return f"(shiftrightunsigned({of}, {8 * (k % SEGMENTS)}) & 255L)"


def _keys() -> F.Column:
    """24 keys: number of the chain's start and of the segment left out, then four segments."""
    out = []
    for i in range(SEGMENTS):
        for n, j in enumerate((2, 3, 4)):
            a, b = [i + x for x in (2, 3, 4) if x != j]
            packed = " | ".join(f"shiftleft({_byte(k)}, {8 * p})" for p, k in enumerate((i, i + 1, a, b)))
            out.append(f"(shiftleft({3 * i + n}L, 32) | {packed})")
    return F.expr(f"array({', '.join(out)})")


def _chain(i: int, bits: list[str]) -> str:
    """Whether the chain that starts at segment i keeps within every budget."""
    ring = [bits[(i + k) % SEGMENTS] for k in range(SEGMENTS)]
    budget = [MAX_BITS * (l + 1) // SEGMENTS for l in range(SEGMENTS)]
    tight = [l for l in range(SEGMENTS) if l + 1 == SEGMENTS or budget[l + 1] > budget[l]]
    return "(" + " AND ".join(f"{' + '.join(ring[: l + 1])} <= {budget[l]}" for l in tight) + ")"


def _first_fit() -> str:
    """The number of the key at which a pair with exclusive-or ``x`` is to be emitted; null if it is no link."""
    bits = [f"bit_count({_byte(k, 'x')})" for k in range(SEGMENTS)]
    cases = []
    for i in range(SEGMENTS):
        p2, p3, p4 = (bits[(i + k) % SEGMENTS] for k in (2, 3, 4))
        cases.append(f"WHEN {_chain(i, bits)} THEN {3 * i} + CASE WHEN {p3} + {p4} = 0 THEN 0 WHEN {p2} + {p4} = 0 THEN 1 ELSE 2 END")
    return f"CASE WHEN bit_count(x) > {MAX_BITS} THEN NULL {' '.join(cases)} END"


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: every point is visited once, no pair is stored."""
    todo, rest = [], fps
    left, right = [], []
    while len(rest) or todo:
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        x = todo.pop()
        near = np.bitwise_count(rest ^ x) <= max_bits
        if near.any():
            got = rest[near]
            left.append(np.full(len(got), x))
            right.append(got)
            todo.extend(got)
            rest = rest[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = forest(np.unique(pdf["fp"].to_numpy().view(np.uint64)))
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(fps: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps`` (fp: long): enough of them to connect all that link."""
    keyed = fps.select("fp", F.explode(_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = cut(keyed.join(shared, "key"), "simhash-keys")
    x = "(a ^ b)"
    cold = live.where(F.col("n") <= hot)
    pairs = cold.select("key", F.col("fp").alias("a")).join(cold.select("key", F.col("fp").alias("b")), "key").where(
        F.expr("a < b") & (F.expr(_first_fit().replace("(x)", x).replace("(x,", f"({x},")) == F.expr("shiftrightunsigned(key, 32)"))
    )
    dealt = live.where(F.col("n") > hot).withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("p", F.expr("pmod(xxhash64(fp), blocks)"))
    dealt = dealt.withColumn("q", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("key", "fp", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    return pairs.select("a", "b").unionByName(dealt.groupBy("key", "p", "q").applyInPandas(_block, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, rid (a name for key and text), fp (signed long), component_id.

    component_id is the smallest key reachable by links of at most 3 bits.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), row_name(F.col(key).cast("long"), text).alias("rid"), F.col(text).alias("text"))
    fp = cut(with_fingerprint(rows).select(key, "rid", "fp"), "simhash-fp")
    reps = cut(fp.groupBy("fp").agg(F.min(key).alias("rep")), "simhash-reps")
    groups = components(links(reps.select("fp")))
    member = reps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = member.join(lowest, "component").select("fp", "component_id")
    return fp.join(of, "fp").select(key, "rid", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key. Rows with a null key are kept: nothing names them.

    The names of the rows that go are fewer than the documents; they are broadcast while they fit, beyond that the join shuffles.
    Equal rows are reduced to one only where there are any.
    """
    near = cut(near_duplicates(docs, key, text), "simhash-groups")
    rid = unused(docs, "rid")
    out = near.where(F.col(key) != F.col("component_id")).select("rid").distinct()
    gone = cut(out.toDF(rid), "simhash-gone")
    twice = cut(near.where(F.col(key) == F.col("component_id")).groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid").toDF(rid), "simhash-twice")
    named = docs.withColumn(rid, row_name(F.col(key).cast("long"), text))
    kept = named.join(sized(gone, NAME_BYTES), rid, "left_anti")
    if not twice.isEmpty():
        again = kept.join(sized(twice, NAME_BYTES), rid, "left_semi").dropDuplicates([rid])
        kept = kept.join(sized(twice, NAME_BYTES), rid, "left_anti").unionByName(again)
    return kept.select(docs.columns)
