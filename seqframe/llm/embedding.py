"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A vector is scaled to length 1 and rotated at random; its code is the signs of the rotated components. Stored beside it are the
correction factor, the inner product of the code (as a unit vector) with the rotated vector, and, for its part as a query, the
rotated vector in levels of four bits, rounded at random. The inner product of one vector's code with another's levels, divided by
the first one's factor, is an unbiased estimate of their cosine. For pairs at the threshold t or above its error has a deviation
of at most sqrt((1 - f^2) (1 - t^2) / f^2 / (D - 1) + step^2 / 4 f^2), and ``Z`` times that is the bound: a pair whose estimate and
bound stay below the threshold, from either side, is passed over. The others are computed exactly in double precision, and exact
cosines alone decide links.

Candidates come from signs too: ``tables`` groups of ``bits`` sign bits from further rotations; two vectors are compared if some
group agrees. ``bits`` follows the size of the largest label, so groups stay small as the data grow, and ``tables`` is what makes a
pair at the threshold meet with a chance of 1 - ``MISS`` or more (closer pairs more surely). Only codes, factors and levels go to
the groups, some 60 bytes for 64 components. A group tells which of its members have a pair that the bound leaves; these alone are
sent their vectors, and a pair is computed and counted in the first group that it shares. Equal vectors are aggregated away first.
A group of more than ``BLOCK`` vectors is dealt in pairs of blocks; a task returns for each vector its number of links, and a
spanning forest of the links, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, those without a label and rows without a
vec_id link with nothing and are their own component; they take no part in any join. Vectors of different lengths never link.
Repeated rows are copies: they link, and each counts. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, drop, row_name, sized

THRESHOLD, MISS, Z, SEED = 0.93, 1e-4, 4.0, 11
BLOCK = 2048
#: Groups up to this size are compared many at a time; so many numbers of vectors are unpacked at once.
SMALL, UNPACKED = 64, 1 << 21
LEVELS = 15


def plan(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a group and number of groups for labels of at most ``largest`` distinct vectors."""
    bits = max(6, min(40, math.ceil(math.log2(max(2, largest))) - 3))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def rotations(dim: int, n_bits: int, seed: int = SEED) -> np.ndarray:
    """Orthogonal matrices side by side, with at least ``n_bits`` columns."""
    rng = np.random.default_rng([seed, dim])
    out = []
    while sum(m.shape[1] for m in out) < n_bits:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)[:, :n_bits]


class Codes(NamedTuple):
    """Unpacked codes: signs (+1, -1), correction factors, rotated vectors from their levels, and the levels' steps."""

    signs: np.ndarray
    factor: np.ndarray
    turned: np.ndarray
    step: np.ndarray

    def take(self, at: np.ndarray | slice) -> Codes:
        return Codes(*(x[at] for x in self))


class Coder:
    def __init__(self, dim: int, bits: int, tables: int):
        self.dim, self.bits, self.tables = dim, bits, tables
        self.main = rotations(dim, dim, SEED)
        self.turns = rotations(dim, bits * tables, SEED + 1)
        self.dither = np.random.default_rng([SEED + 2, dim]).random(dim)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Group number of each vector in each table."""
        signs = (unit @ self.turns > 0).reshape(len(unit), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))

    def pack(self, unit: np.ndarray) -> np.ndarray:
        """For each vector the bytes of its code, its levels, its factor, and the levels' origin and step."""
        turned = unit @ self.main
        factor = np.abs(turned).sum(axis=1) / math.sqrt(self.dim)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / LEVELS, 1e-30)
        level = np.floor((turned - low[:, None]) / step[:, None] + self.dither).clip(0, LEVELS).astype(np.uint8)
        if self.dim % 2:
            level = np.concatenate([level, np.zeros((len(level), 1), np.uint8)], axis=1)
        numbers = np.stack([factor, low, step], axis=1).astype("<f4")
        return np.concatenate([np.packbits(turned > 0, axis=1), level[:, ::2] << 4 | level[:, 1::2], numbers.view(np.uint8)], axis=1)


def unpack(packed: np.ndarray, dim: int) -> Codes:
    a, b = -(-dim // 8), -(-dim // 8) + -(-dim // 2)
    signs = np.unpackbits(packed[:, :a], axis=1, count=dim).astype(np.float32) * 2 - 1
    level = np.stack([packed[:, a:b] >> 4, packed[:, a:b] & 15], axis=2).reshape(len(packed), -1)[:, :dim]
    factor, low, step = np.ascontiguousarray(packed[:, b:]).view("<f4").T
    return Codes(signs, factor, low[:, None] + step[:, None] * level, step)


def deviation(factor: np.ndarray, step: np.ndarray, dim: int, threshold: float = THRESHOLD) -> np.ndarray:
    """Of the error of estimates for pairs at the threshold or above, from codes with ``factor`` and levels with ``step``."""
    square = np.minimum(1, factor.astype(np.float64) ** 2)
    return np.sqrt(((1 - square) * (1 - threshold**2) / max(1, dim - 1) + step.astype(np.float64) ** 2 / 4) / square)


def maybe_dense(a: Codes, b: Codes, threshold: float) -> np.ndarray:
    """Which pairs of a row of ``a`` and one of ``b`` the bound leaves."""
    dim = a.signs.shape[1]
    out = np.ones((len(a.signs), len(b.signs)), bool)
    for x, y, turn in ((a, b, False), (b, a, True)):
        # the larger of the steps bounds every pair's deviation
        estimate = x.signs @ y.turned.T / (math.sqrt(dim) * x.factor[:, None])
        near = estimate + Z * deviation(x.factor, np.full(len(x.factor), y.step.max(initial=0)), dim, threshold)[:, None] + 1e-5 >= threshold
        out &= near.T if turn else near
    return out


def maybe_pairs(c: Codes, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of rows (a, b) the bound leaves."""
    dim = c.signs.shape[1]
    out = np.ones(len(a), bool)
    for x, y in ((a, b), (b, a)):
        estimate = np.einsum("ij,ij->i", c.signs[x], c.turned[y]) / (math.sqrt(dim) * c.factor[x])
        out &= estimate + Z * deviation(c.factor[x], c.step[y], dim, threshold) + 1e-5 >= threshold
    return out


def unit_rows(raw: np.ndarray | list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1, in double precision, from bytes of ``kind`` (f4 or f8)."""
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


CODE_SCHEMA = "node long, label string, n long, dim int, packed binary, raw binary, keys array<long>"


def _coded(bits: int, tables: int, kind: str):
    """(node, label, n, vector) -> the vector with its code and the numbers of its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, Coder] = {}
        for b in batches:
            vectors = [np.asarray(v.values.to_numpy(zero_copy_only=False), kind) for v in b.column("vector")]
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                coder = coders.setdefault(dim, Coder(dim, bits, tables))
                raw = [vectors[k].tobytes() for k in at]
                unit = unit_rows(raw, kind)
                node, label, n = (b.column(c).take(pa.array(at)) for c in ("node", "label", "n"))
                packed = [x.tobytes() for x in coder.pack(unit)]
                cols = [node, label, n, pa.array(np.full(len(at), dim, np.int32)), pa.array(packed, pa.binary()), pa.array(raw, pa.binary()), pa.array(list(coder.keys(unit)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "label", "n", "dim", "packed", "raw", "keys"])

    return run


#: A group, a pair of its blocks, and in which of the two a row is (0: both are one).
GROUP = ["dim", "g", "p", "q"]


def _groups(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray]]:
    """Rows sorted by ``GROUP``, whole groups at a time: the dimension, columns, and where groups start, with the end."""
    held: tuple[int, dict[str, np.ndarray]] | None = None

    def parts(dim: int, rows: dict[str, np.ndarray], start: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray]]:
        k = 0
        while k < len(start) - 1:
            to = max(k + 1, int(np.searchsorted(start, start[k] + UNPACKED // dim, "right")) - 1)
            yield dim, {c: v[start[k] : start[to]] for c, v in rows.items()}, start[k : to + 1] - start[k]
            k = to

    for b in batches:
        dims = b.column("dim").to_numpy()
        for lo, hi in _stretches(dims):
            rows = {c: b.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("g", "p", "q", "side", "node", "packed", *extra)}
            dim = int(dims[lo])
            rows["packed"] = np.frombuffer(b"".join(rows["packed"]), np.uint8).reshape(hi - lo, -1)
            if held and held[0] == dim:
                rows = {c: np.concatenate([held[1][c], v]) for c, v in rows.items()}
            elif held:
                yield from parts(*held, _starts(held[1]))
            start = _starts(rows)
            yield from parts(dim, rows, start[:-1])
            held = dim, {c: v[start[-2] :] for c, v in rows.items()}
    if held:
        yield from parts(*held, _starts(held[1]))


def _stretches(v: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(v[1:] != v[:-1]) + 1
    edges = [0, *edge.tolist(), len(v)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


def _starts(rows: dict[str, np.ndarray]) -> np.ndarray:
    change = np.zeros(len(rows["g"]) - 1, bool)
    for c in ("g", "p", "q"):
        change |= rows[c][1:] != rows[c][:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(rows["g"])]])


def _left(codes: Codes, side: np.ndarray, start: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (a < b) of one group and of different sides that the bound leaves: a stretch of a large group, or all small ones
    at once, row k with row k+1, k+2, and so on."""
    size = np.diff(start)
    for k in np.flatnonzero(size > SMALL):
        lo, hi = int(start[k]), int(start[k + 1])
        for at in range(lo, hi, 256):
            near = np.triu(maybe_dense(codes.take(slice(at, min(hi, at + 256))), codes.take(slice(at, hi)), threshold), 1)
            if (side[lo:hi] != side[lo]).any():
                near &= side[at : min(hi, at + 256), None] != side[None, at:hi]
            a, b = np.nonzero(near)
            yield a + at, b + at
    own = np.repeat(np.where(size <= SMALL, np.arange(len(size)), -1), size)
    for d in range(1, int(size[size <= SMALL].max(initial=1))):
        a = np.flatnonzero((own[d:] == own[:-d]) & (own[d:] >= 0) & ((side[d:] != side[:-d]) | (side[d:] == 0)))
        for k in range(0, len(a), 1 << 16):
            x = a[k : k + (1 << 16)]
            x = x[maybe_pairs(codes, x, x + d, threshold)]
            if len(x):
                yield x, x + d


NEAR_SCHEMA = "dim int, g long, p long, q long, side int, node long"


def _near(threshold: float):
    """Codes sorted by ``GROUP`` -> the rows that have a pair which the bound leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows, start in _groups(batches):
            codes, near = unpack(rows["packed"], dim), np.zeros(len(rows["g"]), bool)
            for a, b in _left(codes, rows["side"], start, threshold):
                near[a] = near[b] = True
            if near.any():
                cols = [pa.array(np.full(int(near.sum()), dim, np.int32)), *(pa.array(rows[c][near]) for c in ("g", "p", "q", "side", "node"))]
                yield pa.RecordBatch.from_arrays(cols, names=["dim", "g", "p", "q", "side", "node"])

    return run


class Forest:
    """A spanning forest of links, of which each stretch is seen once."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while (apart := label[a] != label[b]).any():
            a, b = a[apart], b[apart]
            # each part takes at most one link to a part of lower label, and then its label
            high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
            part, first = np.unique(high, return_index=True)
            self.left.append(a[first])
            self.right.append(b[first])
            to = np.arange(len(label))
            to[part] = low[first]
            while (to != to[to]).any():
                to = to[to]
            label = to[label]
        self.label = label


LINK_SCHEMA = "node long, n_links long, other long"


def _links(bits: int, tables: int, threshold: float, kind: str):
    """Rows with vectors, sorted by ``GROUP`` -> (node, n_links, -1), and links of a spanning forest as (node, 0, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, Coder] = {}
        for dim, rows, start in _groups(batches, ("label", "n", "raw")):
            coder = coders.setdefault(dim, Coder(dim, bits, tables))
            unit, codes, node, weight = unit_rows(list(rows["raw"]), kind), unpack(rows["packed"], dim), rows["node"], rows["n"]
            keys, table = coder.keys(unit), rows["g"] & 0xFFFF
            label = np.unique(rows["label"].astype(str), return_inverse=True)[1]
            counts, forest = np.zeros(len(node), np.int64), Forest(len(node))
            for a, b in _left(codes, rows["side"], start, threshold):
                for k in range(0, len(a), 1 << 14):
                    x, y = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                    # the first table in which both are in one group
                    first = (keys[x] == keys[y]).argmax(axis=1) == table[x]
                    x, y = x[first & (label[x] == label[y])], y[first & (label[x] == label[y])]
                    link = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                    x, y = x[link], y[link]
                    np.add.at(counts, x, weight[y])
                    np.add.at(counts, y, weight[x])
                    forest.add(x, y)
            some = np.flatnonzero(counts)
            left, right = (node[np.concatenate(x)] if x else np.zeros(0, np.int64) for x in (forest.left, forest.right))
            cols = np.concatenate([node[some], left]), np.concatenate([counts[some], np.zeros(len(left), np.int64)]), np.concatenate([np.full(len(some), -1), right])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "n_links", "other"])

    return run


def usable(vectors: DataFrame, vector: str, label: str) -> F.Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``key``, n_links, component_id, kept for every row: links join vectors of equal label with a cosine of at least ``threshold``."""
    kind = "f4" if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else "f8"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<float>" if kind == "f4" else "array<double>").alias("vector"))
    ok = usable(rows, "vector", "label") & F.col("id").isNotNull()
    good = rows.where(ok).withColumn("name", row_name("label", "vector"))
    reps = good.groupBy("name", "label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    reps = cut(reps, "embedding-reps")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, tables = plan(largest, threshold)
    codes = cut(reps.select("node", "label", "n", "vector").mapInArrow(_coded(bits, tables, kind), CODE_SCHEMA), "embedding-codes")
    # a group's number: a hash of 48 bits and the table; labels are compared again where vectors are
    g = F.expr("shiftleft(xxhash64(label, dim, key), 16) | t").alias("g")
    keyed = codes.select("node", "label", "dim", "packed", F.posexplode("keys").alias("t", "key")).select("dim", g, "node", "packed")
    hot = cut(keyed.groupBy("dim", "g").agg(F.count("*").alias("size")).where(F.col("size") > block), "embedding-hot")
    dealt = keyed.join(sized(hot, 64), ["dim", "g"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / block), F.lit(1))).withColumn("own", F.expr("pmod(xxhash64(node), blocks)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    side = F.when(F.col("p") == F.col("q"), 0).otherwise(F.when(F.col("own") == F.col("p"), 1).otherwise(2)).alias("side")
    near = cut(_dealt(dealt.select(*GROUP, side, "node", "packed")).mapInArrow(_near(threshold), NEAR_SCHEMA), "embedding-near")
    with_vectors = near.join(codes.select("node", "label", "n", "packed", "raw"), "node")
    found = cut(_dealt(with_vectors).mapInArrow(_links(bits, tables, threshold, kind), LINK_SCHEMA), "embedding-links")
    for t in (codes, hot, near):
        drop(t)
    counts = found.where("other < 0").groupBy("node").agg(F.sum("n_links").alias("others"))
    groups = components(found.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of = reps.select("name", "node", "rep", "n").join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(lowest, "component").select("name", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.select("id", "name").join(of, "name").select("id", "n_links", "component_id")
    alone = rows.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return near_duplicates(vectors)
