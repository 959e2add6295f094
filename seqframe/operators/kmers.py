"""Counting k-mers by super-k-mers: runs of k-mers with one minimizer travel as one string.

A k-mer's minimizer is the least hash of its m-mers; neighbours mostly share it. K-mers are dealt out by their minimizer's bucket,
so equal ones meet, and a run of them is shuffled once with its letters, not once for each. The runs that a task has for one part
travel in one row, compressed. Parts are as many as the number of k-mers asks for and are filled evenly; each holds the k-mers of its
buckets as numbers. Buckets of so many k-mers that they would fill a part (the share of these grows with the input) are dealt out
anew, by minimizers of more letters. What fills a part even then is left out of this: its rows send their distinct k-mers with
counts, and the sums come back to the rows, so a k-mer that is everywhere is one number for each row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from .intervals import chunks

#: Letters that are digits of a number, and how many fit in 63 bits; k-mers of up to two such numbers are counted so.
LETTERS, FIT = b"ACGTN", 27
DIGIT = np.full(256, 255, np.uint8)
DIGIT[np.frombuffer(LETTERS, np.uint8)] = np.arange(len(LETTERS))
#: Letters of an m-mer, and of one for buckets that would fill a part; buckets of either, k-mers of a part, k-mers of one string at most (a byte).
MINIMIZER, LONGER, BUCKETS, TASK, RUN = 9, 15, 1 << 16, 1 << 22, 200
#: Letters that are packed together, that are dealt out together, and that are worked on at once, within a processor's cache.
PACK, DEAL, BLOCK = 1 << 22, 1 << 24, 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Sequences of a task: their pieces' names, first places and lengths, their digits (255 for another letter, and after each piece), and
#: how many k-mers each bucket has of them, last those with another letter.
STORED = "names array<string>, begin binary, length binary, letters binary, size int, bucket binary, n binary"
#: The super-k-mers of a task for a part: how many, their sequences, for these how many each has and for those their numbers of
#: k-mers and places, compressed, and digits, three in a byte.
PACKED = "part int, rows int, names array<string>, told binary, letters binary"
#: The three digits of a byte.
THREE = np.array([(b // 25, b // 5 % 5, b % 5) for b in range(125)], np.uint8)
#: Whether k-mers are asked about, and whether they count.
ASKED, HAVE = 1, 2


def _windows(letters: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k-mers that begin at each place, for k up to FIT, of digits; what holds another letter is not told."""
    n = len(letters) - k + 1
    if n <= 0 or k <= 0:
        return np.zeros(max(n, 0), np.int64)
    # by doubling: the bits of k from the highest
    code, done = letters.astype(np.int64), 1
    for bit in bin(k)[3:]:
        code = code[: len(code) - done] * len(LETTERS) ** done + code[done:]
        done *= 2
        if bit == "1":
            code = code[:-1] * len(LETTERS) + letters[done : done + len(code) - 1]
            done += 1
    return code


def codes(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of each k-mer of digits: of its first ``FIT`` letters and of the rest."""
    n = max(len(letters) - k + 1, 0)
    first = _windows(letters, min(k, FIT))[:n]
    rest = _windows(letters[FIT:], k - FIT)[:n] if k > FIT else np.zeros(n, np.int64)
    return first, rest


def _minimizers(letters: np.ndarray, k: int, m: int) -> np.ndarray:
    """The least hash of the m-mers of each k-mer of digits."""
    value = _windows(letters, m).astype(np.uint64) * MIX
    value ^= value >> np.uint64(32)
    span = 1
    while span < k - m + 1:
        s = min(span, k - m + 1 - span)
        value = np.minimum(value[:-s], value[s:])
        span += s
    return value


def _buckets(value: np.ndarray) -> np.ndarray:
    return (value * MIX >> np.uint64(40)).astype(np.int64) % BUCKETS


def runs(letters: np.ndarray, k: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of k-mers, and buckets of the super-k-mers of digits; k-mers with another letter (255) are in none.

    K-mers of buckets that are ``hot`` are in one of ``BUCKETS`` further ones, by longer minimizers.
    """
    n = len(letters) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    other = letters == 255
    good, known = None, letters
    if other.any():
        sums = np.append(0, np.cumsum(other))
        good, known = sums[k:] == sums[:n], np.where(other, 0, letters)
    value, far = _minimizers(known, k, min(k, MINIMIZER)), None
    if hot is not None and hot.any():
        far = hot[_buckets(value)]
        value = np.where(far, _minimizers(known, k, min(k, LONGER)), value) if far.any() else value
    change = value[1:] != value[:-1]
    for mark in (good, far):
        if mark is not None:
            change |= mark[1:] != mark[:-1]
    start = np.append(0, np.flatnonzero(change) + 1)
    size = np.diff(np.append(start, n))
    if size.max() > RUN:
        # long runs are cut
        many = -(-size // RUN)
        which = np.repeat(np.arange(len(start)), many)
        part = (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)) * RUN
        start, size = start[which] + part, np.minimum(size[which] - part, RUN)
    if good is not None:
        kept = good[start]
        start, size = start[kept], size[kept]
    bucket = _buckets(value[start])
    return start, size, bucket if far is None else bucket + BUCKETS * far[start]


def _all_runs(letters: np.ndarray, k: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``runs``, worked out in blocks."""
    found = []
    for a in range(0, max(len(letters) - k + 1, 1), BLOCK):
        start, size, bucket = runs(letters[a : a + BLOCK + k - 1], k, hot)
        found.append((start + a, size, bucket))
    return tuple(np.concatenate(x) for x in zip(*found))


def _gathered(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
    """The digits of these places, joined, three in a byte."""
    end = np.cumsum(length)
    out = np.zeros(-(-int(end[-1]) // 3) * 3, np.uint8)
    out[: end[-1]] = raw[np.repeat(start - end + length, length) + np.arange(end[-1])]
    return (out[::3] * 25 + out[1::3] * 5 + out[2::3]).tobytes()


def _compressed(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def stored(seqs: DataFrame, k: int, size: int = 1 << 20) -> DataFrame:
    """``STORED`` rows of sequences, whole or in pieces, computed once: their pieces overlap by k - 1."""

    def row(held: list[tuple]) -> pa.RecordBatch:
        letters = np.concatenate([x for _, _, text in held for x in (text, np.array([255], np.uint8))])
        _, n, bucket = _all_runs(letters, k)
        load = np.bincount(bucket, n, BUCKETS + 1).astype(np.int64)
        load[BUCKETS] = sum(max(len(text) - k + 1, 0) for *_, text in held) - n.sum()
        some = np.flatnonzero(load)
        cols = [[name for name, *_ in held]], [np.array([b for _, b, _ in held], np.int64).tobytes()], [np.array([len(t) for *_, t in held], np.int64).tobytes()], [_compressed(letters.tobytes())], [len(letters)], [some.astype(np.int32).tobytes()], [load[some].tobytes()]
        types = pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["names", "begin", "length", "letters", "size", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = [], 0
        for b in batches:
            for name, begin, text in zip(*b.columns):
                if not text.is_valid:
                    continue
                # a letter of more bytes is another letter, and still one
                whole = DIGIT[np.frombuffer(text.as_py().encode("ascii", "replace"), np.uint8)]
                for a in range(0, max(len(whole) - k + 1, 1), size):
                    held.append((name.as_py(), begin.as_py() + a, whole[a : a + size + k - 1]))
                    letters += len(held[-1][2]) + 1
                    if letters >= PACK:
                        yield row(held)
                        held, letters = [], 0
        if held:
            yield row(held)

    # whole sequences are cut by the tasks, so that what gives them is worked out once for a row
    pieces = chunks(seqs, size, k - 1) if "chunk" in seqs.columns else seqs.select("seq_id", F.lit(1).alias("chunk_start"), F.col("seq").alias("chunk"))
    return settled(pieces.select("seq_id", F.col("chunk_start").cast("long"), "chunk").mapInArrow(run, STORED))


def _letters(row: dict) -> np.ndarray:
    return np.frombuffer(pa.decompress(row["letters"], row["size"], "zstd", asbytes=True), np.uint8)


def bucket_sizes(rows: DataFrame, k: int, hot: np.ndarray | None = None) -> np.ndarray:
    """The number of k-mers of each bucket in ``STORED`` rows and last of those with another letter; if some are ``hot``, of the further
    buckets that these are dealt out to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for r in b.to_pylist():
                if hot is None:
                    load[np.frombuffer(r["bucket"], np.int32)] += np.frombuffer(r["n"], np.int64)
                else:
                    _, n, bucket = _all_runs(_letters(r), k, hot)
                    load[:BUCKETS] += np.bincount(bucket, n, 2 * BUCKETS)[BUCKETS:].astype(np.int64)
        some = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(load[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows.select(*(["bucket", "n"] if hot is None else ["letters", "size"])).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS + 1 rows
        out[r["bucket"]] = r["n"]
    return out


def _packed(held: list[dict], k: int, part_of: np.ndarray, hot: np.ndarray | None) -> pa.RecordBatch:
    """A row for each part that the super-k-mers of these rows go to."""
    raw = np.concatenate([_letters(r) for r in held])
    start, n, bucket = _all_runs(raw, k, hot)
    part = part_of[bucket]
    kept = np.flatnonzero(part >= 0)
    # sorted by digits if the parts' numbers are short
    order = kept[np.argsort(part[kept].astype(np.uint16 if part_of.max() < 1 << 16 else np.int32), kind="stable")]
    start, n, part = start[order], n[order], part[order]
    names = [x for r in held for x in r["names"]]
    begin, length = (np.concatenate([np.frombuffer(r[c], np.int64) for r in held]) for c in ("begin", "length"))
    end = np.cumsum(length + 1)
    piece = np.searchsorted(end, start, "right")
    at = start - (end - length - 1)[piece] + begin[piece]
    borders = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else []
    cols: list[list] = [[] for _ in range(5)]
    for a, b in zip(borders[:-1], borders[1:]):
        first = np.flatnonzero(np.diff(piece[a:b], prepend=-1))
        each = np.diff(first, append=b - a).astype(np.uint32)
        told = _compressed(each.tobytes() + n[a:b].astype(np.uint8).tobytes() + np.diff(at[a:b], prepend=0).tobytes())
        for col, value in zip(cols, (part[a], b - a, [names[j] for j in piece[a:b][first]], told, _gathered(raw, start[a:b], n[a:b] + k - 1))):
            col.append(value)
    types = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "rows", "names", "told", "letters"])


def super_kmers(rows: DataFrame, k: int, part_of: np.ndarray, hot: np.ndarray | None = None) -> DataFrame:
    """``PACKED`` rows of the super-k-mers of ``STORED`` rows whose bucket has a part (not negative) in ``part_of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = [], 0
        for b in batches:
            for j in range(b.num_rows):
                held += b.slice(j, 1).to_pylist()
                letters += held[-1]["size"]
                if letters >= DEAL:
                    yield _packed(held, k, part_of, hot)
                    held, letters = [], 0
        if held:
            yield _packed(held, k, part_of, hot)

    return rows.select("names", "begin", "length", "letters", "size").mapInArrow(run, PACKED)


def _unpacked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """Role, names, super-k-mers of each name, n, at, digits of each packed row."""
    for b in batches:
        for r in b.to_pylist():
            rows, upto = r["rows"], 4 * len(r["names"])
            told = pa.decompress(r["told"], upto + 9 * rows, "zstd", asbytes=True)
            each = np.frombuffer(told, np.uint32, len(r["names"]))
            n = np.frombuffer(told, np.uint8, rows, upto).astype(np.int64)
            at = np.cumsum(np.frombuffer(told[upto + rows :], np.int64))
            yield r["role"], r["names"], each, n, at, THREE[np.frombuffer(r["letters"], np.uint8)].reshape(-1)[: int(n.sum()) + (k - 1) * rows]


def _spread(n: np.ndarray, letters: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Super-k-mer, offset within it, and the two numbers of each k-mer."""
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(np.append(0, np.cumsum(n + k - 1))[:-1], n) + offset
    first, rest = codes(letters, k)
    return row, offset, first[place], rest[place]


def _of(names: list, each: np.ndarray, row: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The names, and which of them each k-mer has."""
    return pa.array(names, pa.string()), np.repeat(np.arange(len(names)), each)[row]


def _equals(first: np.ndarray, rest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal k-mers stand together, and whether each in it differs from the one before.

    What is sorted is a number of the high bits of a k-mer's hash and its place, which is faster than to sort places by k-mers; k-mers
    that share their bits with another one are sorted by themselves afterwards.
    """
    bits = np.uint64(max(len(first) - 1, 1).bit_length())
    keys = first.astype(np.uint64) * MIX
    if k > FIT:
        keys = (keys ^ keys >> np.uint64(32) ^ rest.astype(np.uint64)) * MIX
    keys = (keys >> bits << bits) | np.arange(len(first), dtype=np.uint64)
    keys.sort()
    order = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    keys >>= bits
    new = np.append(True, keys[1:] != keys[:-1])[: len(order)]

    def differs() -> np.ndarray:
        out = np.diff(first[order]) != 0
        return out | (np.diff(rest[order]) != 0) if k > FIT else out

    other = differs()
    if (mixed := other & ~new[1:]).any():
        group = np.cumsum(new)
        again = np.zeros(len(order) + 1, bool)
        again[group[1:][mixed]] = True
        at = np.flatnonzero(again[group])
        some = order[at]
        order[at] = some[np.lexsort((*([rest[some]] if k > FIT else []), first[some], group[at]))]
        other = differs()
    new[1:] |= other
    return order, new


def counted(rows: DataFrame, k: int) -> DataFrame:
    """seq_id, position, n: for every k-mer asked about, how many there are that count, in each partition of packed rows with a role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(_unpacked(batches, k))
        if not any(h[0] & ASKED for h in held):
            return
        n, at, letters = (np.concatenate([h[j] for h in held]) for j in (3, 4, 5))
        role = np.repeat(np.array([h[0] for h in held], np.int8), [len(h[3]) for h in held])
        names = pa.array([x for h in held for x in h[1]], pa.string())
        name_of = np.repeat(np.arange(len(names)), np.concatenate([h[2] for h in held]))
        del held
        upto, seen = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n + k - 1))
        first, rest = np.empty(upto[-1], np.int64), np.zeros(upto[-1] if k > FIT else 0, np.int64)
        # so many super-k-mers at once that their k-mers are about a block
        blocks = [(a, min(a + BLOCK // 8, len(n))) for a in range(0, len(n), BLOCK // 8)]
        for a, b in blocks:
            _, _, first[upto[a] : upto[b]], more = _spread(n[a:b], letters[seen[a] : seen[b]], k)
            if k > FIT:
                rest[upto[a] : upto[b]] = more
        order, new = _equals(first, rest, k)
        del first, rest, letters
        starts = np.flatnonzero(new)
        if (role & HAVE).all():
            counts = np.diff(starts, append=len(order))
        else:
            counts = np.add.reduceat(np.repeat((role & HAVE) // HAVE, n)[order].astype(np.int64), starts)
        found = np.empty(len(order), np.int64)
        found[order] = np.repeat(counts, np.diff(starts, append=len(order)))
        del order, new
        for a, b in blocks:
            asked = np.flatnonzero(role[a:b] & ASKED) + a
            if len(asked):
                many = n[asked]
                offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                place = np.repeat(upto[asked], many) + offset
                cols = names.take(pa.array(np.repeat(name_of[asked], many))), pa.array(np.repeat(at[asked], many) + offset, pa.int64()), pa.array(found[place], pa.int64())
                yield pa.RecordBatch.from_arrays(list(cols), names=["seq_id", "position", "n"])

    return rows.drop("part").mapInArrow(run, "seq_id string, position long, n long")


def counted_apart(rows: DataFrame, k: int) -> DataFrame:
    """What ``counted`` gives, of packed rows that need not meet.

    A row's distinct k-mers are counted where it is and summed over rows, and the sums go to the rows that ask: what is sent grows with
    the k-mers that a row has, not with how often it has them. Rows with one id (equal ones) get the same sums.
    """
    key = ["code", "rest"]
    rows = rows.drop("part").withColumn("id", F.xxhash64("names", "told", "letters"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                r = b.slice(j, 1)
                for role, _, _, n, _, letters in _unpacked(iter([r]), k):
                    _, _, first, rest = _spread(n, letters, k)
                    order, new = _equals(first, rest, k)
                    starts = np.flatnonzero(new)
                    size = np.diff(starts, append=len(order))
                    for s in range(0, len(starts), 1 << 16):
                        part = order[starts[s : s + (1 << 16)]]
                        m = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r.column("id").to_numpy(), m)), pa.array(np.full(m, role, np.int32)), pa.array(first[part], pa.int64()), pa.array(rest[part], pa.int64()), pa.array(size[s : s + m], pa.int64())], names=["id", "role", *key, "n"])

    def answer(asked: pa.Table, sums: pa.Table) -> pa.Table:
        out = []
        codes_, rests, n = (sums.column(c).to_numpy() for c in (*key, "n"))
        for _, names, each, size, at, letters in _unpacked(iter(asked.to_batches()), k):
            row, offset, first, rest = _spread(size, letters, k)
            names, which = _of(names, each, row)
            order, new = _equals(np.append(codes_, first), np.append(rests, rest), k)
            # a k-mer's sum is the only number but 0 among its equals
            value = np.append(n, np.zeros(len(first), np.int64))[order]
            found = np.empty(len(order), np.int64)
            found[order] = np.maximum.reduceat(value, np.flatnonzero(new))[np.cumsum(new) - 1]
            out.append(pa.table([names.take(pa.array(which)), pa.array(at[row] + offset, pa.int64()), pa.array(found[len(n) :], pa.int64())], names=["seq_id", "position", "n"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], names=["seq_id", "position", "n"])

    own = rows.mapInArrow(distinct, "id long, role int, code long, rest long, n long")
    sums = own.groupBy(*key).agg(F.sum(F.when(F.col("role").bitwiseAND(HAVE) > 0, F.col("n")).otherwise(0)).alias("n"))
    sent = own.where(F.col("role").bitwiseAND(ASKED) > 0).select("id", *key).join(sums, key).select("id", *key, "n")
    asked = rows.where(F.col("role").bitwiseAND(ASKED) > 0)
    return asked.groupBy("id").cogroup(sent.groupBy("id")).applyInArrow(answer, "seq_id string, position long, n long")


def _dealt(load: np.ndarray, parts: int) -> np.ndarray:
    """The part of each bucket, -1 for an empty one: the fullest first, each to the part that has least."""
    out = np.full(len(load), -1, np.int32)
    heap = [(0, p) for p in range(parts)]
    for b in np.argsort(-load, kind="stable")[: np.count_nonzero(load)]:
        had, p = heap[0]
        out[b] = p
        heapq.heapreplace(heap, (had + int(load[b]), p))
    return out


def counts_of(query: DataFrame, target: DataFrame, k: int, prefilter: bool = False) -> tuple[DataFrame, bool]:
    """seq_id, position, n: how often the target has each k-mer of ``LETTERS`` that the query has; k is at most 2 ``FIT``. And whether
    the query has k-mers with another letter.

    The number of k-mers of each bucket is counted first, of those that would fill a part again by longer minimizers. With ``prefilter``
    the target's k-mers in buckets without any of the query's stay where they are. A query that is its own target (the same DataFrame)
    travels once.
    """
    roles = {ASKED | HAVE: query} if query is target else {ASKED: query, HAVE: target}
    rows = {role: stored(df, k) for role, df in roles.items()}
    sizes = {role: bucket_sizes(df, k) for role, df in rows.items()}
    other = any(n[BUCKETS] > 0 for role, n in sizes.items() if role & ASKED)
    sizes = {role: n[:BUCKETS] for role, n in sizes.items()}

    def asked(sizes: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        return sizes | {HAVE: np.where(sizes[ASKED] > 0, sizes[HAVE], 0)} if prefilter and query is not target else sizes

    def full(sizes: dict[int, np.ndarray]) -> np.ndarray:
        return sum(sizes.values()) > TASK // 2

    sizes = asked(sizes)
    hot = full(sizes) if full(sizes).any() else None
    if hot is not None:
        sizes = asked({role: np.append(np.where(hot, 0, n), bucket_sizes(rows[role], k, hot)[:BUCKETS]) for role, n in sizes.items()})
    load, left = sum(sizes.values()), full(sizes)
    cold = np.where(left, 0, load)
    parts = max(2 * query.sparkSession.sparkContext.defaultParallelism, -(-int(cold.sum()) // TASK))

    def all_rows(part_of: np.ndarray) -> DataFrame:
        return reduce(DataFrame.unionByName, [super_kmers(df, k, np.where(sizes[role] > 0, part_of, -1), hot).withColumn("role", F.lit(role)) for role, df in rows.items()])

    out = counted(all_rows(_dealt(cold, parts)).repartitionById(parts, "part"), k)
    if left.any():
        # few rows of all that are read: written once, since they are used three times
        out = out.unionByName(counted_apart(settled(all_rows(np.where(left, 0, -1))), k))
    return out, other
