"""Aligned groups and k-mers: supermatrix, 4-fold sites, k-mer counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..functions.seq import BASES, FOURFOLD, codon_numbers
from .intervals import chunks
from .kmers import FIT, counts_of


#: Codons of a stretch.
STRETCH = 1 << 14
#: Whether the base-5 number of a codon's first two letters tells its amino acid.
FREE = np.zeros(25, bool)
FREE[[BASES.index(p[0]) * 5 + BASES.index(p[1]) for p in FOURFOLD]] = True


@F.arrow_udf(BinaryType())
def _masks(pieces: pa.Array) -> pa.Array:
    """A bit for each codon of a piece: whether its prefix is a 4-fold one."""
    return pa.array([np.packbits(FREE[codon_numbers(s, 2)]).tobytes() for s in pieces.to_pylist()], pa.binary())


@F.arrow_udf(BinaryType())
def _common(masks: pa.Array) -> pa.Array:
    """The bits that all masks of a list have; null if there are none."""

    def one(found: list[bytes]) -> bytes | None:
        n = min(map(len, found))
        both = np.bitwise_and.reduce([np.frombuffer(m[:n], np.uint8) for m in found])
        return both.tobytes() if both.any() else None

    return pa.array([one(found) for found in masks.to_pylist()], pa.binary())


@F.arrow_udf(StringType())
def _third_bases(pieces: pa.Array, masks: pa.Array) -> pa.Array:
    """The third letters of the codons of a piece whose bits are set."""

    def one(text: str, mask: bytes) -> str:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8)))
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[3 * at + 2].tobytes().decode("utf-32-le", "surrogatepass")

    return pa.array([one(*x) for x in zip(pieces.to_pylist(), masks.to_pylist())], pa.string())


def fourfold_sites(alns: DataFrame, n_species: int) -> DataFrame:
    """group_id, species, sites: third codon bases at positions where all ``n_species`` have a 4-fold prefix, in order. Groups without such a
    position, or of another number of alignments, have no rows.

    Alignments are cut in stretches of ``STRETCH`` codons, of which the 4-fold ones are bits of a mask; a stretch's masks are combined
    over species, and only bases that are left meet for an alignment. A group's alignments never meet in a row.
    """
    long = 3 * STRETCH
    last = F.greatest(F.lit(0), F.floor((F.length("aln") - 1) / long)).cast("int")
    rows = alns.withColumn("aln", F.coalesce("aln", F.lit(""))).select("group_id", "species", "aln", F.explode(F.sequence(F.lit(0), last)).alias("stretch"))
    rows = rows.select("group_id", "species", "stretch", F.substr("aln", F.col("stretch") * long + 1, F.lit(long)).alias("piece"))
    # every alignment has a first stretch, so these tell how many a group has; a stretch that an alignment lacks is 4-fold nowhere
    found = rows.select("group_id", "stretch", _masks(F.col("piece")).alias("mask")).groupBy("group_id", "stretch").agg(F.collect_list("mask").alias("masks"), F.count("*").alias("n"))
    whole = F.max(F.when(F.col("stretch") == 0, F.col("n"))).over(W.partitionBy("group_id"))
    full = found.withColumn("whole", whole).where((F.col("n") == n_species) & (F.col("whole") == n_species))
    common = full.select("group_id", "stretch", _common(F.col("masks")).alias("mask")).where("mask is not null")
    bases = rows.join(common, ["group_id", "stretch"]).select("group_id", "species", F.struct("stretch", _third_bases(F.col("piece"), F.col("mask")).alias("bases")).alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bases"]), "")
    return bases.groupBy("group_id", "species").agg(joined.alias("sites"))


def supermatrix(alns: DataFrame, part: Column | None = None, guard: int = 1 << 30) -> DataFrame:
    """species, part, aln, length, groups: each species' alignments joined in the order of groups.

    ``part`` cuts the groups into pieces, which must rise with group_id, such as ``floor(group_id / 1000)``: pieces in their order
    make the matrix, whatever its length. A piece of more than ``guard`` residues fails.
    """
    size = F.sum(F.length("aln"))
    joined = F.sort_array(F.collect_list(F.struct("group_id", "aln")))
    out = alns.withColumn("part", F.lit(0) if part is None else part).groupBy("species", "part").agg(joined.alias("parts"), size.alias("length"))
    text = F.array_join(F.transform("parts", lambda x: x["aln"]), "")
    safe = F.when(F.col("length") > guard, F.raise_error(F.lit("a joined alignment is too long; give smaller parts")).cast("string")).otherwise(text)
    return out.select("species", "part", safe.alias("aln"), "length", F.array_join(F.transform("parts", lambda x: x["group_id"].cast("string")), ",").alias("groups"))


#: Base-4 digits that a number holds when read as decimal ones; k-mers of A, C, G and T of up to two such numbers are packed.
DIGITS = 18
#: Sizes of the pieces that sequences are cut into for k-mers, one within the other: cutting works from a piece's start.
PIECES = (1 << 20, 1 << 14, 1 << 8)


def kmers(seqs: DataFrame, k: int, sizes: tuple[int, ...] = PIECES, odd: str | None = None) -> DataFrame:
    """seq_id, position (from 1), code, code2, kmer: every k-mer, from pieces that overlap by k - 1.

    The letters of a k-mer of A, C, G and T, as digits 0 to 3, are one number or two; any other k-mer, and one of more than 2 x ``DIGITS``
    letters, is text. What does not apply is null. With ``odd``, a pattern, only k-mers that it is found in. Pieces are dealt out first.
    """
    whole = chunks(seqs, sizes[0], k - 1).select("seq_id", (F.col("chunk_start") - 1).alias("at"), F.col("chunk").alias("seq")) if "chunk" in seqs.columns else seqs.select("seq_id", F.lit(0).alias("at"), "seq")
    rows = whole.select("seq_id", F.col("at").cast("long").alias("at"), (F.length("seq") - (k - 1)).alias("own"), "seq").where("own > 0")
    for n, size in enumerate(sizes):
        rows = rows.select("seq_id", "at", "own", "seq", F.explode(F.sequence(F.lit(0), F.ceil(F.col("own") / size) - 1)).alias("c"))
        begin = F.col("c") * size
        rows = rows.select("seq_id", (F.col("at") + begin).alias("at"), F.least(F.lit(size), F.col("own") - begin).cast("int").alias("own"), F.substr("seq", (begin + 1).cast("int"), F.lit(size + k - 1)).alias("seq"))
        if odd:
            rows = rows.where(F.col("seq").rlike(odd))
        if n == 0:
            rows = rows.repartition(2 * seqs.sparkSession.sparkContext.defaultParallelism)
    packed = k <= 2 * DIGITS
    digits = lambda c: F.translate(c, "ACGT", "0123")
    rows = rows.withColumn("clean", F.lit(packed) & ~F.col("seq").rlike("[^ACGT]")).withColumn("seq", F.when(F.col("clean"), digits("seq")).otherwise(F.col("seq")))
    every = F.transform(F.sequence(F.lit(1), F.col("own")), lambda i: F.substr("seq", i, F.lit(k)))
    out = rows.select("seq_id", "at", "clean", F.posexplode(every).alias("i", "kmer"))
    if odd:
        out = out.where(F.col("kmer").rlike(odd))
    out = out.withColumn("digits", F.when(F.col("clean"), F.col("kmer")).when(F.lit(packed) & F.col("kmer").rlike("^[ACGT]+$"), digits("kmer")))
    two = F.substring("digits", DIGITS + 1, DIGITS).cast("long") if k > DIGITS else F.lit(None).cast("long")
    return out.select("seq_id", (F.col("at") + F.col("i") + 1).alias("position"), F.substring("digits", 1, DIGITS).cast("long").alias("code"), two.alias("code2"), F.when(F.col("digits").isNull(), F.col("kmer")).alias("kmer"))


def kmer_counts(query: DataFrame, target: DataFrame, k: int = 20, prefilter: bool = False) -> DataFrame:
    """seq_id, position, n: how often the target set has the k-mer that starts at each position of the query.

    K-mers of A, C, G, T and N travel as super-k-mers (``kmers.counts_of``); those with another letter, and all of more letters than
    two numbers hold, one by one. With ``prefilter``, for a query that is small beside the target, only k-mers that may be in it
    are counted.
    """
    if k > 2 * FIT:
        return _text_counts(query, target, k, prefilter, None)
    out, other = counts_of(query, target, k, prefilter)
    return out.unionByName(_text_counts(query, target, k, prefilter, "[^ACGTN]")) if other else out


def _text_counts(query: DataFrame, target: DataFrame, k: int, prefilter: bool, odd: str | None) -> DataFrame:
    """``kmer_counts`` by a row for each k-mer: the target's are counted before they meet the query's, where frequent ones are skewed
    keys that adaptive execution splits."""
    key = ["code", "code2", "kmer"]

    def same(a: str, b: str) -> Column:
        one, two, three = (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in key)
        return one & two & three

    q, t = kmers(query, k, odd=odd).alias("q"), kmers(target, k, odd=odd)
    if prefilter:
        t = t.alias("t").join(q.select(*key).distinct().alias("d"), same("t", "d"), "left_semi")
    counts = t.groupBy(*key).agg(F.count("*").alias("n")).alias("c")
    return q.join(counts, same("q", "c"), "left").select("seq_id", "position", F.coalesce("n", F.lit(0)).alias("n"))
