"""Column functions on sequences and identifiers."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.numbering import numbered

#: The standard genetic code, codons in the order of BASES.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE = {"".join(c): a for c, a in zip(product(BASES, repeat=3), AMINO, strict=True)}
#: Codon prefixes of which every third base gives the same amino acid.
FOURFOLD = tuple(sorted(p for p in {c[:2] for c in CODE} if len({CODE[p + b] for b in BASES}) == 1))


def shorten_id(col: Column, n: int = 20) -> Column:
    """The first ``n`` characters."""
    return F.substring(col, 1, n)


def id_field(col: Column, delim: str, pos: int) -> Column:
    """Field ``pos`` (from 1) of an identifier; delimiters: ``|``, ``,``, space or tab."""
    return F.split_part(col, F.lit(delim), F.lit(pos))


def upper_seq(col: Column) -> Column:
    return F.upper(col)


def hardmask(col: Column, ch: str = "N") -> Column:
    """Lower-case residues replaced by ``ch``, one of N, X, n, x."""
    if ch not in ("N", "X", "n", "x"):
        raise ValueError(f"mask character {ch!r} is not one of N, X, n, x")
    return F.regexp_replace(col, "[a-z]", ch)


def revcomp(col: Column) -> Column:
    """Reverse complement of upper-case A, T, C, G; other characters stay."""
    return F.translate(F.reverse(col), "ATCG", "TAGC")


def subseq(seq: Column, start: Column, stop: Column, strand: Column) -> Column:
    """Bases start..stop (from 1, inclusive), reverse complemented on ``-``; stop < start is an error."""
    part = F.substr(seq, start.cast("int"), (stop - start + 1).cast("int"))
    wrong = F.raise_error(F.concat(F.lit("end before start: "), start.cast("string"), F.lit(".."), stop.cast("string"))).cast("string")
    return F.when(stop < start, wrong).when(strand == "-", revcomp(part)).otherwise(part)


def qualify_id(col: Column, species: Column) -> Column:
    """``species|id`` unless the id has that prefix already."""
    prefix = F.concat(species, F.lit("|"))
    return F.when(F.startswith(col, prefix), col).otherwise(F.concat(prefix, col))


def base26(n: Column, width: int = 4) -> Column:
    """A number as ``width`` letters, a = 0; more letters from 26^width on."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    digit = lambda k: F.substr(letters, (F.floor(n / 26**k) % 26 + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(k) if k < width else F.when(n >= 26**k, digit(k)).otherwise("") for k in reversed(range(max(width, 14)))])


def short_ids(labels: DataFrame, label: str = "label", prefix_length: int = 3) -> DataFrame:
    """label, short: dense short ids in the labels' order, ``N`` + letters + ``M``."""
    rows = numbered(labels.select(label).distinct(), [label], F.substring(label, 1, prefix_length), "_no")
    return rows.select(label, F.concat(F.lit("N"), base26(F.col("_no")), F.lit("M")).alias("short"))


def restore_ids(df: DataFrame, ids: DataFrame, col: str, label: str = "label") -> DataFrame:
    """``df`` with the short ids in ``col`` turned back to labels, by exact match; others stay."""
    joined = df.join(ids.withColumnRenamed("short", col), col, "left")
    return joined.withColumn(col, F.coalesce(label, col)).drop(label)


def codons(seq: Column) -> Column:
    """Whole codons, in order, cut in one pass."""
    return F.regexp_extract_all(seq, F.lit("(?s).{3}"), F.lit(0))


#: Numbers of letters' code points up to 127: bases 0 to 3, any other 4; and amino acids by the number of a codon, a base-5 number.
DIGITS = np.full(128, 4, np.uint8)
DIGITS[[ord(b) for b in BASES]] = range(4)
BY_NUMBER = np.frombuffer("".join(CODE.get("".join(c), "X") for c in product(BASES + "-", repeat=3)).encode(), np.uint8)


def base_numbers(text: str) -> np.ndarray:
    """The letters of a text as ``DIGITS``."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return DIGITS[np.minimum(letters, 127)]


def codon_numbers(text: str, letters: int = 3) -> np.ndarray:
    """The whole codons of a text, or their first ``letters``, as base-5 numbers."""
    x = base_numbers(text)
    x = x[: len(x) // 3 * 3].reshape(-1, 3)
    return (x[:, 0] * 5 + x[:, 1]) if letters == 2 else (x[:, 0] * 25 + x[:, 1] * 5 + x[:, 2])


@F.arrow_udf(StringType())
def _translated(seqs: pa.Array) -> pa.Array:
    return pa.array([None if s is None else BY_NUMBER[codon_numbers(s)].tobytes().decode() for s in seqs.to_pylist()], pa.string())


def translate_cds(seq: Column) -> Column:
    """Amino acids of whole codons; X for a codon with other letters."""
    return _translated(F.upper(seq))


def protein_ok(pep: Column, min_len: int = 10, max_stops: float = 0.2) -> Column:
    """Whether a protein is long enough and has few enough stops."""
    return (F.length(pep) >= min_len) & (F.regexp_count(pep, F.lit(r"\*")) <= max_stops * F.length(pep))


def filter_proteins(df: DataFrame, pep: str = "pep", min_len: int = 10, max_stops: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Good and poor proteins."""
    ok = protein_ok(F.col(pep), min_len, max_stops)
    return df.where(ok), df.where(~ok)


def judge_proteins(df: DataFrame, pep: str = "pep", min_len: int = 10, max_stops: float = 0.2, out: str = "good") -> DataFrame:
    """Good and poor proteins in one table, told by ``out``: nothing is computed twice; those of which it is not known are left out."""
    return df.withColumn(out, protein_ok(F.col(pep), min_len, max_stops)).where(F.col(out).isNotNull())


def qc_sequences(df: DataFrame, min_aa: int = 30) -> DataFrame:
    """Of (gene, isoform, cds, pep): the longest isoform of each gene that is long enough, has no inner stop and whose
    translation is its protein."""
    pep = F.regexp_replace("pep", r"\*$", "")
    good = df.where((F.length(pep) >= min_aa) & ~pep.contains("*") & (F.regexp_replace(translate_cds(F.col("cds")), r"\*$", "") == pep))
    top = F.max_by(F.struct("isoform", "cds", "pep"), F.struct(F.length(pep), F.col("isoform")))
    return good.groupBy("gene").agg(top.alias("t")).select("gene", "t.*")


def bad_codons(aln: Column) -> Column:
    """Whether an aligned coding sequence breaks codons: length no multiple of three, or a codon partly gap."""
    return (F.length(aln) % 3 != 0) | F.exists(codons(aln), lambda c: c.contains("-") & (c != "---"))


def check_codons(df: DataFrame, strict: bool = False) -> DataFrame:
    """group_id, species of alignments with broken codons; with ``strict`` the first one fails the job."""
    bad = df.where(bad_codons(F.col("aln"))).select("group_id", "species")
    if strict:
        bad = bad.withColumn("group_id", F.raise_error(F.concat_ws(" ", F.lit("broken codons in"), "group_id", "species")).cast("string"))
    return bad


def depth_bounds(depth: DataFrame, least: float = 20) -> DataFrame:
    """sample, depth, low, high: int(d / 3) - 1 and int(2 d) + 1 of samples of at least ``least``."""
    return depth.where(F.col("depth") >= least).select("sample", "depth", ((F.col("depth") / 3).cast("long") - 1).alias("low"), ((F.col("depth") * 2).cast("long") + 1).alias("high"))


def tag_source(source: Column, suffix: str | None) -> Column:
    """``source:suffix``; the source alone without a suffix."""
    return F.concat_ws(":", source, F.lit(suffix)) if suffix else source


def label_tracks(col: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule of which the name holds the text; the name itself without one."""
    return F.coalesce(*[F.when(col.contains(text), label) for text, label in rules], col)


def rescale_tree(nodes: DataFrame, factor: float, keep_ci: bool = True) -> DataFrame:
    """Tree nodes with lengths and interval bounds times ``factor``."""
    out = nodes.withColumn("length", F.col("length") * factor)
    for c in ("ci_lo", "ci_hi"):
        out = out.withColumn(c, F.col(c) * factor) if keep_ci else out.drop(c)
    return out


def mark_branches(trees: DataFrame, tips: DataFrame) -> DataFrame:
    """tree_id, tip, tree: a copy of the tree for each of ``tips`` (tree_id, tip) with ``#1`` after that tip."""
    pattern = F.concat(F.lit(r"(?<=[(,])\s*\Q"), F.col("tip"), F.lit(r"\E(?=[:,)])"))
    return trees.join(tips, "tree_id").select("tree_id", "tip", F.regexp_replace("tree", pattern, F.concat("tip", F.lit(" #1"))).alias("tree"))


def filter_hits(hits: DataFrame, max_e: float | None = None, min_len: int | None = None) -> DataFrame:
    """Hits with an e-value of at most ``max_e`` and a length of at least ``min_len``."""
    if max_e is not None:
        hits = hits.where(F.col("e") <= max_e)
    return hits if min_len is None else hits.where(F.col("len") >= min_len)


def evalue_parts(e: Column) -> tuple[Column, Column]:
    """Mantissa and exponent; zero is 1 and -181, so that it sorts first."""
    exponent = F.when(e == 0, -181).otherwise(F.floor(F.log10(e))).cast("long")
    return F.when(e == 0, 1.0).otherwise(F.round(e / F.pow(F.lit(10.0), exponent), 2)), exponent
