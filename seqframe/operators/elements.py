"""Repeat elements: features with their sequences, end pairs, and locating elements in queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..functions.seq import revcomp
from .intervals import chunks
from .locate import first_places

ROLES = ("LTR_retrotransposon", "five_prime_LTR", "three_prime_LTR")


def join_group_seqs(groups: DataFrame, seqs: DataFrame, strict: bool = True) -> DataFrame:
    """group_id, species, gene, seq: members with their sequences (species, gene, seq); with ``strict`` a missing one fails."""
    joined = groups.join(seqs, ["species", "gene"], "left" if strict else "inner")
    if not strict:
        return joined.select("group_id", "species", "gene", "seq")
    missing = F.raise_error(F.concat_ws("|", F.lit("no sequence for "), "species", "gene")).cast("string")
    return joined.select("group_id", "species", "gene", F.coalesce("seq", missing).alias("seq"))


def join_feature_seqs(features: DataFrame, seqs: DataFrame, size: int = 1 << 20) -> DataFrame:
    """element, seqname, whole, five, three: sequences of an element and its two ends, on the feature's strand; null without the
    feature. Of several features of one role the last by (start, stop) counts; a stop before the start is an error.

    Features meet the chunks of ``size`` bases that they lie on, so a long sequence is shared among tasks and is not copied whole.
    """
    roles = {"whole": ROLES[0], "five": ROLES[1], "three": ROLES[2]}
    spans = [F.max_by(F.struct(F.lit(name).alias("role"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "strand"), F.when(F.col("feature") == role, F.struct("start", "stop"))).alias(name) for name, role in roles.items()]
    some = [F.count_if(F.col("feature") == role).alias(f"n_{name}") for name, role in roles.items()]
    wide = features.groupBy("element", "seqname").agg(*spans, *some)
    each = wide.select("element", "seqname", F.explode(F.array_compact(F.array(*[F.when(F.col(f"n_{name}") > 0, F.col(name)) for name in roles]))).alias("x")).select("element", "seqname", "x.*")
    wrong = F.raise_error(F.concat(F.lit("end before start: "), F.col("start").cast("string"), F.lit(".."), F.col("stop").cast("string"))).cast("long")
    each = each.withColumn("stop", F.when(F.col("stop") < F.col("start"), wrong).otherwise(F.col("stop")))
    pieces = each.withColumn("chunk_no", F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("stop") - 1) / size))))
    joined = pieces.join(chunks(seqs, size).withColumnRenamed("seq_id", "seqname").withColumn("chunk_no", F.col("chunk_no").cast("long")), ["seqname", "chunk_no"])
    first = F.greatest("start", "chunk_start")
    piece = F.substr("chunk", (first - F.col("chunk_start") + 1).cast("int"), (F.col("stop") - first + 1).cast("int"))
    held = joined.select("element", "seqname", "strand", F.struct("role", "chunk_no", piece.alias("piece")).alias("p")).groupBy("element", "seqname").agg(F.sort_array(F.collect_list("p")).alias("p"), *[F.max(F.when(F.col("p.role") == name, F.col("strand"))).alias(f"{name}_strand") for name in roles])

    def cut(name: str) -> Column:
        own = F.filter("p", lambda x: x["role"] == name)
        text = F.array_join(F.transform(own, lambda x: x["piece"]), "")
        return F.when(F.size(own) > 0, F.when(F.col(f"{name}_strand") == "-", revcomp(text)).otherwise(text)).alias(name)

    return held.select("element", "seqname", *map(cut, roles))


def join_ltr_ends(families: DataFrame, five: DataFrame, three: DataFrame) -> DataFrame:
    """element, family, five, three: classified elements that have both ends."""
    return families.join(five, "element").join(three, "element").select("element", "family", "five", "three")


def ltr_pair_records(pairs: DataFrame) -> DataFrame:
    """element, header, seq: two records for each element, named ``element#family#role``."""
    ends = F.explode(F.array(F.struct(F.lit(ROLES[1]).alias("role"), F.col("five").alias("seq")), F.struct(F.lit(ROLES[2]).alias("role"), F.col("three").alias("seq"))))
    return pairs.select("element", "family", ends.alias("e")).select("element", F.concat_ws("#", "element", "family", "e.role").alias("header"), "e.seq")


def locate_elements(elements: DataFrame, seqs: DataFrame, size: int = 1 << 20, longest: int = 1 << 16) -> DataFrame:
    """Elements (element, seqname, seq, and part lengths ltr5, ltr3) found in their sequence: start and stop of the whole and inner
    edges of both ends, from 1; start 0 and nulls where the sequence lacks it. The first place counts.

    Where the elements have columns pbs and ppt (sequences), their first places within the element follow as starts and stops, null
    if it lacks them, and with tsr5 and tsr3 (sequences) the spans of their lengths before and behind the element.

    Elements of at most ``longest`` bases, an error beyond, are looked up by a seed and compared where that stands (``first_places``).
    A null element is nowhere. Elements of sequences that are not there have no row.
    """
    # written once: both are read several times, and what gives them may be much work
    seqs = settled(seqs.select("seq_id", *(["chunk_start", "chunk"] if "chunk" in seqs.columns else ["seq"])))
    elements = settled(elements)
    too_long = F.raise_error(F.concat(F.lit("element longer than the overlap: "), F.col("element"))).cast("string")
    wanted = elements.withColumn("seq", F.when(F.length("seq") > longest, too_long).otherwise(F.col("seq")))
    first = first_places(wanted, seqs, size, longest)
    nowhere = elements.where("seq is null").join(chunks(seqs, size).select(F.col("seq_id").alias("seqname")).distinct(), "seqname", "left_semi").withColumn("start", F.lit(0).cast("long"))
    rows = elements.join(first, ["seqname", "seq"]).unionByName(nowhere)
    some = F.col("start") > 0
    stop = F.col("start") + F.length("seq") - 1
    out = {"stop": stop, "ltr5_stop": F.col("start") + F.col("ltr5") - 1, "ltr3_start": stop - F.col("ltr3") + 1}
    for part in ("pbs", "ppt"):
        if part in elements.columns:
            inner = F.nullif(F.expr(f"locate({part}, seq)"), F.lit(0))
            out |= {f"{part}_start": F.col("start") + inner - 1, f"{part}_stop": F.col("start") + inner + F.length(part) - 2}
    if "tsr5" in elements.columns:
        out |= {"tsd5_start": F.col("start") - F.length("tsr5"), "tsd5_stop": F.col("start") - 1}
    if "tsr3" in elements.columns:
        out |= {"tsd3_start": stop + 1, "tsd3_stop": stop + F.length("tsr3")}
    return rows.select("element", "seqname", "start", *[F.when(some, c).cast("long").alias(name) for name, c in out.items()])


def union_tracks(tracks: dict[str, DataFrame], name: str = "ALLDB") -> DataFrame:
    """The rows of all tracks, each tagged with its source, under one track name."""
    out = None
    for source, df in tracks.items():
        rows = df.withColumn("source", F.lit(source)).withColumn("track", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the order of ``keys``, for a report."""
    return df.orderBy(*keys)
