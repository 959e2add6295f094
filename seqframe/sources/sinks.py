"""Writers. Rows become lines by expressions; Spark writes and commits the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import GFF


def wrapped(seq: Column, width: int = 60) -> Column:
    """A sequence in lines of ``width``, in one pass: a substring would be searched for from the sequence's start for each line."""
    return F.coalesce(F.regexp_replace(seq, rf"(?s).{{{width}}}(?!\z)", "$0\n"), F.lit(""))


def fasta_records(df: DataFrame, header: str = "seq_id", seq: str = "seq", width: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """value: a FASTA record per row."""
    return df.select(*keep, F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrapped(F.col(seq), width)).alias("value"))


def write_fasta(df: DataFrame, path: str, by: str = "seq_id") -> None:
    """One folder for each value of ``by``, whose records meet in one file."""
    records = df.withColumn("_by", F.col(by)).select("_by", F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), wrapped(F.col("seq"))).alias("value"))
    records.withColumnRenamed("_by", by).repartition(by).write.partitionBy(by).text(path)


def gff_lines(df: DataFrame) -> DataFrame:
    """value: nine tab-separated columns, nulls as ``.``."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in GFF]).alias("value"))


def write_gff(df: DataFrame, path: str) -> None:
    gff_lines(df).write.text(path)


def paml_records(alns: DataFrame) -> DataFrame:
    """group_id, value: a sequential alignment of each group: ``\\tN\\tL``, then names and wrapped residues."""
    rows = F.sort_array(F.collect_list(F.struct("species", "aln")))
    out = alns.groupBy("group_id").agg(rows.alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.concat(x["species"], F.lit("\n"), wrapped(x["aln"]))), "\n")
    head = F.concat(F.lit("\t"), F.size("r").cast("string"), F.lit("\t"), F.length(F.col("r")[0]["aln"]).cast("string"), F.lit("\n"))
    return out.select("group_id", F.concat(head, body).alias("value"))


def write_paml(alns: DataFrame, path: str) -> None:
    """One folder and file for each group; what is grouped is dealt by group already."""
    paml_records(alns).write.partitionBy("group_id").text(path)


def write_species_lists(lists: DataFrame, path: str) -> None:
    """Sorted group names, one folder for each species."""
    lists.select("species", F.col("group_id").cast("string").alias("value")).repartition("species").sortWithinPartitions("species", "value").write.partitionBy("species").text(path)


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """value: ``Fam_id, Genes, Species, members``, tab separated."""
    return clusters.select(F.concat_ws("\t", F.col("group_id").cast("string"), F.col("genes").cast("string"), F.col("species").cast("string"), "members").alias("value"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    clusters.select(F.col("group_id").alias("#Fam_id"), F.col("genes").alias("Genes"), F.col("species").alias("Species"), "members").write.csv(path, sep="\t", header=True)


def group_records(seqs: DataFrame) -> DataFrame:
    """group_id, type, value: a FASTA record named by species for each sequence."""
    return seqs.select("group_id", "type", F.concat(F.lit(">"), F.col("species"), F.lit("\n"), wrapped(F.col("seq"))).alias("value"))


def write_group_fasta(seqs: DataFrame, path: str) -> None:
    """Records named by species, one folder and file for each group and type (cds, pep)."""
    group_records(seqs).repartition("group_id", "type").write.partitionBy("group_id", "type").text(path)


def write_ltr_pairs(records: DataFrame, path: str) -> None:
    """Both end records of each element (element, header, seq), one folder and file each."""
    records.select("element", F.concat(F.lit(">"), F.col("header"), F.lit("\n"), wrapped(F.col("seq"))).alias("value")).repartition("element").write.partitionBy("element").text(path)
