"""Formats with a record on each line, and FASTA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.intervals import rechunked
from .lines import file_name, gff, number, read_text, tokens


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seq_id, seq, source_file; a record is a row, however the file is split."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("record"))
    return parse_fasta(rows)


def parse_fasta(records: DataFrame) -> DataFrame:
    """seq_id (first token of the header), seq (lines joined) of records (source_file, record)."""
    text = F.regexp_replace("record", r"^\s*>", "")
    head = F.regexp_extract(text, r"^[^\r\n]*", 0)
    seq = F.regexp_replace(F.substr(text, F.length(head) + 1, F.length(text)), r"\s+", "")
    return records.select(F.split_part(F.translate(F.trim(head), "\t", " "), F.lit(" "), F.lit(1)).alias("seq_id"), seq.alias("seq"), "source_file").where(F.col("seq_id") != "")


def read_fasta_chunks(spark: SparkSession, path: str | list[str], size: int = 1 << 20) -> DataFrame:
    """source_file, record (from 1 in its file), seq_id, chunk_no, chunk_start (from 1), chunk: records in pieces of ``size`` residues.

    No record is ever a row: files are read in splits, line by line. Residues are counted within a split from its last header on;
    what a split lacks, the header it begins under and the residues before, comes from one row for each split. Text before a file's
    first header and records without a name or residues give no rows.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return fasta_chunks(lines, size)


def fasta_chunks(lines: DataFrame, size: int = 1 << 20) -> DataFrame:
    """``read_fasta_chunks`` of lines (source_file, split, id that rises within a split, line)."""
    head = F.col("line").rlike(r"^\s*>")
    name = F.split_part(F.translate(F.trim(F.regexp_replace("line", r"^\s*>", "")), "\t\r", "  "), F.lit(" "), F.lit(1))
    rows = lines.select("source_file", "split", "id", F.when(head, name).alias("name"), F.when(head, F.lit("")).otherwise(F.regexp_replace("line", r"\s+", "")).alias("piece"))
    key = ["source_file", "split"]
    upto = W.partitionBy(*key).orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("*", F.count("name").over(upto).alias("heads"), F.sum(F.length("piece").cast("long")).over(upto).alias("sum"))
    # residues before the last header of the split; their running sum never falls
    rows = rows.select("*", F.max(F.when(F.col("name").isNotNull(), F.col("sum"))).over(upto).alias("before"), F.last("name", ignorenulls=True).over(upto).alias("own"))
    splits = rows.groupBy(*key).agg(F.count("name").alias("heads"), F.max_by("own", "id").alias("last"), F.max(F.col("sum")).alias("sum"), F.max("before").alias("before"))
    earlier = W.partitionBy("source_file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select(*key, "heads", (F.col("sum") - F.coalesce("before", F.lit(0))).alias("tail"), F.coalesce(F.sum("heads").over(earlier), F.lit(0)).alias("records"), F.last("last", ignorenulls=True).over(earlier).alias("under"))
    # residues behind a last header, of all splits before, less those before the last split that has a header
    splits = splits.withColumn("all", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
    base = F.col("all") - F.coalesce(F.last(F.when(F.col("heads") > 0, F.col("all")), ignorenulls=True).over(earlier), F.lit(0))
    joined = rows.join(splits.select(*key, "records", "under", base.alias("base")), key).where("piece <> ''")
    start = F.when(F.col("heads") == 0, F.col("base") + F.col("sum")).otherwise(F.col("sum") - F.col("before")) - F.length("piece") + 1
    pieces = joined.select("source_file", (F.col("records") + F.col("heads")).alias("record"), F.coalesce("own", "under").alias("seq_id"), start.alias("begin"), "piece")
    return rechunked(pieces.where("seq_id <> ''"), ["source_file", "record", "seq_id"], size)


def parse_gff(lines: DataFrame) -> DataFrame:
    """GFF rows: exactly nine tab-separated fields, comments dropped, ``.`` null."""
    f = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("#")).withColumn("f", f).where(F.size("f") == 9)
    field = lambda i: F.nullif(F.trim(F.get("f", F.lit(i))), F.lit("."))
    return gff(rows, seqname=field(0), source=field(1), feature=field(2), start=number(field(3)), stop=number(field(4)), score=number(field(5), "double"), strand=field(6), frame=field(7), attribute=field(8))


def read_gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_gff(read_text(spark, path))


def gff3_attributes(attribute: Column) -> Column:
    """The map of ``key=value;...``."""
    return F.str_to_map(F.regexp_replace(attribute, r";\s*$", ""), F.lit(";"), F.lit("="))


def parse_groups(lines: DataFrame) -> DataFrame:
    """group_id, member, species of lines ``GID: sp|gene sp|gene ...``."""
    rows = lines.withColumn("t", tokens(F.col("line"))).where(F.size("t") > 0)
    rows = rows.select(F.regexp_replace(F.get("t", F.lit(0)), ":$", "").alias("group_id"), F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("member"))
    return rows.select("group_id", "member", F.split_part("member", F.lit("|"), F.lit(1)).alias("species"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return parse_groups(read_text(spark, path))


def parse_gene_totals(lines: DataFrame) -> DataFrame:
    """species, n_genes of lines ``Sp.fasta:N``; another line is an error."""
    pattern = r"^(\w+)\.fasta:(\d+)\s*$"
    wrong = F.raise_error(F.concat(F.lit("not a gene total: "), F.col("line"))).cast("string")
    good = F.when(F.col("line").rlike(pattern), F.col("line")).otherwise(wrong)
    rows = lines.where(F.trim("line") != "").select(good.alias("line"))
    return rows.select(F.regexp_extract("line", pattern, 1).alias("species"), F.regexp_extract("line", pattern, 2).cast("bigint").alias("n_genes"))


def parse_clusters(lines: DataFrame) -> DataFrame:
    """group_id, genes, species, member of ``#``-headed tables with a comma list in the fourth column."""
    rows = lines.where(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 4)
    return rows.select(F.get("f", F.lit(0)).alias("group_id"), number(F.get("f", F.lit(1))).alias("genes"), number(F.get("f", F.lit(2))).alias("n_species"), F.explode(F.split(F.get("f", F.lit(3)), ",")).alias("member"))


def parse_family_matrix(lines: DataFrame, species: list[str]) -> DataFrame:
    """family_id, species, n of lines ``Desc, Family ID, counts`` (tabs); ``species`` names the count columns."""
    rows = lines.where(~F.col("line").startswith("Desc\t")).withColumn("f", F.split("line", "\t")).where(F.size("f") == len(species) + 2)
    pairs = F.arrays_zip(F.array(*map(F.lit, species)).alias("species"), F.slice("f", 3, len(species)).alias("n"))
    return rows.select(F.get("f", F.lit(1)).alias("family_id"), F.explode(pairs).alias("p")).select("family_id", F.col("p")["species"].alias("species"), number(F.col("p")["n"]).alias("n"))


def read_family_matrix(spark: SparkSession, path: str) -> DataFrame:
    """family_id, species, n; species names come from the header, read by Spark."""
    wide = spark.read.csv(path, sep="\t", header=True)
    ids = wide.columns[:2]
    return wide.unpivot(ids, wide.columns[2:], "species", "n").select(F.col(ids[1]).alias("family_id"), "species", number(F.col("n")).alias("n"))


def parse_psl(lines: DataFrame) -> DataFrame:
    """Alignments of lines that start with two numbers: q_name, q_size, t_name, strand, block_sizes, q_starts."""
    rows = lines.where(F.col("line").rlike(r"^\d+\t\d+\t")).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 21)
    numbers = lambda i: F.transform(F.filter(F.split(F.get("f", F.lit(i)), ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    return rows.select(F.get("f", F.lit(9)).alias("q_name"), number(F.get("f", F.lit(10))).alias("q_size"), F.get("f", F.lit(13)).alias("t_name"), F.get("f", F.lit(8)).alias("strand"), numbers(18).alias("block_sizes"), numbers(19).alias("q_starts"))


def parse_lengths(lines: DataFrame) -> DataFrame:
    """seq_id, length."""
    t = tokens(F.col("line"))
    return lines.withColumn("t", t).where(F.size("t") >= 2).select(F.get("t", F.lit(0)).alias("seq_id"), number(F.get("t", F.lit(1))).alias("length")).where("length is not null")


BLAST = ("qry", "sub", "pid", "len", "mism", "gap", "qs", "qe", "ss", "se", "e", "bits")
BLAST_TYPES = ("string", "string", "double", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "double", "double")


def parse_blast_tab(lines: DataFrame) -> DataFrame:
    """Tabular hits, comments dropped."""
    rows = lines.where(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t")).where(F.size("f") == 12)
    return rows.select("source_file", *[number(F.trim(F.get("f", F.lit(i))), t).alias(c) for i, (c, t) in enumerate(zip(BLAST, BLAST_TYPES, strict=True))])


def blast_to_gff(hits: DataFrame, program: str = "blast", feature: str = "match") -> DataFrame:
    """Hits as features on the query: ascending span, strand from the orientation, bit score; the source is program:db, with the
    database in the file's name after the first ``_``."""
    db = F.regexp_extract(file_name(F.col("source_file")), r"^[^_]*_(.*)$", 1)
    turned = (F.col("qs") > F.col("qe")) != (F.col("ss") > F.col("se"))
    return gff(hits, seqname=F.col("qry"), source=F.concat_ws(":", F.lit(program), F.nullif(db, F.lit(""))), feature=F.lit(feature), start=F.least("qs", "qe"), stop=F.greatest("qs", "qe"), score=F.col("bits"), strand=F.when(turned, "-").otherwise("+"), attribute=F.col("sub"))


def rm_to_gff(lines: DataFrame, all_plus: bool = False) -> DataFrame:
    """Repeat-finder tables (13 tokens or more, numeric score first): ``C`` is the minus strand, unless all are taken as plus."""
    rows = lines.withColumn("t", tokens(F.col("line"))).where((F.size("t") >= 13) & F.get("t", F.lit(0)).rlike(r"^\d+$"))
    t = lambda i: F.get("t", F.lit(i))
    strand = F.lit("+") if all_plus else F.when(t(8) == "C", "-").otherwise(t(8))
    return gff(rows, seqname=t(4), source=F.lit("repeatmasker"), feature=F.lit("repeat_region"), start=number(t(5)), stop=number(t(6)), score=number(t(0), "double"), strand=strand, attribute=t(9))


def geneid_to_gff(lines: DataFrame) -> DataFrame:
    """Gene-finder GFF with First, Internal, Single and Terminal as ``exon``."""
    rows = parse_gff(lines)
    return rows.withColumn("feature", F.when(F.col("feature").isin("First", "Internal", "Single", "Terminal"), "exon").otherwise(F.col("feature")))


def eugene_to_gff(lines: DataFrame) -> DataFrame:
    """Gene-finder GFF without UTR rows; the model's number is the second dot part of the name."""
    rows = parse_gff(lines).where(~F.col("feature").isin("UTR5", "UTR3"))
    return rows.withColumn("attribute", F.concat(F.lit("eugene_simp_"), F.split_part("attribute", F.lit("."), F.lit(2))))


def parse_depth(lines: DataFrame) -> DataFrame:
    """sample, depth (fifth column); lines that start with ``#`` or ``ID`` are headers."""
    rows = lines.where(~F.col("line").rlike("^(#|ID)")).withColumn("t", tokens(F.col("line"))).where(F.size("t") >= 5)
    return rows.select(F.get("t", F.lit(0)).alias("sample"), number(F.get("t", F.lit(4)), "double").alias("depth"))


def read_classified(records: DataFrame) -> DataFrame:
    """element, family, seq of FASTA rows named ``id#family``: families that are no LTR are LTR_unknown, ``/`` becomes ``_``."""
    rows = records.where(F.col("seq_id").contains("_LTRFinder_"))
    family = F.split_part("seq_id", F.lit("#"), F.lit(2))
    return rows.select(F.split_part("seq_id", F.lit("#"), F.lit(1)).alias("element"), F.when(F.startswith(family, F.lit("LTR")), F.translate(family, "/", "_")).otherwise("LTR_unknown").alias("family"), "seq")
