"""Reading text: records of a line each, whole reports as numbered lines, and helpers for blocks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..operators.numbering import numbered


def read_lines(spark: SparkSession, path: str | list[str], large: bool = False, limit: int | None = None) -> DataFrame:
    """source_file, line_no, line of every report.

    A report is one task's row. ``large`` ones are cut in splits instead: lines are numbered within a split and shifted by those of
    the splits before, and a column split makes ``blocks`` and ``carried`` work on stretches of a report, so that no task holds one. With a ``limit`` only files of at most so many
    bytes are read, or, of large ones, only those of more.
    """
    size = F.col("_metadata.file_size")
    kept = F.lit(True) if limit is None else size > limit if large else size <= limit
    if not large:
        return numbered_lines(spark.read.text(path, wholetext=True).where(kept).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text")))
    rows = spark.read.text(path).where(kept).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("_id"))
    return numbered(rows, ["_id"], F.col("split"), "line_no", by=("source_file",)).drop("_id")


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, line of formats whose lines stand alone; files of any size are split."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("line"))


def numbered_lines(reports: DataFrame) -> DataFrame:
    """source_file, line_no, line of reports (source_file, text)."""
    return reports.select("source_file", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def tokens(line: Column) -> Column:
    """The runs of a line between white space."""
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def number(text: Column, kind: str = "bigint") -> Column:
    """A number, or null for text that is none."""
    return text.try_cast(kind)


def pick(line: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern's match; null without a match."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def in_file() -> WindowSpec:
    """A file's lines up to the present one."""
    return W.partitionBy("source_file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)


def blocks(lines: DataFrame, header: str, out: str = "block") -> DataFrame:
    """``lines`` with ``out``: how many lines that match ``header`` came so far in the file (0 before the first)."""
    mark = F.col("line").rlike(header).cast("int")
    if "split" not in lines.columns:
        return lines.withColumn(out, F.sum(mark).over(in_file()))
    before = F.coalesce(F.sum("_n").over(_splits()), F.lit(0)).alias("_before")
    shift = lines.groupBy("source_file", "split").agg(F.sum(mark).alias("_n")).select("source_file", "split", before)
    return lines.join(shift, ["source_file", "split"]).withColumn(out, F.col("_before") + F.sum(mark).over(_in_split())).drop("_before")


def carried(lines: DataFrame, value: Column, out: str) -> DataFrame:
    """``lines`` with ``out``: the last value that was not null so far in the file."""
    rows, last = lines.withColumn("_v", value), F.last("_v", ignorenulls=True)
    if "split" not in lines.columns:
        return rows.withColumn(out, last.over(in_file())).drop("_v")
    ends = rows.where(F.col("_v").isNotNull()).groupBy("source_file", "split").agg(F.max_by("_v", "line_no").alias("_v"))
    ends = lines.select("source_file", "split").distinct().join(ends, ["source_file", "split"], "left").select("source_file", "split", last.over(_splits()).alias("_before"))
    return rows.join(ends, ["source_file", "split"]).withColumn(out, F.coalesce(last.over(_in_split()), "_before")).drop("_v", "_before")


def running(lines: DataFrame, out: str) -> DataFrame:
    """``lines`` with ``out``: their numbers from 1 in the file, as text."""
    if "split" not in lines.columns:
        n = F.row_number().over(W.partitionBy("source_file").orderBy("line_no"))
        return lines.withColumn(out, n.cast("string"))
    return numbered(lines, ["line_no"], F.col("split"), out, by=("source_file",)).withColumn(out, (F.col(out) + 1).cast("string"))


def _in_split() -> WindowSpec:
    return W.partitionBy("source_file", "split").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)


def _splits() -> WindowSpec:
    """The splits of a file before the present one."""
    return W.partitionBy("source_file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)


def file_name(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


GFF = ("seqname", "source", "feature", "start", "stop", "score", "strand", "frame", "attribute")


def gff(df: DataFrame, **cols: Column) -> DataFrame:
    """source_file and the nine GFF columns; those not given are null."""
    kinds = {"start": "bigint", "stop": "bigint", "score": "double"}
    return df.select("source_file", *[cols.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in GFF])
