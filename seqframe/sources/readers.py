"""Readers by path: ``read_x(spark, path)`` gives the rows of all files of a format. ``path`` is a file, a folder, a pattern or a list.

Formats with a record on each line are split wherever Spark likes. A report of many lines is one row if its file has at most
``SMALL`` bytes; a larger one is read in splits, and its blocks are found across them. One call reads both kinds, and ``large`` (all
files are, or none is) only spares it the look at their sizes. Further options are those of the parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models as M
from . import reports as R
from . import tables as T
from .lines import read_lines, read_text
from .tables import read_family_matrix, read_fasta, read_fasta_chunks, read_gff, read_groups
from .trees import read_codeml_clade, read_time_tree_nodes

Path = str | list[str]


def _records(parse: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, path: Path, **options) -> DataFrame:
        return parse(read_text(spark, path), **options)

    read.__doc__ = parse.__doc__
    return read


#: Bytes of a file that one task may hold as a row.
SMALL = 16 << 20


def _reports(parse: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, path: Path, large: bool | None = None, **options) -> DataFrame:
        if large is not None:
            return parse(read_lines(spark, path, large), **options)
        # sizes come from the listing; no content is read
        size = spark.read.format("binaryFile").load(path).agg(F.min("length"), F.max("length")).first()
        if size[1] is None or size[1] <= SMALL:
            return parse(read_lines(spark, path), **options)
        if size[0] > SMALL:
            return parse(read_lines(spark, path, True), **options)
        few, many = (parse(read_lines(spark, path, kind, SMALL), **options) for kind in (False, True))
        return few.unionByName(many)

    read.__doc__ = parse.__doc__
    return read


read_gene_totals = _records(T.parse_gene_totals)
read_clusters = _records(T.parse_clusters)
read_psl = _records(T.parse_psl)
read_lengths = _records(T.parse_lengths)
read_blast_tab = _records(T.parse_blast_tab)
read_repeatmasker = _records(T.rm_to_gff)
read_geneid = _records(T.geneid_to_gff)
read_eugene = _records(T.eugene_to_gff)
read_depth = _records(T.parse_depth)

read_ltrfinder = _reports(R.ltrfinder_to_gff)
read_ltrfinder_summary = _reports(R.ltrfinder_summary)
read_ltrseq = _reports(R.ltrseq_to_gff)
read_findltr = _reports(R.findltr_to_gff)
read_repseek = _reports(R.repseek_to_gff)
read_trf = _reports(R.trf_to_gff)
read_tenest = _reports(R.tenest_to_gff)
read_findmite = _reports(R.findmite_to_gff)
read_genscan = _reports(R.genscan_to_gff)
read_genemark = _reports(R.genemark_to_gff)
read_codeml_branch = _reports(M.codeml_branch)
read_codeml_freeratio = _reports(M.codeml_freeratio)
read_codeml_branchsite = _reports(M.codeml_branchsite)
read_psmc = _reports(M.read_psmc)
read_pair_distance = _reports(M.read_pair_distance)
read_time_tree = _reports(M.read_time_tree)


def read_blast_gff(spark: SparkSession, path: Path, **options) -> DataFrame:
    """Tabular hits as features on the query."""
    return T.blast_to_gff(read_blast_tab(spark, path), **options)


def read_classified(spark: SparkSession, path: Path) -> DataFrame:
    """Classified elements of FASTA files."""
    return T.read_classified(read_fasta(spark, path))


__all__ = sorted(n for n in dir() if n.startswith("read_") and n not in ("read_lines", "read_text"))
