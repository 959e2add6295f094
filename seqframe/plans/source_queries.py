"""Queries that write the tables' rows in a report's layout and read them back: the SQL takes the rows directly.

Reports are built by Spark, one for each sequence or order, so the work follows the tables.
"""

from pyspark.sql import functions as F

from ..operators import groups as G
from ..sources import lines as L
from ..sources import models as M
from ..sources import reports as R
from ..sources import sinks as K
from ..sources import tables as T
from ..sources import trees as N
from .registry import query


def text(pattern: str, *cols):
    return F.format_string(pattern, *cols)


def lines(df, path, line):
    """One-line records as (source_file, line)."""
    return df.select(path.alias("source_file"), line.alias("line"))


def dealt(suffix: str = "", folder: str = "d"):
    """Path of the report that an event of a sequence stands in: events are dealt in thousands, so reports stay small."""
    return F.concat(F.lit(folder), F.floor(F.col("event_id") / 1000).cast("string"), F.lit("/"), "seqname", F.lit(suffix))


def reports(df, path, order, block, head: str = "", foot: str = ""):
    """Numbered lines of one report for each path: a head, the rows' blocks in order, a foot."""
    parts = F.sort_array(F.collect_list(F.struct(*order, block.alias("_block"))))
    whole = df.withColumn("_path", path).groupBy("_path").agg(parts.alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["_block"]), "\n")
    return L.numbered_lines(whole.select(F.col("_path").alias("source_file"), F.concat(F.lit(head), body, F.lit(foot)).alias("text")))


def whole_reports(df, path, block, head: str = ""):
    """(source_file, text) where every row is a report of its own: nothing is gathered. Paths must differ."""
    return df.select(path.alias("source_file"), F.concat(F.lit(head), F.coalesce(block, F.lit(""))).alias("text"))


@query("SELECT seq_id, md5(seq) AS seq FROM {seq_v} WHERE length(seq) > 0")
def s1_fasta(get):
    rows = get("seq_v").where("length(seq) > 0")
    records = K.fasta_records(rows.withColumn("head", F.concat("seq_id", F.lit(" a test"))), "head").select(F.lit("x.fa").alias("source_file"), F.col("value").alias("record"))
    return T.parse_fasta(records).select("seq_id", F.md5("seq").alias("seq"))


def _gff(get):
    f = get("features_v")
    rows = L.gff(f.withColumn("source_file", F.lit("x.gff")), seqname=F.col("seqname"), source=F.lit("demo"), feature=F.col("track"), start=F.col("start"), stop=F.col("stop"), strand=F.lit("+"), attribute=F.concat(F.lit("ID="), F.col("event_id").cast("string"), F.lit(";Name=n")))
    return lines(K.gff_lines(rows), F.lit("x.gff"), F.col("value"))


@query("SELECT seqname, track AS feature, start, stop, CAST(NULL AS DOUBLE) AS score, CAST(event_id AS STRING) AS id FROM {features_v}")
def s2_k2_gff(get):
    rows = _gff(get).unionByName(lines(get("region"), F.lit("x.gff"), F.concat(F.lit("# "), F.col("r_name"))))
    return T.parse_gff(rows).select("seqname", "feature", "start", "stop", "score", T.gff3_attributes(F.col("attribute"))["ID"].alias("id"))


@query("SELECT CAST(group_id AS STRING) AS group_id, species || '|' || gene AS member, species FROM {groups_v}")
def s3_groups(get):
    rows = get("groups_v").groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "species", "gene"))), " ").alias("m"))
    return T.parse_groups(lines(rows, F.lit("groups.txt"), F.concat(F.col("group_id").cast("string"), F.lit(": "), F.col("m"))))


@query("SELECT species, n_genes FROM {gene_totals_v}")
def s4_gene_totals(get):
    return T.parse_gene_totals(lines(get("gene_totals_v"), F.lit("n.txt"), text("%s.fasta:%d", "species", "n_genes")))


@query("SELECT CAST(group_id AS STRING) AS group_id, count(*) OVER (PARTITION BY group_id) AS genes, species || '|' || gene AS member FROM {groups_v}")
def s5_k5_clusters(get):
    return T.parse_clusters(lines(K.cluster_lines(G.cluster_summary(get("groups_v"))), F.lit("c.txt"), F.col("value"))).select("group_id", "genes", "member")


@query("SELECT CAST(group_id AS STRING) AS family_id, s AS species, count(*) FILTER (WHERE species = s) AS n FROM {groups_v} CROSS JOIN (SELECT unnest(['S0', 'S1', 'S2', 'S3']) AS s) GROUP BY ALL")
def s6_family_matrix(get):
    species = ["S0", "S1", "S2", "S3"]
    rows = G.family_matrix(get("groups_v"), species)
    return T.parse_family_matrix(lines(rows, F.lit("m.txt"), F.concat_ws("\t", F.lit("(null)"), *[F.col(c).cast("string") for c in ("group_id", *species)])), species)


def _psl(get):
    b = get("blocks_v")
    zero = F.lit("0")
    start = F.when(F.col("size") % 2 == 0, F.col("qlen") - F.col("qstart") - F.col("size")).otherwise(F.col("qstart"))
    row = F.concat_ws("\t", *[zero] * 8, F.when(F.col("size") % 2 == 0, "-").otherwise("+"), F.col("query"), F.col("qlen").cast("string"), zero, zero, F.col("target"), zero, zero, zero, F.lit("1"), F.concat(F.col("size").cast("string"), F.lit(",")), F.concat(start.cast("string"), F.lit(",")), F.lit("0,"))
    return T.parse_psl(lines(b, F.lit("x.psl"), row))


@query("SELECT query, qlen, target, qstart + 1 AS qstart, size FROM {blocks_v}")
def s7_psl(get):
    from ..operators.intervals import psl_blocks

    return psl_blocks(_psl(get))


@query("SELECT 'p' || CAST(p_partkey AS STRING) AS seq_id, CAST(p_size AS BIGINT) AS length FROM part")
def s8_lengths(get):
    return T.parse_lengths(lines(get("part"), F.lit("l.txt"), text("p%d\t%d", "p_partkey", "p_size")))


def _hits(get):
    h = get("hits_v").withColumn("k", F.pmod(F.length("qry"), F.lit(2)))
    row = F.concat_ws("\t", "qry", "sub", F.lit("97.5"), F.lit("100"), F.lit("1"), F.lit("0"), F.lit("11"), F.lit("110"), F.when(F.col("k") == 0, "210").otherwise("111"), F.when(F.col("k") == 0, "111").otherwise("210"), F.lit("1e-20"), F.col("bits").cast("string"))
    return T.parse_blast_tab(lines(h, F.lit("dir/HEX_TREP9.bln"), row))


@query("SELECT qry, sub, 97.5::DOUBLE AS pid, round(bits, 4) AS bits FROM {hits_v}")
def s9_blast_tab(get):
    return _hits(get).select("qry", "sub", "pid", F.round("bits", 4).alias("bits"))


@query("SELECT qry AS seqname, 'blast:TREP9' AS source, 11::BIGINT AS start, 110::BIGINT AS stop, round(bits, 4) AS score, CASE WHEN length(qry) % 2 = 0 THEN '-' ELSE '+' END AS strand, sub AS attribute FROM {hits_v}")
def s10_blast_to_gff(get):
    return T.blast_to_gff(_hits(get)).select("seqname", "source", "start", "stop", F.round("score", 4).alias("score"), "strand", "attribute")


@query("SELECT seqname, start, stop, CASE WHEN event_id % 2 = 0 THEN '-' ELSE '+' END AS strand, 'R' || CAST(event_id AS STRING) AS attribute FROM {features_v}")
def s12_repeatmasker(get):
    f = get("features_v")
    row = text("  469 36.2  0.7  1.6 %s  %d  %d (80657) %s  R%d  Unknown  1482 1784 (3156)", "seqname", "start", "stop", F.when(F.col("event_id") % 2 == 0, "C").otherwise("+"), "event_id")
    return T.rm_to_gff(lines(f, F.lit("x.out"), row)).select("seqname", "start", "stop", "strand", "attribute")


def _ltrfinder(get):
    f = get("features_v").withColumn("n", F.col("event_id"))
    block = text("[%d] %s Len:82726\nLocation : %d - %d Len: 1 Strand:%s\nScore    : 7 [LTR region similarity:0.964]\nStatus   : 11111110000\n5'-LTR   : %d - %d Len: 2\n3'-LTR   : %d - %d Len: 2\nTSR      : %s\nPBS   : [16/17] %d - %d (MetCAT)\nDomain: %d - %d [possible ORF:%d-%d, (reverse transcriptase)]\n", "n", "seqname", "start", F.col("stop") + 100, F.when(F.col("n") % 2 == 0, "-").otherwise("+"), "start", F.col("start") + 10, F.col("stop") + 90, F.col("stop") + 100, F.when(F.col("n") % 3 == 0, "NOT FOUND").otherwise(text("%d - %d , %d - %d [CTTTT]", F.col("start") - 5, F.col("start") - 1, F.col("stop") + 101, F.col("stop") + 105)), F.col("start") + 12, F.col("start") + 20, F.col("start") + 30, F.col("start") + 40, F.col("start") + 28, F.col("start") + 44)
    return reports(f, dealt(), ["n"], block, head="Program    : LTR_FINDER\n\n")


LTRF = " UNION ALL ".join(
    f"SELECT seqname, '{name}' AS feature, {a} AS start, {b} AS stop, 7::DOUBLE AS score, CASE WHEN event_id % 2 = 0 THEN '-' ELSE '+' END AS strand, 'ltr_finder_' || CAST(event_id AS STRING) AS attribute FROM {{features_v}} WHERE {when}"
    for name, a, b, when in [
        ("LTR_retrotransposon", "start", "stop + 100", "true"), ("five_prime_LTR", "start", "start + 10", "true"), ("three_prime_LTR", "stop + 90", "stop + 100", "true"),
        ("primer_binding_site", "start + 12", "start + 20", "true"), ("target_site_duplication", "start - 5", "start - 1", "event_id % 3 <> 0 AND start >= 5"), ("target_site_duplication", "stop + 101", "stop + 105", "event_id % 3 <> 0 AND start >= 5"),
        ("rt_domain", "start + 30", "start + 40", "true"), ("rt_orf", "start + 28", "start + 44", "true"),
    ]
)


@query(LTRF)
def s13_ltrfinder(get):
    return R.ltrfinder_to_gff(_ltrfinder(get)).select("seqname", "feature", "start", "stop", "score", "strand", "attribute")


@query("SELECT seqname || '_LTRFinder_def' || CAST(event_id AS STRING) AS element, start AS element_start, stop + 100 AS element_stop, 0.964::DOUBLE AS similarity, 1::BIGINT AS n_domains FROM {features_v}")
def s14_ltrfinder_summary(get):
    return R.ltrfinder_summary(_ltrfinder(get)).select("element", "element_start", "element_stop", "similarity", "n_domains")


def _numbered(where: str = "true") -> str:
    return f"(SELECT *, CAST(row_number() OVER (PARTITION BY seqname, floor(event_id / 1000) ORDER BY event_id) AS STRING) AS no FROM {{features_v}} WHERE {where})"


def _three(seq: str, where: str, score: str, attribute: str, strand: str = "NULL") -> str:
    parts = [("LTR_retrotransposon", "start", "stop + 50"), ("five_prime_LTR", "start", "start + 9"), ("three_prime_LTR", "stop + 41", "stop + 50")]
    return " UNION ALL ".join(f"SELECT seqname, '{n}' AS feature, {a} AS start, {b} AS stop, {score} AS score, CAST({strand} AS STRING) AS strand, {attribute} AS attribute FROM {_numbered(where)}" for n, a, b in parts)


@query(_three("seqname", "event_id % 3 <> 0", "0.5::DOUBLE", "seqname || '_ltrseq_' || no"))
def s15_ltrseq(get):
    f = get("features_v")
    good = text("Report: String 0 Accepted  %d %d ... %d %d  length 10  span 50 diff 7.0 Confidence 0.500000 TSR #GAATT#\n", "start", F.col("start") + 9, F.col("stop") + 41, F.col("stop") + 50)
    bad = text("Report: String 0 Rejected %d %d ... %d %d  length 441  span 1252 diff 18.7\n", "start", F.col("start") + 9, "stop", "stop")
    rows = reports(f, dealt(".txt"), ["event_id"], F.when(F.col("event_id") % 3 == 0, bad).otherwise(good))
    return R.ltrseq_to_gff(rows).select("seqname", "feature", "start", "stop", "score", "strand", "attribute")


@query(_three("seqname", "true", "NULL::DOUBLE", "seqname || '_findltr_' || CAST(event_id AS STRING)", "CASE WHEN event_id % 2 = 0 THEN '-' ELSE '+' END"))
def s16_findltr(get):
    row = text("%d\t%d\t%d\t%d\t%d\t%s\t10\t10\t30\t98.6", "event_id", "start", F.col("start") + 9, F.col("stop") + 41, F.col("stop") + 50, F.when(F.col("event_id") % 2 == 0, "-").otherwise("+"))
    rows = lines(get("features_v"), F.concat(F.lit("d/"), "seqname", F.lit(".txt")), row)
    return R.findltr_to_gff(rows).select("seqname", "feature", "start", "stop", "score", "strand", "attribute")


REPSEEK = " UNION ALL ".join(f"SELECT seqname, CASE WHEN event_id % 2 = 0 THEN 'overlapping_inverted_repeat' ELSE 'direct_repeat' END AS feature, {a} AS start, {b} AS stop, 33.5::DOUBLE AS score, 'repseek' || no || CASE WHEN event_id % 2 = 0 THEN ':inv' ELSE ':dir' END AS attribute FROM {_numbered()}" for a, b in (("start", "start + 47"), ("stop + 100", "stop + 151")))


@query(REPSEEK)
def s17_repseek(get):
    row = text("%s\t%d\t%d\t48\t52\t-24\t119-143-20-3.05\t84.6\t33.5\t2.5\t2\t0.5", F.when(F.col("event_id") % 2 == 0, "Overlap.inv").otherwise("Distant.dir"), "start", F.col("stop") + 100)
    rows = reports(get("features_v"), dealt(".txt"), ["event_id"], row)
    return R.repseek_to_gff(rows).select("seqname", "feature", "start", "stop", "score", "attribute")


@query(f"SELECT seqname, start, stop, 77::DOUBLE AS score, 'TRF' || CASE WHEN length(no) < 4 THEN lpad(no, 4, '0') ELSE no END AS attribute FROM {_numbered()}")
def s18_trf(get):
    row = text("%d %d 3 2.0 3 90 5 77 10 20 30 40 1.5 ACG ACGACG", "start", "stop")
    rows = reports(get("features_v"), dealt(".dat"), ["event_id"], row, head="Tandem Repeats Finder\n\n")
    return R.trf_to_gff(rows).select("seqname", "start", "stop", "score", "attribute")


TENEST = " UNION ALL ".join(f"SELECT seqname, '{n}' AS feature, {a} AS start, {b} AS stop, 'pair_Angela_p' || CAST(event_id AS STRING) AS attribute FROM {{features_v}}" for n, a, b in (("five_prime_LTR_component", "start", "start + 9"), ("three_prime_LTR_component", "stop + 41", "stop + 50"), ("LTR_retrotransposon", "start + 10", "start + 15"), ("LTR_retrotransposon", "start + 20", "start + 30")))


@query(TENEST)
def s19_tenest(get):
    i = F.col("event_id")
    block = text("PAIR p%d Angela 0 0.029 1 1 0\np%d L %d %d 1 10\np%d R %d %d 1 10\np%d M %d %d 1 6 %d %d 7 16", i, i, "start", F.col("start") + 9, i, F.col("stop") + 41, F.col("stop") + 50, i, F.col("start") + 10, F.col("start") + 15, F.col("start") + 30, F.col("start") + 20)
    rows = reports(get("features_v"), dealt(".LTR"), ["event_id"], block, head="82726\nqry-1\n")
    return R.tenest_to_gff(rows).select("seqname", "feature", "start", "stop", "attribute")


@query(f"SELECT seqname, 'findmite:TA_11' AS source, start, stop, seqname || '_TA_11_' || no AS attribute FROM {_numbered()}")
def s20_findmite(get):
    block = text("\nPattern  : AAAATC\nSequence : >%s\nMismatch : 1\nNNNNACCA(%d)-----AAAATC\nTTCG-----(%d)GGG", "seqname", "start", "stop")
    rows = reports(get("features_v"), dealt(), ["event_id"], block, head="Direct repeats               : TA\nLength of TIR(3-15)          : 11\n")
    return R.findmite_to_gff(rows).select("seqname", "source", "start", "stop", "attribute")


@query("SELECT seqname, start, stop, 0.892::DOUBLE AS score, CASE WHEN event_id % 2 = 0 THEN '-' ELSE '+' END AS strand, 'gene_' || CAST(event_id AS STRING) AS attribute FROM {features_v}")
def s21_genscan(get):
    i, minus = F.col("event_id"), F.col("event_id") % 2 == 0
    block = text(" %d.00 Prom +    400    439   40                               3.92\n %d.01 Init %s  %d  %d   28  0  1  132  100   -33 0.892   4.63", i, i, F.when(minus, "-").otherwise("+"), F.when(minus, F.col("stop")).otherwise(F.col("start")), F.when(minus, F.col("start")).otherwise(F.col("stop")))
    rows = reports(get("features_v"), dealt(".out"), ["event_id"], block, head="GENSCAN 1.0\n\nGn.Ex Type S .Begin ...End\n----- ---- - ------ ------\n\n", foot="\n\nPredicted peptide sequence(s):\n\n 9.01 Init + 1 2 28 0 1 132 100 -33 0.892 4.63")
    return R.genscan_to_gff(rows).select("seqname", "start", "stop", "score", "strand", "attribute")


@query(f"SELECT seqname, start, stop, '-' AS strand, 'RNA' || CASE WHEN length(no) < 4 THEN lpad(no, 4, '0') ELSE no END AS attribute FROM {_numbered()}")
def s22_genemark(get):
    block = text("\n  %d     1   -  Initial      %d     %d      50          2 1", "event_id", "start", "stop")
    rows = reports(get("features_v"), dealt(".out"), ["event_id"], block, head="GeneMark.hmm (Version 2.2a)\n\nPredicted genes/exons\n")
    return R.genemark_to_gff(rows).select("seqname", "start", "stop", "strand", "attribute")


@query("SELECT seqname, CASE WHEN event_id % 3 = 0 THEN 'exon' ELSE 'Other' END AS feature, start, stop FROM {features_v}")
def s23_geneid(get):
    row = F.concat_ws("\t", "seqname", F.lit("geneid"), F.when(F.col("event_id") % 3 == 0, "Internal").otherwise("Other"), F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("1.5"), F.lit("+"), F.lit("0"), F.lit("gene_1"))
    return T.geneid_to_gff(lines(get("features_v"), F.lit("x"), row)).select("seqname", "feature", "start", "stop")


@query("SELECT seqname, start, stop, 'eugene_simp_' || CAST(event_id AS STRING) AS attribute FROM {features_v} WHERE event_id % 4 <> 0")
def s24_eugene(get):
    row = F.concat_ws("\t", "seqname", F.lit("EuGene"), F.when(F.col("event_id") % 4 == 0, "UTR5").otherwise("E.Intr"), F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("0"), F.lit("+"), F.lit("."), text("HEX.%d.0", "event_id"))
    return T.eugene_to_gff(lines(get("features_v"), F.lit("x"), row)).select("seqname", "start", "stop", "attribute")


@query("SELECT CAST(cluster AS STRING) AS cluster, CASE WHEN model = 1 THEN 'All' ELSE 'm' || CAST(model AS STRING) END AS model, np, round(lnl, 6) AS lnl, CASE WHEN model = 1 THEN 0.5 ELSE 0.25 END::DOUBLE AS w1, CASE WHEN model = 1 THEN 0.5 ELSE 1.75 END::DOUBLE AS w2 FROM {fits_v}")
def s25_codeml_branch(get):
    f = get("fits_v")
    block = F.concat(text("lnL(ntime: 11  np: %d):  %.6f      +0.000000\n", "np", "lnl"), F.when(F.col("model") == 1, "omega (dN/dS) =  0.5000").otherwise("w (dN/dS) for branches:  0.25000 1.75000"))
    rows = whole_reports(f, text("d/%d_m%d.mlc", "cluster", "model"), block, head="seed used = 1\n\n")
    return M.codeml_branch(rows).withColumn("lnl", F.round("lnl", 6))


KAKS = "(SELECT cluster, species, max(n) AS n, max(s) AS s, max(dn) AS dn, max(ds) AS ds FROM {kaks_v} GROUP BY ALL)"


@query("SELECT CAST(cluster AS STRING) AS cluster, species, 300::BIGINT AS len, round(250.5 * dn, 6) AS ndn, round(50.5 * ds, 6) AS sds, round(dn, 4) AS dn, round(ds, 4) AS ds FROM {kaks_v}")
def s26_codeml_freeratio(get):
    k = get("kaks_v")
    rows = k.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("species", "dn", "ds"))).alias("t"))
    tree = lambda field, mark: F.concat(F.lit("("), F.array_join(F.transform("t", lambda x: F.concat(x["species"], F.lit(mark), x[field].cast("string"))), ", "), F.lit(");"))
    whole = F.concat(F.lit(" 4 300\n\n   6..1  0.1  10.0  10.0\n   6..2  0.1  250.5  50.5  0.2\ndS tree:\n"), tree("ds", ": "), F.lit("\ndN tree:\n"), tree("dn", ": "), F.lit("\nw ratios as labels for TreeView:\n"), tree("dn", " #"))
    numbered = L.numbered_lines(rows.select(text("d/%d.mlc", "cluster").alias("source_file"), whole.alias("text")))
    return M.codeml_freeratio(numbered).select("cluster", "species", "len", F.round("ndn", 6).alias("ndn"), F.round("sds", 6).alias("sds"), F.round("dn", 4).alias("dn"), F.round("ds", 4).alias("ds"))


@query("SELECT CAST(l_orderkey AS STRING) AS cluster, 'T1' AS label, round(max(l_discount), 4) AS dn, round(max(l_tax), 4) AS ds, round(max(l_quantity), 4) AS w FROM lineitem GROUP BY l_orderkey")
def s27_clade_rates(get):
    x = get("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("cluster")).agg(F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_quantity").alias("q"))
    tree = lambda c, m: F.concat(F.lit(f"((T1{m}1, T11{m}2){m}"), F.col(c).cast("string"), F.lit(f", T2{m}4);"))
    fits = x.select("cluster", tree("d", ": ").alias("dn_tree"), tree("t", ": ").alias("ds_tree"), tree("q", " #").alias("w_tree"))
    marked = x.select("cluster", F.lit("T1").alias("label"), F.lit(1).alias("up"))
    return M.clade_rates(fits, marked).select("cluster", "label", *[F.round(c, 4).alias(c) for c in ("dn", "ds", "w")])


@query("SELECT CAST(cluster AS STRING) AS cluster, species, 'nofix' AS kind, -1234.5::DOUBLE AS lnl, 2.5::DOUBLE AS w, CASE WHEN cluster % 2 = 0 THEN 2 END::INT AS n_sites FROM (SELECT DISTINCT cluster, species FROM {kaks_v}) WHERE cluster % 5 <> 0")
def s28_codeml_branchsite(get):
    k = get("kaks_v").select("cluster", "species").distinct()
    lnl = F.when(F.col("cluster") % 5 == 0, "no result").otherwise("lnL(ntime: 11  np: 16):  -1234.500000  +0.0")
    beb = F.when(F.col("cluster") % 2 == 0, "Bayes Empirical Bayes (BEB) analysis\nPositive sites for foreground lineages Prob(w>1):\n    10 K 0.987*\n    22 A 0.612\n\nThe grid (see ternary graph)\n").otherwise("")
    block = F.concat(lnl, F.lit("\nforeground w     0.1  1.0  2.5  1.5\n"), beb)
    return M.codeml_branchsite(L.numbered_lines(whole_reports(k, text("d/%d/%s/nofix.mlc", "cluster", "species"), block))).select("cluster", "species", "kind", "lnl", "w", F.when(F.col("sites").isNotNull(), F.size("sites")).alias("n_sites"))


@query("SELECT DISTINCT CAST(cluster AS STRING) AS cluster FROM {kaks_v} WHERE cluster % 5 = 0")
def s28_missing_fits(get):
    k = get("kaks_v").select("cluster").distinct()
    block = F.when(F.col("cluster") % 5 == 0, "no result").otherwise("lnL(ntime: 11  np: 16):  -1234.500000  +0.0")
    return M.missing_fits(L.numbered_lines(whole_reports(k, F.col("cluster").cast("string"), block))).select(F.col("source_file").alias("cluster"))


@query("SELECT 'u' || CAST(user_id % 50 AS STRING) AS sample, event_id AS round, round(value, 3) AS fit, 0.01::DOUBLE AS theta, 0.5::DOUBLE AS dt, k::BIGINT AS k, round(value * k, 3) AS lam FROM events CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)")
def s29_psmc(get):
    e = get("events")
    bins = "\n".join("RS\t%d\t0.5\t%.3f" for _ in range(3))
    block = text("RD\t%d\nRI\t%.3f\nDT\t0.5\nTR\t0.010\t0.002\n" + bins + "\nPA\t4+5*3\n//", "event_id", "value", *[x for k in range(3) for x in (F.lit(k), F.col("value") * k)])
    rows = reports(e, F.concat(F.lit("d"), F.floor(F.col("event_id") / 1000).cast("string"), F.lit("/u"), (F.col("user_id") % 50).cast("string"), F.lit(".psmc")), ["event_id"], block, head="CC\tpsmc\n")
    return M.read_psmc(rows).select("sample", "round", F.round("fit", 3).alias("fit"), "theta", "dt", "k", F.round("lam", 3).alias("lam"))


@query("SELECT 'e' || CAST(p_partkey AS STRING) AS element, p_type AS family, round(p_retailprice, 2) AS distance FROM part")
def s30_pair_distance(get):
    p = get("part")
    block = text("\n    2\n\n  0.0  %.2f  a 1\nx 0.00 %.2f\ny %.2f 0.00", "p_retailprice", "p_retailprice", "p_retailprice")
    rows = reports(p, text("d/e%d/x.dnadist", "p_partkey"), ["p_partkey"], block)
    families = p.select(text("e%d", "p_partkey").alias("element"), F.col("p_type").alias("family"))
    return M.merge_distances(M.read_pair_distance(rows), families).withColumn("distance", F.round("distance", 2))


@query("SELECT seq_id || '_LTRFinder_def1' AS element, CASE WHEN doc_id % 3 = 0 THEN 'LTR_Copia' ELSE 'LTR_unknown' END AS family, md5(seq) AS seq FROM {seq_v} WHERE doc_id % 2 = 0")
def s31_classified(get):
    rows = get("seq_v").withColumn("seq_id", F.concat("seq_id", F.when(F.col("doc_id") % 2 == 0, "_LTRFinder_def1#").otherwise("_other#"), F.when(F.col("doc_id") % 3 == 0, "LTR/Copia").otherwise("DNA/x")))
    return T.read_classified(rows).select("element", "family", F.md5("seq").alias("seq"))


@query("SELECT 't' || CAST(o_orderkey AS STRING) AS tree_id, i::BIGINT AS ord, CASE i WHEN 0 THEN 1.5 WHEN 1 THEN 2.5 ELSE round(o_totalprice, 2) END::DOUBLE AS length, CASE i WHEN 2 THEN 0.5 END::DOUBLE AS ci_lo, CASE i WHEN 2 THEN 0.75 END::DOUBLE AS ci_hi FROM orders CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)")
def s32_time_tree(get):
    block = text("#NEXUS\nBEGIN TREES;\n\tUTREE 1 = (old: 9);\n\tUTREE 2 = ((A: 1.5, B: 2.5) [&95%%={0.5, 0.75}]: %.2f);\nEND;", "o_totalprice")
    rows = reports(get("orders"), text("d/t%d.tre", "o_orderkey"), ["o_orderkey"], block)
    return M.read_time_tree(rows).withColumn("length", F.round("length", 2))


LADDER = "(SELECT cluster, i, count(*) OVER (PARTITION BY cluster) AS m, floor(lnl * 10) / 8 AS x FROM (SELECT cluster, lnl, row_number() OVER (PARTITION BY cluster ORDER BY model) AS i FROM {fits_v}))"
LADDER_NODES = f"""(SELECT cluster, m - 2 + i AS node, CASE WHEN i = 1 THEN 0 ELSE 2 * i - 3 END AS post, CASE WHEN i = 1 THEN m - 1 ELSE m - i + 1 END AS depth,
CASE WHEN m = 1 THEN NULL ELSE m - greatest(i, 2) END AS parent, true AS tip, 0 AS size, 'L' || CAST(i AS STRING) AS label, x AS length, CAST(NULL AS DOUBLE) AS ci_lo, CAST(NULL AS DOUBLE) AS ci_hi FROM {LADDER}
UNION ALL SELECT cluster, m - i, 2 * i - 2, m - i, CASE WHEN i < m THEN m - i - 1 END, false, 2 * i - 2, NULL, -x, 0.5, x FROM {LADDER} WHERE i > 1)"""


def _ladders(get, path, body=lambda tree: tree):
    """A tree for each cluster: its first two models, then one more in each bracket, as reports of one line."""
    rows = get("fits_v").withColumn("lnl", F.floor(F.col("lnl") * 10) / 8).groupBy(path.alias("source_file")).agg(F.sort_array(F.collect_list(F.struct("model", "lnl"))).alias("t"))
    x = lambda v: F.format_string("%.3f", v["lnl"])
    joined = F.aggregate(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), F.struct(F.lit(1).alias("i"), F.concat(F.lit("L1: "), x(F.get("t", F.lit(0)))).alias("s")), lambda a, v: F.struct((a["i"] + 1).alias("i"), F.concat(F.lit("("), a["s"], F.lit(", L"), (a["i"] + 1).cast("string"), F.lit(": "), x(v), F.lit(") [&95%={0.5, "), x(v), F.lit("}]: "), F.format_string("%.3f", -v["lnl"])).alias("s")))
    return L.numbered_lines(rows.select("source_file", body(F.concat(joined["s"], F.lit(";"))).alias("text")))


@query(f"SELECT 't' || CAST(cluster AS STRING) AS tree_id, CAST(CASE WHEN tip AND depth = 0 THEN 0 ELSE node END AS BIGINT) AS node, CAST(post AS BIGINT) AS post, CAST(depth AS BIGINT) AS depth, CAST(parent AS BIGINT) AS parent, tip, CAST(size AS BIGINT) AS size, label, length, ci_lo, ci_hi FROM {LADDER_NODES}")
def s32_time_tree_nodes(get):
    rows = _ladders(get, text("d/t%d.tre", "cluster"), lambda tree: F.concat(F.lit("#NEXUS\nBEGIN TREES;\n\tUTREE 1 = (old: 9);\n\tUTREE 2 = "), tree, F.lit("\nEND;")))
    return N.time_tree_nodes(rows).drop("mark")


@query(f"SELECT 't' || CAST(cluster AS STRING) AS tree_id, string_agg(CASE WHEN tip THEN CASE WHEN post > 0 THEN ', ' ELSE repeat('(', CAST(depth AS INT)) END || label ELSE ')' || printf(' [&95%%={{%.3f, %.3f}}]', ci_lo * 100, ci_hi * 100) END || printf(': %.3f', length * 100), '' ORDER BY post) || ';' AS tree FROM {LADDER_NODES} GROUP BY cluster")
def p16_rescaled_tree_text(get):
    from ..functions.seq import rescale_tree

    rows = _ladders(get, text("d/t%d.tre", "cluster"), lambda tree: F.concat(F.lit("tree 1 = "), tree))
    return N.tree_text(rescale_tree(N.time_tree_nodes(rows), 100), ["tree_id"], digits=3)


@query(f"SELECT CAST(cluster AS STRING) AS cluster, label, CAST(300 AS BIGINT) AS len, round(d, 3) AS dn, round(2 * d, 3) AS ds, round(250.5 * d, 6) AS ndn, round(3 * d, 3) AS w FROM (SELECT cluster, 'L2' AS label, -x AS d FROM {LADDER} WHERE i = 2 AND m > 2 UNION ALL SELECT cluster, 'L1', x FROM {LADDER} WHERE i = 1 UNION ALL SELECT cluster, 'L3', x FROM {LADDER} WHERE i = 3)")
def s27_codeml_clade(get):
    """Ladders as trees of reports; L2's tree marks the branch of the first pair, L1 and L3 stand for themselves."""
    rows = get("fits_v").groupBy(text("d/%d/branch.freeratio.mlc", "cluster").alias("source_file")).agg(F.max("cluster").alias("cluster"), F.sort_array(F.collect_list(F.struct("model", "lnl"))).alias("t")).withColumn("t", F.transform("t", lambda v: F.floor(v["lnl"] * 10) / 8))

    def tree(sign: str, factor: int):
        number = lambda v: F.concat(F.lit(sign), F.format_string("%.3f", v * factor))
        first = F.concat(F.lit("L1"), number(F.get("t", F.lit(0))))
        add = lambda a, v: F.struct((a["i"] + 1).alias("i"), F.concat(F.lit("("), a["s"], F.lit(", L"), (a["i"] + 1).cast("string"), number(v), F.lit(")"), number(-v)).alias("s"))
        return F.concat(F.lit("("), F.aggregate(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), F.struct(F.lit(1).alias("i"), first.alias("s")), add)["s"], F.lit(");"))

    whole = F.concat(F.lit(" 4 300\nlnL(ntime: 11  np: 16):  -1234.500000  +0.0\n   6..2  0.1  250.5  50.5  0.2\ndS tree:\n"), tree(": ", 2), F.lit("\ndN tree:\n"), tree(": ", 1), F.lit("\nw ratios as labels for TreeView:\n"), tree(" #", 3))
    reports_ = L.numbered_lines(rows.select("source_file", whole.alias("text")))
    marked = rows.where(F.size("t") > 2).select(text("d/%d/tree/tree.L2", "cluster").alias("source_file"), F.lit("((L1, L2) #1, L3);").alias("text"))
    bare = rows.where(F.size("t") <= 2).select(text("d/%d/tree/tree.L2", "cluster").alias("source_file"), F.lit("(L1, L2);").alias("text"))
    tips = get("region").selectExpr("explode(array('L1', 'L2', 'L3')) AS label")
    out = N.codeml_clade(reports_, L.numbered_lines(marked.unionByName(bare)), tips)
    return out.select("cluster", "label", "len", *[F.round(c, 3).alias(c) for c in ("dn", "ds", "w")], F.round("ndn", 6).alias("ndn"))


@query("SELECT 's' || CAST(s_suppkey AS STRING) AS sample, round(s_acctbal, 2) AS depth FROM supplier")
def s33_depth(get):
    rows = lines(get("supplier"), F.lit("d.txt"), text("s%d 1 2 3 %.2f", "s_suppkey", "s_acctbal")).unionByName(lines(get("region"), F.lit("d.txt"), F.lit("ID a b c depth")))
    return T.parse_depth(rows).withColumn("depth", F.round("depth", 2))


@query("SELECT group_id, count(*) AS n, '\t' || CAST(count(*) AS STRING) || '\t' || CAST(max(length(aln)) AS STRING) AS head FROM {codons_v} GROUP BY group_id")
def k3_paml(get):
    rows = K.paml_records(get("codons_v")).withColumn("x", F.split("value", "\n"))
    return rows.select("group_id", F.size(F.filter("x", lambda v: v.rlike("^S[0-9]$"))).cast("bigint").alias("n"), F.col("x")[0].alias("head"))


@query("SELECT seq_id, CAST(ceil(length(seq) / 60) AS BIGINT) AS n_lines FROM {seq_v} WHERE length(seq) > 0")
def k1_fasta(get):
    rows = K.fasta_records(get("seq_v").where("length(seq) > 0"), keep=("seq_id",))
    return rows.select("seq_id", (F.size(F.split("value", "\n")) - 1).cast("bigint").alias("n_lines"))


@query("SELECT l_orderkey::VARCHAR AS cluster, greatest(max(l_discount), max(l_tax)) AS w FROM lineitem GROUP BY l_orderkey")
def t3_max_w(get):
    rows = get("lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("a"), F.max("l_tax").alias("b"))
    block = text("lnL(ntime: 11  np: 16):  -1234.500000  +0.0\nforeground w     0.1  1.0  %.2f  %.2f", "a", "b")
    fits = M.codeml_branchsite(L.numbered_lines(whole_reports(rows, text("d/%d/S1/nofix.mlc", "l_orderkey"), block)))
    return fits.select("cluster", "w")


@query("SELECT seq_id, md5(seq) AS seq FROM {seq_v} WHERE length(seq) > 0")
def u2_fasta_union(get):
    rows = get("seq_v").where("length(seq) > 0")
    record = K.fasta_records(rows, keep=("doc_id",)).select(F.concat(F.lit("part"), (F.col("doc_id") % 3).cast("string"), F.lit(".fa")).alias("source_file"), F.col("value").alias("record"))
    files = [record.where(F.col("source_file") == f"part{k}.fa") for k in range(3)]
    return T.parse_fasta(files[0].unionByName(files[1]).unionByName(files[2])).select("seq_id", F.md5("seq").alias("seq"))


@query("SELECT CAST(group_id AS STRING) AS group_id, species, md5(aln) AS seq FROM {codons_v}")
def k6_group_fasta(get):
    rows = get("codons_v").select("group_id", F.lit("cds").alias("type"), "species", F.col("aln").alias("seq"))
    records = K.group_records(rows).select(F.concat_ws("/", F.col("group_id").cast("string"), "type").alias("source_file"), F.col("value").alias("record"))
    return T.parse_fasta(records).select(F.split_part("source_file", F.lit("/"), F.lit(1)).alias("group_id"), F.col("seq_id").alias("species"), F.md5("seq").alias("seq"))
