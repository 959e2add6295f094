"""Queries on sequences, alignments and elements."""

from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import stats as N
from ..operators import align as A
from ..operators import elements as E
from ..operators import intervals as I
from ..operators import numbering as B
from .registry import query


@query("SELECT seq_id, substring(c_name, 1, 8) AS short, split_part(c_name, '#', 2) AS field FROM (SELECT CAST(c_custkey AS STRING) AS seq_id, c_name FROM customer)")
def p1_p2_identifiers(get):
    return get("customer").select(F.col("c_custkey").cast("string").alias("seq_id"), S.shorten_id(F.col("c_name"), 8).alias("short"), S.id_field(F.col("c_name"), "#", 2).alias("field"))


@query("SELECT seq_id, md5(upper(seq)) AS seq FROM {seq_v}")
def p3_upper_seq(get):
    return get("seq_v").select("seq_id", F.md5(S.upper_seq(F.col("seq"))).alias("seq"))


@query("SELECT seq_id, md5(regexp_replace(seq, '[a-z]', 'N', 'g')) AS masked FROM {seq_v}")
def p4_hardmask(get):
    return get("seq_v").select("seq_id", F.md5(S.hardmask(F.col("seq"))).alias("masked"))


@query("SELECT seq_id, strand, CASE WHEN strand = '-' THEN translate(reverse(substring(upper(seq), 5, 46)), 'ATCG', 'TAGC') ELSE substring(upper(seq), 5, 46) END AS part FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '+' END AS strand FROM {seq_v})")
def p5_subseq(get):
    rows = get("seq_v").withColumn("strand", F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+"))
    return rows.select("seq_id", "strand", S.subseq(F.upper("seq"), F.lit(5), F.lit(50), F.col("strand")).alias("part"))


@query("SELECT seq_id, md5(translate(reverse(upper(seq)), 'ATCG', 'TAGC')) AS rc FROM {seq_v}")
def p6_revcomp(get):
    return get("seq_v").select("seq_id", F.md5(S.revcomp(F.upper("seq"))).alias("rc"))


@query("SELECT DISTINCT CASE WHEN gene LIKE species || '|%' THEN gene ELSE species || '|' || gene END AS id FROM (SELECT species, CASE WHEN group_id % 2 = 0 THEN species || '|' || gene ELSE gene END AS gene FROM {groups_v})")
def p7_qualify_id(get):
    rows = get("groups_v").withColumn("gene", F.when(F.col("group_id") % 2 == 0, F.concat_ws("|", "species", "gene")).otherwise(F.col("gene")))
    return rows.select(S.qualify_id(F.col("gene"), F.col("species")).alias("id")).distinct()


def _letters(n: str) -> str:
    letter = lambda k: f"chr(CAST(97 + ({n} // {26**k}) % 26 AS INT))"
    return " || ".join(letter(k) if k < 4 else f"CASE WHEN {n} >= {26**k} THEN {letter(k)} ELSE '' END" for k in range(8, -1, -1))


@query(f"SELECT p_name AS label, 'N' || {_letters('n')} || 'M' AS short FROM (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS n FROM (SELECT DISTINCT p_name FROM part))")
def p8_short_ids(get):
    return S.short_ids(get("part").select(F.col("p_name").alias("label")), prefix_length=8)


@query("SELECT p_partkey, p_name AS node FROM part")
def p8_restore_ids(get):
    labels = get("part").select("p_partkey", F.col("p_name").alias("label"))
    ids = S.short_ids(labels, prefix_length=8)
    return S.restore_ids(labels.join(ids, "label").select("p_partkey", F.col("short").alias("node")), ids, "node")


CODON_CASE = "CASE c " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in S.CODE.items()) + " ELSE 'X' END"
PEP = f"(SELECT seq_id, string_agg({CODON_CASE}, '' ORDER BY i) AS pep FROM (SELECT seq_id, i, substring(upper(seq), 3 * i + 1, 3) AS c FROM (SELECT seq_id, seq, unnest(range(0, length(seq) // 3)) AS i FROM {{seq_v}})) GROUP BY seq_id)"


def _pep(get):
    return get("seq_v").where("length(seq) >= 3").select("seq_id", S.translate_cds(F.col("seq")).alias("pep"))


@query(f"SELECT * FROM {PEP}")
def p10_translate_cds(get):
    return _pep(get)


@query(f"SELECT seq_id, length(pep) >= 10 AND length(pep) - length(replace(pep, '*', '')) <= 0.05 * length(pep) AS good FROM {PEP}")
def p11_filter_proteins(get):
    return S.judge_proteins(_pep(get), "pep", 10, 0.05).select("seq_id", "good")


@query(f"SELECT gene, isoform FROM (SELECT gene, isoform, row_number() OVER (PARTITION BY gene ORDER BY length(pep) DESC, isoform DESC) AS r FROM (SELECT 'g' || CAST(CAST(floor(CAST(substring(seq_id, 2) AS BIGINT) / 3) AS BIGINT) AS STRING) AS gene, seq_id AS isoform, regexp_replace(pep, '\\*$', '') AS pep FROM {PEP}) WHERE length(pep) >= 30 AND pep NOT LIKE '%*%') WHERE r = 1")
def p9_qc_sequences(get):
    rows = get("seq_v").where("length(seq) >= 3").select(F.concat(F.lit("g"), F.floor(F.col("doc_id") / 3).cast("string")).alias("gene"), F.col("seq_id").alias("isoform"), F.col("seq").alias("cds"))
    return S.qc_sequences(rows.withColumn("pep", S.translate_cds(F.col("cds")))).select("gene", "isoform")


@query("SELECT group_id, species FROM (SELECT group_id, species, CASE WHEN group_id % 3 = 0 THEN replace(aln, 'TTT', 'T-T') WHEN group_id % 3 = 1 THEN substring(aln, 1, length(aln) - 2) ELSE aln END AS aln FROM {codons_v}) WHERE length(aln) % 3 <> 0 OR len(list_filter([substring(aln, 3 * i + 1, 3) FOR i IN range(0, length(aln) // 3)], lambda c: contains(c, '-') AND c <> '---')) > 0")
def p12_check_codons(get):
    aln = F.when(F.col("group_id") % 3 == 0, F.replace("aln", F.lit("TTT"), F.lit("T-T"))).when(F.col("group_id") % 3 == 1, F.substr("aln", F.lit(1), F.length("aln") - 2)).otherwise(F.col("aln"))
    return S.check_codons(get("codons_v").withColumn("aln", aln))


@query("SELECT event_id, track || ':v1' AS source FROM {features_v}")
def p14_tag_source(get):
    return get("features_v").select("event_id", S.tag_source(F.col("track"), "v1").alias("source"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'metal' WHEN p_type LIKE '%E%' THEN 'e' ELSE p_type END AS label FROM part")
def p19_label_tracks(get):
    return get("part").select("p_partkey", S.label_tracks(F.col("p_type"), [("STEEL", "metal"), ("E", "e")]).alias("label"))


@query("SELECT l_orderkey AS tree_id, l_linenumber AS ord, round(l_quantity * 100, 6) AS length, round(l_discount * 100, 6) AS ci_lo, round(l_tax * 100, 6) AS ci_hi FROM lineitem")
def p16_rescale_tree(get):
    nodes = get("lineitem").select(F.col("l_orderkey").alias("tree_id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("length"), F.col("l_discount").alias("ci_lo"), F.col("l_tax").alias("ci_hi"))
    return S.rescale_tree(nodes, 100).select("tree_id", "ord", *[F.round(c, 6).alias(c) for c in ("length", "ci_lo", "ci_hi")])


@query("SELECT n_nationkey AS tree_id, 'T' || CAST(t AS STRING) AS tip, '((T1' || CASE WHEN t = 1 THEN ' #1' ELSE '' END || ':1,T11' || CASE WHEN t = 11 THEN ' #1' ELSE '' END || ':2):3,T2' || CASE WHEN t = 2 THEN ' #1' ELSE '' END || ':4);' AS tree FROM nation CROSS JOIN (SELECT unnest([1, 2, 11]) AS t)")
def p17_mark_branches(get):
    trees = get("nation").select(F.col("n_nationkey").alias("tree_id"), F.lit("((T1:1,T11:2):3,T2:4);").alias("tree"))
    tips = get("nation").select(F.col("n_nationkey").alias("tree_id"), F.explode(F.array(F.lit("T1"), F.lit("T2"), F.lit("T11"))).alias("tip"))
    return S.mark_branches(trees, tips)


@query("""
WITH p AS (SELECT seq_id, upper(seq) AS s, unnest(range(1, length(seq) + 1)) AS i FROM {seq_v}), g AS (SELECT seq_id, i, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS r FROM p WHERE substring(s, i, 1) = 'N')
SELECT seq_id, min(i) AS start, max(i) AS stop FROM g GROUP BY seq_id, r HAVING count(*) >= 2
""")
def w3_find_gaps(get):
    return I.find_gaps(get("seq_v"), 2, size=1000)


@query("""
WITH q AS (SELECT seq_id, i AS position, substring(s, i, 20) AS k FROM (SELECT seq_id, upper(seq) AS s, unnest(range(1, length(seq) - 18)) AS i FROM {seq_v}))
SELECT seq_id, CAST(position AS BIGINT) AS position, n FROM q JOIN (SELECT k, count(*) AS n FROM q GROUP BY k) t USING (k)
""")
def a12_kmer_counts(get):
    seqs = get("seq_v").withColumn("seq", F.upper("seq"))
    return A.kmer_counts(seqs, seqs, 20)


@query("SELECT group_id, species, string_agg(substring(c, 3, 1), '' ORDER BY i) AS sites FROM (SELECT *, count(*) OVER (PARTITION BY group_id, i) AS n FROM (SELECT group_id, species, i, substring(aln, 3 * i + 1, 3) AS c FROM (SELECT group_id, species, aln, unnest(range(0, length(aln) // 3)) AS i FROM {codons_v})) WHERE substring(c, 1, 2) IN (" + ", ".join(f"'{p}'" for p in S.FOURFOLD) + ")) WHERE n = 4 GROUP BY ALL")
def a13_fourfold_sites(get):
    return A.fourfold_sites(get("codons_v"), 4)


@query("SELECT species, CAST(floor(group_id / 256) AS BIGINT) AS part, md5(string_agg(aln, '' ORDER BY group_id)) AS aln, CAST(sum(length(aln)) AS BIGINT) AS length, string_agg(CAST(group_id AS STRING), ',' ORDER BY group_id) AS groups FROM {codons_v} GROUP BY ALL")
def a14_supermatrix(get):
    return A.supermatrix(get("codons_v"), F.floor(F.col("group_id") / 256)).withColumn("aln", F.md5("aln"))


@query("""
WITH c AS (SELECT a.group_id, a.species AS s1, b.species AS s2, unnest(string_split(a.aln, '')) AS u, unnest(string_split(b.aln, '')) AS v FROM {codons_v} a JOIN {codons_v} b ON a.group_id = b.group_id AND a.species < b.species),
d AS (SELECT group_id, s1, s2, count(*) FILTER (WHERE u IN ('A', 'C', 'G', 'T') AND v IN ('A', 'C', 'G', 'T')) AS n,
count(*) FILTER (WHERE u || v IN ('AG', 'GA', 'CT', 'TC')) AS ti, count(*) FILTER (WHERE u <> v AND u IN ('A', 'C', 'G', 'T') AND v IN ('A', 'C', 'G', 'T')) AS df FROM c GROUP BY ALL),
e AS (SELECT *, ti / n AS pp, (df - ti) / n AS qq FROM d)
SELECT group_id, s1, s2, CASE WHEN n > 0 AND 1 - 2 * pp - qq > 0 AND 1 - 2 * qq > 0 THEN round(0.0 - 0.5 * ln(1 - 2 * pp - qq) - 0.25 * ln(1 - 2 * qq), 6) END AS distance FROM e
""")
def n8_k2p(get):
    return N.k2p_pairs(get("codons_v")).withColumn("distance", F.round("distance", 6))


@query("SELECT g.group_id, g.species, g.gene, md5(s.seq) AS seq FROM (SELECT DISTINCT group_id, species, gene FROM {groups_v}) g JOIN (SELECT DISTINCT species, gene, species || gene AS seq FROM {groups_v}) s ON g.species = s.species AND g.gene = s.gene")
def j1_join_group_seqs(get):
    g = get("groups_v")
    seqs = g.select("species", "gene", F.concat("species", "gene").alias("seq")).distinct()
    return E.join_group_seqs(g.distinct(), seqs).withColumn("seq", F.md5("seq"))


def _features(get):
    """Elements of 50 bases or, in every third sequence, all of it, dealt over the whole of their sequences by doc_id."""
    rows = get("seq_v").where("length(seq) >= 60").withColumn("strand", F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+"))
    n = F.length("seq")
    start = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(1 + (F.col("doc_id") * 37) % (n - 49))
    stop = F.when(F.col("doc_id") % 3 == 0, n).otherwise(start + 49)
    parts = [("LTR_retrotransposon", start, stop), ("five_prime_LTR", start, start + 9), ("three_prime_LTR", stop - 9, stop)]
    spans = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), a.cast("long").alias("start"), b.cast("long").alias("stop")) for name, a, b in parts]))
    return rows.select(F.concat("seq_id", F.lit("_LTRFinder_def1")).alias("element"), F.col("seq_id").alias("seqname"), "strand", spans.alias("p")).select("element", "seqname", "strand", "p.*")


def _cut(a: str, n: str) -> str:
    return f"CASE WHEN doc_id % 2 = 0 THEN translate(reverse(substring(s, {a}, {n})), 'ATCG', 'TAGC') ELSE substring(s, {a}, {n}) END"


ENDS = f"(SELECT seq_id || '_LTRFinder_def1' AS element, seq_id AS seqname, {_cut("a", "n")} AS whole, {_cut("a", "10")} AS five, {_cut("a + n - 10", "10")} AS three FROM (SELECT doc_id, seq_id, upper(seq) AS s, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 1 + (doc_id * 37) % (length(seq) - 49) END AS a, CASE WHEN doc_id % 3 = 0 THEN length(seq) ELSE 50 END AS n FROM {{seq_v}} WHERE length(seq) >= 60))"


def _ends(get):
    return E.join_feature_seqs(_features(get), get("seq_v").select("seq_id", F.upper("seq").alias("seq")), size=1 << 10)


@query(f"SELECT * FROM {ENDS}")
def j2_join_feature_seqs(get):
    return _ends(get)


def _pairs(get):
    ends = _ends(get)
    families = get("seq_v").select(F.concat("seq_id", F.lit("_LTRFinder_def1")).alias("element"), F.when(F.col("doc_id") % 3 == 0, "LTR_Copia").otherwise("LTR_Gypsy").alias("family"))
    return E.join_ltr_ends(families, ends.select("element", "five"), ends.select("element", "three"))


PAIRED = f"(SELECT element, CASE WHEN CAST(substring(seqname, 2) AS BIGINT) % 3 = 0 THEN 'LTR_Copia' ELSE 'LTR_Gypsy' END AS family, five, three FROM {ENDS})"


@query(f"SELECT * FROM {PAIRED}")
def j3_join_ltr_ends(get):
    return _pairs(get)


@query(f"SELECT element, element || '#' || family || '#five_prime_LTR' AS header, five AS seq FROM {PAIRED} UNION ALL SELECT element, element || '#' || family || '#three_prime_LTR', three FROM {PAIRED}")
def k7_ltr_pair_records(get):
    return E.ltr_pair_records(_pairs(get))


@query("""
WITH e AS (SELECT seq_id, seq, CASE WHEN doc_id % 5 = 0 THEN 'xx' || substring(seq, 1, 38) ELSE substring(seq, 1 + (doc_id * 37) % (length(seq) - 39), 40) END AS x FROM {seq_v} WHERE length(seq) >= 60),
p AS (SELECT *, CAST(instr(seq, x) AS BIGINT) AS p, CAST(instr(x, substring(x, 11, 8)) AS BIGINT) AS b, CAST(instr(x, substring(x, 22, 6)) AS BIGINT) AS t FROM e)
SELECT seq_id || 'e' AS element, seq_id AS seqname, p AS start, p + 39 AS stop, p + 9 AS ltr5_stop, p + 30 AS ltr3_start, p + b - 1 AS pbs_start, p + b + 6 AS pbs_stop, p + t - 1 AS ppt_start, p + t + 4 AS ppt_stop,
p - 5 AS tsd5_start, p - 1 AS tsd5_stop, p + 40 AS tsd3_start, p + 43 AS tsd3_stop FROM p WHERE p > 0
UNION ALL SELECT seq_id || 'e', seq_id, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE p = 0
""")
def j10_locate_elements(get):
    rows = get("seq_v").where("length(seq) >= 60")
    part = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("xx"), F.substring("seq", 1, 38))).otherwise(F.substr("seq", (1 + (F.col("doc_id") * 37) % (F.length("seq") - 39)).cast("int"), F.lit(40)))
    elements = rows.select(F.concat("seq_id", F.lit("e")).alias("element"), F.col("seq_id").alias("seqname"), part.alias("seq"), F.lit(10).alias("ltr5"), F.lit(10).alias("ltr3"), F.lit("ACGTA").alias("tsr5"), F.lit("ACGT").alias("tsr3"))
    return E.locate_elements(elements.withColumns({"pbs": F.substring("seq", 11, 8), "ppt": F.substring("seq", 22, 6)}), rows, size=1 << 10, longest=64)


@query("SELECT event_id, 'TRF' || CASE WHEN n < 10000 THEN lpad(CAST(n AS STRING), 4, '0') ELSE CAST(n AS STRING) END AS attribute FROM (SELECT event_id, row_number() OVER (PARTITION BY seqname ORDER BY event_id) AS n FROM {features_v})")
def w4_number_features(get):
    return B.number_features(get("features_v"), ["seqname"], ["event_id"], "TRF", 4, bucket=F.floor(F.col("event_id") / 1000)).select("event_id", "attribute")


@query("SELECT seq_id, CAST(least(6, floor((upto + size / 2) * 7 / total)) AS BIGINT) AS part FROM (SELECT seq_id, length(seq) AS size, sum(length(seq)) OVER (ORDER BY doc_id) - length(seq) AS upto, sum(length(seq)) OVER () AS total FROM {seq_v})")
def w8_split_balanced(get):
    return B.split_balanced(get("seq_v"), 7, F.length("seq"), ["doc_id"], F.floor(F.col("doc_id") / 100)).select("seq_id", "part")


@query("SELECT seq_id, CAST(floor((sum(length(seq)) OVER (ORDER BY doc_id) - length(seq)) / 100000) AS BIGINT) AS part FROM {seq_v}")
def w8_split_by_size(get):
    return B.split_by_size(get("seq_v"), 100_000, F.length("seq"), ["doc_id"], F.floor(F.col("doc_id") / 100)).select("seq_id", "part")


@query("SELECT seq_id, (row_number() OVER (ORDER BY doc_id) - 1) % 5 AS part FROM {seq_v}")
def w9_split_round_robin(get):
    return B.split_round_robin(get("seq_v"), 5, ["doc_id"], F.floor(F.col("doc_id") / 100)).select("seq_id", "part")
