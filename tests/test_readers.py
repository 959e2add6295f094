"""Every reader on files of its format, and reports that are read in several splits."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqframe.functions import stats as N
from seqframe.sources import readers as X


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_every_reader_is_tested():
    text = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    assert [n for n in X.__all__ if f".{n}(" not in text] == []


@pytest.mark.parametrize("limit", [0, 400, 10**6])
def test_one_call_reads_small_and_large_files(spark, tmp_path, monkeypatch, limit):
    """A file of 200 and one of 900 bytes: both small, one of each kind, both large; those that are not asked for are not listed."""
    monkeypatch.setattr(X, "SMALL", limit)
    for name, rounds in (("a", 2), ("b", 9)):
        put(tmp_path, f"{name}.psmc", "CC\tx\n" + "".join(f"RD\t{r}\nRI\t0.{r}\nDT\t0.5\nTR\t0.01\t0.002\n" + "".join(f"RS\t{k}\t0.5\t{k}.25\n" for k in range(4)) + "PA\t4+5*3\n//\n" for r in range(rounds)))
    cols = ["sample", "round", "fit", "theta", "k", "lam"]
    whole = rows(X.read_psmc(spark, str(tmp_path), large=False), *cols)
    assert rows(X.read_psmc(spark, str(tmp_path)), *cols) == whole and len(whole) == 44
    for large, n in ((False, {0: 0, 400: 1, 10**6: 2}[limit]), (True, {0: 2, 400: 1, 10**6: 0}[limit])):
        scan = spark.read.text(str(tmp_path), wholetext=not large).where(F.col("_metadata.file_size") > limit if large else F.col("_metadata.file_size") <= limit)
        scan.collect()
        plan = scan._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        assert leaf.metrics().apply("numFiles").value() == n


def test_records(spark, tmp_path):
    put(tmp_path, "fa/a.fa", ">s1 first\nACGT\nAC\n>s2\nGG\n")
    put(tmp_path, "fa/b.fa", ">s3|x\r\nTT\r\nTT\r\n")
    assert rows(X.read_fasta(spark, str(tmp_path / "fa")), "seq_id", "seq") == [("s1", "ACGTAC"), ("s2", "GG"), ("s3|x", "TTTT")]
    gff = put(tmp_path, "a.gff", "##gff-version 3\nc1\tx\texon\t3\t9\t1.5\t-\t.\tID=e1\nc1\tgeneid\tFirst\t4\t8\t.\t+\t0\tg1\ntoo\tshort\n")
    assert rows(X.read_gff(spark, gff), "seqname", "feature", "start", "stop", "score", "strand") == [("c1", "First", 4, 8, None, "+"), ("c1", "exon", 3, 9, 1.5, "-")]
    assert rows(X.read_geneid(spark, gff), "feature", "start") == [("exon", 3), ("exon", 4)]
    groups = put(tmp_path, "groups.txt", "g1: A|x A|y B|z\ng2: C|w\n")
    assert rows(X.read_groups(spark, groups), "group_id", "member", "species") == [("g1", "A|x", "A"), ("g1", "A|y", "A"), ("g1", "B|z", "B"), ("g2", "C|w", "C")]
    assert rows(X.read_gene_totals(spark, put(tmp_path, "n.txt", "Aa.fasta:12\nBb.fasta:7\n")), "species", "n_genes") == [("Aa", 12), ("Bb", 7)]
    clusters = put(tmp_path, "c.txt", "#Fam_id\tGenes\tSpecies\tmembers\ng1\t2\t1\tA|x,A|y\n")
    assert rows(X.read_clusters(spark, clusters), "group_id", "genes", "n_species", "member") == [("g1", 2, 1, "A|x"), ("g1", 2, 1, "A|y")]
    matrix = put(tmp_path, "m.txt", "Desc\tFamily ID\tA\tB\n(null)\tf1\t3\t0\n")
    assert rows(X.read_family_matrix(spark, matrix), "family_id", "species", "n") == [("f1", "A", 3), ("f1", "B", 0)]
    psl = put(tmp_path, "x.psl", "psLayout version 3\n\n" + "\t".join("90 0 0 0 0 0 0 0 - q1 100 5 95 t1 500 10 100 2 40,50, 5,45, 10,60,".split(" ")) + "\n")
    assert rows(X.read_psl(spark, psl), "q_name", "q_size", "t_name", "strand", "block_sizes", "q_starts") == [("q1", 100, "t1", "-", [40, 50], [5, 45])]
    assert rows(X.read_lengths(spark, put(tmp_path, "l.txt", "id len\ns1\t10\ns2 20\n")), "seq_id", "length") == [("s1", 10), ("s2", 20)]
    hits = put(tmp_path, "HEX_TREP9.bln", "# comment\nq\ts\t97.5\t100\t1\t0\t11\t110\t210\t111\t1e-20\t180.5\n")
    assert rows(X.read_blast_tab(spark, hits), "qry", "sub", "pid", "qs", "e", "bits") == [("q", "s", 97.5, 11, 1e-20, 180.5)]
    assert rows(X.read_blast_gff(spark, hits), "source", "start", "stop", "strand") == [("blast:TREP9", 11, 110, "-")]
    masked = put(tmp_path, "x.out", "   SW  perc\nscore div\n\n  469 36.2  0.7  1.6 seq1  7  42 (80657) C  R9  Unknown  (3156) 1784 1482 5\n")
    assert rows(X.read_repeatmasker(spark, masked), "seqname", "start", "stop", "strand", "attribute") == [("seq1", 7, 42, "-", "R9")]
    assert rows(X.read_repeatmasker(spark, masked, all_plus=True), "strand") == [("+",)]
    eugene = put(tmp_path, "e.gff", "s\tEuGene\tE.Init\t5\t9\t0\t+\t.\tHEX.3.0\ns\tEuGene\tUTR5\t1\t4\t0\t+\t.\tHEX.3.0\n")
    assert rows(X.read_eugene(spark, eugene), "start", "attribute") == [(5, "eugene_simp_3")]
    assert rows(X.read_depth(spark, put(tmp_path, "d.txt", "ID a b c depth\n#x\ns1 1 2 3 24.5\n")), "sample", "depth") == [("s1", 24.5)]
    classified = put(tmp_path, "k.fa", ">a_LTRFinder_def1#LTR/Copia\nAC\n>b_LTRFinder_def2#DNA/x\nGT\n>other#LTR/Copia\nTT\n")
    assert rows(X.read_classified(spark, classified), "element", "family", "seq") == [("a_LTRFinder_def1", "LTR_Copia", "AC"), ("b_LTRFinder_def2", "LTR_unknown", "GT")]


LTRFINDER = "Program    : LTR_FINDER\nVersion    : 1.0\n\n" + "".join(
    f"[{n}] seq1 Len:82726\nLocation : {100 * n} - {100 * n + 90} Len: 91 Strand:{'+-'[n % 2]}\nScore    : 7 [LTR region similarity:0.964]\nStatus   : 11111110000\n5'-LTR   : {100 * n} - {100 * n + 10} Len: 11\n3'-LTR   : {100 * n + 80} - {100 * n + 90} Len: 11\nTSR      : NOT FOUND\nPBS   : [16/17] {100 * n + 12} - {100 * n + 20} (MetCAT)\nDomain: {100 * n + 30} - {100 * n + 40} [possible ORF:{100 * n + 28}-{100 * n + 44}, (reverse transcriptase)]\n\n"
    for n in range(1, 40)
)


@pytest.mark.parametrize("large", [False, True])
def test_reports(spark, tmp_path, large):
    if large:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        if large:
            assert spark.read.text(put(tmp_path, "ltr/x.txt", LTRFINDER)).rdd.getNumPartitions() > 20
        got = X.read_ltrfinder(spark, put(tmp_path, "ltr/x.txt", LTRFINDER), large)
        parts = {"LTR_retrotransposon": (0, 90), "five_prime_LTR": (0, 10), "three_prime_LTR": (80, 90), "primer_binding_site": (12, 20), "rt_domain": (30, 40), "rt_orf": (28, 44)}
        assert rows(got, "feature", "start", "stop", "strand", "attribute") == sorted(((f, 100 * n + a, 100 * n + b, "+-"[n % 2], f"ltr_finder_{n}") for n in range(1, 40) for f, (a, b) in parts.items()), key=str)
        assert rows(X.read_ltrfinder_summary(spark, str(tmp_path / "ltr/x.txt"), large), "element", "n_domains") == sorted((f"seq1_LTRFinder_def{n}", 1) for n in range(1, 40))
        text = "LTR_seq\n" + "".join(f"Report: String 0 {'Accepted ' if n % 3 else 'Rejected'} {n} {n + 9} ... {n + 41} {n + 50}  length 10  span 50 diff 7.0{' Confidence 0.500000 TSR #GAATT#' if n % 3 else ''}\n" for n in range(1, 20))
        kept = [n for n in range(1, 20) if n % 3]
        assert rows(X.read_ltrseq(spark, put(tmp_path, "ltrseq/s.txt", text), large).where("feature = 'LTR_retrotransposon'"), "start", "stop", "attribute") == sorted(((n, n + 50, f"s_ltrseq_{k + 1}") for k, n in enumerate(kept)), key=str)
        assert rows(X.read_findltr(spark, put(tmp_path, "find/s.txt", "1\t5\t9\t20\t29\t+\t5\t10\t11\t98.6\nshort\n"), large), "feature", "start", "stop") == [("LTR_retrotransposon", 5, 29), ("five_prime_LTR", 5, 9), ("three_prime_LTR", 20, 29)]
        text = "".join(f"Tandem.dir\t{10 * n}\t{10 * n + 500}\t5\t6\t0\tx\t90\t3.5\t1\t1\t1\n" for n in range(1, 12))
        assert rows(X.read_repseek(spark, put(tmp_path, "rep/s.txt", text), large), "start", "attribute") == sorted(((10 * n + a, f"repseek{n}:dir") for n in range(1, 12) for a in (0, 500)), key=str)
        text = "Tandem Repeats\n\n" + "".join(f"{n} {n + 5} 3 2.0 3 90 5 77 10 20 30 40 1.5 ACG ACGACG\n" for n in range(1, 12))
        assert rows(X.read_trf(spark, put(tmp_path, "trf/s.dat", text), large), "start", "attribute") == sorted(((n, f"TRF{n:04d}") for n in range(1, 12)), key=str)
        text = "82726\nqry\nSOLO s0 Ang 1 1\ns0 90 80 1 11\n" + "".join(f"PAIR p{n} Ang 0\np{n} L {n} {n + 4} 1 5\np{n} M 20 10 1 11 30 40 1 11\n" for n in range(1, 9))
        assert rows(X.read_tenest(spark, put(tmp_path, "te/s.LTR", text), large).where("feature like 'five%'"), "start", "attribute") == sorted(((n, f"pair_Ang_p{n}") for n in range(1, 9)), key=str)
        text = "Direct repeats               : TA\nLength of TIR(3-15)          : 11\n" + "".join(f"\nPattern  : AAAATC\nSequence : >s\nMismatch : 1\nNNNNACCA({n})-----AAAATC\nTTCG-----({n + 9})GGG\n" for n in range(1, 9))
        assert rows(X.read_findmite(spark, put(tmp_path, "mite/s.txt", text), large), "start", "stop", "attribute") == sorted(((n, n + 9, f"s_TA_11_{n}") for n in range(1, 9)), key=str)
        exon = " {n}.01 Init +  {a}  {b}   28  0  1  132  100   -33 0.892   4.63\n"
        text = "GENSCAN 1.0\n\n----- ---- - ------\n" + "".join(exon.format(n=n, a=n, b=n + 5) for n in range(1, 9)) + "Predicted peptide sequence(s):\n" + exon.format(n=99, a=1, b=2)
        assert rows(X.read_genscan(spark, put(tmp_path, "gs/s.out", text), large), "start", "attribute") == [(n, f"gene_{n}") for n in range(1, 9)]
        text = "GeneMark.hmm\n\n" + "".join(f"  {n}     {e}   -  Initial      {n}     {n + 9}      50          2 1\n" for n in (3, 5, 8) for e in (1, 2))
        assert rows(X.read_genemark(spark, put(tmp_path, "gm/s.out", text), large).distinct(), "start", "attribute") == [(3, "RNA0001"), (5, "RNA0002"), (8, "RNA0003")]
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k)


@pytest.mark.parametrize("large", [False, True])
def test_model_results(spark, tmp_path, large):
    if large:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        put(tmp_path, "br/c1_All.mlc", "seed\nlnL(ntime: 11  np: 14):  -1234.500000      +0.0\nomega (dN/dS) =  0.5000\n")
        put(tmp_path, "br/c1_m2.mlc", "seed\nlnL(ntime: 11  np: 15):  -1230.250000      +0.0\nw (dN/dS) for branches:  0.25000 1.75000\n")
        fits = X.read_codeml_branch(spark, str(tmp_path / "br"), large)
        assert rows(fits, "cluster", "model", "np", "lnl", "w1", "w2") == [("c1", "All", 14, -1234.5, 0.5, 0.5), ("c1", "m2", 15, -1230.25, 0.25, 1.75)]
        assert rows(N.pair_models(fits, "All"), "cluster", "model", "stat", "ddf") == [("c1", "m2", 8.5, 1)]
        text = " 4 300\n\n   6..1  0.1  10.0  10.0\n   6..2  0.1  250.5  50.5  0.2\ndS tree:\n(A: 0.1, B: 0.2);\ndN tree:\n(A: 0.01, B: 0.02);\nw ratios as labels for TreeView:\n(A #0.1 , B #0.1 );\n"
        assert rows(X.read_codeml_freeratio(spark, put(tmp_path, "fr/c7.mlc", text), large), "cluster", "species", "len", "n", "s", "dn", "ds", "w") == [("c7", "A", 300, 250.5, 50.5, 0.01, 0.1, 0.1), ("c7", "B", 300, 250.5, 50.5, 0.02, 0.2, 0.1)]
        beb = "Bayes Empirical Bayes (BEB) analysis\nPositive sites for foreground lineages Prob(w>1):\n    10 K 0.987*\n    22 A 0.612\n\nThe grid (see ternary graph)\n    33 A 0.9\n"
        for kind, lnl, more in (("fix", "-1236.500000", ""), ("nofix", "-1234.500000", beb)):
            put(tmp_path, f"bs/c1/S1/{kind}.mlc", f"lnL(ntime: 11  np: 16):  {lnl}  +0.0\nforeground w     0.1  1.0  2.5  1.5\n{more}")
        put(tmp_path, "bs/c2/S1/fix.mlc", "no result\n")
        fits = X.read_codeml_branchsite(spark, str(tmp_path / "bs/*/*"), large)
        assert [(r["cluster"], r["species"], r["kind"], r["lnl"], r["w"], r["sites"] and [tuple(x) for x in r["sites"]]) for r in fits.orderBy("kind").collect()] == [("c1", "S1", "fix", -1236.5, 2.5, None), ("c1", "S1", "nofix", -1234.5, 2.5, [(10, "K", 0.987), (22, "A", 0.612)])]
        assert [(r["stat"], r["ddf"], len(r["sites"]), round(r["p"], 6)) for r in N.pair_branchsite(fits).collect()] == [(4.0, 1, 2, 0.0455)]
        text = "CC\tpsmc\n" + "".join(f"RD\t{k}\nRI\t0.{k}\nDT\t0.5\nTR\t0.010\t0.002\nRS\t0\t0.5\t{k}.5\nRS\t1\t0.7\t2\nPA\t4+5*3\n//\n" for k in range(4))
        assert rows(X.read_psmc(spark, put(tmp_path, "ps/x.psmc", text), large), "sample", "round", "fit", "theta", "k", "lam") == sorted(("x", n, n / 10, 0.01, k, (n + 0.5, 2.0)[k]) for n in range(4) for k in range(2))
        assert rows(X.read_pair_distance(spark, put(tmp_path, "ds/e1/x.dnadist", "    2\na 0.00 1.25\nb 1.25 0.00\n"), large), "element", "distance") == [("e1", 1.25)]
        text = "#NEXUS\nBEGIN TREES;\n\tUTREE 1 = (old: 9);\n\tUTREE 2 = ((A: 1.5, B: 2.5) [&95%={0.5, 0.75}]: 3);\nEND;\n"
        assert rows(X.read_time_tree(spark, put(tmp_path, "tt/t.tre", text), large), "tree_id", "ord", "length", "ci_lo", "ci_hi") == [("t", 0, 1.5, None, None), ("t", 1, 2.5, None, None), ("t", 2, 3.0, 0.5, 0.75)]
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k)
