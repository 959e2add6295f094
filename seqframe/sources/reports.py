"""Reports of repeat and gene finders, as GFF rows. Input: numbered lines (source_file, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lines import blocks, carried, file_name, gff, number, pick, running, tokens

LTR = "LTR_retrotransposon"
FIVE, THREE = "five_prime_LTR", "three_prime_LTR"
TSD = "target_site_duplication"


def _parts(*parts: tuple[str | Column, Column, Column]) -> Column:
    """Features of one element: (name, start, stop), those without a start left out, one row each."""
    rows = F.array(*[F.struct((F.lit(n) if isinstance(n, str) else n).alias("feature"), a.cast("bigint").alias("start"), b.cast("bigint").alias("stop")) for n, a, b in parts])
    return F.explode(F.filter(rows, lambda p: p["start"].isNotNull())).alias("p")


def _span(c: Column, pattern: str) -> tuple[Column, Column]:
    """The two numbers of ``a - b`` after the pattern."""
    full = pattern + r"\s*(\d+)\s*-\s*(\d+)"
    return number(pick(c, full, 1)), number(pick(c, full, 2))


def ltrfinder_elements(lines: DataFrame) -> DataFrame:
    """One row per ``[n]`` block: span, strand, score, similarity, status flags, both LTRs, TSR, PBS, PPT and domains."""
    rows = blocks(lines, r"^\[\d+\]\s").where("block > 0")
    c = F.col("line")
    found = {"n": number(pick(c, r"^\[(\d+)\]\s+(\S+)")), "seqname": pick(c, r"^\[(\d+)\]\s+(\S+)", 2), "strand": pick(c, r"^Location :.*Strand:([+-])"), "score": number(pick(c, r"^Score\s+: ([\d.]+)"), "double"), "similarity": number(pick(c, r"similarity:([\d.]+)"), "double"), "status": pick(c, r"^Status\s+: ([01]+)")}
    for name, head in (("element", "^Location :"), ("ltr5", "^5'-LTR\\s+:"), ("ltr3", "^3'-LTR\\s+:"), ("tsr5", r"^TSR\s+:"), ("pbs", r"^PBS\s+:\s*\[[^\]]*\]"), ("ppt", r"^PPT\s+:\s*\[[^\]]*\]")):
        found[f"{name}_start"], found[f"{name}_stop"] = _span(c, head)
    found["tsr3_start"], found["tsr3_stop"] = _span(c, r"^TSR\s+:\s*\d+ - \d+ ,")
    domain = r"^Domain: (\d+) - (\d+).*possible ORF:(\d+)-(\d+), \(([^)]*)\)"
    entry = F.when(c.rlike(domain), F.struct("line_no", pick(c, domain, 5).alias("name"), *[number(pick(c, domain, g)).alias(n) for g, n in ((1, "start"), (2, "stop"), (3, "orf_start"), (4, "orf_stop"))]))
    wide = rows.select("source_file", "block", *[v.alias(k) for k, v in found.items()], entry.alias("domain"))
    return wide.groupBy("source_file", "block").agg(*[F.max(k).alias(k) for k in found], F.sort_array(F.collect_list("domain")).alias("domains")).where("element_start is not null")


#: A domain's name in the report and in the features.
DOMAINS = (("integrase core", "integrase_core"), ("integrase (c", "integrase_cterm"), ("rnaseh", "rnaseh"), ("reverse transcriptase", "rt"))


def ltrfinder_to_gff(lines: DataFrame) -> DataFrame:
    """Features of every element: the whole, its LTRs, binding site, tract, target sites, domains and their ORFs."""
    rows = ltrfinder_elements(lines)
    at = lambda n: (F.col(f"{n}_start"), F.col(f"{n}_stop"))
    fixed = F.array(*[F.struct(F.lit(f).alias("feature"), a.alias("start"), b.alias("stop")) for f, (a, b) in ((LTR, at("element")), (FIVE, at("ltr5")), (THREE, at("ltr3")), ("primer_binding_site", at("pbs")), ("RR_tract", at("ppt")), (TSD, at("tsr5")), (TSD, at("tsr3")))])
    kind = lambda d: F.coalesce(*[F.when(F.lower(d["name"]).contains(text), name) for text, name in DOMAINS])
    part = lambda suffix, a, b: F.transform("domains", lambda d: F.struct(F.concat(kind(d), F.lit(suffix)).alias("feature"), d[a].alias("start"), d[b].alias("stop")))
    every = F.filter(F.concat(fixed, part("_domain", "start", "stop"), part("_orf", "orf_start", "orf_stop")), lambda p: p["start"].isNotNull() & p["feature"].isNotNull())
    out = rows.select("source_file", "seqname", "score", "strand", "n", F.explode(every).alias("p"))
    return gff(out, seqname=F.col("seqname"), source=F.lit("ltr_finder"), feature=F.col("p.feature"), start=F.col("p.start"), stop=F.col("p.stop"), score=F.col("score"), strand=F.col("strand"), attribute=F.concat(F.lit("ltr_finder_"), F.col("n").cast("string")))


def ltrfinder_summary(lines: DataFrame, name: str = "def") -> DataFrame:
    """One row per element, with the id ``seq_LTRFinder_<set><n>``."""
    rows = ltrfinder_elements(lines)
    cols = ["seqname", "element_start", "element_stop", "strand", "score", "similarity", "status", "ltr5_start", "ltr5_stop", "ltr3_start", "ltr3_stop", "tsr5_start", "tsr5_stop", "tsr3_start", "tsr3_stop", "pbs_start", "pbs_stop", "ppt_start", "ppt_stop"]
    return rows.select(F.concat("seqname", F.lit(f"_LTRFinder_{name}"), F.col("n").cast("string")).alias("element"), *cols, F.size("domains").cast("bigint").alias("n_domains"))


def ltrseq_to_gff(lines: DataFrame) -> DataFrame:
    """Accepted reports (19 tokens) as span and both LTRs; rejected ones have 15 tokens."""
    rows = lines.where(F.col("line").startswith("Report:")).withColumn("t", tokens(F.col("line"))).where((F.size("t") >= 19) & (F.get("t", F.lit(3)) == "Accepted"))
    rows = running(rows, "no")
    t = lambda i: number(F.get("t", F.lit(i)))
    out = rows.select("source_file", "no", number(F.get("t", F.lit(16)), "double").alias("score"), _parts((LTR, t(4), t(8)), (FIVE, t(4), t(5)), (THREE, t(7), t(8))))
    seq = file_name(F.col("source_file"))
    return gff(out, seqname=seq, source=F.lit("LTR_seq"), feature=F.col("p.feature"), start=F.col("p.start"), stop=F.col("p.stop"), score=F.col("score"), attribute=F.concat(seq, F.lit("_ltrseq_"), F.col("no")))


def findltr_to_gff(lines: DataFrame) -> DataFrame:
    """Lines of exactly ten tokens: the whole element to the end of its 3' LTR, and both LTRs."""
    rows = lines.withColumn("t", tokens(F.col("line"))).where((F.size("t") == 10) & F.get("t", F.lit(0)).rlike(r"^\d+$"))
    t = lambda i: number(F.get("t", F.lit(i)))
    out = rows.select("source_file", F.get("t", F.lit(0)).alias("no"), F.get("t", F.lit(5)).alias("strand"), _parts((LTR, t(1), t(4)), (FIVE, t(1), t(2)), (THREE, t(3), t(4))))
    seq = file_name(F.col("source_file"))
    return gff(out, seqname=seq, source=F.lit("FindLTR"), feature=F.col("p.feature"), start=F.col("p.start"), stop=F.col("p.stop"), strand=F.col("strand"), attribute=F.concat(seq, F.lit("_findltr_"), F.col("no")))


def repseek_to_gff(lines: DataFrame, compat: bool = False) -> DataFrame:
    """Both copies of every repeat; a copy ends at start + length - 1, with ``compat`` one past it."""
    rows = running(lines.where(F.col("line").rlike(r"^\w+\.(dir|inv)\s")).withColumn("t", tokens(F.col("line"))), "no")
    kind, way = F.split_part(F.get("t", F.lit(0)), F.lit("."), F.lit(1)), F.split_part(F.get("t", F.lit(0)), F.lit("."), F.lit(2))
    name = F.concat(F.when(F.lower(kind) == "distant", "").otherwise(F.concat(F.when(F.lower(kind) == "overlap", "overlapping").otherwise(F.lower(kind)), F.lit("_"))), F.when(way == "inv", "inverted").otherwise("direct"), F.lit("_repeat"))
    t = lambda i: number(F.get("t", F.lit(i)))
    less = 0 if compat else 1
    out = rows.select("source_file", "no", way.alias("way"), number(F.get("t", F.lit(8)), "double").alias("score"), _parts((name, t(1), t(1) + t(3) - less), (name, t(2), t(2) + t(4) - less)))
    return gff(out, seqname=file_name(F.col("source_file")), source=F.lit("repseek"), feature=F.col("p.feature"), start=F.col("p.start"), stop=F.col("p.stop"), score=F.col("score"), strand=F.lit("+"), attribute=F.concat(F.lit("repseek"), F.col("no"), F.lit(":"), F.col("way")))


def trf_to_gff(lines: DataFrame) -> DataFrame:
    """Tandem repeats: lines of exactly 15 tokens; ids ``TRF%04d``."""
    rows = running(lines.withColumn("t", tokens(F.col("line"))).where((F.size("t") == 15) & F.get("t", F.lit(0)).rlike(r"^\d+$")), "no")
    return gff(rows, seqname=file_name(F.col("source_file")), source=F.lit("TRF"), feature=F.lit("tandem_repeat"), start=number(F.get("t", F.lit(0))), stop=number(F.get("t", F.lit(1))), score=number(F.get("t", F.lit(7)), "double"), attribute=F.concat(F.lit("TRF"), F.when(F.length("no") < 4, F.lpad("no", 4, "0")).otherwise(F.col("no"))))


def tenest_to_gff(lines: DataFrame) -> DataFrame:
    """SOLO, PAIR, FRAG and NLTR records; coordinates stand in groups of four, of which the first two are on the sequence."""
    c = F.col("line")
    head = r"^(SOLO|PAIR|FRAG|NLTR) (\S+) (\S+)"
    rows = carried(lines, F.when(c.rlike(head), F.struct(pick(c, head, 1).alias("kind"), pick(c, head, 2).alias("id"), pick(c, head, 3).alias("te"))), "head")
    rows = rows.select("*", "head.*").where(~c.rlike(head) & F.col("id").isNotNull()).withColumn("t", tokens(c)).where(F.get("t", F.lit(0)) == F.col("id"))
    side = F.when(F.col("kind") == "PAIR", F.get("t", F.lit(1)))
    rows = rows.withColumn("side", side).withColumn("xs", F.when(F.col("kind") == "PAIR", F.slice("t", 3, F.size("t"))).otherwise(F.slice("t", 2, F.size("t"))))
    rows = rows.where(F.size("xs") >= 4).select("source_file", "kind", "id", "te", "side", "xs", F.explode(F.sequence(F.lit(0), F.floor(F.size("xs") / 4).cast("int") - 1)).alias("k"))
    a, b = number(F.get("xs", F.col("k") * 4)), number(F.get("xs", F.col("k") * 4 + 1))
    feature = F.when(F.col("side") == "L", "five_prime_LTR_component").when(F.col("side") == "R", "three_prime_LTR_component").when(F.col("kind") == "NLTR", "non_LTR_retrotransposon").otherwise(LTR)
    return gff(rows, seqname=file_name(F.col("source_file")), source=F.lit("tenest"), feature=feature, start=F.least(a, b), stop=F.greatest(a, b), attribute=F.concat_ws("_", F.lower("kind"), "te", "id"))


def findmite_elements(lines: DataFrame) -> DataFrame:
    """One row per ``Pattern`` block: pattern, seqname, body (lines joined), start, stop, seq, and its number in the file."""
    c = F.col("line")
    rows = blocks(lines, r"^Pattern\s*:")
    settings = rows.where("block = 0").groupBy("source_file").agg(F.max(pick(c, r"^Direct repeats\s*:\s*(\S+)")).alias("repeat"), F.max(pick(c, r"^Length of TIR[^:]*:\s*(\d+)")).alias("tir"))
    is_head = c.rlike(r"^(Pattern|Sequence|Mismatch)\s*:")
    one = rows.where("block > 0").groupBy("source_file", "block").agg(F.max(pick(c, r"^Pattern\s*:\s*(\S+)")).alias("pattern"), F.max(pick(c, r"^Sequence\s*:\s*>?(\S+)")).alias("seqname"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~is_head, F.struct("line_no", F.trim(c).alias("x"))))), lambda s: s["x"]), "").alias("body"))
    body = r"\((\d+)\)-----([A-Za-z]*)-----\((\d+)\)"
    return one.join(settings, "source_file").select("source_file", "block", "repeat", "tir", "pattern", "seqname", number(pick(F.col("body"), body, 1)).alias("start"), pick(F.col("body"), body, 2).alias("seq"), number(pick(F.col("body"), body, 3)).alias("stop")).where("start is not null")


def findmite_to_gff(lines: DataFrame) -> DataFrame:
    """Elements as ``mite`` features, named by sequence, repeat, TIR length and number."""
    rows = findmite_elements(lines)
    name = F.concat_ws("_", "repeat", "tir")
    return gff(rows, seqname=F.col("seqname"), source=F.concat(F.lit("findmite:"), name), feature=F.lit("mite"), start=F.col("start"), stop=F.col("stop"), attribute=F.concat_ws("_", "seqname", name, F.col("block").cast("string")))


EXON_TYPES = ("Init", "Intr", "Term", "Sngl")


def genscan_to_gff(lines: DataFrame) -> DataFrame:
    """Exons between the dashed rule and the peptides; minus-strand spans are turned, the score is the exon's probability."""
    c = F.col("line")
    rows = blocks(blocks(lines, r"^-{3,}", "open"), "(?i)predicted peptide", "shut")
    rows = rows.where("open > 0 and shut = 0").withColumn("t", tokens(c)).where((F.size("t") >= 12) & F.get("t", F.lit(1)).isin(list(EXON_TYPES)))
    a, b = number(F.get("t", F.lit(3))), number(F.get("t", F.lit(4)))
    gene = F.split_part(F.get("t", F.lit(0)), F.lit("."), F.lit(1))
    return gff(rows, seqname=file_name(F.col("source_file")), source=F.lit("genscan"), feature=F.lit("exon"), start=F.least(a, b), stop=F.greatest(a, b), score=number(F.get("t", F.lit(11)), "double"), strand=F.get("t", F.lit(2)), attribute=F.concat(F.lit("gene_"), gene))


def genemark_to_gff(lines: DataFrame) -> DataFrame:
    """One ``exon`` row per exon; genes are numbered ``RNA%04d`` within a report."""
    rows = lines.where(F.col("line").rlike(r"^\s*\d+\s+\d+\s+[+-]\s+\S+\s+\d+\s+\d+\s")).withColumn("t", tokens(F.col("line")))
    rows = rows.withColumn("gene", F.get("t", F.lit(0)).cast("bigint"))
    # genes of a report, few beside its exons
    order = F.row_number().over(W.partitionBy("source_file").orderBy("gene")).cast("string")
    genes = rows.select("source_file", "gene").distinct().withColumn("no", order)
    rows = rows.join(genes, ["source_file", "gene"])
    return gff(rows, seqname=file_name(F.col("source_file")), source=F.lit("GeneMarkHMM"), feature=F.lit("exon"), start=number(F.get("t", F.lit(4))), stop=number(F.get("t", F.lit(5))), strand=F.get("t", F.lit(2)), attribute=F.concat(F.lit("RNA"), F.when(F.length("no") < 4, F.lpad("no", 4, "0")).otherwise(F.col("no"))))
