"""Intervals (1-based, ends inclusive): merging, overlap joins on bins, coverage, segmentation and gap runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Length of a bin of the overlap join, a power of two near the length of a long feature.
BIN = 512
#: Length of the stretches that intervals are merged in: of sequences, and of queries.
SPAN, QUERY_SPAN = 1 << 20, 1 << 12
#: Rows of a score track that are cut into runs together.
STRETCH = 1 << 16


def merge(df: DataFrame, by: list[str], span: int | None = SPAN) -> DataFrame:
    """Islands (by, start, stop) of overlapping or touching intervals.

    Intervals are cut at multiples of ``span`` and merged within each stretch; only islands that reach a stretch's edge meet
    again, so a sequence that holds most of the rows is shared among tasks. Without ``span`` each key is merged at once.
    """
    rows = df.select(*by, "start", "stop")
    if span is None:
        return _islands(rows, by)
    one = _islands(binned(rows, span), [*by, "bin"])
    edge = (F.col("start") == F.col("bin") * span + 1) | (F.col("stop") == (F.col("bin") + 1) * span)
    return _islands(one.withColumn("inner", F.when(edge, F.lit(None)).otherwise(F.col("start"))), [*by, "inner"]).drop("inner")


def _islands(df: DataFrame, by: list[str]) -> DataFrame:
    order = W.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("start") <= reach + 1, 0).otherwise(1)
    island = F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = df.withColumn("new", new).withColumn("island", island)
    return rows.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def binned(df: DataFrame, size: int = BIN) -> DataFrame:
    """Every interval cut at bin edges: bin, start, stop within it."""
    first, last = F.floor((F.col("start") - 1) / size), F.floor((F.col("stop") - 1) / size)
    rows = df.withColumn("bin", F.explode(F.sequence(first, last)))
    return rows.withColumn("start", F.greatest("start", F.col("bin") * size + 1)).withColumn("stop", F.least("stop", (F.col("bin") + 1) * size))


def overlap_join(features: DataFrame, size: int = BIN) -> DataFrame:
    """track_i, track_j, shared: bases of a sequence that both tracks cover, for every ordered pair of tracks.

    Tracks are merged first; pieces cut at bin edges meet on (sequence, bin) and their overlaps add up, so none counts twice.
    """
    pieces = binned(merge(features, ["track", "seqname"]), size)
    a = pieces.select(F.col("track").alias("track_i"), "seqname", "bin", F.col("start").alias("s1"), F.col("stop").alias("e1"))
    b = pieces.select(F.col("track").alias("track_j"), "seqname", "bin", F.col("start").alias("s2"), F.col("stop").alias("e2"))
    joined = a.join(b, ["seqname", "bin"]).where("s1 <= e2 AND s2 <= e1")
    return joined.groupBy("track_i", "track_j").agg(F.sum(F.least("e1", "e2") - F.greatest("s1", "s2") + 1).alias("shared"))


def _covered(df: DataFrame, by: list[str], within: list[str], span: int = SPAN) -> DataFrame:
    """by, covered: bases that intervals of the same ``by`` and ``within`` cover, each once.

    Islands are not needed: of the intervals cut at multiples of ``span``, in order, each adds what lies behind those before it.
    """
    rows = binned(df.select(*by, *within, "start", "stop"), span)
    reach = F.max("stop").over(W.partitionBy(*by, *within, "bin").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    added = F.greatest(F.lit(0).cast("long"), F.col("stop") - F.greatest(F.col("start") - 1, reach))
    return rows.select(*by, added.alias("covered")).groupBy(*by).agg(F.sum("covered").alias("covered"))


def covered(features: DataFrame, by: list[str]) -> DataFrame:
    """by, covered: bases that intervals cover, each once."""
    return _covered(features, by, ["seqname"])


def track_coverage(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """track, seqname, fraction: share of each sequence that a track covers."""
    got = _covered(features, ["track", "seqname"], [])
    return got.join(lengths, "seqname").select("track", "seqname", "covered", F.round(F.try_divide("covered", "length"), 6).alias("fraction"))


def overlap_crosstab(features: DataFrame, digits: int = 4) -> DataFrame:
    """track_i, track_j, ratio: shared bases of both over those that track i covers; null where it covers none."""
    of = covered(features, ["track"]).select(F.col("track").alias("track_i"), "covered")
    return overlap_join(features).join(of, "track_i").select("track_i", "track_j", F.round(F.try_divide("shared", "covered"), digits).alias("ratio"))


def track_intersect(features: DataFrame, a: str, b: str) -> DataFrame:
    """shared: bases that both tracks cover."""
    return overlap_join(features.where(F.col("track").isin(a, b))).where((F.col("track_i") == a) & (F.col("track_j") == b)).select("shared")


def track_positions(features: DataFrame) -> DataFrame:
    """seqname, position, track: a row for each covered base (as long as the covered sequence; ask for few tracks)."""
    return merge(features, ["track", "seqname"]).select("seqname", F.explode(F.sequence("start", "stop")).alias("position"), "track")


def segment_scores(rows: DataFrame, threshold: float, min_len: int | None = None, emit_open: bool = True, max_step: int | None = None) -> DataFrame:
    """Runs of rows (seqname, row_no, start, stop, score) with score >= threshold: seqname, start, stop, n, score.

    ``emit_open=False`` drops a run that lasts to the sequence's end; ``max_step`` also cuts where starts lie further apart. Cuts are
    counted within stretches of row_no and shifted by those of the stretches before, so a long track is shared among tasks.
    """
    key = ["seqname", "_b"]
    own, by_stretch = W.partitionBy(*key).orderBy("row_no"), W.partitionBy("seqname").orderBy("_b")
    rows = rows.withColumn("_b", F.floor(F.col("row_no") / STRETCH)).withColumn("cut", (F.col("score") < threshold).cast("int"))
    if max_step is not None:
        ends = rows.groupBy(*key).agg(F.max_by("start", "row_no").alias("_end"))
        rows = rows.join(ends.select(*key, F.lag("_end").over(by_stretch).alias("_end")), key)
        step = F.col("start") - F.coalesce(F.lag("start").over(own), F.col("_end")) > max_step
        rows = rows.withColumn("cut", F.greatest("cut", F.coalesce(step.cast("int"), F.lit(0))))
    sums = rows.groupBy(*key).agg(F.sum("cut").alias("_cuts"), F.max("row_no").alias("_last"))
    sums = sums.select(*key, F.coalesce(F.sum("_cuts").over(by_stretch.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_shift"), F.max("_last").over(W.partitionBy("seqname")).alias("last"))
    runs = rows.withColumn("run", F.sum("cut").over(own.rowsBetween(W.unboundedPreceding, 0))).join(sums, key).withColumn("run", F.col("run") + F.col("_shift")).where(F.col("score") >= threshold)
    out = runs.groupBy("seqname", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"), F.max(F.col("row_no") == F.col("last")).alias("open"))
    if min_len is not None:
        out = out.where(F.col("stop") - F.col("start") >= min_len)
    if not emit_open:
        out = out.where(~F.col("open"))
    return out.select("seqname", "start", "stop", "n", F.lit(float(threshold)).alias("score"))


def filter_scores(rows: DataFrame, threshold: float) -> DataFrame:
    """The rows with score >= threshold."""
    return rows.where(F.col("score") >= threshold)


def chunks(seqs: DataFrame, size: int = 1 << 20, overlap: int = 0) -> DataFrame:
    """seq_id, chunk_no, chunk_start (1-based), chunk: sequences in pieces that overlap the next by ``overlap``.

    Sequences are rows (seq_id, seq), or are in pieces already (seq_id, chunk_start, chunk, without overlap), as ``read_fasta_chunks``
    gives them: these are cut anew, so that no row ever holds a sequence.
    """
    if "chunk" in seqs.columns:
        return rechunked(seqs.select("seq_id", F.col("chunk_start").alias("begin"), F.col("chunk").alias("piece")), ["seq_id"], size, overlap)
    n = F.greatest(F.ceil(F.length("seq") / size), F.lit(1))
    rows = seqs.select("seq_id", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select("seq_id", "chunk_no", (F.col("chunk_no") * size + 1).alias("chunk_start"), F.substr("seq", (F.col("chunk_no") * size + 1).cast("int"), F.lit(size + overlap)).alias("chunk"))


def rechunked(pieces: DataFrame, by: list[str], size: int, overlap: int = 0) -> DataFrame:
    """by, chunk_no, chunk_start, chunk of adjoining pieces (by, begin: from 1, piece): each is cut at the chunks' borders and goes to
    the chunks that it lies in, where the cuts are joined."""
    end = F.col("begin") + F.length("piece") - 1
    first = F.greatest(F.lit(0), F.floor((F.col("begin") - 1 - overlap) / size))
    last = F.greatest(first, F.floor((end - 1) / size))
    rows = pieces.where("piece is not null").withColumn("chunk_no", F.explode(F.sequence(first, last)))
    at = F.greatest(F.col("begin"), F.col("chunk_no") * size + 1)
    upto = F.least(end, (F.col("chunk_no") + 1) * size + overlap)
    cut = F.substr("piece", (at - F.col("begin") + 1).cast("int"), (upto - at + 1).cast("int"))
    joined = rows.select(*by, "chunk_no", F.struct(at.alias("at"), cut.alias("cut")).alias("x")).groupBy(*by, "chunk_no").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return joined.select(*by, "chunk_no", (F.col("chunk_no") * size + 1).alias("chunk_start"), F.array_join(F.transform("x", lambda x: x["cut"]), "").alias("chunk"))


def find_gaps(seqs: DataFrame, min_len: int = 100, gap: str = "N", compat: bool = False, size: int = 1 << 20) -> DataFrame:
    """seq_id, start, stop: maximal runs of ``gap`` (either case) of at least ``min_len``.

    Chunks are searched apart and runs that touch are joined again. ``compat`` ends a run one past its last base and loses a
    run that reaches one of the last two positions.
    """
    pattern = f"[{gap.upper()}{gap.lower()}]+"
    found = F.regexp_extract_all("chunk", F.lit(pattern), F.lit(0))
    pieces = chunks(seqs, size).where(F.col("chunk").rlike(pattern)).select("seq_id", "chunk_start", F.transform(found, lambda x: F.length(x)).alias("runs"), F.transform(F.split("chunk", pattern, -1), lambda x: F.length(x)).alias("rest"))
    rows = pieces.select("seq_id", "chunk_start", F.posexplode("runs").alias("i", "n"), "rest")
    rows = rows.withColumn("skip", F.get("rest", F.col("i")))
    order = W.partitionBy("seq_id", "chunk_start").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    stop = F.col("chunk_start") - 1 + F.sum(F.col("skip") + F.col("n")).over(order)
    rows = rows.withColumn("stop", stop).select("seq_id", (F.col("stop") - F.col("n") + 1).alias("start"), "stop")
    out = merge(rows, ["seq_id"]).where(F.col("stop") - F.col("start") + 1 >= min_len)
    if compat:
        last = F.length("seq") if "seq" in seqs.columns else F.col("chunk_start") + F.length("chunk") - 1
        ends = seqs.groupBy("seq_id").agg(F.max(last).alias("len"))
        out = out.join(ends, "seq_id").where(F.col("stop") < F.col("len") - 1).withColumn("stop", F.col("stop") + 1).drop("len")
    return out


def best_target_coverage(blocks: DataFrame) -> DataFrame:
    """query, target, covered, ratio: of each query's targets, the one whose blocks cover most of the query's bases."""
    spans = blocks.select("query", "qlen", "target", F.col("qstart").alias("start"), (F.col("qstart") + F.col("size") - 1).alias("stop"))
    got = _covered(spans, ["query", "qlen", "target"], [], QUERY_SPAN)
    top = F.max_by(F.struct("target", "covered"), F.struct("covered", "target"))
    return got.groupBy("query", "qlen").agg(top.alias("t")).select("query", "t.target", "t.covered", F.round(F.try_divide("t.covered", "qlen"), 6).alias("ratio"))


def psl_blocks(psl: DataFrame, compat: bool = False) -> DataFrame:
    """query, qlen, target, qstart, size of each alignment block; minus-strand starts are turned to the forward strand."""
    rows = psl.select(F.col("q_name").alias("query"), F.col("q_size").alias("qlen"), F.col("t_name").alias("target"), "strand", F.explode(F.arrays_zip("q_starts", "block_sizes")).alias("b"))
    start = F.col("b.q_starts")
    if not compat:
        start = F.when(F.substring("strand", 1, 1) == "-", F.col("qlen") - F.col("b.q_starts") - F.col("b.block_sizes")).otherwise(start)
    return rows.select("query", "qlen", "target", (start + 1).alias("qstart"), F.col("b.block_sizes").alias("size"))


CLASSES = (200, 500, 1000)


def _classes(length: Column) -> Column:
    return F.explode(F.filter(F.array(*map(F.lit, CLASSES)), lambda c: length > c)).alias("longer_than")


def length_classes(lengths: DataFrame) -> DataFrame:
    """longer_than, n, bases: sequences longer than each class limit."""
    return lengths.select("length", _classes(F.col("length"))).groupBy("longer_than").agg(F.count("*").alias("n"), F.sum("length").alias("bases"))


def coverage_report(best: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per class: sequences, those aligned, covered to more than 50 % and 90 %, and these as fractions; null for an empty class."""
    rows = lengths.join(best.select(F.col("query").alias("seq_id"), "ratio"), "seq_id", "left").select("ratio", _classes(F.col("length")))
    out = rows.groupBy("longer_than").agg(F.count("*").alias("n"), F.count("ratio").alias("aligned"), F.count_if(F.col("ratio") > 0.5).alias("half"), F.count_if(F.col("ratio") > 0.9).alias("most"))
    return out.select("*", *[fraction(F.col(c), F.col("n")).alias(f"{c}_fraction") for c in ("aligned", "half", "most")])


def fraction(part: Column, whole: Column) -> Column:
    """part / whole to six digits; null for none."""
    return F.round(F.try_divide(part, whole), 6)
