"""Queries on features, score tracks and alignment blocks."""

from pyspark.sql import functions as F

from ..functions import stats as N
from ..operators import elements as E
from ..operators import intervals as I
from .registry import query

BASES = "(SELECT DISTINCT track, seqname, unnest(generate_series(start, stop)) AS pos FROM {features_v})"
PIECE = "(SELECT DISTINCT query, qlen, target, unnest(generate_series(qstart, qstart + size - 1)) AS pos FROM {blocks_v})"
BEST = f"(SELECT query, qlen, target, covered FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY covered DESC, target DESC) AS r FROM (SELECT query, qlen, target, count(*) AS covered FROM {PIECE} GROUP BY ALL)) WHERE r = 1)"
LENGTHS = "(SELECT query AS seq_id, CAST(max(size) * 30 AS BIGINT) AS length FROM {blocks_v} GROUP BY query)"


def lengths(get):
    return get("blocks_v").groupBy(F.col("query").alias("seq_id")).agg((F.max("size") * 30).alias("length"))


@query(f"SELECT a.track AS track_i, b.track AS track_j, count(*) AS shared FROM {BASES} a JOIN {BASES} b ON a.seqname = b.seqname AND a.pos = b.pos GROUP BY ALL")
def j8_overlap_join(get):
    return I.overlap_join(get("features_v"))


@query(f"SELECT a.track, a.seqname, count(*) AS covered, round(count(*) / any_value(l.length), 6) AS fraction FROM {BASES} a JOIN (SELECT seqname, max(stop) AS length FROM {{features_v}} GROUP BY seqname) l ON a.seqname = l.seqname GROUP BY a.track, a.seqname")
def a9_track_coverage(get):
    f = get("features_v")
    return I.track_coverage(f, f.groupBy("seqname").agg(F.max("stop").alias("length")))


@query(f"WITH b AS (SELECT * FROM {BASES}), c AS (SELECT track, count(*) AS n FROM b GROUP BY track) SELECT x.track AS track_i, y.track AS track_j, round(count(*) / any_value(c.n), 4) AS ratio FROM b x JOIN b y ON x.seqname = y.seqname AND x.pos = y.pos JOIN c ON x.track = c.track GROUP BY ALL")
def a10_overlap_crosstab(get):
    return I.overlap_crosstab(get("features_v"))


@query("SELECT DISTINCT seqname, unnest(generate_series(start, stop)) AS position, track FROM {features_v} WHERE track = 'click'")
def a11_track_positions(get):
    return I.track_positions(get("features_v").where(F.col("track") == "click"))


@query(f"SELECT count(*) AS shared FROM {BASES} a JOIN {BASES} b ON a.seqname = b.seqname AND a.pos = b.pos WHERE a.track = 'click' AND b.track = 'view'")
def u3_track_intersect(get):
    return I.track_intersect(get("features_v"), "click", "view")


@query("SELECT event_id, 'ALLDB' AS track, track AS source, seqname, start, stop FROM {features_v} WHERE track IN ('click', 'view')")
def u1_union_tracks(get):
    f = get("features_v")
    return E.union_tracks({t: f.where(F.col("track") == t) for t in ("click", "view")}).select("event_id", "track", "source", "seqname", "start", "stop")


@query(f"SELECT track, seqname, count(*) AS covered FROM {BASES} GROUP BY ALL")
def o2_merge(get):
    return I.merge(get("features_v"), ["track", "seqname"]).groupBy("track", "seqname").agg(F.sum(F.col("stop") - F.col("start") + 1).alias("covered"))


RUNS = """
WITH s AS (SELECT *, row_no - row_number() OVER (PARTITION BY seqname ORDER BY row_no) AS g FROM {scores_v} WHERE score >= 40)
SELECT seqname, min(row_no) AS start, max(row_no) + 19 AS stop, count(*) AS n, CAST(40 AS DOUBLE) AS score FROM s GROUP BY seqname, g
"""


def _scores(get):
    return get("scores_v").select("seqname", "row_no", F.col("row_no").alias("start"), (F.col("row_no") + 19).alias("stop"), "score")


@query(RUNS)
def w1_segment_scores(get):
    return I.segment_scores(_scores(get), 40)


@query(RUNS + " HAVING max(row_no) + 19 - min(row_no) >= 21")
def w1_segment_scores_min_len(get):
    return I.segment_scores(_scores(get), 40, min_len=21)


@query(RUNS + " HAVING max(row_no) < (SELECT max(row_no) FROM {scores_v} t WHERE t.seqname = s.seqname)")
def w1_segment_scores_closed(get):
    return I.segment_scores(_scores(get), 40, emit_open=False)


@query("SELECT seqname, row_no, score FROM {scores_v} WHERE score >= 40")
def w2_filter_scores(get):
    return I.filter_scores(get("scores_v"), 40).select("seqname", "row_no", "score")


@query(f"SELECT query, target, covered, round(covered / qlen, 6) AS ratio FROM {BEST}")
def a7_best_target_coverage(get):
    return I.best_target_coverage(get("blocks_v"))


@query(f"SELECT CAST(c AS INT) AS longer_than, count(*) AS n, CAST(sum(length) AS BIGINT) AS bases FROM {LENGTHS} JOIN (SELECT unnest([200, 500, 1000]) AS c) ON length > c GROUP BY c")
def a6_length_classes(get):
    return I.length_classes(lengths(get))


@query(f"""
WITH r AS (SELECT c AS longer_than, covered / qlen AS ratio FROM {LENGTHS} l JOIN (SELECT unnest([200, 500, 1000]) AS c) ON length > c LEFT JOIN (SELECT * FROM {BEST} WHERE covered > 200) b ON l.seq_id = b.query),
n AS (SELECT longer_than, count(*) AS n, count(ratio) AS aligned, count(*) FILTER (WHERE ratio > 0.5) AS half, count(*) FILTER (WHERE ratio > 0.9) AS most FROM r GROUP BY ALL)
SELECT *, round(aligned / n, 6) AS aligned_fraction, round(half / n, 6) AS half_fraction, round(most / n, 6) AS most_fraction FROM n
""")
def a8_coverage_report(get):
    return I.coverage_report(I.best_target_coverage(get("blocks_v")).where("covered > 200"), lengths(get))


@query("SELECT query, target, qstart, size FROM {blocks_v} WHERE query IN (SELECT 'q' || CAST(p_partkey AS STRING) FROM part WHERE p_size <= 10)")
def j6_restrict(get):
    ids = get("part").where("p_size <= 10").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query"))
    return N.restrict(get("blocks_v"), ids, "query").select("query", "target", "qstart", "size")


@query("SELECT track, round(count(*) FILTER (WHERE score > 50) / count(*), 6) AS fraction FROM {features_v} GROUP BY track")
def n9_fraction(get):
    return get("features_v").groupBy("track").agg(I.fraction(F.count_if(F.col("score") > 50), F.count("*")).alias("fraction"))


@query("SELECT event_id, track, seqname, start FROM {features_v} ORDER BY seqname, start, event_id")
def t1_ordered(get):
    return E.ordered(get("features_v"), ["seqname", "start", "event_id"]).select("event_id", "track", "seqname", "start")
