"""Views over the given tables, written once and readable by Spark and by DuckDB.

``@us(x)``, ``@strip(x, pattern)`` and ``@list(a, b)`` stand for functions that the two spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
UPPER, MAPPED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTNN"

VIEWS = {
    "groups_v": "SELECT l_orderkey AS group_id, 'S' || CAST(l_suppkey % 4 AS STRING) AS species, CAST(l_partkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS gene FROM {lineitem}",
    "gene_totals_v": "SELECT species, count(DISTINCT gene) + 100 AS n_genes FROM {groups_v} GROUP BY species",
    "features_v": "SELECT event_id, event_type AS track, 'chr' || CAST(user_id % 5 AS STRING) AS seqname, CAST(floor((@us(ts) - 1704067200000000) / 60000000) AS BIGINT) + 1 AS start, CAST(floor((@us(ts) - 1704067200000000) / 60000000) AS BIGINT) + 1 + CAST(floor(value) AS BIGINT) AS stop, value AS score FROM {events}",
    "scores_v": "SELECT 'u' || CAST(user_id AS STRING) AS seqname, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS row_no, value AS score FROM {events}",
    "seq_v": f"SELECT doc_id, 'd' || CAST(doc_id AS STRING) AS seq_id, translate(@strip(text, '[^A-Za-z]'), '{UPPER}{UPPER.lower()}', '{MAPPED}{MAPPED.lower()}') AS seq FROM {{documents}}",
    "blocks_v": "SELECT 'q' || CAST(l_partkey AS STRING) AS query, CAST(2000 AS BIGINT) AS qlen, 't' || CAST(l_suppkey AS STRING) AS target, l_orderkey % 1500 AS qstart, CAST(l_quantity AS BIGINT) AS size FROM {lineitem}",
    "fits_v": "SELECT l_orderkey AS cluster, CAST(l_linenumber AS BIGINT) AS model, CAST(l_linenumber AS BIGINT) AS np, max(-l_extendedprice / 1000) AS lnl FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "kaks_v": "SELECT l_orderkey AS cluster, 'S' || CAST(l_suppkey % 5 AS STRING) AS species, min(100 + 10 * l_quantity) AS len, max(50 + l_quantity) AS n, max(20 + l_linenumber) AS s, max(l_discount) AS dn, max(30 * l_tax) AS ds FROM {lineitem} GROUP BY l_orderkey, 'S' || CAST(l_suppkey % 5 AS STRING)",
    "codons_v": "SELECT CAST(floor(doc_id / 4) AS BIGINT) AS group_id, 'S' || CAST(doc_id % 4 AS STRING) AS species, rpad(upper(seq), CAST(longest + (3 - longest % 3) % 3 AS INT), '-') AS aln FROM (SELECT doc_id, seq, max(length(seq)) OVER (PARTITION BY CAST(floor(doc_id / 4) AS BIGINT)) AS longest FROM {seq_v}) s WHERE longest > 0",
    "hits_v": "SELECT a.species || '|' || a.gene AS qry, b.species || '|' || b.gene AS sub, max(exp(-(a.q + b.q) / 4)) AS e, max(a.p + b.p) AS bits, max(100 - abs(a.d - b.d) * 500) AS pct FROM {genes_v} a JOIN {genes_v} b ON a.group_id = b.group_id AND a.species <> b.species GROUP BY a.species || '|' || a.gene, b.species || '|' || b.gene",
    "hits_all_v": "SELECT a.species || '|' || a.gene AS qry, b.species || '|' || b.gene AS sub, max(exp(-(a.q + b.q) / 4)) AS e, max(a.p + b.p) AS bits, max(100 - abs(a.d - b.d) * 500) AS pct FROM {genes_v} a JOIN {genes_v} b ON a.group_id = b.group_id AND (a.species <> b.species OR a.gene <> b.gene) GROUP BY a.species || '|' || a.gene, b.species || '|' || b.gene",
    "sitefits_v": "SELECT CAST(l_orderkey AS STRING) AS cluster, 'S' || CAST(l_suppkey % 5 AS STRING) AS species, CASE WHEN l_linenumber % 2 = 0 THEN 'fix' ELSE 'nofix' END AS kind, max(-l_extendedprice / 1000) AS lnl, max(l_quantity) AS w FROM {lineitem} GROUP BY l_orderkey, l_suppkey % 5, l_linenumber % 2",
    "genes_v": "SELECT l_orderkey AS group_id, 'S' || CAST(l_suppkey % 4 AS STRING) AS species, CAST(l_partkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS gene, max(l_quantity) AS q, max(l_extendedprice) AS p, max(l_discount) AS d FROM {lineitem} GROUP BY l_orderkey, l_suppkey % 4, l_partkey, l_linenumber",
}
SPARK = {r"@us\(([^()]*)\)": r"unix_micros(CAST(\1 AS TIMESTAMP))", r"@strip\(([^,()]*), '([^']*)'\)": r"regexp_replace(\1, '\2', '')", r"@list\(([^,()]*), ([^()]*)\)": r"sequence(\1, \2)"}
DUCKDB = {r"@us\(([^()]*)\)": r"epoch_us(\1)", r"@strip\(([^,()]*), '([^']*)'\)": r"regexp_replace(\1, '\2', '', 'g')", r"@list\(([^,()]*), ([^()]*)\)": r"generate_series(\1, \2)"}


def _text(sql: str, dialect: dict[str, str]) -> str:
    for pattern, to in dialect.items():
        sql = re.sub(pattern, to, sql)
    while m := re.search(r"\{(\w+)\}", sql):
        name = m[1]
        inner = f"({_text(VIEWS[name], dialect)})" if name in VIEWS else name
        sql = sql[: m.start()] + inner + sql[m.end() :]
    return sql


def duckdb_sql(sql: str) -> str:
    """``sql`` with views in place of their names in braces, for DuckDB."""
    return _text(sql, DUCKDB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts that a scan would have in fewer tasks than there are cores, at most one split for each, are dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, name: str, **by: str) -> DataFrame:
    """A view, or a table, as a DataFrame; ``by``: tables that are dealt out by a column, so that what meets by it later is not dealt out again."""
    if name not in VIEWS:
        df = table(spark, sf_dir, name)
        return df.repartition(by[name]) if name in by else df
    sql = VIEWS[name]
    for pattern, to in SPARK.items():
        sql = re.sub(pattern, to, sql)
    used = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: view(spark, sf_dir, n, **by) for n in used})
