"""Helpers shared by the operators: shared folders, lineage cuts, word splitting and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: A word is a run of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


#: A table of more bytes than this is not broadcast; its join shuffles.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="seqframe-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder: its lineage ends there and lost executors cost no recomputation.

    The shuffle files of the job that wrote it are removed when it is done.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for made in _made:
        made.append(out)
    return out


#: Lists of the tables that ``cut`` makes, one for each ``scratch`` that is open.
_made: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Drops, at its end, the tables that ``cut`` made meanwhile, but for those taken off the list that it gives."""
    made: list[DataFrame] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made[:] = [m for m in _made if m is not made]
        for t in made:
            drop(t)


def drop(df: DataFrame) -> None:
    """Deletes a table made by ``cut`` that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """For an application to call: its session hands rows to Python ``BATCH_ROWS`` at a time, as texts are long, or fewer if it does
    so already. Operators leave the setting alone: it is read when a result is computed, which is after they return."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def row_name(*cols: str | F.Column) -> F.Column:
    """A name of 128 bits for what a row holds in ``cols``: rows share it if these are equal."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with as many ``_`` behind it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fits(df: DataFrame, width: int | F.Column, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a written table, of ``width`` bytes each, take at most ``most`` bytes."""
    per = F.lit(width) if isinstance(width, int) else width
    return (df.agg(F.sum(per.cast("long"))).first()[0] or 0) <= most


def sized(df: DataFrame, width: int | F.Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, to be broadcast if it fits."""
    return F.broadcast(df) if fits(df, width, most) else df


def held_out(key: str = "doc_id") -> F.Column:
    """True for the fifth of the documents that nothing may be learned from."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long), by alternating large-star and small-star rounds.

    Returns (node, component) with the smallest reachable node as the component, for nodes that have an edge. Every round
    is two aggregations with a join on a node; minima are aggregated before the shuffle, the join is left to the adaptive
    planner's skew handling, and each round's edge list is written to the shared folder. Only two numbers reach the driver.
    Self-loops and repeated or reversed edges are allowed; nulls are not links and are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "edges")
    state = _digest(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        new = cut(small, "edges")
        now = _digest(new)
        drop(e)
        e = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _digest(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]
