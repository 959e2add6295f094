"""Running numbers and balanced parts without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], bucket: Column, out: str = "no", weight: Column | None = None, upto: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``out``: the rows' numbers from 0 in the order of (bucket, *order), which must name a row, within ``by``.

    Buckets are numbered apart and shifted by the sizes of those before, so only one row per bucket meets in one task.
    ``bucket`` must rise with the order. With ``weight``, ``upto`` is the running sum of weights before the row.
    """
    w = F.lit(1) if weight is None else weight
    rows = df.withColumn("_b", bucket).withColumn("_w", w)
    key = [*by, "_b"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("_w").alias("_s"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_from"))
    own = W.partitionBy(*key).orderBy(*order)
    joined = rows.join(shift, key).withColumn(out, F.col("_shift") + F.row_number().over(own) - 1)
    if upto:
        joined = joined.withColumn(upto, F.col("_from") + F.coalesce(F.sum("_w").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return joined.drop("_b", "_w", "_shift", "_from")


def number_features(df: DataFrame, by: list[str], order: list[str], prefix: str, pad: int, out: str = "attribute", bucket: Column | None = None) -> DataFrame:
    """Running ids within ``by``: prefix and the zero-padded number from 1. With a ``bucket`` that rises with the order, the rows of
    one ``by`` are shared among tasks."""
    if bucket is None:
        rows = df.withColumn("_no", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    else:
        rows = numbered(df, order, bucket, "_no", by=tuple(by)).withColumn("_no", F.col("_no") + 1)
    return rows.withColumn(out, F.concat(F.lit(prefix), _padded(F.col("_no"), pad))).drop("_no")


def _padded(n: Column, pad: int) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) < pad, F.lpad(text, pad, "0")).otherwise(text)


def split_balanced(df: DataFrame, n: int, size: Column, order: list[str], bucket: Column, out: str = "part") -> DataFrame:
    """``out``: one of ``n`` parts of near-equal total size; a row goes where its midpoint falls."""
    total = df.agg(F.sum(size).alias("_total"))
    rows = numbered(df.withColumn("_size", size), order, bucket, "_no", F.col("_size"), "_upto").crossJoin(F.broadcast(total))
    part = F.floor((F.col("_upto") + F.col("_size") / 2) * n / F.col("_total"))
    return rows.withColumn(out, F.least(F.lit(n - 1), part).cast("long")).drop("_size", "_no", "_upto", "_total")


def split_by_size(df: DataFrame, most: int, size: Column, order: list[str], bucket: Column, out: str = "part") -> DataFrame:
    """``out``: parts of about ``most``: a row goes where it starts, counted in steps of ``most``."""
    rows = numbered(df.withColumn("_size", size), order, bucket, "_no", F.col("_size"), "_upto")
    return rows.withColumn(out, F.floor(F.col("_upto") / most).cast("long")).drop("_size", "_no", "_upto")


def split_round_robin(df: DataFrame, n: int, order: list[str], bucket: Column, out: str = "part") -> DataFrame:
    """``out``: the row's number modulo ``n``."""
    return numbered(df, order, bucket, "_no").withColumn(out, (F.col("_no") % n).cast("long")).drop("_no")
