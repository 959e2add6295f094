"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts become sets of shingles of five words (lower case, runs of letters and numbers); an item of fewer words is one shingle, its
whole sequence, and documents are cut into shingles of each width that items have. A document that holds ``needed`` of an item's n
shingles, the least number that is ``THRESHOLD`` of them, holds one of any n - needed + 1 of them. So items are partitioned by
their number of shingles: those of a partition need equally many and have a MinHash sketch of equal size, the n - needed + 1 least
of the item's shingle hashes, but for hashes that more than ``COMMON`` items share, which come last. Below ``SHORT`` shingles a
partition is an exact index instead: all hashes of its items. A document is a candidate for an item of a partition if one of all
its shingle hashes is there and it has at least the partition's ``needed`` shingles: none that holds an item is missed, whatever
the sizes of item and document. Documents themselves are not sketched: a sketch of a long document loses short items.

Candidates alone are read again and verified: shingles are compared as strings by a join of (document, shingle) of the candidate
pairs' items with those of the candidate documents, each of which is cut once, however many items it may hold.

Everything is DataFrame expressions. Documents are not shuffled to find candidates while the sketches, of fixed width, take no more
than ``BROADCAST_BYTES``; beyond that the join shuffles. So it is with candidates when they are read again, and with items.

Defined cases: null or empty texts and those without a word have no shingles, so such items are never found and such documents
never match; repeated rows and copies are each reported; a null doc_id or item_id is reported as null. A table without rows gives
no rows. The words and shingles of one text are held by one task, some ten times its length. Only doc_id, text and item_id are
read; further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fits, row_name, sized, unused

WIDTH, THRESHOLD = 5, 0.8
#: Bytes of a row of names and numbers in memory: of a sketch, a candidate or a name.
ROW_BYTES = 64
#: Items of fewer shingles keep all their hashes; a hash of more items than this is the last to be in a sketch.
SHORT, COMMON = 10, 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _start(shingle, w: Column, width: int):
    return lambda i: shingle(w, i, width)


def _of_widths(text: Column, widths: list[int], shingle) -> Column:
    """The distinct shingles of the widths; null if there are none."""
    def body(w: Column) -> Column:
        each = [F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), _start(shingle, w, k))) for k in widths]
        return F.array_distinct(F.flatten(F.array_compact(F.array(*each))) if len(each) > 1 else each[0])

    return _let(words(text), body)


def _string(w: Column, i: Column, width: int) -> Column:
    return F.array_join(F.slice(w, i + 1, width), " ")


def _hash(w: Column, i: Column, width: int) -> Column:
    return F.xxhash64(*[w[i + k] for k in range(width)])


def shingle_strings(text: Column, widths: list[int]) -> Column:
    """The distinct shingles of a text; null or empty if there are none."""
    return _of_widths(text, widths, _string)


def shingle_hashes(text: Column, widths: list[int]) -> Column:
    """Distinct 64-bit hashes of a text's shingles; null or empty if there are none."""
    return _of_widths(text, widths, _hash)


def needed(n: Column, threshold: float) -> Column:
    """The least number of an item's ``n`` shingles that reaches the threshold."""
    return F.ceil(n * F.lit(float(threshold))).cast("int")


def _by_width(items: DataFrame, make, out: str) -> DataFrame:
    """``items`` (with a column width) with ``out``: the shingles of each item at its own width."""
    made = F.coalesce(*[F.when(F.col("width") == k, make(F.col("text"), [k])) for k in range(1, WIDTH + 1)])
    return items.withColumn(out, made)


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """size, item, h, needed: the sketch of every item (item, text, width), in the partition of its number of shingles, ``size``."""
    rows = _by_width(items, shingle_hashes, "hashes").withColumn("size", F.size("hashes")).select("size", "item", F.explode("hashes").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("items")).where(F.col("items") > COMMON).select("h", F.lit(True).alias("common"))
    least = F.row_number().over(W.partitionBy("item").orderBy(F.coalesce("common", F.lit(False)), "h"))
    need = needed(F.col("size"), threshold)
    kept = F.when(F.col("size") < SHORT, F.col("size")).otherwise(F.col("size") - need + 1)
    return rows.join(common, "h", "left").withColumn("least", least).where(F.col("least") <= kept).select("size", "item", "h", need.alias("needed"))


def with_width(items: DataFrame) -> DataFrame:
    """``items`` that have a word, with the width of their shingles."""
    return items.withColumn("width", F.least(F.lit(WIDTH), F.size(words(F.col("text"))))).where("width > 0")


def candidates(docs: DataFrame, items: DataFrame, widths: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """rid, item: documents (rid, text) that hold a shingle of the sketch of an item (item, text, width)."""
    index = cut(sketches(items, threshold), "benchmark-sketches")
    hashes = docs.select("rid", shingle_hashes(F.col("text"), widths).alias("hashes"))
    rows = hashes.select("rid", F.size("hashes").alias("m"), F.explode("hashes").alias("h"))
    return rows.join(sized(index, ROW_BYTES), "h").where("m >= needed").select("rid", "item").distinct()


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """``key``, item_id, n_shared, n_shingles, containment: the items whose shingles a document holds to ``threshold`` or more."""
    named = docs.select(F.col(key).alias("key"), row_name("doc_id", "text").alias("rid"), "text")
    items = with_width(benchmark.select(F.col("item_id").cast("long").alias("item_id"), row_name("item_id", "text").alias("item"), "text"))
    items = cut(items, "benchmark-items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect()) or [WIDTH]
    found = cut(candidates(named.select("rid", "text"), items.select("item", "text", "width").dropDuplicates(["item"]), widths, threshold), "benchmark-candidates")
    rids = cut(found.select("rid").distinct(), "benchmark-documents")
    of_docs = named.join(sized(rids, ROW_BYTES), "rid").select("rid", F.explode(shingle_strings(F.col("text"), widths)).alias("shingle")).distinct()
    once = items.select("item", "text", "width").dropDuplicates(["item"])
    shingles = _by_width(once, shingle_strings, "shingles").select("item", F.size("shingles").cast("long").alias("n_shingles"), F.explode("shingles").alias("shingle"))
    # an item's shingles of five words take some ten times its text
    shingles = F.broadcast(shingles) if fits(items, F.length("text") * 10 + ROW_BYTES) else shingles
    shared = found.join(shingles, "item").join(of_docs, ["rid", "shingle"]).groupBy("rid", "item").agg(F.count("*").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    held = cut(shared.where(F.col("n_shared") >= needed(F.col("n_shingles"), threshold)), "benchmark-held")
    rows = named.select("key", "rid").join(sized(held, 2 * ROW_BYTES), "rid").join(sized(items.select("item_id", "item"), ROW_BYTES), "item")
    return rows.select(F.col("key").alias(key), "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold an item. Rows are named by doc_id and text, so a row with a null doc_id can go too."""
    rid = unused(docs, "rid")
    named = docs.withColumn(rid, row_name("doc_id", "text"))
    hits = cut(contained(named, benchmark, threshold, rid).select(rid).distinct(), "benchmark-hits")
    return named.join(sized(hits, ROW_BYTES), rid, "left_anti").select(docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment."""
    return contained(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
