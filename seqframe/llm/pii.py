"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers. Each distinct base value is a protected
entity c. A term t (a word of a document that holds the value, outside of base spans) reveals c as far as seeing t makes c likelier: with document frequencies over the
whole corpus, PMI(c; t) = log(N co(c, t) / (df(c) df(t))), set against IC(c) = log(N / df(c)), the information that c itself
holds. A term of which PMI / IC reaches ``GENERALISE`` is generalised to its entity's kind, one that reaches ``REMOVE`` is
removed, at every place in the documents that hold c. co counts the documents that hold both; an association seen in fewer
than ``TOGETHER`` documents is no evidence. As co is at most df(c), PMI / IC can reach ``GENERALISE`` only for terms of
df(t) <= N (df(c) / N) ^ GENERALISE: more frequent ones are left out before terms meet entities, which loses nothing.

Everything is DataFrame expressions. A pattern's matches and the text between them come from the same scan, so positions are
running sums of lengths; patterns use possessive repeats and start only where a run starts or the last match ended, which
changes no match and keeps the scan linear. Only matches, rare terms, term counts and the words of documents that hold a revealing
term are shuffled, never texts, unless spans are to be applied to more documents than may be broadcast.

Defined cases: a null text is an empty one, and stays null when texts are sanitised; a null doc_id is kept; equal rows get equal results; matches that fail their check
are dropped and not tried again at another place; spans of different kinds may overlap, term spans never overlap base spans.
Positions are code points, the end exclusive. Texts are read whole; the matches and words of one text are held by one task. An empty
table gives no rows. Only doc_id and text are read; further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, row_name, sized, unused

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The patterns, in the order of KINDS.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOGETHER, GENERALISE, REMOVE = 2, 0.8, 0.95
WORD = r"\p{L}{3,}"
#: Bytes of a row of names and numbers in memory; code points of a block that pieces of a text are cut from.
ROW_BYTES, BLOCK = 64, 4096


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    part = F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")
    ip = F.forall(F.split(part, r"\."), lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).cast("int") <= 255))
    card = F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).otherwise(n.between(9, 15))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_name(F.col("doc_id").cast("long"), "text").alias("rid"), F.coalesce("text", F.lit("")).alias("text"))


def _scan(text: Column, kind: str) -> Column:
    """kind, matches and the pieces of text around them; null if nothing matches."""
    pattern = F.lit(PATTERNS[kind])
    hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    found = F.when(hint, F.regexp_extract_all(text, pattern, F.lit(0)))
    return F.transform(F.array(found), lambda m: F.when(F.size(m) > 0, F.struct(F.lit(kind).alias("kind"), m.alias("found"), F.split(text, PATTERNS[kind], -1).alias("gaps"))))[0]


def base_spans(docs: DataFrame) -> DataFrame:
    """rid, kind, start, end, value: valid matches in documents (rid, text)."""
    scans = docs.select("rid", F.explode(F.array_compact(F.array(*[_scan(F.col("text"), k) for k in KINDS]))).alias("x"))
    at = F.posexplode(F.transform("x.found", lambda m, i: F.struct(m.alias("value"), F.length(F.element_at("x.gaps", i + 1)).alias("gap"))))
    rows = scans.select("rid", "x.kind", at.alias("i", "m")).select("rid", "kind", "i", "m.*").distinct()
    upto = F.sum(F.col("gap") + F.length("value")).over(W.partitionBy("rid", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.length("value"))
    return rows.where(_valid(F.col("kind"), F.col("value"))).select("rid", "kind", "start", "end", "value")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_words(text), F.lower))


def _cut_bytes(cuts: str) -> Column:
    """Bytes of a row of a name and an array of cuts in memory."""
    return F.size(cuts) * ROW_BYTES + 2 * ROW_BYTES


def _cut_out(text: Column, spans: Column, body) -> Column:
    """``body(span, cut)`` for every one of ``spans``, where ``cut(at, to)`` is the text from at to before to.

    The text is cut into blocks once, so that a piece is looked up in its own blocks and not from the text's start.
    """
    def piece(blocks: Column, at: Column, to: Column) -> Column:
        first, last = F.floor(at / BLOCK).cast("int"), F.floor((to - 1) / BLOCK).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.when(to > at, F.substr(held, (at - first * BLOCK + 1).cast("int"), (to - at).cast("int"))).otherwise("")

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.transform(F.array(blocks), lambda b: F.transform(spans, lambda c: body(c, lambda at, to: piece(b, at, to))))[0]


def outside(docs: DataFrame, spans: DataFrame, rids: DataFrame) -> DataFrame:
    """rid, at, piece: the text between base spans, from position ``at``, of the documents among ``rids``."""
    upto = F.max("end").over(W.partitionBy("rid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    free = spans.join(rids, "rid", "left_semi").withColumn("at", F.coalesce(upto, F.lit(0).cast("long")))
    kept = F.collect_list(F.when(F.col("start") > F.col("at"), F.struct("at", F.col("start").alias("to"))))
    cuts = cut(free.groupBy("rid").agg(kept.alias("cuts"), F.max("end").alias("last")), "pii-outside")
    tail = F.array(F.struct(F.col("last").alias("at"), F.length("text").cast("long").alias("to")))
    pieces = _cut_out(F.col("text"), F.concat("cuts", tail), lambda c, cut: F.struct(c["at"].alias("at"), cut(c["at"], c["to"]).alias("piece")))
    return docs.join(sized(cuts, _cut_bytes("cuts")), "rid").select("rid", F.explode(pieces).alias("c")).select("rid", "c.*")


def _document_set() -> list[Column]:
    """Aggregates that name the set of the documents of a group's rows, each document once: their number and 128 bits."""
    return [F.count("*").alias("n"), F.bit_xor("rid.a").alias("a"), F.bit_xor("rid.b").alias("b")]


def disclosure(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """rid, kind, start, end, ratio: terms whose PMI / IC reaches ``GENERALISE``, in the documents that hold what they reveal.

    Entities of the same documents are one class, and so are terms of the same documents and df, as their figures agree. Pairs of
    classes come from an entity class's documents but for the one with most terms: they need ``TOGETHER`` documents, two at least,
    so another one has each pair, and a document of many values and words is left to the smaller ones that it shares them with.
    """
    total = max(2.0, float(docs.count()))
    rare = lambda df_c: F.lit(total * (1 + 1e-9)) * F.pow(df_c / total, F.lit(GENERALISE))
    each = cut(spans.select("rid", "kind", "value").distinct(), "pii-each")
    entity = each.groupBy("kind", "value").agg(*_document_set()).where(F.col("n") >= TOGETHER)
    entity = cut(entity.select("kind", "value", F.struct("n", "a", "b").alias("entities")), "pii-entities")
    holders = each.join(sized(entity, F.length("value") + ROW_BYTES), ["kind", "value"])
    holders = cut(holders.groupBy("rid", "entities").agg(F.min("kind").alias("kind")), "pii-holders")
    most = entity.agg(F.max("entities.n")).first()[0] or 0
    held = docs.select(F.explode(_terms(F.col("text"))).alias("term"))
    terms = held.groupBy("term").agg(F.count("*").alias("df_t")).where((F.col("df_t") >= TOGETHER) & (F.col("df_t") <= rare(F.lit(most))))
    terms = cut(terms, "pii-terms")
    rids = cut(holders.select("rid").distinct(), "pii-rids")
    found = outside(docs, spans, rids).select("rid", F.explode(_terms(F.col("piece"))).alias("term")).join(sized(terms, F.length("term") + ROW_BYTES), "term")
    found = cut(found.groupBy("rid", "term").agg(F.max("df_t").alias("df_t")), "pii-found")
    # a term of one such document is together with nothing twice
    alike = found.groupBy("term").agg(F.max("df_t").alias("df_t"), *_document_set()).where(F.col("n") >= TOGETHER)
    alike = cut(alike.select("term", F.struct("df_t", "n", "a", "b").alias("terms")), "pii-alike")
    words = cut(found.join(sized(alike, F.length("term") + ROW_BYTES), "term").select("rid", "terms").distinct(), "pii-words")
    weight = words.groupBy("rid").agg(F.count("*").alias("weight"))
    weighed = cut(holders.join(weight, "rid").select("rid", "entities", "weight"), "pii-weighed")
    heaviest = cut(weighed.groupBy("entities").agg(F.max_by("rid", F.struct("weight", "rid")).alias("skipped")), "pii-heaviest")
    others = weighed.join(sized(heaviest, 2 * ROW_BYTES), "entities").where(F.col("rid") != F.col("skipped"))
    pairs = others.join(words, "rid").where(F.col("terms.df_t") <= rare(F.col("entities.n")))
    pairs = cut(pairs.groupBy("entities", "terms").agg(F.count("*").alias("co"), F.max("skipped").alias("skipped")), "pii-together")
    there = words.select(F.col("rid").alias("skipped"), "terms", F.lit(1).alias("one"))
    together = pairs.join(there, ["skipped", "terms"], "left").withColumn("co", F.col("co") + F.coalesce("one", F.lit(0))).where(F.col("co") >= TOGETHER)
    pmi = F.log(F.col("co") * F.lit(total) / (F.col("entities.n") * F.greatest("terms.df_t", "co")))
    ic = F.log(F.lit(total) / F.col("entities.n"))
    shown = cut(together.withColumn("ratio", F.when(ic > 0, pmi / ic)).where(F.col("ratio") >= GENERALISE).select("entities", "terms", "ratio"), "pii-shown")
    # documents of both, from the class of fewer documents
    few = F.col("terms.n") <= F.col("entities.n")
    by_term = shown.where(few).join(words, "terms").join(holders, ["rid", "entities"])
    by_entity = shown.where(~few).join(holders, "entities").join(words, ["rid", "terms"])
    both = by_term.select("rid", "terms", "ratio", "kind").unionByName(by_entity.select("rid", "terms", "ratio", "kind"))
    both = both.groupBy("rid", "terms").agg(F.max("ratio").alias("ratio"), F.min("kind").alias("kind"))
    wanted = cut(both.join(alike, "terms").select("rid", "term", "ratio", "kind"), "pii-wanted")
    return wanted.join(places(outside(docs, spans, wanted.select("rid").distinct())), ["rid", "term"]).select("rid", "start", "end", "ratio", "kind")


def places(pieces: DataFrame) -> DataFrame:
    """rid, term, start, end: every word of pieces (rid, at, piece)."""
    rows = pieces.select("rid", "at", _words(F.col("piece")).alias("found"), F.split("piece", WORD, -1).alias("gaps")).where(F.size("found") > 0)
    at = F.posexplode(F.arrays_zip("found", F.slice("gaps", F.lit(1), F.size("found")).alias("gap")))
    words = rows.select("rid", "at", at.alias("i", "m")).select("rid", "at", "i", F.col("m.found").alias("word"), F.length("m.gap").alias("gap")).distinct()
    upto = F.sum(F.col("gap") + F.length("word")).over(W.partitionBy("rid", "at").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    ends = words.withColumn("end", (F.col("at") + upto).cast("long"))
    return ends.select("rid", F.lower("word").alias("term"), (F.col("end") - F.length("word")).alias("start"), "end")


def all_spans(docs: DataFrame) -> DataFrame:
    """rid, no, kind, start, end, label: base spans and the spans of terms, of documents (rid, text)."""
    spans = cut(base_spans(docs), "pii-base")
    shown = disclosure(docs, spans)
    base = spans.select("rid", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("no"), "kind", "start", "end", F.concat(F.lit("["), F.upper("kind"), F.lit("]")).alias("label"))
    label = F.when(F.col("ratio") >= REMOVE, F.lit("")).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit(" TERM]")))
    terms = shown.select("rid", F.lit(len(KINDS) + 1).alias("no"), F.lit(TERM).alias("kind"), "start", "end", label.alias("label"))
    # terms are taken from the text between base spans, so they overlap none
    return base.unionByName(terms)


def _joined(keep: Column) -> Column:
    rows = F.sort_array(F.collect_list(F.when(keep, F.struct("start", "no", "kind", "end"))))
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    named = _named(docs)
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    of = all_spans(named.select("rid", "text")).groupBy("rid").agg(*counts, F.sha2(_joined(F.col("no") <= len(KINDS)), 256).alias("base_sha256"), _joined(F.lit(True)).alias("spans"))
    rows = named.select("doc_id", "rid").join(of, "rid", "left")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its label, overlapping spans together; n_chars follows if it is there."""
    named = _named(docs)
    rows = all_spans(named.select("rid", "text"))
    reach = F.max("end").over(W.partitionBy("rid").orderBy("start", "no").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(W.partitionBy("rid").orderBy("start", "no").rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", F.struct("start", "no")).alias("label"))
    previous = F.coalesce(F.lag("end").over(W.partitionBy("rid").orderBy("start")), F.lit(0))
    spans = runs.withColumn("from", previous).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "from", "end", "label"))).alias("cuts"))
    rid, cuts = unused(docs, "rid"), unused(docs, "cuts")
    spans = sized(cut(spans.toDF(rid, cuts), "pii-spans"), _cut_bytes(cuts))
    text = F.col("text")
    kept = _cut_out(text, F.col(cuts), lambda c, cut: F.concat(cut(c["from"], c["start"]), c["label"]))
    tail = F.substr(text, (F.element_at(cuts, -1)["end"] + 1).cast("int"), F.length(text))
    out = docs.withColumn(rid, row_name(F.col("doc_id").cast("long"), "text")).join(spans, rid, "left")
    out = out.withColumn("text", F.when(F.col(cuts).isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
