"""WARC archives compressed record by record with a Zstandard dictionary.

Each archive is a ``.warc.zst`` stream: first a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the
archive's own records, then one Zstandard frame for each record, so that a record can be read alone. An archive closes once
its records hold ``ARCHIVE_BYTES``; a task keeps one archive in memory. Archives are rows (name, data) of a table in the
shared folder, so Spark's own commit protocol makes a task that is lost or repeated harmless and any store will do;
``export`` writes them as files.

Of records with equal payloads of ``REVISIT_FROM`` bytes or more, that with the largest page_id is a response and the others
revisit it. The largest id is found by an aggregation on digest and length (partial sums first, so a payload that a third of
the pages share is no hot spot); the payloads move once, by page_id, digest and length.

Defined cases: a null html is an empty payload; null urls become empty targets; a null page_id is written with an empty id, always
as a response, and never referred to; rows that share a page_id are told apart by their payloads, and rows that share both give
records of their own, each a response if the page_id is the largest, with ids that also count the task's records; very long
payloads make an archive of their own, held whole by one task; an empty table gives no archive. Only page_id, url and html are
read, whatever else there is.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The skippable frame's magic number, the profile that a revisit names.
MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_FROM = 1000
ARCHIVE_BYTES, DICT_BYTES, SAMPLE_BYTES, SLICE, READ_BYTES, LEVEL = 4 << 20, 32 << 10, 1 << 20, 8 << 10, 1 << 20, 3
DATE = "1970-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (SHA-1), payload_bytes, refers_to, one, refers_one: what is to be written for each page.

    Revisits carry no payload. ``one`` and ``refers_one`` tell whether the page, and the response that it revisits, are the only
    row of their page_id and payload, so that these name them. Rows without a page_id do not take part in the join.
    """
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    whole = whole.withColumn("sha256", F.sha2("payload", 256)).withColumn("n", F.length("payload"))
    marks = cut(whole.where("page_id is not null").groupBy("page_id", "sha256", "n").agg(F.count("*").alias("rows")), "warc-digests")
    latest = marks.where(F.col("n") >= REVISIT_FROM).groupBy("sha256", "n").agg(F.max(F.struct("page_id", "rows")).alias("last"), F.count("*").alias("pages")).where("pages > 1").select("sha256", "n", "last")
    joined = marks.join(latest, ["sha256", "n"], "left").withColumn("last", F.when(F.col("page_id") < F.col("last.page_id"), F.col("last")))
    special = cut(joined.where("last is not null or rows > 1"), "warc-revisits")
    named = whole.where("page_id is not null").join(special, ["page_id", "sha256", "n"], "left").unionByName(whole.where("page_id is null").withColumns({"rows": F.lit(None).cast("long"), "last": F.lit(None).cast(special.schema["last"].dataType)}))
    one = F.col("page_id").isNotNull() & (F.coalesce("rows", F.lit(1)) == 1)
    return named.select("page_id", "url", F.when(F.col("last").isNull(), F.col("payload")).alias("payload"), F.sha1("payload").alias("digest"), F.col("n").cast("long").alias("payload_bytes"), F.col("last.page_id").alias("refers_to"), one.alias("one"), F.coalesce(F.col("last.rows") == 1, F.lit(False)).alias("refers_one"))


def record_id(page_id, digest: str, copy: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def record(page_id, url: str, payload: bytes | None, digest: str, payload_bytes: int, refers_to, one: bool = True, refers_one: bool = True, copy: str = "") -> bytes:
    """One WARC/1.1 record; a payload of None makes it a revisit. Its id comes from page_id and digest and, where several rows share
    both, from ``copy``; a revisit names the record that it refers to if that is the only one of its page_id and digest."""
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(name, digest, '' if one else copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url.replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {name}",
        f"X-Payload-Bytes: {payload_bytes}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_one:
            head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def samples(records: list[bytes]) -> list[bytes]:
    """About ``SAMPLE_BYTES`` in slices of at most ``SLICE`` bytes, spread evenly over all records."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    out, at = [], 0
    for r in records:
        for k in range(0, len(r), SLICE):
            if at % step == 0:
                out.append(r[k : k + SLICE])
            at += 1
    return out


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary's skippable frame, then each record's own frame. Too little to learn from: no dictionary."""
    some = samples(records)
    size = sum(map(len, some))
    learned = None
    if len(some) >= 8 and size >= 16 * 1024:
        try:
            learned = zstandard.train_dictionary(min(DICT_BYTES, size // 8), some, k=256, d=8)
        except zstandard.ZstdError:
            learned = None
    head = learned.as_bytes() if learned else b""
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_content_size=True)
    return struct.pack("<II", MAGIC, len(head)) + head + b"".join(map(press.compress, records))


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one after another, from one pass over its frames."""
    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    learned = zstandard.ZstdCompressionDict(data[8 : 8 + n]) if n else None
    source = zstandard.ZstdDecompressor(dict_data=learned).stream_reader(memoryview(data)[8 + n :], read_across_frames=True)
    held, end = bytearray(), None
    while part := source.read(READ_BYTES):
        held += part
        at = 0
        while end is not None or (end := _end(held, at)) is not None:
            if at + end > len(held):
                break
            yield bytes(memoryview(held)[at : at + end])
            at, end = at + end, None
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def _end(held: bytearray, at: int) -> int | None:
    """Length of the record that starts at ``at``; None if its head is not whole yet."""
    head = held.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    length = re.search(rb"\r\nContent-Length: (\d+)", held[at:head])
    return head + 4 + int(length[1]) + 4 - at


def parse(raw: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    return fields


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of all pages to the shared folder; the table (name, n_records, data) of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, 0
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            data = pack(held)
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha256(data).hexdigest()[:24]}.warc.zst"]), pa.array([len(held)], pa.int64()), pa.array([data], pa.binary())], names=["name", "n_records", "data"])

        for b in batches:
            for k in range(b.num_rows):
                held.append(record(*(c[k].as_py() for c in b.columns), copy=f"{task}:{seen}"))
                seen += 1
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return cut(roles(pages).mapInArrow(run, "name string, n_records long, data binary"), "warc")


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives; digest and length of a response are taken anew from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

        for b in batches:
            for data in b.column(0):
                rows = []
                for raw in unpack(data.as_py()):
                    r = parse(raw)
                    digest, n = r["WARC-Payload-Digest"].removeprefix("sha1:"), int(r["X-Payload-Bytes"])
                    if r["payload"] is not None and (hashlib.sha1(r["payload"]).hexdigest() != digest or len(r["payload"]) != n):
                        raise ValueError(f"record {r['WARC-Record-ID']}: its payload has another digest")
                    page, refers = r["X-Page-ID"], r.get("X-Refers-To-Page-ID")
                    rows.append((int(page) if page else None, n, digest, r["WARC-Type"], int(refers) if refers else None, r["WARC-Target-URI"], r["payload"] if payloads else None))
                    if len(rows) >= 512:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return archives.select("data").mapInArrow(run, READ_SCHEMA)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes every archive as a file into ``folder``, which all executors must share; returns (name, n_records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            sizes = []
            for name, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, name))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["name", "n_records", "bytes"])

    return archives.select("name", "n_records", "data").mapInArrow(run, "name string, n_records long, bytes long")


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the archives as read back."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
