"""WARC archives: writing, normalising whole-file gzip streams into one member per record, reading back.

Records are written by Spark's text writer with gzip, which makes one stream of a whole file. The
normaliser inflates such a stream once, from its first byte to its last, cuts it into records by their
lengths and writes every record as a gzip member of its own. Members go through the text writer too, so
files are committed like any output of Spark and a lost executor leaves none behind. What that writer
puts after a row is an empty gzip member, which readers pass over.

The sidecar index is read off the committed archives, so it cannot disagree with them: one row per
record with file, offset, length, type and payload digest.

Nulls in html are empty payloads; a null url leaves the header out; null ids are kept as such. Records
that end early are kept as their own members of type ``truncated``. Repeated rows: all rows with the
largest id of their payload are responses.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:signalmill:page:"

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Compressed bytes of an archive file, after which the next one begins; a reader holds one file at a time.
ARCHIVE_BYTES = 32 << 20
LEVEL = 6
_STEP = 1 << 14

INDEX = (
    "archive string, offset long, length long, record_type string, page_id long, target_uri string, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


EMPTY = member(b"", 9)


def with_types(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with ``_payload``, ``_bytes``, ``_digest`` and ``_refers_to`` (null: a response).

    Ids are summed up by digest before anything meets the pages; only digests with copies go on. A
    payload that very many pages share is a skewed join key, which adaptive execution splits.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.withColumns({"_payload": payload, "_bytes": F.octet_length(payload).cast("long")})
    rows = rows.withColumn("_digest", F.sha1(F.col("_payload").cast("binary")))
    copies = rows.where(F.col("_bytes") >= least).groupBy(F.col("_digest").alias("_of")).agg(
        F.max(key).alias("_last"), F.count("*").alias("_n")
    )
    copies = copies.where("_n > 1").select("_of", "_last")
    same = (F.col("_digest") == F.col("_of")) & (F.col("_bytes") >= least)
    older = F.col("_last").isNotNull() & (F.col(key).isNull() | (F.col(key) < F.col("_last")))
    joined = rows.join(copies.hint("shuffle_hash"), same, "left")
    return joined.withColumn("_refers_to", F.when(older, F.col("_last"))).drop("_of", "_last")


def record(key: Column, url: Column, payload: Column, size: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """A record as text, without the two line ends behind it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda k: F.concat(F.lit(f"<{PAGE_URN}"), F.coalesce(k.cast("string"), F.lit("null")), F.lit(">"))
    revisit = refers_to.isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", size.cast("string")), F.lit("\r\n"),
    )
    body = F.when(revisit, "").otherwise(payload)
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(key)),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]+", " ")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn(refers_to)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"), http, body,
    )


def write_streams(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
    least: int = REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """One record per page under ``path``, each file one gzip stream."""
    rows = with_types(pages.select(key, url, html), key, html, least)
    text = record(*(F.col(c) for c in (key, url, "_payload", "_bytes", "_digest", "_refers_to")), date)
    rows.select(text.alias("value")).write.option("compression", "gzip").option("lineSep", END).text(path)


class RecordCutter:
    """Cuts a byte stream, fed in parts, into records."""

    def __init__(self):
        self.data, self.need, self.searched = bytearray(), 0, 0

    def feed(self, part: bytes) -> Iterator[bytes]:
        self.data += part
        while True:
            if not self.need:
                head = self.data.find(b"\r\n\r\n", max(0, self.searched - 3))
                if head < 0:
                    self.searched = len(self.data)
                    return
                found = re.search(rb"(?i)^content-length:[ \t]*(\d+)", self.data[:head], re.MULTILINE)
                self.need = head + 4 + (int(found[1]) if found else 0) + len(END)
            if len(self.data) < self.need:
                return
            yield bytes(self.data[: self.need])
            del self.data[: self.need]
            self.need = self.searched = 0

    def rest(self) -> bytes:
        """What is left at the end of the stream: nothing, or a record that ends early."""
        left, self.data, self.need, self.searched = bytes(self.data), bytearray(), 0, 0
        return left if left.strip() else b""


def normalize(spark: SparkSession, source: str, target: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> None:
    """Every record of the gzip files under ``source`` as its own member in files under ``target``.

    A file's stream is read in order as parts between carriage returns, so a task holds one record, not
    one file. Files go on to the next archive when they reach ``archive_bytes``.
    """
    parts = spark.read.option("lineSep", "\r").text(source)
    parts = parts.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("part"))
    schema = "archive string, seq long, member binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        file, cutter, seq, roll, used = None, RecordCutter(), 0, 0, 0

        def packed(data: bytes) -> int:
            nonlocal seq, roll, used
            own = member(data, level)
            if used and used + len(own) + len(EMPTY) > archive_bytes:
                roll, used = roll + 1, 0
            used += len(own) + len(EMPTY)
            rows.append((f"{file.partition('.')[0]}-{roll:05d}", seq, own))
            seq += 1
            return len(own)

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "seq", "member"])

        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file:
                    if file is not None and (left := cutter.rest()):
                        size += packed(left)
                    file, seq, roll, used = name, 0, 0, 0
                else:
                    part = b"\r" + part
                for data in cutter.feed(part):
                    size += packed(data)
                if size >= 4 << 20:
                    yield flushed()
                    rows, size = [], 0
        if file is not None and (left := cutter.rest()):
            packed(left)
        if rows:
            yield flushed()

    rows = parts.mapInArrow(run, schema).sortWithinPartitions("archive", "seq")
    rows.select("archive", F.col("member").cast("string")).write.partitionBy("archive").option(
        "encoding", "ISO-8859-1"
    ).option("lineSep", EMPTY.decode("latin-1")).text(target)


def members(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of every gzip member."""
    at = 0
    while at < len(data):
        unpacker, out, fed = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if fed >= len(data):
                raise ValueError(f"gzip member at {at} ends early")
            out.append(unpacker.decompress(data[fed : fed + _STEP]))
            fed = min(fed + _STEP, len(data))
        end = fed - len(unpacker.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def _head(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, body


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(rf"<{PAGE_URN}(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def parse(data: bytes) -> tuple[str, int | None, str | None, int, str, int | None, bytes]:
    """Type, page id, uri, payload bytes and digest, page referred to, payload (empty for revisits)."""
    fields, block = _head(data)
    length = fields.get("content-length", "")
    if not length.isdigit() or len(block) != int(length) + len(END):
        return "truncated", _page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), len(block), hashlib.sha1(block).hexdigest(), None, block
    block = block[: -len(END)]
    kind, payload = fields.get("warc-type", ""), block
    if fields.get("content-type", "").startswith("application/http"):
        http, payload = _head(block)
    if kind == "revisit":
        size, digest = int(http.get("content-length", 0)), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    refers_to = _page_of(fields.get("warc-refers-to"))
    return kind, _page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, refers_to, payload


def _archives(spark: SparkSession, target: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true")
    return files.load(target).select(F.regexp_extract("path", "archive=([^/]+)", 1).alias("archive"), "content")


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """Every record of the archives under ``target``: offset, length and what its headers and payload say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in INDEX.split(", ")]
        kinds = [pa.string() if f.split()[1] == "string" else pa.int64() for f in INDEX.split(", ")]
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [
                    (archive, offset, length, *parse(data)[:6])
                    for offset, length, data in members(memoryview(content.as_buffer())) if data
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _archives(spark, target).mapInArrow(run, INDEX)


def write_index(spark: SparkSession, target: str, index: str) -> DataFrame:
    """The sidecar index of the archives under ``target``, written and read again."""
    read_archives(spark, target).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def fetch(spark: SparkSession, target: str, wanted: DataFrame) -> DataFrame:
    """Payloads of some index rows, by offset: ``archive``, ``offset``, ``payload``. For selections, not whole corpora."""
    places = wanted.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = memoryview(content.as_buffer())
                rows = [
                    (archive, p["offset"], parse(next(members(data[p["offset"] : p["offset"] + p["length"]]))[2])[6])
                    for p in own
                ]
                kinds = (pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "offset", "payload"]
                )

    return _archives(spark, target).join(places, "archive").mapInArrow(run, "archive string, offset long, payload binary")
