"""Dictionary-compressed WARC archives: writer and reader.

An archive starts with a skippable Zstandard frame that embeds a dictionary, built from the archive's own
first records (at most ``SAMPLE`` bytes of them); then each record is a Zstandard frame of its own, made with
that dictionary, so records can be read singly. Each task writes its archives as it goes, a new one at about
``ARCHIVE`` bytes of records. Files carry a random name; only those of tasks that committed are in the
manifest, so a lost or repeated task leaves no record twice.

Of records with equal payloads (SHA-256) of at least ``least`` bytes, that with the largest id is the
``response``, the others are ``revisit`` records without payload that refer to it; smaller ones are always
responses. Groups are settled on digests before any payload moves: payloads are shuffled once by page id,
so a payload that a third of all pages share is no hot key.

A null html is an empty payload, a null url is written as ``urn:page:`` and the id. Rows repeated with their
id are records of their own: the first is the response, the others revisit that id. A row with a null id is
always a response. Empty tables give no archive; extra columns are not archived. Payloads of any length are one
record, held whole by the task that writes or reads it.

Archives go to a folder by ``pyarrow.fs`` uri (file, hdfs, s3, gs) that all executors reach.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, read, shared_dir, table

LEAST = 1000
SAMPLE = 4 << 20
DICTIONARY = 112_640
ARCHIVE = 256 << 20
DATE = "2026-01-01T00:00:00Z"
# Fixed values of the formats: frame magics, and the profile of revisits with an identical payload.
SKIPPABLE = 0x184D2A5D
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record(kind: str, id: int | None, n: int, url: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if id is None else id}:{n}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <urn:page:{refers_to}:0>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, rest[:size]


class Writer:
    """Archives of one task, in a folder."""

    def __init__(self, folder: str, most: int = ARCHIVE, sample: int = SAMPLE):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.prefix = folder.rstrip("/")[: -len(self.folder.rstrip("/"))] if folder.rstrip("/").endswith(self.folder.rstrip("/")) else ""
        self.files.create_dir(self.folder, recursive=True)
        self.most, self.sample = most, sample
        self.out, self.waiting, self.held, self.done = None, [], 0, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= self.sample:
                self._open()
        else:
            self._put(data)
        if self.size >= self.most:
            self.close()

    size = 0

    def _dictionary(self) -> zstandard.ZstdCompressionDict:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, max(1024, self.held // 8)), self.waiting)
        except zstandard.ZstdError:  # too few or too equal records to train on
            return zstandard.ZstdCompressionDict(b"".join(self.waiting)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def _open(self) -> None:
        name = f"pages-{uuid.uuid4().hex}.warc.zst"
        self.path = f"{self.prefix}{self.folder.rstrip('/')}/{name}"
        self.out = self.files.open_output_stream(f"{self.folder.rstrip('/')}/{name}", compression=None)
        learned = self._dictionary()
        packed = zstandard.ZstdCompressor(level=3).compress(learned.as_bytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=learned)
        self.count, self.size = 0, 0
        first, self.waiting, self.held = self.waiting, [], 0
        about = b"software: gristmill\r\nformat: WARC File Format 1.1\r\n"
        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
        self.out.write(self.packer.compress(info.encode() + about + b"\r\n\r\n"))
        for data in first:
            self._put(data)

    def _put(self, data: bytes) -> None:
        self.out.write(self.packer.compress(data))
        self.count += 1
        self.size += len(data)

    def close(self) -> None:
        if self.out is None and self.waiting:
            self._open()
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.count, self.size))
            self.out, self.size = None, 0


def records(path: str, block: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive, read as a stream."""
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_stream(name, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} does not start with a dictionary")
        raw = zstandard.ZstdDecompressor().decompress(source.read(size))
        whole = raw[:4] == b"\x37\xa4\x30\xec"
        learned = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if whole else zstandard.DICT_TYPE_RAWCONTENT)
        unpack = zstandard.ZstdDecompressor(dict_data=learned)
        rest, frame, out = b"", unpack.decompressobj(), io.BytesIO()
        started = False
        while True:
            data = rest or source.read(block)
            if not data:
                break
            out.write(frame.decompress(data))
            started, rest = True, b""
            if frame.eof:
                yield parse(out.getvalue())
                rest, started = frame.unused_data, False
                frame, out = unpack.decompressobj(), io.BytesIO()
        if started:
            raise ValueError(f"{path} is cut short")


def plan(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """The records to write: kind, id, n (place among rows with equal id and payload), url, digests, size, refers_to, payload."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload")).withColumns(
        {"sum": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")}
    )
    keys = rows.where((F.col("size") >= least) & F.col("id").isNotNull()).select("id", "sum")
    groups = keys.groupBy("sum").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = keys.distinct().join(groups, "sum").select(F.col("id").alias("_id"), F.col("sum").alias("_sum"), "first")
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "sum").orderBy(F.col("url").asc_nulls_last())) - 1)
    met = placed.join(copies, (placed["id"] == copies["_id"]) & (placed["sum"] == copies["_sum"]), "left")
    again = F.col("first").isNotNull() & ((F.col("first") != F.col("id")) | (F.col("n") > 0))
    return met.select(
        F.when(again, "revisit").otherwise("response").alias("kind"), "id", "n",
        F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("url"),
        F.sha1("payload").alias("digest"), "size", F.when(again, F.col("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, folder: str, most: int = ARCHIVE, sample: int = SAMPLE, **columns) -> DataFrame:
    """Write the archives; the manifest (path, n_records, n_bytes) of what was committed."""

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = Writer(folder, most, sample)
        for pdf in batches:
            for kind, id, n, url, digest, size, first, payload in zip(pdf["kind"], pdf["id"], pdf["n"], pdf["url"], pdf["digest"], pdf["size"], pdf["refers_to"], pdf["payload"]):
                as_int = lambda x: None if pd.isna(x) else int(x)
                writer.add(record(kind, as_int(id), int(n), url, digest, int(size), as_int(first), bytes(payload) if kind == "response" else b""))
        writer.close()
        yield pd.DataFrame(writer.done, columns=["path", "n_records", "n_bytes"])

    # Ids go as text: pandas would make doubles of whole numbers beside nulls.
    planned = plan(bounded_batches(pages), **columns)
    return table(planned.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")}).mapInPandas(archives, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each page record of the archives, each payload held against its digest."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for pdf in batches:
            for path in pdf["path"]:
                rows, size = [], 0
                for fields, block in records(path):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    body = block.partition(b"\r\n\r\n")[2]
                    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if kind == "response" and (len(body) != n or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"a payload in {path} does not match its digest")
                    of = lambda x: (lambda s: int(s) if s else None)(x[len("<urn:page:") : -1].rpartition(":")[0]) if x else None
                    rows.append((of(fields["WARC-Record-ID"]), n, digest, kind, of(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], body if payloads and kind == "response" else None))
                    size += len(body) if payloads else 200
                    if size >= 8 << 20:
                        yield frame(rows, names)
                        rows, size = [], 0
                yield frame(rows, names)

    def frame(rows: list, names: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "path").mapInPandas(load, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    told = read_archives(write(pages, folder), payloads=False)
    return told.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH keyed AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), sized AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS d, sha256(payload) AS s FROM keyed
), ranked AS (
  SELECT *, max(page_id) OVER (PARTITION BY s) AS first FROM sized
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM ranked
"""
