"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame`` bytes; a bundle is a run of frames, closed by a seek table in
a skippable frame (sizes of all frames, so any zstd reader still reads the whole file and a seeking reader jumps to one).
An index maps each record's identifier to its frame, its offset within the decompressed frame and its length. A bundle holds
about ``bundle`` bytes before compression, so one is made and read in bounded memory; a longer single record has its own.

Bundles are rows of a table (bundle, data, index), which any shared store keeps whole if an executor is lost. Of records
with equal payloads of at least ``least`` bytes the one with the smallest page_id is the response and the rest are revisits
that name it; the equal ones are found by an aggregate over (SHA-256, SHA-1, length) that combines before it shuffles, never by a
group of payloads, so payloads made to collide in the digest that WARC reports are still kept apart. A null html is the empty
payload. Rows that repeat a page_id with the same payload are each written, with the same type. A row without a page_id counts
as later than all others: it is a revisit where a row with an id has its payload, else a response. A null url is written as the
record's own identifier; control characters and blanks in it are escaped. An empty table gives no bundles and no rows; columns
other than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.tables import Scratch

#: Fixed values of the seekable format: the skippable frame that holds the table, and the end of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> tuple[str, bytes]:
    """The identifier and the bytes of one record; a revisit keeps the HTTP head and leaves the payload out."""
    name = f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    head.append(f"WARC-Target-URI: {quote(url, safe='''!#$%&'()*+,/:;=?@[]~''') if url else name}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """WARC headers, block, HTTP headers and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, block, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


class Bundle:
    """Builds one seekable bundle and its index."""

    def __init__(self, frame: int, level: int):
        self.frame, self.zstd = frame, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.open_size = self.size = 0

    def add(self, name: str, data: bytes) -> None:
        if self.open_size and self.open_size + len(data) > self.frame:
            self.close_frame()
        self.index.append((name, len(self.sizes), self.open_size, len(data)))
        self.open.append(data)
        self.open_size += len(data)
        self.size += len(data)

    def close_frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.open_size))
            self.open, self.open_size = [], 0

    def close(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.parts, struct.pack("<II", SKIPPABLE, len(table)), table])


class Reader:
    """Random access to the frames of a bundle by the seek table at its end."""

    def __init__(self, data: bytes):
        n, kind, magic = struct.unpack("<IBI", data[-9:])
        each = 12 if kind & 0x80 else 8
        if magic != SEEKABLE or struct.unpack("<II", data[-9 - each * n - 8 : -9 - each * n]) != (SKIPPABLE, each * n + 9):
            raise ValueError("no seek table")
        self.data, self.at = data, [0]
        self.raw = []
        for k in range(n):
            packed, raw = struct.unpack_from("<II", data, len(data) - 9 - each * (n - k))
            self.at.append(self.at[-1] + packed)
            self.raw.append(raw)
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        return self.zstd.decompress(self.data[self.at[k] : self.at[k + 1]], max_output_size=self.raw[k])

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def resolve(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """``pages`` as (page_id, url, payload, refers_to): the page of which each is a revisit, else null."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    # one key of all that makes two payloads equal; only these few bytes of a page are aggregated
    key = F.unhex(F.concat(F.sha2("payload", 256), F.sha1("payload"), F.lpad(F.hex(F.octet_length("payload")), 16, "0")))
    rows = rows.select("*", key.alias("_key"))
    keys = rows.where(F.octet_length("payload") >= least).select("page_id", "_key")
    same = keys.groupBy("_key").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last"), F.count("*").alias("_n"), F.count("page_id").alias("_ids"))
    # written before the join, so that Spark can split a digest that very many pages have
    first = scratch.keep(same.where("refers_to <> _last or (_ids > 0 and _ids < _n)").select("_key", "refers_to"), "first")
    again = keys.join(first, "_key").where("page_id is null or page_id <> refers_to").distinct()
    again = again.select(F.col("page_id").alias("_page"), F.col("_key").alias("_again"), "refers_to")
    return rows.join(again, rows["page_id"].eqNullSafe(F.col("_page")) & (F.col("_key") == F.col("_again")), "left").select("page_id", "url", "payload", "refers_to")


def bundles(resolved: DataFrame, frame: int = 256 << 10, bundle: int = 16 << 20, level: int = 3) -> DataFrame:
    """(bundle, data, index) rows with a record for each row of ``resolved``."""

    def run(batches):
        from pyspark import TaskContext

        task, made, now = TaskContext.get().partitionId(), 0, Bundle(frame, level)

        def row():
            nonlocal made, now
            done, now, made = now, Bundle(frame, level), made + 1
            data = done.close()
            names, frames, offsets, lengths = zip(*done.index)
            entry = pa.StructArray.from_arrays([pa.array(names), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["record_id", "frame", "offset", "length"])
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{made:06d}"]), pa.array([data], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), entry)], names=["bundle", "data", "index"])

        for b in batches:
            for page, url, payload, refers in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                name, data = record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py())
                if now.size and now.size + len(data) > bundle:
                    yield row()
                now.add(name, data)
        if now.index:
            yield row()

    return resolved.mapInArrow(run, f"bundle string, data binary, index {INDEX}")


def read(archive: DataFrame) -> DataFrame:
    """A row for each record of the bundles, from what is written there."""

    def number(name: str):
        tail = name.rpartition(":")[2].rstrip(">")
        return None if tail == "None" else int(tail)

    def run(batches):
        for b in batches:
            for data, index in zip(b.column(0), b.column(1)):
                reader, at, frame = Reader(data.as_py()), -1, b""
                rows: list[list] = [[], [], [], [], [], [], []]
                for e in index.as_py():
                    if e["frame"] != at:
                        at, frame = e["frame"], reader.frame(e["frame"])
                    fields, _, http, body = parse(frame[e["offset"] : e["offset"] + e["length"]])
                    if fields["WARC-Record-ID"] != f"<{e['record_id']}>":
                        raise ValueError("the index does not lead to its record")
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = fields["WARC-Type"] == "response"
                    if response and (digest(body) != told or len(body) != int(http["Content-Length"])):
                        raise ValueError("a payload does not match its digest")
                    refers = None if response else number(fields["WARC-Refers-To"])
                    url = fields["WARC-Target-URI"]
                    for column, x in zip(rows, (number(fields["WARC-Record-ID"]), int(http["Content-Length"]), told, fields["WARC-Type"], refers, None if url.startswith("urn:page:") else unquote(url), body if response else None)):
                        column.append(x)
                # a bundle is bounded, and payloads leave in slices
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
                yield from (out.slice(k, 256) for k in range(0, out.num_rows, 256))

    return archive.select("data", "index").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary")


def archive(pages: DataFrame, least: int = 0, **sizes: int) -> DataFrame:
    """The bundles of ``pages``, written to the shared folder."""
    scratch = Scratch(pages.sparkSession, "warc")
    made = scratch.keep(bundles(resolve(pages, scratch, least), **sizes), "bundles")
    scratch.drop("first")
    return made


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read(archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
