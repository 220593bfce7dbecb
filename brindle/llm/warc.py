"""WARC: writing captures as archives, reading archives back, and assembling transactions.

A capture is a request record, a response record (or a revisit record where an equal payload was seen before) and a
metadata record; request and metadata name the response in ``WARC-Concurrent-To``. ``write_warc`` makes those records and
``assemble`` joins them back into one nested row for each capture.

Archives are written by Spark's text writer with a record for each row and the two line ends that follow a record as the
separator, so they land wherever Spark can write; with compression, the file is one gzip stream. ``read_records`` takes
archives by Spark's binary reader and follows ``Content-Length``, so payloads may hold anything, and files of one or many
gzip members are inflated as they are walked. A file is held compressed by one task: keep files under ``maxLength`` (2 GB).

Archives may be damaged: bytes after the last gzip member are passed over, a record whose length is missing or no number, or
that ends before its length, becomes a row of type ``damaged`` with what could be read, and reading goes on at the next
record head or ends with the file. So one bad file neither fails the job nor loses its records without a trace.

Defined results: a null payload counts as empty; empty payloads are equal and so revisit each other. Of rows with equal
payloads those with the smallest id are responses, all others revisit that id; rows that repeat an id and payload become
records alike. Captures without a request or metadata record have null there; of several, the one with the smallest record
id is taken. Columns besides the ones named are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import map_rows, shared_dir

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_FIELDS = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long"
RECORDS = f"{RECORD_FIELDS}, fields map<string,string>, payload binary"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page, kind: str, digest: str) -> str:
    """A stable URN for the record of some kind of a page with some payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}:{digest}')}>"


def _record(kind: str, rid: str, headers: list[tuple[str, str]], content_type: str, body: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *headers, ("Content-Type", content_type), ("Content-Length", str(len(body)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in lines)
    return VERSION + b"\r\n" + head + b"\r\n" + body


def _clean(value: str | None) -> str:
    """A header value: no line ends."""
    return " ".join((value or "").split())


def capture_records(page, url: str | None, payload: bytes, original) -> Iterator[bytes]:
    """The three records of a capture; ``original`` is the id that a revisit refers to, or None for a response."""
    digest = f"sha1:{sha1_base32(payload)}"
    url = _clean(url) or "urn:none"
    rid = record_id(page, "response", digest)
    shared = [("WARC-Target-URI", url), ("WARC-Payload-Digest", digest)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    yield _record("request", record_id(page, "request", digest), [("WARC-Target-URI", url), ("WARC-Concurrent-To", rid)], "application/http; msgtype=request", f"GET {url} HTTP/1.1\r\n\r\n".encode())
    if original is None:
        yield _record("response", rid, shared, "application/http; msgtype=response", head + payload)
    else:
        links = [("WARC-Refers-To", record_id(original, "response", digest)), ("WARC-Profile", PROFILE)]
        yield _record("revisit", rid, [*shared, *links], "application/http; msgtype=response", head)
    notes = (f"page-id: {page}\r\n" if page is not None else "") + f"payload-bytes: {len(payload)}\r\n" + (f"original-page-id: {original}\r\n" if original is not None else "")
    yield _record("metadata", record_id(page, "metadata", digest), [("WARC-Target-URI", url), ("WARC-Concurrent-To", rid)], "application/warc-fields", notes.encode())


def with_originals(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``pages`` with ``original``: null for responses, else the smallest id with the same payload.

    Digests are grouped first (each task sends one row for each digest), and only revisits, by id and digest, meet the rows
    with payloads. So a payload that a third of the pages share costs no task more than its ids.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    keyed = pages.withColumn("_digest", F.sha1(payload))
    ids = keyed.select(F.col(id_col).alias("_id"), "_digest")
    firsts = ids.groupBy("_digest").agg(F.min("_id").alias("original"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    revisits = ids.join(firsts, "_digest").where(F.col("_id") > F.col("original")).dropDuplicates(["_id", "_digest"])
    return keyed.join(revisits.select("_id", F.col("_digest").alias("_d"), "original"), (F.col(id_col) == F.col("_id")) & (F.col("_digest") == F.col("_d")), "left").drop("_id", "_d", "_digest")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_min_bytes: int = 0, records_per_file: int = 6000, compression: str = "gzip") -> None:
    """Writes the captures of ``pages`` to archives under ``path``. Payloads shorter than ``revisit_min_bytes`` never revisit."""
    rows = with_originals(pages.select(id_col, url_col, payload_col), id_col, payload_col)

    def records(read):
        for page, url, html, original in read:
            payload = (html or "").encode("utf-8", "surrogatepass")
            if len(payload) < revisit_min_bytes:
                original = None
            for r in capture_records(page, url, payload, original):
                yield (r.decode("utf-8", "surrogatepass"),)

    out = map_rows(rows.select(id_col, url_col, payload_col, "original"), "value string", records, chunk=300)
    writer = out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
    (writer.option("compression", compression) if compression else writer).text(path)


class _Source:
    """Reads bytes from a buffer, inflating gzip members one after another if it is compressed. What cannot be inflated ends it."""

    def __init__(self, data: bytes, step: int = 1 << 16):
        self.data, self.at, self.step, self.held, self.broken = memoryview(data), 0, step, bytearray(), False
        self.inflate = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        while self.at < len(self.data) and not self.broken:
            part = bytes(self.data[self.at : self.at + self.step])
            self.at += len(part)
            if not self.inflate:
                self.held += part
                return True
            before = len(self.held)
            while part and not self.broken:
                if self.inflate.eof:
                    if not part.startswith(b"\x1f"):
                        self.broken = True  # no further member
                        break
                    self.inflate = zlib.decompressobj(31)
                saved = self.inflate.copy()
                try:
                    self.held += self.inflate.decompress(part)
                except zlib.error:
                    self.broken = True
                    self._rescue(saved, part)
                part = self.inflate.unused_data
            if len(self.held) > before:
                return True
        return False

    def _rescue(self, inflate, part: bytes) -> None:
        """What comes before the damage, a few bytes at a time."""
        with contextlib.suppress(zlib.error):
            for i in range(0, len(part), 8):
                self.held += inflate.decompress(part[i : i + 8])

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is dropped; None at the end."""
        seen = 0
        while (i := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:i])
        del self.held[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_archive(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, bool]]:
    """(headers with lower-case names, block, whether the record is whole) of each record."""
    source = _Source(data)
    while (head := source.until(b"\r\n\r\n")) is not None:
        # where a length was wrong, the next record's head may come after other bytes
        lines = head[max(0, head.rfind(b"WARC/1")) :].lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            continue
        headers = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        length = dict(headers).get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield headers, b"", False
            continue
        block = source.take(int(length))
        yield headers, block, len(block) == int(length)


def read_records(spark: SparkSession, path: str, with_payload: bool = True, glob: str = "part-*") -> DataFrame:
    """A row for each record of the archives under ``path``.

    The payload is the HTTP body of responses and the block of other records; digest and length are those of what the
    record holds (a revisit's digest is the one it declares). ``fields`` has the lines of a metadata record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content")

    def records(read):
        for (data,) in read:
            for headers, block, whole in parse_archive(data):
                one = dict(headers)
                kind, payload, fields = one.get("warc-type") if whole else "damaged", block, None
                if one.get("content-type", "").startswith("application/http"):
                    payload = block.partition(b"\r\n\r\n")[2]
                if kind == "metadata":
                    fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()}
                digest = sha1_base32(payload)
                if kind == "revisit":
                    digest = one.get("warc-payload-digest", "").removeprefix("sha1:") or None
                links = [v for k, v in headers if k == "warc-concurrent-to"]
                yield one.get("warc-record-id"), kind, links, one.get("warc-refers-to"), one.get("warc-target-uri"), one.get("warc-date"), digest, len(payload), fields, payload if with_payload else None

    return map_rows(files, RECORDS, records, chunk=64)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, response, request and metadata, joined on the concurrent-to identifiers.

    ``records`` is read several times: pass a stored table. A record belongs to the capture that it names, or to the capture that names it.
    """
    columns = [c for c in records.columns if c != "concurrent_to"]
    nested = F.struct(*columns)
    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), nested.alias("response"), "concurrent_to")
    named = main.select("capture_id", F.explode("concurrent_to").alias("member"))

    def joined(kind: str) -> DataFrame:
        own = records.where(F.col("type") == kind)
        naming = own.select(F.explode("concurrent_to").alias("capture_id"), nested.alias(kind))
        by_main = named.join(own.select(F.col("record_id").alias("member"), nested.alias(kind)), "member").select("capture_id", kind)
        return naming.unionByName(by_main).groupBy("capture_id").agg(F.min_by(kind, F.col(kind).record_id).alias(kind))

    return main.drop("concurrent_to").join(joined("request"), "capture_id", "left").join(joined("metadata"), "capture_id", "left")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark)}/brindle-warc-{uuid.uuid4().hex}"
