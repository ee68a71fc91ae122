"""Legacy ARC archives converted to WARC 1.1, with revisit records for equal payloads.

ARC: a file begins with a filedesc:// record, whose second line starts with its version; each record is a
header line and as many bytes as its last field declares. Version 1 lines have the fields URL, IP, date,
type, length; version 2 lines have URL, IP, date, type, status, checksum, location, offset, file, length.
Fields are split from the right, so that a blank in a URL does no harm. Dates of 8 to 14 digits become ISO.
A line that is no header (of a version that is known; its length a number), a block that ends before its declared
length, and gzip data that end or break off are reported as rows with an error and the offset; reading goes on at the
next line that is a header. convert() leaves them out, and faults() lists them.

WARC: a record's identifier is a UUID of the file and the offset that it comes from; digests are base-32
SHA-1. Of records with equal payloads (of least_bytes or more), the one with the largest key is written as
response, the others as revisit, which refer to it.

Scale: files are read as binary rows, one file a row, decompressed as a stream; so archives should be of
at most some hundred MB each, as those written here are (one a task). Only digests that occur twice or
more are joined back, and Spark splits a hot digest's rows.

Null or empty payloads are records of 0 bytes, null URLs are written as "-". A null key is written without
an X-Record-Key line and read back as null; it counts as smallest. Repeated rows are records of their own.
An empty table gives archives without records; other columns of the table are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from splicework.llm.common import new_path

ARC_FIELDS = {1: 5, 2: 10}
_V1 = b"1 0 splicework\nURL IP-address Archive-date Content-type Archive-length\n"
RECORD = "file string, offset long, key long, url string, ip string, date string, mime string, head binary, payload binary, digest string, error string"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's namespace for URLs


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{file}#{offset}')}>"


def iso_date(digits: str) -> str:
    d = (digits + "00000101000000"[len(digits) :]) if len(digits) < 14 else digits[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


class _Stream:
    """Lines and blocks of a file's bytes, gzip members decompressed one piece at a time."""

    def __init__(self, data: bytes):
        # base: the place in the file of have's first byte
        self.pieces, self.have, self.at, self.base = self._plain(data), b"", 0, 0

    #: Whether a gzip member is not at its end; at the end of the file, it broke off.
    open = False

    def _plain(self, data: bytes) -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        engine = zlib.decompressobj(31)
        try:
            for i in range(0, len(data), 1 << 20):
                piece = data[i : i + (1 << 20)]
                while piece:
                    yield engine.decompress(piece)
                    piece = engine.unused_data
                    if engine.eof:
                        self.open, engine = False, zlib.decompressobj(31)
                    else:
                        self.open = True
        except zlib.error:
            self.open = True  # what follows in the file cannot be told from garbage

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.have += piece
        return True

    def line(self) -> bytes | None:
        while (i := self.have.find(b"\n", self.at - self.base)) < 0:
            if not self._more():
                break
        return self._cut(i + 1 if i >= 0 else len(self.have))

    def _cut(self, end: int) -> bytes | None:
        out = self.have[self.at - self.base : end]
        self.at = self.base + end
        if self.at - self.base > 1 << 22:
            self.have, self.base = self.have[self.at - self.base :], self.at
        return out or None

    def block(self, n: int) -> bytes:
        while len(self.have) - (self.at - self.base) < n and self._more():
            pass
        out = self._cut(self.at - self.base + n)
        return out or b""


_LENGTH = re.compile(rb"[0-9]{1,18}")
_DATE = re.compile(rb"[0-9]{8,14}")


def _header(line: bytes, version: int) -> list[bytes] | None:
    """The fields of a header line of the version; None if it is none."""
    f = line.strip().rsplit(b" ", ARC_FIELDS.get(version, 0) - 1)
    good = version in ARC_FIELDS and len(f) == ARC_FIELDS[version] and _LENGTH.fullmatch(f[-1]) and _DATE.fullmatch(f[2])
    return f if good else None


def parse_arc(name: str, data: bytes) -> Iterator[dict]:
    stream, version, lost = _Stream(data), 1, False

    def fault(offset: int, what: str) -> dict:
        return dict.fromkeys(("key", "url", "ip", "date", "mime", "head", "payload", "digest")) | {"file": name, "offset": offset, "error": what}

    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        offset = stream.at - len(line)
        if line.startswith(b"filedesc://") and _LENGTH.fullmatch(last := line.split()[-1]):
            block = stream.block(int(last)).split(None, 1)
            version = int(block[0]) if block and _LENGTH.fullmatch(block[0]) else 0
            if version not in ARC_FIELDS:
                yield fault(offset, "version")
            lost = False
            continue
        f = _header(line, version)
        if f is None:
            if not lost:  # once, until a header is found again
                yield fault(offset, "header")
            lost = True
            continue
        lost, size = False, int(f[-1])
        block = stream.block(size)
        if len(block) < size:
            yield fault(offset, "length")
            continue
        head, payload = split_http(block)
        url, ip, date, mime = (x.decode("utf-8", "replace") for x in f[:4])
        yield {"file": name, "offset": offset, "key": http_number(head, b"x-record-key"), "url": url, "ip": ip, "date": iso_date(date), "mime": mime, "head": head, "payload": payload, "digest": sha1_base32(payload), "error": None}
    if stream.open:
        yield fault(stream.at, "gzip")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its blank line, and the payload; all is payload without such a header."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def http_number(head: bytes, name: bytes) -> int | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*(-?[0-9]+)\r?$", head)
    return int(found[1]) if found else None


def parse_warc(name: str, data: bytes) -> Iterator[dict]:
    stream = _Stream(data)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.line()) not in (None, b"\r\n"):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        if not _LENGTH.fullmatch(fields.get("content-length", "").encode()):
            continue
        head, payload = split_http(stream.block(int(fields["content-length"])))
        kind = fields.get("warc-type")
        if kind not in ("response", "resource", "revisit"):
            continue
        full = kind != "revisit"
        length = None if full else fields.get("x-payload-length") or http_number(head, b"content-length")
        yield {
            "key": http_number(head, b"x-record-key"), "record_id": fields.get("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "refers_to_id": fields.get("warc-refers-to"), "payload": payload if full else None,
            "payload_bytes": len(payload) if full else None if length is None else int(length),
            "payload_digest": sha1_base32(payload) if full else fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        }


WARC_RECORD = "key long, record_id string, record_type string, url string, date string, refers_to_id string, payload binary, payload_bytes long, payload_digest string"


def _parsed(files: DataFrame, parse, schema: str, columns: list[str]) -> DataFrame:
    """The records of binary files, some at a time; only the named columns leave the task."""
    full = {f.name: f.dataType for f in StructType.fromDDL(schema)}
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(c, kinds[full[c].simpleString()]) for c in columns])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some, held = [], 0
                for r in parse(name, data.as_py()):
                    some.append({c: r[c] for c in columns})
                    held += len(r["payload"] or b"") + 500
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(some, schema=arrow)
                        some, held = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema=arrow)

    return files.select("path", "content").mapInArrow(rows, ", ".join(f"{c} {full[c].simpleString()}" for c in columns))


def read_arc(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    return _parsed(spark.read.format("binaryFile").load(folder), parse_arc, RECORD, columns)


def read_warc(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    return _parsed(spark.read.format("binaryFile").load(folder), parse_warc, WARC_RECORD, columns)


def write_arc(pages: DataFrame, key: Column, url: Column, payload: Column, folder: str, date: str = "20000101000000") -> None:
    """A version 1 archive a task, gzipped, of HTTP responses with payload (binary) as their body."""
    size = F.coalesce(F.octet_length(payload), F.lit(0)).cast("string")
    mark = F.coalesce(F.concat(F.lit("X-Record-Key: "), key.cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), mark, F.lit("Content-Length: "), size, F.lit("\r\n\r\n"))
    line = F.concat(F.coalesce(F.regexp_replace(url, r"[\x00-\x20]", "%20"), F.lit("-")), F.lit(f" 0.0.0.0 {date} text/html "), (F.octet_length(head) + size.cast("int")).cast("string"), F.lit("\n"))
    rows = pages.select(F.concat(line.cast("binary"), head.cast("binary"), F.coalesce(payload, F.lit(b""))).alias("record"))

    def with_version(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = b"filedesc://splicework.arc 0.0.0.0 %s text/plain %d\n%s" % (date.encode(), len(_V1), _V1)
        yield pa.RecordBatch.from_pydict({"record": pa.array([first], pa.binary())})
        yield from batches

    rows.mapInArrow(with_version, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").text(folder)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = 0) -> None:
    """Writes WARC files, gzipped, of all the records of the ARC files."""
    rank = F.struct("key", "file", "offset")
    seen = read_arc(spark, arc_folder, ["digest", "key", "file", "offset", "url", "date", "error"]).where("error is null")
    again = seen.groupBy("digest").agg(F.max(F.struct("key", "file", "offset", "url", "date")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    records = read_arc(spark, arc_folder, ["file", "offset", "key", "url", "ip", "date", "mime", "head", "payload", "digest", "error"]).where("error is null")
    big = F.octet_length("payload") >= least_bytes
    other = F.coalesce(big & ~rank.eqNullSafe(F.struct("first.key", "first.file", "first.offset")) & F.col("first").isNotNull(), F.lit(False))
    rows = records.join(again, "digest", "left").withColumn("refers", F.when(other, F.col("first"))).drop("first")
    out = pa.schema([("record", pa.binary())])

    def warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"record": [_warc_record(r) for r in batch.to_pylist()]}, schema=out)

    rows.mapInArrow(warc, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_folder)


def faults(spark: SparkSession, arc_folder: str) -> DataFrame:
    """What convert() leaves out: file, offset, error (version, header, length, gzip)."""
    return read_arc(spark, arc_folder, ["file", "offset", "error", "payload"]).where("error is not null").drop("payload")


def _warc_record(r: dict) -> bytes:
    refers = r["refers"]
    block = r["head"] if refers else r["head"] + r["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response' if r['head'] else 'resource'}", f"WARC-Record-ID: {record_id(r['file'], r['offset'])}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}"]
    lines += [f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if refers:
        lines += [f"WARC-Refers-To: {record_id(refers['file'], refers['offset'])}", f"WARC-Refers-To-Target-URI: {refers['url']}", f"WARC-Refers-To-Date: {refers['date']}"]
        lines += [f"X-Payload-Length: {len(r['payload'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if r['head'] else r['mime']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """pages to ARC, ARC to WARC, and WARC read back: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, F.col(id_col).cast("long"), F.col(url_col), F.col(payload_col).cast("binary"), arc)
    convert(spark, arc, warc)
    records = read_warc(spark, warc, ["key", "record_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest"])
    first = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    named = records.where("record_type = 'revisit'").join(first, "refers_to_id", "left")
    columns = [F.col("key").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    return records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(named.select(*columns))
