"""Legacy ARC records, their conversion to WARC, and the reading of WARC archives.

An ARC record is a header line of space-separated fields (five in version 1, ten in version 2), then
as many payload bytes as its last field declares. The converter parses both versions by the declared
length and synthesises the WARC fields that ARC lacks: record id, timestamp, type and digests.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm.common import chunks, drop, give_back, lean
from granary.session import cut, shared_dir

#: Fixed values of the formats.
ARC_FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}
ARC_LINES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

GZIP = b"\x1f\x8b"
HTTP = "application/http; msgtype=response"
#: Bytes of records, before compression, after which a task goes on to another file (a longer record stands alone).
FILE_BYTES = 64 << 20

#: Capture time and address of records whose source has none.
NO_DATE, NO_IP = "19700101000000", "0.0.0.0"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escaped(url: str | None) -> str:
    """A url as one field of an ARC line: white space, control characters and % percent-encoded; '-' if there is none."""
    if url is None:
        return "-"
    out = "".join(f"%{ord(c):02X}" if c <= " " or c == "%" or c == "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) if c.isspace() else c for c in url)
    return "%2D" if out == "-" else out


def _unescaped(field: str) -> str | None:
    from urllib.parse import unquote_to_bytes

    return None if field == "-" else unquote_to_bytes(field).decode("utf-8", "replace")


def arc_record(url: str | None, payload: bytes, version: int = 1, date: str = NO_DATE, ip: str = NO_IP, mime: str = "text/html", status: str = "200", offset: int = 0, filename: str = "-") -> bytes:
    head = [_escaped(url), ip, date, mime]
    if version == 2:
        head += [status, "-", "-", str(offset), filename]
    return " ".join([*head, str(len(payload))]).encode() + b"\n" + payload + b"\n"


def arc_version_block(version: int, filename: str = "archive.arc", date: str = NO_DATE, origin: str = "granary") -> bytes:
    body = f"{version} 0 {origin}\n{ARC_LINES[version]}\n\n".encode()
    head = f"filedesc://{filename} {NO_IP} {date} text/plain " + ("200 - - 0 " + filename + " " if version == 2 else "")
    return head.encode() + f"{len(body)}\n".encode() + body + b"\n"


def parse_arc(data: bytes, version: int | None = None):
    """Yields (fields, payload) of each record. A version block sets the version of what follows it.

    Without a block the version follows from the number of fields. Raises ValueError on a line of
    another number of fields, on a declared length that is no number, and on a truncated payload.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line without an end")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if not line:
            at = end + 1
            continue
        parts = line.split(" ")
        block = parts[0].startswith("filedesc://")
        kind = version if version and not block else {5: 1, 10: 2}.get(len(parts))
        if kind is None or len(parts) != len(ARC_FIELDS[kind]) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        fields = dict(zip(ARC_FIELDS[kind], parts, strict=True))
        at, size = end + 1, int(parts[-1])
        if at + size > len(data):
            raise ValueError("an ARC payload shorter than its declared length")
        payload = data[at : at + size]
        at += size
        if block:
            version = int(payload.split(b" ", 1)[0])
            continue
        fields["version"], fields["url"] = kind, _unescaped(fields["url"])
        yield fields, payload


def warc_date(date: str) -> str:
    """14 (or fewer, from the left) digits -> ISO 8601 in UTC; an impossible date becomes the epoch."""
    try:
        return datetime.datetime.strptime((date + "19700101000000"[len(date) :])[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def http_message(payload: bytes, mime: str = "text/html", status: str = "200") -> bytes:
    """The payload behind the header of a response; one that has a header stays as it is."""
    if payload.startswith(b"HTTP/"):
        return payload
    return f"HTTP/1.1 {status} OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def body_of(message: bytes) -> bytes:
    """What follows the header of an HTTP message (its lines end in CR LF, or LF alone in old archives)."""
    ends = [(i, n) for i, n in ((message.find(b"\r\n\r\n"), 4), (message.find(b"\n\n"), 2)) if i >= 0]
    if not ends:
        return b""
    i, n = min(ends)
    return message[i + n :]


def payload_of(head: dict, block: bytes) -> bytes:
    """The payload in a record's block."""
    return body_of(block) if head.get("content-type", "").startswith("application/http") else block


def warc_record(fields: dict, payload: bytes, key: str, refers_to: str | None = None, extra: dict | None = None) -> bytes:
    """A WARC 1.1 record: a response, or a revisit (no block) of the record of key `refers_to`.

    The block is an HTTP message; where the payload has no HTTP header, one is synthesised. Payload
    digest and length are those of the body.
    """
    message = http_message(payload, fields["mime"], fields.get("status", "200"))
    block = b"" if refers_to is not None else message
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(key),
        "WARC-Date": warc_date(fields["date"]),
        "WARC-Target-URI": fields["url"] if fields["url"] is not None else "about:blank",
        "WARC-IP-Address": fields["ip"],
        "WARC-Payload-Digest": f"sha1:{base32_sha1(body_of(message))}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "WARC-Identified-Payload-Type": fields["mime"],
        "Content-Type": HTTP,
    }
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to)}
    head |= extra or {}
    lines = "".join(f"{k}: {str(v).translate(_LINE)}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


#: A header value is one line.
_LINE = {10: "%0A", 13: "%0D"}


def parse_warc(data: bytes):
    """Yields (headers by lower-cased name, block) of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:200]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at, size = end + 4, int(head["content-length"])
        if at + size > len(data):
            raise ValueError("a WARC block shorter than its declared length")
        yield head, data[at : at + size]
        at += size + 4


def member(record: bytes) -> bytes:
    """The record as a gzip member of its own."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def members(data: bytes):
    """What each gzip member holds (plain data: all of it), one after the other. Zeros after a member are padding."""
    if not data.startswith(GZIP):
        yield data
        return
    while data:
        one = zlib.decompressobj(31)
        out = one.decompress(data) + one.flush()
        if not one.eof:
            raise ValueError("a gzip member without its end")
        yield out
        data = one.unused_data.lstrip(b"\0")


def _page_key(page_id, copy, payload: bytes) -> str:
    return f"page:{page_id}:{copy}:{base32_sha1(payload)}"


def _to_warc(most: int):
    """Pages with their decision -> (value, file): each page first as a legacy ARC record (both versions), then converted.

    The value is the record's gzip member less its last byte. That byte, the highest of the record's
    length, is 0 for records under 16 MB, and it is what the text writer puts after each row; after a
    longer record it is padding.
    """

    def run(batches):
        file = size = 0
        for batch in chunks(batches, "html"):
            out, files = [], []
            for page, copy, url, html, first, first_copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version, raw = 1 + ((page if isinstance(page, int) else 0) & 1), (html or "").encode()
                arc = arc_version_block(version) + arc_record(url, http_message(raw), version, filename="pages.arc")
                for fields, message in parse_arc(arc):
                    extra = {"WARC-X-Page-Id": "" if page is None else page, "WARC-X-Payload-Length": len(raw)}
                    if first_copy is not None:
                        extra["WARC-X-Refers-To-Page"] = "" if first is None else first
                    record = warc_record(fields, message, _page_key(page, copy, raw), None if first_copy is None else _page_key(first, first_copy, raw), extra)
                    if size and size + len(record) > most:
                        file, size = file + 1, 0
                    size += len(record)
                    packed = member(record)
                    out.append(packed[:-1] if len(record) < 1 << 24 else packed)
                    files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files, pa.int32())], names=["value", "file"])

    return run


READ_DDL = "page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, record_id string, target_uri string, warc_date string"


def _from_warc(kind: pa.DataType):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "warc_date"]
    kinds = (kind, pa.int64(), pa.string(), pa.string(), kind, pa.string(), pa.string(), pa.string())
    own = (lambda x: x) if pa.types.is_string(kind) else int

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, block in (x for part in members(data.as_py()) for x in parse_warc(part)):
                    type_, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    payload = payload_of(head, block)
                    if type_ == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"the payload of {head['warc-record-id']} doesn't have its digest")
                    size = len(payload) if type_ == "response" else int(head["warc-x-payload-length"])
                    page, to = head.get("warc-x-page-id"), head.get("warc-x-refers-to-page")
                    rows.append((own(page) if page else None, size, digest, type_, own(to) if to else None, head["warc-record-id"], head["warc-target-uri"], head["warc-date"]))
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def decided(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, the payload's hash, first (the page whose payload others repeat) and whether that counts.

    Of records with equal payloads of at least `least` bytes the smallest page_id is the response;
    null ids come last. Ids are whole numbers or strings.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = lean(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(html, 256).alias("_key"))
    groups = rows.groupBy("_key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    many = groups.filter("n > 1").select(F.col("_key").alias("_many"), "first")
    both = rows.join(many, F.col("_key") == F.col("_many"), "left")
    long = F.col("_many").isNotNull() & (F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    return both.select("page_id", "url", "html", "_key", "first", long.alias("_long"))


def write_warc(pages: DataFrame, out_dir: str, least: int = 0) -> None:
    """Writes WARC files of pages (page_id, url, html) to out_dir, a folder that Spark can write.

    A null or empty html is an empty payload. Every row gives one record, a gzip member of its own;
    files are of about FILE_BYTES at most.
    """
    rows = decided(pages, least)
    same = F.col("page_id").eqNullSafe(F.col("first"))
    again = rows.groupBy("_key", "page_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("_key").alias("_again"), F.col("page_id").alias("_id"))
    if again.isEmpty():
        plan = rows.withColumn("copy", F.lit(0))
    else:  # rows that repeat a page_id and its payload are numbered; of the first page's one is the response
        marked = rows.join(again, (F.col("_key") == F.col("_again")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
        rank = F.row_number().over(Window.partitionBy("_key", "page_id").orderBy("url")) - 1
        alone, several = marked.filter("_again is null"), marked.filter("_again is not null")
        plan = alone.withColumn("copy", F.lit(0)).unionByName(several.withColumn("copy", rank))
    plan = plan.withColumn("first_copy", F.when(F.col("_long") & ~(same & (F.col("copy") == 0)), F.lit(0)))
    records = plan.select("page_id", "copy", "url", "html", "first", "first_copy").mapInArrow(give_back(_to_warc(FILE_BYTES)), "value binary, file int")
    writer = records.select(F.col("value").cast("string"), "file").write.mode("overwrite").partitionBy("file")
    writer.option("lineSep", "\0").option("compression", "none").text(out_dir)


def read_warc(spark, path: str, kind: str = "long") -> DataFrame:
    """Records of the WARC files (plain or gzip) in path: READ_DDL, with ids of this kind. Payload digests of responses are checked."""
    schema = spark.range(0).select(F.lit(None).cast(kind).alias("x")).schema
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > 0).select("content")
    return lean(files).mapInArrow(give_back(_from_warc(to_arrow_type(schema["x"].dataType))), READ_DDL.format(kind=kind))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as WARC (through ARC) into the shared folder and reads them back; what was read is kept, and the archives go."""
    spark = pages.sparkSession
    out = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, out, least)
    got = cut(read_warc(spark, out, pages.schema["page_id"].dataType.simpleString()))
    drop(spark, out)
    return got


def records_of(arc: DataFrame, content: Column, key: Column) -> DataFrame:
    """ARC archives (a row each: bytes and a unique key) -> WARC archives with the same number of records, all responses."""

    def convert(batches):
        for batch in batches:
            out = []
            for data, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(b"".join(warc_record(f, p, f"{name}:{i}") for i, (f, p) in enumerate(parse_arc(data or b""))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["key", "warc"])

    return arc.select(content.cast("binary").alias("content"), key.cast("string").alias("key")).mapInArrow(convert, "key string, warc binary")
