"""Web archives: ARC writer, ARC-to-WARC converter, WARC writer and reader, all over files in a shared folder.

Archives are written by Spark's text writer, whose line separator is the formats' last line feed, and read as whole files.
A file holds at most `records` records and begins with its own version block, so no file is large and each can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import LAST_ID, shared_folder, slices

#: The header fields of both ARC versions, in the order of the published format (fixed values).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Of the payload-digest revisit profile (fixed value).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ODD = re.compile(rb"[\x00-\x20\x7f-\xff]")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str | None) -> str:
    """A header field without blanks: other bytes percent-encoded; "-" where there is none."""
    return _ODD.sub(lambda m: b"%%%02X" % m[0][0], (value or "").encode()).decode() or "-"


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 ledgerloom\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(head[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(url: str | None, block: bytes, version: int, date: str, name: str = "-", offset: int = 0) -> bytes:
    """A record without the line feed that ends it."""
    head = {"URL": _field(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(head[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block


def http_block(page_id: int | None, payload: bytes) -> bytes:
    page = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_records(data: bytes) -> Iterator[dict[str, str | bytes | int]]:
    """The records of an ARC file, by the header line of its version and the declared lengths; "block" holds the bytes."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].rstrip(b"\r").decode("latin-1").split(" ")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"ARC record at {at} is cut: {len(block)} of {length} bytes")
        if values[0].startswith("filedesc:"):
            version = int(block.split(b" ", 1)[0])
            if len(values) != len(ARC_FIELDS[version]):
                raise ValueError(f"ARC version {version} has {len(ARC_FIELDS[version])} fields, this file has {len(values)}")
        names = ARC_FIELDS[version]
        if len(values) != len(names):
            raise ValueError(f"ARC header at {at} has {len(values)} fields, version {version} has {len(names)}")
        yield dict(zip(names, values)) | {"block": block, "offset": at}
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, gap, payload = block.partition(b"\r\n\r\n")
    return head + gap, payload


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts) -> str:
    """The same for the same parts, so a task that runs again writes the same file."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A record without its last line feed."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r"


def warc_info(name: str, date: str) -> bytes:
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", name), "WARC-Date": date, "Content-Type": "application/warc-fields"}
    return warc_record(fields, b"format: WARC File Format 1.1\r\n") + b"\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"WARC record at {at} is cut: {len(block)} of {length} bytes")
        yield fields, block
        at = end + 4 + length + 4


def _http_fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ": " in line)


def _write(rows: DataFrame, folder: str, records: int) -> None:
    written = rows.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", records)
    written.option("zlib.compress.level", "TWO").text(folder)  # a quarter of the time of the usual level, a tenth more bytes


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _unpacked(content: bytes) -> bytes:
    """A file's bytes; a gzip file may have several members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def _values(make: Callable[[dict, int], bytes], text: str) -> Callable:
    """mapInArrow: one binary value for each row; make gets the row and its number in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in slices(batches, text):
            found = []
            for row in batch.to_pylist():
                found.append(make(row, number))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["value"])

    return run


def write_arc(pages: DataFrame, folder: str, version: int = 1, date: str = "20000101000000", records: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One ARC record a page. Null html is empty; a null url is "-", blanks and other bytes in it are percent-encoded."""
    def make(row: dict, number: int) -> bytes:
        head = arc_version_block(f"part-{number // records}.arc", version, date) + b"\n" if number % records == 0 else b""
        return head + arc_record(row["_url"], http_block(row["_id"], (row["_html"] or "").encode()), version, date)

    chosen = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    _write(chosen.mapInArrow(_values(make, "_html"), "value binary"), folder, records)


ARC_ROWS = "page_id bigint, url string, date string, content_type string, block binary, payload_bytes bigint, payload_digest string, source string"


def read_arc(spark: SparkSession, folder: str, with_block: bool = True) -> DataFrame:
    """A row for each captured document; block is the zlib-compressed response (null without `with_block`), source its file and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for record in arc_records(_unpacked(content)):
                    if record["URL"].startswith("filedesc:"):
                        continue
                    head, payload = split_http(record["block"])
                    page = _http_fields(head).get("X-Page-Id")
                    rows.append((int(page) if page else None, record["URL"], record["Archive-date"], record["Content-type"], zlib.compress(record["block"], 1) if with_block else None, len(payload), payload_digest(payload), f"{path.rsplit('/', 1)[-1]} {record['offset']}"))
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
                columns = zip(*rows) if rows else [()] * len(types)
                names = [f.split(" ")[0] for f in ARC_ROWS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _files(spark, folder).mapInArrow(run, ARC_ROWS)


def convert_arc(spark: SparkSession, arc: str, warc: str, least: int = 0, records: int = 1000) -> None:
    """ARC files to WARC files. Of captures with equal payloads of at least `least` bytes, that with the smallest page_id is
    a response (rows that repeat that page_id too; captures without one come last), the others are revisits of it.

    The smallest page_id of a digest is aggregated in each task before it is shuffled, and a digest that very many captures
    share is split by Spark's skew join.
    """
    captures = read_arc(spark, arc)
    order = F.coalesce("page_id", F.lit(LAST_ID))
    firsts = read_arc(spark, arc, with_block=False).groupBy("payload_digest").agg(F.min(order).alias("first"))
    joined = captures.join(firsts, "payload_digest").withColumn(
        "first", F.when((F.col("first") < order) & (F.col("payload_bytes") >= least), F.col("first"))
    )

    def make(row: dict, number: int) -> bytes:
        date = warc_date(row["date"])
        info = warc_info(f"part-{number // records}.warc {row['source']}", date) if number % records == 0 else b""
        block = zlib.decompress(row["block"])
        head, payload = split_http(block)
        kind = "revisit" if row["first"] is not None else "response" if head else "resource"
        fields = {
            "WARC-Type": kind, "WARC-Record-ID": record_id(kind, row["source"]), "WARC-Date": date, "WARC-Target-URI": row["url"],
            "WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "Content-Type": "application/http; msgtype=response" if head else row["content_type"],
        }
        if kind == "revisit":
            fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To-Page": str(row["first"])}
            block = head
        fields["WARC-Block-Digest"] = f"sha1:{payload_digest(block)}"
        return info + warc_record(fields, block)

    _write(joined.mapInArrow(_values(make, "block"), "value binary"), warc, records)


WARC_ROWS = "page_id bigint, url string, warc_date string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each record but warcinfo. A revisit's digest and length are those of the full payload; its payload is null.

    Digests of responses are computed from what was read; one that isn't as declared is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1).to_pylist():
                rows = []
                for fields, block in warc_records(_unpacked(content)):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    http, revisit = _http_fields(head), fields["WARC-Type"] == "revisit"
                    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and payload_digest(payload) != declared:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't as declared")
                    refers = int(fields["WARC-Refers-To-Page"]) if revisit else None
                    rows.append((int(http["X-Page-Id"]) if "X-Page-Id" in http else None, fields["WARC-Target-URI"], fields["WARC-Date"], int(http["Content-Length"]) if revisit else len(payload), declared, fields["WARC-Type"], None if refers == LAST_ID else refers, None if revisit or not with_payload else payload))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                columns = zip(*rows) if rows else [()] * len(types)
                names = [f.split(" ")[0] for f in WARC_ROWS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _files(spark, folder).mapInArrow(run, WARC_ROWS)


def archive(pages: DataFrame, version: int = 1, least: int = 0, with_payload: bool = False) -> DataFrame:
    """Pages to ARC files, converted to WARC files, read back. See `write_arc`, `convert_arc`, `read_warc`."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "archives")
    write_arc(pages, f"{folder}/arc", version)
    convert_arc(spark, f"{folder}/arc", f"{folder}/warc", least)
    return read_warc(spark, f"{folder}/warc", with_payload)
