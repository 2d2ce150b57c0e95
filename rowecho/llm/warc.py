"""Web archives: pages to legacy ARC files, ARC to WARC, and WARC read back.

The converter reads an ARC file record by record: the version block names the fields of the
header lines (five in version 1, ten in version 2), and a record is as long as its line declares.
Each becomes a WARC record with an identifier, a date, a type and digests made from it; of equal
payloads one record is a response and the others are revisits that name it. Files are written by
Spark's text writer, whose line end is the record end, and read as whole files of bounded size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowecho.llm.common import bounded_batches, cut, new_path, table, text_or_empty

FILE_BYTES = 16 << 20  # about, of an archive before compression
LARGEST_FILE = 512 << 20  # at most, unless one page is larger
CRAWLED, ADDRESS = "20200101000000", "0.0.0.0"  # pages tell neither
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# fixed values: the header lines of both versions
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CONVERTED = ("page_id bigint, url string, date string, record_id string, payload_bytes bigint, "
             "payload_digest string, head binary, payload binary")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_response(page_id: int | None, html: bytes) -> bytes:
    """What a crawler would have stored; the page's id travels as a header."""
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n"
            f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n").encode() + html


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 rowecho\n{ARC_FIELDS[version]}\n".encode()
    middle = {1: "", 2: "200 - - 0 " + name + " "}[version]
    return f"filedesc://{name} {ADDRESS} {CRAWLED} text/plain {middle}{len(body)}\n".encode() + body


def arc_record(version: int, name: str, url: str | None, block: bytes) -> bytes:
    """A record without the line end that follows it."""
    safe = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url or "") or "-"
    middle = {1: "", 2: f"200 {digest(block)} - 0 {name} "}[version]
    return f"{safe} {ADDRESS} {CRAWLED} text/html {middle}{len(block)}\n".encode() + block


def read_arc(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of an ARC file, without its version block."""
    names: list[str] | None = None
    while line := file.readline():
        line = line.rstrip(b"\r\n")
        if not line:  # the line end after a record
            continue
        length = int(line.rsplit(b" ", 1)[1])
        block = file.read(length)
        if len(block) != length:
            raise ValueError(f"an ARC record declares {length} bytes and has {len(block)}")
        if names is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError("an ARC file starts with its version block")
            first, second = block.decode("latin-1").splitlines()[:2]
            version = int(first.split()[0])
            names = second.split()
            if names != ARC_FIELDS.get(version, "").split():
                raise ValueError(f"unknown ARC header of version {version}: {second}")
            continue
        # a URL may hold blanks, the other fields do not
        yield dict(zip(names, line.decode("utf-8", "replace").rsplit(" ", len(names) - 1))), block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with the empty line that ends it) and payload of an HTTP response; a block of
    another protocol is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, end, payload = block.partition(b"\r\n\r\n")
    return head + end, payload


def header_of(head: bytes, name: str) -> str | None:
    found = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)[ \t]*\r?$", head.decode("latin-1"))
    return found.group(1) if found else None


def warc_date(arc_date: str) -> str:
    """ISO date of the digits of an ARC date; what is cut off counts as the earliest."""
    digits = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(re.sub(r"\D", "", arc_date)):])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def read_warc(file) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        fields = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = file.read(length)
        if len(block) != length:
            raise ValueError(f"a WARC record declares {length} bytes and has {len(block)}")
        yield fields, block


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` bytes of their binary columns."""
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size >= most or len(held) >= 5_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


_RECORD = pa.schema([("value", pa.binary())])


def _write(records: DataFrame, path: str, per_file: int, end: str) -> None:
    """Records in gzip files of ``per_file`` records each."""
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end).option(
        "compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option(
        "maxRecordsPerFile", per_file).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def records_per_file(pages: DataFrame, html_column: str) -> int:
    size = pages.select(F.octet_length(text_or_empty(html_column)).alias("n")).agg(
        F.avg("n").alias("mean"), F.max("n").alias("most")).head()
    return int(max(2, min(FILE_BYTES // ((size["mean"] or 0) + 500), LARGEST_FILE // ((size["most"] or 0) + 500))))


def write_arc(pages: DataFrame, path: str, per_file: int, id_column: str = "page_id", url_column: str = "url",
              html_column: str = "html") -> None:
    """ARC files of the pages, of version 1 and 2 in turn by task."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.spark_partition_id().alias("task"), F.col(id_column).cast("bigint"),
                        F.col(url_column).cast("string"), text_or_empty(html_column).cast("binary"))

    def run(batches):
        def records():
            n = 0
            for batch in batches:
                for task, page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    version, name = 1 + task % 2, f"pages-{task}-{n // per_file}"
                    if n % per_file == 0:  # the writer starts a file here
                        n += 1
                        yield (arc_version_block(version, name),)
                    n += 1
                    yield (arc_record(version, name, url, http_response(page_id, html)),)

        return _batched(records(), _RECORD)

    _write(rows.mapInArrow(run, "value binary"), path, per_file, "\n")


def convert(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files as WARC fields. The payload is kept deflated."""
    bounded_batches(spark)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "head": pa.binary(), "payload": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.string())) for c in CONVERTED.split(", ")])

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                for fields, block in read_arc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    head, payload = split_http(block)
                    page_id, own = _number(header_of(head, "X-Page-Id")), digest(payload)
                    url, date = fields["URL"], warc_date(fields["Archive-date"])
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {date} {own}")
                    yield (page_id, url, date, f"<urn:uuid:{name}>", len(payload), own, head, zlib.compress(payload, 1))

    return _files(spark, path).mapInArrow(lambda batches: _batched(records(batches), schema), CONVERTED)


def with_revisits(converted: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Each record with ``to``, the record it revisits: the one with the largest page_id among
    equal payloads of at least ``least_bytes``; null for responses. Records that repeat that page_id are
    responses as well; a null page_id counts as the smallest."""
    largest = cut(converted.filter(F.col("payload_bytes") >= least_bytes).groupBy(
        "payload_digest", "payload_bytes").agg(
        F.max(F.struct("page_id", "record_id", "url", "date")).alias("to"),
        F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "largest")
    joined = converted.join(largest, ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("to", F.when(~F.col("page_id").eqNullSafe(F.col("to.page_id")), F.col("to")))


def write_warc(records: DataFrame, path: str, per_file: int) -> None:
    """WARC files of the records of ``with_revisits``."""
    bounded_batches(records.sparkSession)
    rows = records.select("page_id", "url", "date", "record_id", "payload_bytes", "payload_digest", "head",
                          F.when(F.col("to").isNull(), F.col("payload")).alias("payload"), "to")

    def run(batches):
        def out():
            n = 0
            for batch in batches:
                for row in batch.to_pylist():
                    if n % per_file == 0:
                        n += 1
                        info = b"software: rowecho\r\nformat: WARC File Format 1.1\r\n"
                        name = uuid.uuid5(uuid.NAMESPACE_URL, f"info {row['record_id']}")
                        yield (warc_record([
                            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"),
                            ("WARC-Date", row["date"]), ("Content-Type", "application/warc-fields")], info),)
                    n += 1
                    to = row["to"]
                    block = row["head"] + (b"" if to else zlib.decompress(row["payload"]))
                    http = row["head"] != b""
                    fields = [
                        ("WARC-Type", "revisit" if to else "response" if http else "resource"),
                        ("WARC-Record-ID", row["record_id"]),
                        ("WARC-Date", row["date"]), ("WARC-Target-URI", row["url"]),
                        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
                        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                        ("Content-Type", "application/http; msgtype=response" if http else "text/html")]
                    if to:
                        fields += [
                            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", to["record_id"]),
                            ("WARC-Refers-To-Target-URI", to["url"]), ("WARC-Refers-To-Date", to["date"]),
                            ("X-Refers-To-Page-Id", "" if to["page_id"] is None else str(to["page_id"]))]
                    yield (warc_record(fields, block),)

        return _batched(out(), _RECORD)

    _write(rows.mapInArrow(run, "value binary"), path, per_file, RECORD_END)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records of WARC files,
    the digest of a response checked on its payload."""
    bounded_batches(spark)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                for fields, block in read_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    declared = fields["warc-payload-digest"].removeprefix("sha1:")
                    if f"sha1:{digest(block)}" != fields["warc-block-digest"]:
                        raise ValueError(f"block digest of {fields['warc-record-id']}")
                    page_id, size = _number(header_of(head, "X-Page-Id")), len(payload)
                    if fields["warc-type"] == "revisit":
                        size = int(header_of(head, "Content-Length"))
                    elif digest(payload) != declared:
                        raise ValueError(f"payload digest of {fields['warc-record-id']}")
                    yield (page_id, size, declared, fields["warc-type"], _number(fields.get("x-refers-to-page-id")))

    return _files(spark, path).mapInArrow(
        lambda batches: _batched(records(batches), schema),
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, least_bytes: int = 0, **columns) -> DataFrame:
    """Pages through ARC and WARC files in the shared folder; a row per page as in ``read_back``.

    A null html is an empty payload, a null url is written as ``-``; an empty table gives no files
    and an empty result. Columns other than the three are not read."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    per_file = records_per_file(pages, columns.get("html_column", "html"))
    write_arc(pages, arc, per_file, **columns)
    write_warc(with_revisits(convert(spark, arc), least_bytes), warc, per_file)
    return read_back(spark, warc)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS last,
        array_to_string(list_transform(range(0, 8), lambda i: list_transform([('0x' || hex[i * 5 + 1:i * 5 + 5])::BIGINT],
          lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v >> 15) + 1] ||
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 10) & 31) + 1] ||
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 5) & 31) + 1] ||
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v & 31) + 1])[1]), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM b
"""
