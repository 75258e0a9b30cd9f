"""Legacy archive converter: ARC files in, equivalent WARC records out.

An ARC file starts with a version block; its second line gives the version and with it the fields
of the URL record lines (5 in version 1, 10 in version 2). Records follow one another by their
declared lengths. The converter synthesises what WARC has and ARC lacks: record ids, ISO dates,
types, payload and block digests, and revisit records for payloads seen before.

Files are read whole, one at a time, by Spark's binary reader; the writers here keep them to
about ``FILE_BYTES`` before compression. Spark's text writer carries the archives, gzipped as
usual, so any file system will do.

Defined results: a null page is an empty payload; a null URL is ``unknown:``; a record cut short
by the end of its file is kept and marked ``truncated``; a record that starts with an HTTP header
is a response if that header names a page, whatever its URL, or if its URL is of HTTP or of no
scheme; a header line that can't be read is an error that names the file; of equal payloads the smallest page is the response (pages without a
number come last), also among repeated rows; an empty table gives an empty archive and table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.bloom import blocks_for, flagged, present_filter
from offerloom.llm.common import attach_groups, stored
from offerloom.session import shared_folder

FILE_BYTES = 16_000_000
CAPTURED = "20240101000000"
# The fields of an ARC record line by version, and the profile of a WARC revisit.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length".split(),
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
REVISIT_PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = b"X-Page-Id:"
SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")

ARC_ROW = "file string, offset long, url string, archived string, mime string, status string, block binary, truncated boolean"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def records_per_file(rows: DataFrame, size: Column) -> int:
    """How many records of average size make a file of ``FILE_BYTES``."""
    mean = rows.select(F.avg(size)).first()[0]
    return max(2, int(FILE_BYTES // (mean or FILE_BYTES)))


def _unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


# ARC


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Pages as HTTP responses in ARC files, by turns of version 1 and version 2."""
    chosen = pages.select(pages[id_col].cast("string"), F.coalesce(pages[url], F.lit("unknown:")), F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8"))
    most = records_per_file(pages, F.coalesce(F.octet_length(pages[html]), F.lit(0)) + 200)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        version = "2" if number % 2 else "1"
        about = f"{version} 0 Converter\n{' '.join(ARC_FIELDS[version])}\n".encode()
        given = {"URL": f"filedesc://{number}.arc", "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/plain"}
        first = " ".join([given.get(f, "-") for f in ARC_FIELDS[version][:-1]] + [str(len(about))]).encode() + b"\n" + about
        written = 0
        for batch in batches:
            out = []
            for page, address, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                if written % most == 0:  # Spark begins a new file here
                    out.append(first)
                    written += 1
                written += 1
                payload = body.as_py()
                page_line = PAGE_HEADER + b" " + (page.as_py() or "").encode() + b"\r\n"
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + page_line + b"\r\n" + payload
                given = {
                    "URL": quote(address.as_py(), safe="!#$%&'()*+,/:;=?@[]~"), "IP-address": "192.0.2.1", "Archive-date": CAPTURED,
                    "Content-type": "text/html", "Result-code": "200", "Filename": f"{number}.arc",
                }
                out.append(" ".join([given.get(f, "-") for f in ARC_FIELDS[version][:-1]] + [str(len(block))]).encode() + b"\n" + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = chosen.mapInArrow(records, "record binary").select(F.col("record").cast("string"))
    lines.write.options(lineSep="\n", compression="gzip", maxRecordsPerFile=most).text(path)


def parse_arc(data: bytes, name: str) -> Iterator[tuple]:
    """Rows of ``ARC_ROW`` for the records after the version block."""
    fields, at = None, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        body = stop + 1 if stop >= 0 else len(data)
        values = line.rsplit(" ", len(fields or ARC_FIELDS["1"]) - 1)
        if fields is None and line.startswith("filedesc://"):
            values = line.split(" ")
        if not values[-1].isdigit() or len(values) != len(fields or values):
            raise ValueError(f"{name}: no record line at byte {at}: {line[:80]!r}")
        length = int(values[-1])
        block = data[body : body + length]
        if fields is None:
            version = block.split(b" ", 1)[0].decode("ascii", "replace")
            if not line.startswith("filedesc://") or version not in ARC_FIELDS:
                raise ValueError(f"{name}: no version block")
            fields = ARC_FIELDS[version]
        else:
            row = dict(zip(fields, values, strict=True))
            yield name, at, row["URL"], row["Archive-date"], row["Content-type"], row.get("Result-code"), block, len(block) < length
        at = body + length


def _read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes of the rows' binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size > limit or len(held) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    schema = pa.schema([
        ("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("archived", pa.string()), ("mime", pa.string()),
        ("status", pa.string()), ("block", pa.binary()), ("truncated", pa.bool_()),
    ])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches(parse_arc(_unpacked(data.as_py()), name.as_py().rsplit("/", 1)[-1]), schema)

    return _read_files(spark, path).mapInArrow(parse, ARC_ROW)


# WARC


def _page_of(head: bytes) -> tuple[bool, int | None]:
    """Whether an HTTP header names a page, and its number; a page without one has an empty value."""
    value = next((x[len(PAGE_HEADER) :].strip() for x in head.split(b"\r\n") if x.startswith(PAGE_HEADER)), None)
    return value is not None, int(value) if value and value.removeprefix(b"-").isdigit() else None


def _http_header(url: str, block: bytes) -> bytes:
    """The HTTP header of a record that is a response, else nothing."""
    end = block.find(b"\r\n\r\n") + 4
    if end < 4 or not block.startswith(b"HTTP/"):
        return b""
    scheme = SCHEME.match(url)
    return block[:end] if _page_of(block[:end])[0] or scheme is None or scheme[1].lower() in ("http", "https", "unknown") else b""


def synthesise(arc: DataFrame) -> DataFrame:
    """ARC records with what a WARC record needs: id, date, kind, digests and the length of the HTTP header (0: none)."""
    schema = pa.schema([
        ("record_id", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("mime", pa.string()), ("header_bytes", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("page", pa.int64()), ("truncated", pa.bool_()), ("block", pa.binary()),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                block, head = r["block"], _http_header(r["url"], r["block"])
                payload = block[len(head) :]
                day = (r["archived"] + "0101000000"[len(r["archived"]) - 4 :] if len(r["archived"]) < 14 else r["archived"])[:14]
                date = f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z"
                whole = sha1_base32(block)
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{r['file']}:{r['offset']} {r['url']} {whole}")
                page = _page_of(head)[1]
                mime = "application/http; msgtype=response" if head else r["mime"]
                yield f"urn:uuid:{name}", date, "response" if head else "resource", r["url"], mime, len(head), len(payload), sha1_base32(payload), whole, page, r["truncated"], block

    return arc.mapInArrow(
        lambda batches: _batches(rows(batches), schema),
        "record_id string, date string, kind string, url string, mime string, header_bytes long, payload_bytes long, "
        "payload_digest string, block_digest string, page long, truncated boolean, block binary",
    )


def with_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` (stored) with ``original``: id, date and url of the response that an equal payload of at least
    ``min_bytes`` refers to, null for that response itself."""
    order = F.struct(F.col("page").isNull().alias("a"), F.col("page").alias("b"), F.col("record_id").alias("c"))
    first = F.min_by(F.struct("record_id", "date", "url"), order).alias("original")
    same = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes) & ~F.col("truncated")).select("record_id", "payload_digest", "page", "date", "url")
    groups = stored(same.groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1"), "warc-groups")
    met = attach_groups(same.select("record_id", "payload_digest"), groups, "payload_digest", "n", same.count())
    revisits = stored(met.where("record_id <> original.record_id").select("record_id", "original", F.xxhash64("record_id").alias("r")), "warc-revisits")
    # Only records that may be revisits are shuffled with their blocks.
    blocks = blocks_for(revisits.count())
    probed = flagged(records.withColumn("r", F.xxhash64("record_id")), "r", present_filter(revisits, "r", blocks), blocks).drop("r")
    none = F.lit(None).cast(revisits.schema["original"].dataType)
    alone = probed.where("not __maybe").withColumn("original", none)
    return alone.unionByName(probed.where("__maybe").join(revisits.drop("r"), "record_id", "left")).drop("__maybe")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(records: DataFrame, path: str, most: int) -> None:
    """Records with ``original`` as WARC files of at most ``most`` records; a revisit keeps its HTTP header only."""
    again = F.col("original").isNotNull()
    block = F.when(again, F.substring("block", F.lit(1), F.col("header_bytes").cast("int"))).otherwise(F.col("block"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(again, "revisit").otherwise(F.col("kind"))), _line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        _line("WARC-Date", F.col("date")), _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Block-Digest", F.when(~again, F.concat(F.lit("sha1:"), "block_digest"))), _line("WARC-Truncated", F.when(F.col("truncated"), "length")),
        _line("WARC-Profile", F.when(again, REVISIT_PROFILE)), _line("WARC-Refers-To", F.concat(F.lit("<"), "original.record_id", F.lit(">"))),
        _line("WARC-Refers-To-Target-URI", F.col("original.url")), _line("WARC-Refers-To-Date", F.col("original.date")),
        _line("Content-Type", F.col("mime")), _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    record = F.concat(F.encode(head, "UTF-8"), block, F.encode(F.lit("\r\n"), "UTF-8"))
    records.select(record.cast("string").alias("record")).write.options(lineSep="\r\n", compression="gzip", maxRecordsPerFile=most).text(path)


def parse_warc(data: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        length = int(head["Content-Length"])
        yield head, data[stop + 4 : stop + 4 + length]
        at = stop + 4 + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; the digest of a response is computed from its block, that of a revisit is the declared one."""
    schema = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("refers_to_id", pa.string()),
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ])

    def row(head: dict[str, str], block: bytes) -> tuple:
        http = head["Content-Type"].startswith("application/http")
        end = block.find(b"\r\n\r\n") + 4 if http else 0
        page = _page_of(block[:end])[1]
        revisit = head["WARC-Type"] == "revisit"
        declared = head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        found = declared if revisit else sha1_base32(block[end:])
        if found != declared:
            raise ValueError(f"{head['WARC-Record-ID']}: the payload is not what was written")
        return (
            head["WARC-Record-ID"].strip("<>"), head["WARC-Type"], head["WARC-Target-URI"], head["WARC-Date"], head.get("WARC-Refers-To", "").strip("<>") or None,
            page, None if revisit else len(block) - end, found,
        )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches((row(*r) for r in parse_warc(_unpacked(data.as_py()), name.as_py())), schema)

    return _read_files(spark, path).mapInArrow(
        parse, "record_id string, record_type string, url string, date string, refers_to_id string, page_id long, payload_bytes long, payload_digest string"
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    records = stored(synthesise(read_arc(spark, arc_path)), "warc-records")
    write_warc(with_revisits(records, min_bytes), warc_path, records_per_file(records, F.octet_length("block") + 700))


def page_archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages to ARC files, those to WARC files, and these read back: one row per page."""
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, min_bytes)
    read = stored(read_warc(spark, warc), "warc-index")
    # Each response is one row here, so that the join only has many rows on the side of the revisits.
    target = read.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    again = read.where("record_type = 'revisit'").drop("payload_bytes").join(target, "refers_to_id").withColumnRenamed("full_bytes", "payload_bytes")
    alone = read.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return alone.unionByName(again)
