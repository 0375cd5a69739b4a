"""WARC archives: a writer made of DataFrame functions and a salvage reader.

Writing. Each page becomes one record; Spark's text writer lays the records down, with the blank lines
that end a record as its line separator, so Spark's own commit protocol covers lost tasks. Records whose
payload repeats an earlier one of ``revisit_bytes`` or more are ``revisit`` records without a block.

Reading. Archives come in as binary files. The reader walks from record to record by Content-Length and
checks version line, header fields, length, end of record and payload digest. After a failed check it
searches for the next version line (``WARC/1.1``), or in gzip archives for the next member, goes on from
there and logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telluric.llm.shared import folder, saved

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
HEADER = re.compile(rb"WARC/1\.1\r\n(?:[!#$%&'*+.^_`|~0-9A-Za-z-]+:[^\r\n]*\r\n(?:[ \t][^\r\n]*\r\n)*)*")
ONCE = (b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length")
USUAL_HEADER = 1 << 16
CHUNK = 1 << 14

READ_SCHEMA = (
    "archive string, begin long, end long, gap string, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_digest string, payload_bytes long, payload binary"
)


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 100) -> DataFrame:
    """(record string): each page's record without the closing blank lines.

    Null html counts as empty, a null url or id is left out of the header. Of equal payloads of at least
    revisit_bytes the one with the smallest id is the response (ids null: after all others); the rest refer
    to it. Smaller payloads are responses each. Rows that repeat id and payload of the response are responses too.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.col(url_col), "[\r\n]", "").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "bytes": F.octet_length("html").cast("long")})
    first = rows.where(F.col("bytes") >= revisit_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # as a table its size is known, so Spark broadcasts it if it is under its threshold and doesn't shuffle the pages then
    first = saved(first.where("copies > 1 AND first IS NOT NULL").drop("copies"), f"{folder(pages.sparkSession)}/first")
    known = rows.join(first, F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    header = F.concat(
        F.lit(VERSION.decode()),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    return known.select(header.alias("record"))


def write_warc(pages: DataFrame, path: str, *, archive_bytes: int = 32 << 20, **columns) -> None:
    """Write pages as uncompressed archives (text parts of Spark's writer) below path, of archive_bytes at most by the mean page, 8 times that by the longest.

    A longer page has an archive of its own. Archives are read whole by one task each, so none may exceed Spark's limit for a value, 2 GB.
    """
    size = F.octet_length(columns.get("html_col", "html"))
    n = pages.select(F.avg(size).alias("mean"), F.max(size).alias("most")).first()
    most = max(1, int(min(archive_bytes / max(600, n["mean"] or 0), 8 * archive_bytes / max(600, n["most"] or 0))))
    made = records(pages, **columns).select("record")
    made.write.option("lineSep", END.decode()).option("maxRecordsPerFile", most).text(path)


def _field(header: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":(.*)\r$", header)
    return found[1].strip(b" \t").decode("utf-8", "replace") if found else None


def _parse(data: bytes, at: int) -> tuple[int, dict] | str:
    """The record at a position as (its end, fields), or what is wrong with it."""
    if not data.startswith(VERSION, at):
        return "no version line"
    head = data.find(END, at, at + USUAL_HEADER)
    if head < 0:
        # long fields: no header goes on beyond the next version line
        stop = data.find(b"\r\n" + VERSION, at)
        head = data.find(END, at, len(data) if stop < 0 else stop + 2)
    if head < 0:
        return "no end of header"
    header = data[at : head + 2]
    if not HEADER.fullmatch(header) or any(len(re.findall(rb"(?im)^" + n + rb":", header)) > 1 for n in ONCE):
        return "broken header"  # such as the start of one record and the rest of another
    length = _field(header, b"Content-Length")
    if not length or not length.isdigit():
        return "no Content-Length"
    begin, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != END:
        return "no end of record" if end <= len(data) else "truncated"
    payload, kind = data[begin:end], _field(header, b"WARC-Type")
    digest = (_field(header, b"WARC-Payload-Digest") or "").removeprefix("sha256:") or None
    if kind == "response" and digest and hashlib.sha256(payload).hexdigest() != digest:
        return "wrong digest"
    full = _field(header, b"X-Payload-Length")
    return end + 4, {
        "record_type": kind,
        "record_id": _field(header, b"WARC-Record-ID"),
        "refers_to": _field(header, b"WARC-Refers-To"),
        "target_uri": _field(header, b"WARC-Target-URI"),
        "payload_digest": digest or hashlib.sha256(payload).hexdigest(),
        "payload_bytes": int(full) if kind == "revisit" and full and full.isdigit() else len(payload),
        "payload": payload,
    }


def walk(data: bytes) -> Iterator[tuple[int, int, str | None, dict]]:
    """(begin, end, gap, fields) of each record and each quarantined gap of an uncompressed archive."""
    at = 0
    while at < len(data):
        found = _parse(data, at)
        if not isinstance(found, str):
            yield at, found[0], None, found[1]
            at = found[0]
            continue
        # the next version line; one inside a payload of a sound record was never looked at
        nxt = data.find(VERSION, at + 1)
        while nxt >= 0 and isinstance(_parse(data, nxt), str):
            nxt = data.find(VERSION, nxt + 1)
        nxt = len(data) if nxt < 0 else nxt
        yield at, nxt, found, {}
        at = nxt


def members(data: bytes) -> Iterator[tuple[int, int, str | None, bytes]]:
    """(begin, end, gap, content) of each gzip member; broken stretches are gaps that end at the next sound member."""
    at = 0
    while at < len(data):
        one, fed, parts, why = zlib.decompressobj(wbits=31), at, [], None
        try:
            while not one.eof and fed < len(data):
                parts.append(one.decompress(data[fed : fed + CHUNK]))
                fed = min(len(data), fed + CHUNK)
            why = None if one.eof else "truncated member"
        except zlib.error as x:
            why = f"broken member: {x}"
        if why is None:
            end = fed - len(one.unused_data)
            yield at, end, None, b"".join(parts)
        else:
            end = data.find(MEMBER, at + 1)
            end = len(data) if end < 0 else end
            yield at, end, why, b""
        at = end


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict]]:
    """Records and gaps of an archive, gzip or not; positions are those of the file. Adjoining gaps of members become one."""
    if not data.startswith(MEMBER):
        yield from walk(data)
        return
    gap = None
    for begin, end, why, content in members(data):
        if why:
            gap = (gap[0], end, gap[2]) if gap else (begin, end, why)
            continue
        if gap:
            yield *gap, {}
            gap = None
        for _, _, inner, fields in walk(content):
            yield begin, end, inner, fields
    if gap:
        yield *gap, {}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "begin", "end", "gap", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            rows, size = [], 0
            for begin, end, gap, fields in salvage(content.as_py()):
                rows.append({"archive": path, "begin": begin, "end": end, "gap": gap} | fields)
                size += len(fields.get("payload", b"")) + 500
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record and every quarantined gap (gap says why; its record columns are null) of the archives below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_read, READ_SCHEMA)


def compressed(record: bytes) -> bytes:
    """A record as a gzip member of its own, as .warc.gz archives have it."""
    return gzip.compress(record + END, mtime=0)
