"""WARC archives written by Spark and read back by a salvage reader (operator 10).

Writing. Each row is one record of a WARC/1.1 file. Records are built by SQL
functions and written through Spark's text writer (each record one gzip member, or
plain), so archives go to any store Spark writes to and files of a lost
executor never appear. Equal
payloads (equal SHA-1 *and* SHA-256) are written once, as the response of the
row with the largest id; the others are ``revisit`` records that refer to it.
Only the digests are grouped; a hot payload folds in partial aggregation.

Reading. Archives come as whole files of at most ``records_per_archive``
records; plain files and files of gzip members are told apart by their first
bytes. Every record is checked: version line, header block, Content-Length,
the two line ends behind the block, payload digest. After a failed check the
reader searches for the next valid gzip member or version line from one byte
on, goes on there, and logs the bytes it skipped (file, offset, length, reason).

Defined results. A null payload counts as empty. Of rows that repeat the
largest id and the payload, each is a response. A null id is written without an
id and read back as null; it never wins over an id; where all ids of a payload
are null, each is a response. A null uri is left out. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.session import scratch_path

RECORDS = 2000                  # records per archive
EPOCH = "1970-01-01T00:00:00Z"  # capture time of rows that have none
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
STEP = 1 << 16                  # bytes unpacked at a time
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(sha1_hex: Column) -> Column:
    """Forty hex digits as 32 base32 digits, ten (40 bits) at a time."""
    pieces = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*pieces), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def packed(record: bytes) -> bytes:
    """The record as a gzip member without its last byte. The text writer must end each
    row with a byte of its own: it is this one, always 0. It is the highest of the
    record's length; behind records of 16 MiB or more an empty member ends in a 0."""
    member = gzip.compress(record, 6, mtime=0)
    return (member + gzip.compress(b"", mtime=0) if member[-1] else member)[:-1]


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
          min_bytes: int = 0, records_per_archive: int = RECORDS, compression: str = "gzip") -> None:
    """Write one record per row to archives below ``path``; payloads of fewer
    than ``min_bytes`` bytes are never revisited."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"),
                        F.octet_length(payload).alias("n_bytes"), F.sha1(payload).alias("sha1"),
                        F.sha2(payload, 256).alias("sha256"))
    first = (rows.filter(F.col("n_bytes") >= min_bytes).groupBy("sha1", "sha256")
             .agg(F.max("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    rows = rows.join(first, ["sha1", "sha256"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    crlf = "\r\n"

    def field(name: str, value: Column) -> Column:      # nothing where the value is null
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(crlf)), F.lit(""))

    one_line = F.regexp_replace("uri", r"[\x00-\x1f\x7f]", "")
    head = F.concat(
        F.lit("WARC/1.1" + crlf),
        F.when(revisit, F.lit(f"WARC-Type: revisit{crlf}")).otherwise(F.lit(f"WARC-Type: response{crlf}")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        F.lit(f"WARC-Date: {EPOCH}{crlf}"), field("WARC-Target-URI", one_line), field("X-Row-ID", F.col("id")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        field("X-Payload-Length", F.col("n_bytes")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT}{crlf}"), field("X-Refers-To-Row", F.col("first_id"))))
         .otherwise(F.lit("")),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))), F.lit(crlf))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    value, end = F.concat(head, block, F.lit(crlf)), crlf
    if compression == "gzip":
        pack = F.pandas_udf(lambda records: records.map(packed), BinaryType())
        value, end = pack(F.concat(value, F.lit(crlf)).cast("binary")).cast("string"), "\0"
    (rows.select(value.alias("value")).write.option("lineSep", end)
     .option("maxRecordsPerFile", records_per_archive)
     .option("compression", "none" if compression == "gzip" else compression).text(path))


def _log(gaps: list, name: str, at: int, length: int, why: str) -> None:
    """Note skipped bytes; what follows a gap without a break belongs to it."""
    if gaps and gaps[-1][1] + gaps[-1][2] == at:
        gaps[-1] = (name, gaps[-1][1], gaps[-1][2] + length, gaps[-1][3])
    else:
        gaps.append((name, at, length, why))


def _members(data: bytes, name: str, gaps: list) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, bytes, whole) of every gzip member; of a damaged one, the bytes of the
    steps before that in which the damage shows (what that one gives may be wrong already)."""
    at = 0
    while at < len(data):
        if not data.startswith(GZIP, at):
            nxt = data.find(GZIP, at)
            nxt = len(data) if nxt < 0 else nxt
            _log(gaps, name, at, nxt - at, "no gzip member")
            at = nxt
            continue
        unpack, out, why = zlib.decompressobj(31), [], "gzip member cut short"
        try:
            for k in range(at, len(data), STEP):
                out.append(unpack.decompress(data[k:k + STEP]))
                if unpack.eof:
                    break
        except zlib.error as e:
            why = f"gzip member damaged: {e}"
        yield at, b"".join(out), unpack.eof
        if unpack.eof:
            at = min(k + STEP, len(data)) - len(unpack.unused_data)
        else:
            nxt = data.find(GZIP, at + 1)
            nxt = len(data) if nxt < 0 else nxt
            _log(gaps, name, at, nxt - at, why)
            at = nxt


def _record(data: bytes, at: int) -> tuple[dict, bytes, int] | str:
    """(header, block, end) of a whole valid record at ``at``, or what is wrong."""
    line = VERSION.match(data, at)
    if not line:
        return "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return "header block not ended"
    header = {}
    for raw in data[line.end():stop].split(b"\r\n"):
        key, colon, value = raw.partition(b":")
        if not colon or not key.strip():
            return "header line without a name"
        header[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = header.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return "no Content-Length"
    begin, end = stop + 4, stop + 4 + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        return "block and Content-Length disagree"
    block, digest = data[begin:end], header.get("warc-payload-digest", "")
    if header.get("warc-type") == "response" and digest.startswith("sha1:") and \
            base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:]:
        return "payload digest disagrees"
    return header, block, end + 4


def salvage(data: bytes, name: str) -> tuple[list[tuple[int, dict, bytes]], list[tuple[str, int, int, str]]]:
    """All valid records of an archive as (offset, header, block), and the gaps
    as (file, offset, length, reason). Offsets of records in a gzip member are
    the member's; of a damaged member the records before the damage are kept."""
    records, gaps = [], []
    packed = data.startswith(GZIP)
    for base, plain, whole in _members(data, name, gaps) if packed else [(0, data, True)]:
        at = 0
        while at < len(plain):
            got = _record(plain, at)
            if isinstance(got, str):
                nxt = VERSION.search(plain, at + 1)
                nxt = nxt.start() if nxt else len(plain)
                if not packed:
                    _log(gaps, name, at, nxt - at, got)
                elif whole:
                    gaps.append((name, base, nxt - at, f"inside the member, at {at}: {got}"))
                at = nxt
            else:
                records.append((base + (0 if packed else at), got[0], got[1]))
                at = got[2]
    return records, gaps


SCHEMA = ("file string, offset long, length long, gap string, row_id string, uri string, record_type string, "
          "refers_to string, payload_digest string, payload_bytes long, payload binary")


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, and a row with ``gap`` set
    for every range of bytes that could not be read."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                records, gaps = salvage(bytes(data), name)
                out = [(name, at, None, None, h.get("x-row-id"), h.get("warc-target-uri"), h.get("warc-type"),
                        h.get("x-refers-to-row"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        int(h.get("x-payload-length", len(block))), block if payloads else None)
                       for at, h, block in records]
                out += [(f, at, n, why, *[None] * 7) for f, at, n, why in gaps]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(rows, SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", **how) -> DataFrame:
    """Write the archives to the shared folder and read every record back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, id_col=id_col, **how)
    kind = pages.schema[id_col].dataType
    return read(pages.sparkSession, path, payloads=False).filter("gap is null").select(
        F.col("row_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
