"""WARC archives: writing pages with revisit records, and a reader that salvages what follows damage.

Writing is one text file per task, whose line ends are the blank lines that end a record; Spark's writer commits whole files only.
Of pages with equal payloads, by digest and length, the one with the largest id is a response; the others are revisits that name it.
Reading checks each record: version line, headers, length, the blank lines after its block, the digest of a response's payload. After
a failed check, the reader goes on at the record's own end if another record or the archive's end is there, so that records quoted in
a damaged payload aren't taken for real ones; else it looks for the next version line (in gzip archives: the next member that opens
with one). The bytes between are told as a gap with the reason. Archive files are read whole, so that RECORDS bounds them.

Null html is an empty payload, and empty payloads are equal too. A null url has no target header. A null id counts as smaller than
any other. Rows that repeat the largest id of a payload are all responses. Very long pages are records like others. Other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import fresh_path, written

#: Records of an archive file, at most.
RECORDS = 2_000
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
#: Bytes of a member that are inflated at a time.
PART = 1 << 20
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
READ = "kind string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap_start long, gap_bytes long, reason string"


def base32_sha1(payload: Column) -> Column:
    """Five hexadecimal digits of the digest are four digits to the base 32, in another alphabet."""
    h = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Payloads of fewer than ``least`` bytes are never revisits."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    same = rows.select("page_id", "digest", "bytes").filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    same = written(same.filter("n > 1").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first"), "same")
    rows = rows.join(same, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    # line ends can't stand in a header
    url = F.regexp_replace("url", r"[\r\n]+", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">\r\nWARC-Date: " + DATE),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path)


def headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def record(data: bytes, at: int) -> tuple[dict | str, int | None]:
    """The record that begins at a place and where it ends, or why there is none, and its end if that can still be told."""
    version = VERSION.match(data, at)
    if not version:
        return "no version line", None
    stop = data.find(b"\r\n\r\n", version.end() - 2)
    if stop < 0:
        return "headers don't end", None
    h = headers(data[version.end() : stop])
    length = h.get("content-length", "")
    if not length.isdigit():
        return "no length", None
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "the block doesn't end where its length says", None
    block = data[stop + 4 : end]
    cut = block.find(b"\r\n\r\n")
    payload = block[cut + 4 :] if h.get("content-type", "").startswith("application/http") and cut >= 0 else block
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h.get("warc-type") == "response" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        return "the payload has another digest", end + 4 if end + 4 == len(data) or VERSION.match(data, end + 4) else None
    return {"h": h, "payload": payload, "digest": digest}, end + 4


def salvage(data: bytes, at: int = 0) -> Iterator[tuple[str, object]]:
    """('record', ...) of each whole record and ('gap', (start, bytes, reason)) of what lies between."""
    while at < len(data):
        got, end = record(data, at)
        if isinstance(got, str):
            if end is None:
                later = VERSION.search(data, at + 1)
                end = later.start() if later else len(data)
            yield "gap", (at, end - at, got)
        else:
            yield "record", got
        at = end


def members(data: bytes) -> Iterator[tuple[str, object]]:
    """The same for an archive of gzip members, each of one or more records."""
    at, whole = 0, memoryview(data)
    while at < len(data):
        inflate, parts, end = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof and end < len(data):
                parts.append(inflate.decompress(whole[end : end + PART]))
                end = min(end + PART, len(data))
            text = b"".join(parts)
            if inflate.eof and VERSION.match(text):
                yield from salvage(text)
                at = end - len(inflate.unused_data)
                continue
            reason = "the member doesn't end" if not inflate.eof else "no version line"
        except zlib.error as e:
            reason = str(e)
        later = data.find(MEMBER, at + 1)
        while later >= 0 and not opens(data, later):
            later = data.find(MEMBER, later + 1)
        end = later if later >= 0 else len(data)
        yield "gap", (at, end - at, reason)
        at = end


def opens(data: bytes, at: int) -> bool:
    """Whether a member at a place opens with a version line."""
    try:
        return bool(VERSION.match(zlib.decompressobj(31).decompress(data[at : at + 4096], 16)))
    except zlib.error:
        return False


def page_number(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records (kind 'record') and gaps (kind 'gap') of all archive files below a path; payloads themselves only if asked."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = []
                for kind, x in members(data) if data[:2] == MEMBER[:2] else salvage(data):
                    if kind == "gap":
                        rows.append(("gap", None, None, None, None, None, None, None, *x))
                        continue
                    h, n = x["h"], x["h"].get("x-payload-length", "")
                    rows.append(
                        ("record", page_number(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), page_number(h.get("warc-refers-to")), int(n) if n.isdigit() else len(x["payload"]), x["digest"] or None, x["payload"] if payloads else None, None, None, None)
                    )
                if rows:
                    out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in READ.split(", ")], dtype=object)
                    yield out.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes", "gap_start", "gap_bytes")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads these back."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
