"""Legacy ARC archives, converted to WARC.

An ARC file begins with a ``filedesc`` record that names its version; each
record is one header line of version-specific fields, whose last field is the
declared length, and that many bytes.  The converter parses the fields from
the right (URLs may hold spaces), reads exactly the declared bytes, and
synthesises what WARC asks for: a record id derived from the content, a W3C
timestamp from the 14-digit date, the type, and SHA-1 digests in base 32.

Archives are written by Spark's own writer, so any shared store will do: a
WARC record ends with CR LF CR LF, which is the writer's line separator, and
a row is one archive of about ``archive_bytes`` (one file), gzip-compressed.

Defined cases: a null html is an empty payload; equal payloads of at least
``least_bytes`` bytes are stored once, by the smallest page_id, other rows
are revisits of it (rows that repeat it entirely are responses too); a null
page_id is always a response and never referred to by a page that has one; a
null url becomes ``urn:page:<page_id>``; an empty table gives an empty result
and no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.text import as_longs, as_text
from netloom.storage import new_path, stored

#: The field names of both ARC versions, in order.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = "\r\n\r\n"
READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes

    @property
    def url(self) -> str:
        return self.fields["URL"]


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_url(url: str) -> str:
    """A URL as its ARC header line holds it."""
    return re.sub(r"[\r\n]+", " ", url) or "-"


def arc_line(version: int, **values: str) -> bytes:
    names = FIELDS[version].split()
    clean = [arc_url(values.get(n, "-")) if n == "URL" else re.sub(r"\s+", "-", values.get(n.replace("-", "_"), "-")) or "-" for n in names]
    return (" ".join(clean) + "\n").encode()


def arc_start(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 netloom\n{FIELDS[version]}\n\n".encode()
    return arc_line(version, URL=f"filedesc://{name}", IP_address="0.0.0.0", Archive_date=date, Content_type="text/plain", Archive_length=str(len(body))) + body


def arc_record(version: int, url: str, date: str, block: bytes, mime: str = "text/html", **values: str) -> bytes:
    return arc_line(version, URL=url, IP_address="0.0.0.0", Archive_date=date, Content_type=mime, Archive_length=str(len(block)), **values) + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its filedesc record first."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC header line without an end")
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        if not version:
            first = data[end + 1 : data.find(b"\n", end + 1)].split()
            version = int(first[0]) if first and first[0] in (b"1", b"2") else 0
            if not line.startswith("filedesc:") or not version:
                raise ValueError("not an ARC file of version 1 or 2")
        names = FIELDS[version].split()
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"ARC header line with fields missing: {line[:200]!r}")
        n = int(values[-1])
        block = data[end + 1 : end + 1 + n]
        if len(block) != n:
            raise ValueError("ARC record shorter than its declared length")
        yield ArcRecord(version, dict(zip(names, values, strict=True)), block)
        at = end + 1 + n


def warc_date(date: str) -> str:
    """ISO time of an ARC date; dates cut short begin their period."""
    digits = re.sub(r"\D", "", date)[:14]
    whole = digits + "00000101000000"[len(digits) :] if len(digits) >= 4 else "19700101000000"
    try:
        return datetime.strptime(whole, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header (with its empty line) and payload of an HTTP response block."""
    if block.startswith(b"HTTP/"):
        at = block.find(b"\r\n\r\n")
        if at >= 0:
            return block[: at + 4], block[at + 4 :]
    return b"", block


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record without its final CR LF CR LF."""
    lines = [*headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogateescape") + b"\r\n" + block


def record_id(url: str, date: str, block: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {sha1_32(block)}')}>"


def convert(arc: ArcRecord, revisit_of: tuple[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record.

    revisit_of: (record id, page id) of the response with the same payload.
    """
    head, payload = split_http(arc.block)
    digest = sha1_32(payload)
    headers = [("WARC-Record-ID", record_id(arc.url, arc.fields["Archive-date"], arc.block)), ("WARC-Date", warc_date(arc.fields["Archive-date"])), ("WARC-Target-URI", arc.url), ("WARC-IP-Address", arc.fields["IP-address"])]
    if arc.url.startswith("filedesc:"):
        info = f"format: WARC File Format 1.1\r\nconverted-from: ARC/{arc.version}\r\n".encode()
        return record([("WARC-Type", "warcinfo"), *headers[:2], ("WARC-Filename", arc.url.removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")], info)
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    if page:
        headers.append(("X-Page-Id", page[1].decode()))
    if revisit_of:
        uri, first = revisit_of
        headers += [("WARC-Refers-To", uri), ("X-Refers-To-Page-Id", first), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return record([("WARC-Type", "revisit"), *headers, ("Content-Type", "application/http;msgtype=response")], head)
    headers.append(("WARC-Block-Digest", f"sha1:{sha1_32(arc.block)}"))
    kind = ("response", "application/http;msgtype=response") if head else ("resource", arc.fields["Content-type"])
    return record([("WARC-Type", kind[0]), *headers, ("Content-Type", kind[1])], arc.block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        n = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} doesn't end where it says")
        yield headers, block
        at = end + 8 + n


def page_block(page_id, html: str | None) -> bytes:
    """A page as the HTTP response that a crawler would have stored."""
    body = (html if isinstance(html, str) else "").encode()
    known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(body)}\r\n\r\n".encode() + body


def page_uri(page_id, url: str | None) -> str:
    return url if isinstance(url, str) and url else f"urn:page:{page_id}"


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, first, first_url) of every page that repeats an earlier
    payload; first_url is the least url of the first page's rows, all of which
    are responses."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", F.sha1(html).alias("sha"), F.octet_length(html).alias("n")).where(F.col("n") >= least_bytes)
    known = keyed.where("page_id IS NOT NULL")
    least = F.min(F.struct("page_id", "url"))
    shared = known.groupBy("sha").agg(least.alias("least"), F.count("*").alias("copies")).where("copies > 1").select("sha", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url"))
    return known.drop("url").join(shared, "sha").where("page_id <> first").select("page_id", "sha", "first", "first_url").distinct()


def archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 16 << 20, date: str = "20200101000000") -> DataFrame:
    """One string per WARC archive; pages pass through ARC and its converter.

    The revisit table is stored first, so that Spark knows its size and
    decides by it whether the join may broadcast.
    """
    repeats = stored(first_pages(pages, least_bytes), "revisits")
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("sha"))
    rows = keyed.join(repeats, ["page_id", "sha"], "left").select(*as_text("page_id", "first"), "url", "html", "first_url")

    def run(batches):
        out, size, n = [], 0, 0
        for pdf in batches:
            for page, url, text, first, first_url in zip(*(pdf[c].tolist() for c in ("page_id", "url", "html", "first", "first_url")), strict=True):
                uri = page_uri(page, url)
                version = 1 + n % 2  # both versions of the legacy format
                n += 1
                legacy = arc_start(version, "pages.arc", date) + arc_record(version, uri, date, page_block(page, text))
                parsed = list(parse_arc(legacy))
                # the same payload, so the first page's block differs in its id only
                of = None if first is None else (record_id(arc_url(page_uri(first, first_url)), date, page_block(first, text)), first)
                if not out:
                    out.append(convert(parsed[0]))
                out.append(convert(parsed[1], of))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"value": [END.encode().join(out).decode("utf-8")]})
                    out, size = [], 0
        if out:
            yield pd.DataFrame({"value": [END.encode().join(out).decode("utf-8")]})

    return rows.mapInPandas(run, "value string")


def write(archive_rows: DataFrame, path: str) -> None:
    """One gzip file per archive."""
    archive_rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read(spark, path: str) -> DataFrame:
    """One row per page record of the archives in ``path``."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for h, block in parse_warc(gzip.decompress(content)):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(h["X-Payload-Length"])
                    if kind == "response":
                        payload = split_http(block)[1]
                        if (len(payload), sha1_32(payload)) != (n, digest):
                            raise ValueError(f"payload of {h['WARC-Record-ID']} isn't what its digest says")
                    page, first = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                    rows.append((page, n, digest, kind, first))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return as_longs(files.select("content").mapInPandas(run, READ), "page_id", "refers_to")


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the archives of ``pages`` and read them back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(archives(pages, **options), path)
    return read(spark, path)


def oracle() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digit = f"substr('{alphabet}', ((('0x' || substr(sha, 5 * g + 1, 5))::BIGINT >> (15 - 5 * c)) & 31)::INT + 1, 1)"
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: {digit.replace("g +", "(i // 4) +").replace("5 * c", "5 * (i % 4)")}), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
