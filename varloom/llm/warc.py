"""WARC derivatives: metadata and plain-text records made from response records.

``responses`` describes fetched pages as response records; ``derivatives`` makes of
each a metadata record (JSON: title, links, headers, digests) and a conversion record
(plain text).  Both refer to the response by its record id and repeat its target, date,
HTTP headers and payload digest.  Ids are made from content, so reruns give the same
ones and repeated rows repeated records.

``write_records`` stores records in WARC 1.1 form, ``read_records`` reads them back by
their content lengths.

A null or empty body gives empty text, no title and no links; a null URL gives a
record without target, whose relative links stay relative.  Markup that is never
closed ends with the page.  Rows are independent of each other; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import slices

#: Comments, elements whose content is no text, declarations, and tags.  Each
#: alternative also ends at the end of the page, so no position is scanned twice.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title)\b(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+(?:>|\Z)"
    r"(?P<inner>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)",
    re.I | re.S,
)
LINK = re.compile(r"\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Elements that end a line of text.
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr "
    "html li main nav ol p pre section table td th tr ul".split()
)
_GAPS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")

RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_headers string, source_digest string, block_digest string, content_length bigint, block string"
)


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def page_parts(body: str, base: str | None) -> tuple[str, str, list[str]]:
    """Plain text, title and links of a page, in order and without repeats of a link."""
    out: list[str] = []
    title, links, at = "", [], 0
    for m in MARKUP.finditer(body):
        out.append(body[at : m.start()])
        at = m.end()
        raw = m["raw"]
        if raw:
            if raw.lower() == "title" and not title:
                title = " ".join(html.unescape(m["inner"]).split())
            elif raw.lower() == "textarea":
                out.append(m["inner"])
            continue
        tag = m["tag"]
        if not tag:
            continue
        if tag.lower() in BREAKS:
            out.append("\n")
        if not m["close"] and "=" in m["rest"]:
            for a, b, c in LINK.findall(m["rest"]):
                link = html.unescape(a or b or c).strip()
                try:
                    links.append(urljoin(base, link) if base else link)
                except ValueError:  # an address that cannot be resolved stays as it is
                    links.append(link)
    out.append(body[at:])
    text = _LINES.sub("\n", _GAPS.sub(" ", html.unescape("".join(out)))).strip()
    return text, title, list(dict.fromkeys(links))


def responses(pages: DataFrame, date: str, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, record_id, target_uri, warc_date, http_headers, payload, payload_digest) of fetched pages."""
    kind = dict(pages.dtypes)[key]
    names = "record_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__body", 8 << 20):
            ids, heads, sums = [], [], []
            urls, bodies = batch.column("__url").to_pylist(), [b or "" for b in batch.column("__body").to_pylist()]
            for k, u, b in zip(batch.column("__key").to_pylist(), urls, bodies, strict=True):
                data = b.encode()
                sums.append(sha1_digest(data))
                ids.append(record_id("response", str(k), u or "", sums[-1]))
                heads.append(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n")
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), *[pa.array(x, pa.string()) for x in (ids, urls, [date] * len(ids), heads, bodies, sums)]],
                names=[key, *[n.split(" ")[0] for n in names.split(", ")]],
            )

    chosen = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(body).alias("__body"))
    return chosen.mapInArrow(run, f"`{key}` {kind}, {names}")


def derivatives(source: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records (``RECORD``) beside ``key`` for each row of ``responses``: metadata and conversion."""
    kind = dict(source.dtypes)[key]
    names = [key, *[c.split(" ")[0] for c in RECORD.split(", ")]]
    chosen = source.select(key, "record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload", 4 << 20):
            made = []
            for r in batch.to_pylist():
                text, title, links = page_parts(r["payload"] or "", r["target_uri"])
                headers = [h.partition(": ")[::2] for h in (r["http_headers"] or "").split("\r\n")[1:] if h]
                about = json.dumps(
                    {"title": title, "links": links, "http-headers": dict(headers), "payload-digest": r["payload_digest"]},
                    ensure_ascii=False,
                )
                for name, mime, block in (("metadata", "application/json", about), ("conversion", "text/plain", text)):
                    data = block.encode("utf-8", "replace")
                    made.append((
                        r[key], name, record_id(name, r["record_id"]), r["record_id"], r["target_uri"], r["warc_date"], mime,
                        r["http_headers"], r["payload_digest"], sha1_digest(data), len(data), data.decode(),
                    ))
            columns = list(zip(*made, strict=True))
            kinds = [batch.schema.field(key).type, *[pa.string()] * 9, pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return chosen.mapInArrow(run, f"`{key}` {kind}, {RECORD}")


def spelt(records: DataFrame) -> DataFrame:
    """One column ``value`` with each record in WARC 1.1 form, but for the two line ends after it."""

    def line(name: str, column: str):
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit("\r\n"))).otherwise("")

    lines = [
        F.lit("WARC/1.1\r\n"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"),
        line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"),
        line("WARC-Source-Payload-Digest", "source_digest"), line("WARC-Block-Digest", "block_digest"),
        F.when(F.col("source_headers").isNotNull(), F.concat(
            F.lit("WARC-Source-Headers: "), F.regexp_replace(F.base64(F.col("source_headers").cast("binary")), r"\s", ""), F.lit("\r\n"))).otherwise(""),
        line("Content-Type", "content_type"), line("Content-Length", "content_length"),
        F.lit("\r\n"), F.col("block"),
    ]
    return records.select(F.concat(*lines).alias("value"))


def write_records(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    spelt(records).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).mode("errorifexists").text(path)


_FIELDS = {
    "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri",
    "WARC-Date": "warc_date", "Content-Type": "content_type", "WARC-Source-Headers": "source_headers",
    "WARC-Source-Payload-Digest": "source_digest", "WARC-Block-Digest": "block_digest", "Content-Length": "content_length",
}


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one file, each cut by its content length."""
    at = 0
    while (at := data.find(b"WARC/1.1\r\n", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        found: dict = dict.fromkeys(_FIELDS.values())
        for header in data[at:end].split(b"\r\n")[1:]:
            name, _, value = header.decode().partition(": ")
            if name in _FIELDS:
                found[_FIELDS[name]] = value
        length = int(found["content_length"])
        found["content_length"] = length
        if found["source_headers"] is not None:
            found["source_headers"] = base64.b64decode(found["source_headers"]).decode()
        found["block"] = data[end + 4 : end + 4 + length].decode()
        at = end + 4 + length
        yield found


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records (``RECORD``) of the files that ``write_records`` left under ``path``."""
    names = [c.split(" ")[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                found = list(parse_records(data.as_py()))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[n] for r in found], pa.int64() if n == "content_length" else pa.string()) for n in names],
                        names=names,
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
