"""WARC derivatives: responses to linked metadata and plain-text conversion records.

Each response record yields one metadata record (what the response's headers and its page's head say)
and, if its payload is text, one conversion record (the page's visible text). Both carry a
WARC-Refers-To with the response's id and the response's target address and date; ids are made from
the response's id, so rebuilding gives the same records; digests are SHA-1 in base 32, of the block
and, for responses, of the payload. Records are independent: nothing is exchanged.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import table

CRLF = "\r\n"
GZIP = b"\x1f\x8b\x08"
HEAD = re.compile(rb"(?<=\r\n)WARC/[0-9]+\.[0-9]+\r\n")
UNPACKED = 1 << 28  # bytes that a compressed payload may unpack to
STEP = 1 << 20  # bytes of a file unpacked at once
#: Elements whose content is no text, and elements that end a line.
SILENT = re.compile(r"<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", re.I | re.S)
BREAKING = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
TAG = re.compile(r"<[^>]*>")
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
LINK = re.compile(r"<(a|link|img|script)\b[^>]*?\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
META = re.compile(r"<meta\b[^>]*>", re.I)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
RECORD_SCHEMA = "source_id long, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, headers array<struct<name:string,value:string>>, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def made_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def fields(lines: bytes) -> list[tuple[str, str]]:
    """Header fields, folded lines joined, in order; lines without a colon are skipped."""
    out: list[tuple[str, str]] = []
    for line in lines.replace(b"\r\n", b"\n").split(b"\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def first(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for n, v in headers if n.lower() == name.lower()), None)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and payload; a block without a blank line is all headers."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, payload = block.partition(b"\n\n")
    status, _, rest = head.partition(b"\n")
    return status.decode("utf-8", "replace").strip(), fields(rest), payload


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without chunking and compression; left as it is where they do not read, or where it

    would unpack to more than ``UNPACKED`` bytes.
    """
    if (first(headers, "Transfer-Encoding") or "").lower() == "chunked":
        out, at = [], 0
        try:
            while (end := payload.index(b"\r\n", at)) >= 0:
                size = int(payload[at:end].split(b";")[0], 16)
                if not size:
                    break
                out.append(payload[end + 2 : end + 2 + size])
                at = end + 2 + size + 2
            payload = b"".join(out)
        except ValueError:
            pass
    try:
        how = (first(headers, "Content-Encoding") or "").lower()
        return unpacked(payload, 31) if how in ("gzip", "x-gzip") else unpacked(payload, 15) if how == "deflate" else payload
    except zlib.error:
        return payload


def unpacked(payload: bytes, kind: int) -> bytes:
    """A compressed payload unpacked; one that grows beyond ``UNPACKED`` bytes counts as unreadable."""
    out, data = [], payload
    left = UNPACKED
    while data:
        z = zlib.decompressobj(kind)
        out.append(z.decompress(data, left + 1))
        left -= len(out[-1])
        if left < 0:
            raise zlib.error("unpacks to too much")
        if not z.eof:
            raise zlib.error("cut short")
        data = z.unused_data if kind == 31 and z.unused_data[:2] == GZIP[:2] else b""
    return b"".join(out)


def charset(headers: list[tuple[str, str]], payload: bytes) -> str:
    found = re.search(r"charset\s*=\s*\"?([\w.:-]+)", first(headers, "Content-Type") or "", re.I) or re.search(r"<meta\b[^>]*charset\s*=\s*[\"']?([\w.:-]+)", payload[:4096].decode("latin-1"), re.I)
    try:
        return found and "".encode(found[1]) is not None and found[1] or "utf-8"
    except LookupError:
        return "utf-8"


def visible(page: str) -> str:
    """The lines of a page that are seen, blanks collapsed and entities resolved."""
    text = re.sub(r"[ \t\r\n\f]+", " ", SILENT.sub(" ", page))
    lines = (entities.unescape(x).strip() for x in TAG.sub("", BREAKING.sub("\n", text)).split("\n"))
    return "\n".join(x for x in lines if x)


def described(status: str, http: list[tuple[str, str]], page: str | None) -> dict:
    """What the metadata record says of a response."""
    out: dict = {"http-status": status, "http-headers": [[n, v] for n, v in http]}
    if page is not None:
        title = TITLE.search(page)
        out["title"] = entities.unescape(re.sub(r"\s+", " ", title[1]).strip()) if title else None
        metas = [{n.lower(): entities.unescape(a or b or c) for n, a, b, c in ATTRIBUTE.findall(m)} for m in META.findall(page)]
        out["metas"] = metas
        out["links"] = [{"element": e.lower(), "url": entities.unescape(a or b or c)} for e, a, b, c in LINK.findall(page)]
    return out


def derivatives(headers: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The metadata and conversion records of one response; none for other records."""
    if (first(headers, "WARC-Type") or "").lower() != "response":
        return []
    origin, uri, date = (first(headers, f"WARC-{n}") for n in ("Record-ID", "Target-URI", "Date"))
    origin = origin or made_id("response", uri or "", date or "", hashlib.sha1(block).hexdigest())
    status, http, payload = split_http(block)
    body = decoded(payload, http)
    kind = (first(http, "Content-Type") or "").split(";")[0].strip().lower()
    is_html = kind in ("text/html", "application/xhtml+xml") or (not kind and body.lstrip()[:1] == b"<")
    page = body.decode(charset(http, body), "replace") if is_html or kind.startswith("text/") else None
    told = described(status, http, page if is_html else None)
    told["payload-digest"] = first(headers, "WARC-Payload-Digest") or digest(payload)
    out = [("metadata", "application/json", json.dumps(told, ensure_ascii=False, sort_keys=True).encode())]
    if page is not None:
        out.append(("conversion", "text/plain", (visible(page) if is_html else page).encode("utf-8", "replace")))
    made = []
    for warc_type, content_type, data in out:
        record = {"warc_type": warc_type, "record_id": made_id(warc_type, origin), "refers_to": origin, "target_uri": uri, "date": date, "content_type": content_type, "content_length": len(data), "block_digest": digest(data), "payload_digest": told["payload-digest"], "block": data}
        own = [("WARC-Type", warc_type), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", origin), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", record["block_digest"]), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        record["headers"] = [{"name": n, "value": v} for n, v in own if v is not None]
        # headers of the source that the new record does not set itself go along under their own names
        mine = {n.lower() for n, _ in own} | {"warc-payload-digest", "warc-truncated", "warc-concurrent-to"}
        record["headers"] += [{"name": n, "value": v} for n, v in headers if n.lower() not in mine]
        made.append(record)
    return made


def build_derivatives(records: DataFrame, id_col: str, header_col: str = "header", block_col: str = "block") -> DataFrame:
    """Metadata and conversion records of the responses among ``records``.

    ``records`` has an id, the record's header fields as text or bytes and its block as bytes. Returns
    source_id, warc_type, record_id, refers_to, target_uri, date, content_type, content_length,
    block_digest, payload_digest, headers and block. A response without text gives a metadata record
    only; other record types, and null headers, give nothing; a null block is empty. A response
    without an id gets one from its address, date and block. Undecodable bytes become U+FFFD, unknown
    character sets are read as UTF-8. Repeated rows give repeated records, an empty table none; other
    columns are left out.
    """
    own = records.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(header_col).cast("binary"), F.lit(b"")).alias("_h"), F.coalesce(F.col(block_col).cast("binary"), F.lit(b"")).alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in KINDS]
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256).to_pydict()
                rows = [r | {"source_id": i} for i, h, x in zip(part["_id"], part["_h"], part["_b"], strict=True) for r in derivatives(fields(h), x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in KINDS], names=names)

    return own.mapInArrow(run, RECORD_SCHEMA)


KINDS = [
    *((n, pa.int64() if n in ("source_id", "content_length") else pa.string()) for n in ("source_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest")),
    ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
    ("block", pa.binary()),
]


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after another, or the file if it is not compressed.

    A broken member gives what could be read of it; reading goes on at the next member's head.
    """
    if data[:2] != GZIP[:2]:
        yield data
        return
    at = 0
    while at >= 0:
        z, out = zlib.decompressobj(31), []
        view = memoryview(data)[at:]
        try:
            for i in range(0, len(view), STEP):
                out.append(z.decompress(view[i : i + STEP]))
                if z.eof:
                    break
            rest = len(z.unused_data) + max(0, len(view) - i - STEP) if z.eof else 0
            at = len(data) - rest if rest else -1
        except zlib.error:
            at = data.find(GZIP, at + 1)
        yield b"".join(out)
        if at >= 0 and data[at : at + 2] != GZIP[:2]:
            at = data.find(GZIP, at)


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes, str | None]]:
    """(header, block, error) of each record of a WARC file, plain or in gzip members.

    A record without a readable Content-Length, or whose block reaches over the next record's head or
    the end, is told in ``error`` ("no length" or "truncated"), with what there is of its block;
    reading goes on at the next record's head.
    """
    for part in members(data):
        at = 0 if part.startswith(b"WARC/") else next_head(part, 0)
        while at >= 0:
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                yield part[at:], b"", "truncated"
                break
            header, begin = part[at:end], end + 4
            length = first(fields(header), "Content-Length") or ""
            stop = begin + int(length) if re.fullmatch(r"[0-9]{1,18}", length) else -1
            # a whole record ends with the file or before another head
            if stop < 0 or stop > len(part) or (part[stop:].strip() and not part[stop : stop + 9].lstrip(b"\r\n").startswith(b"WARC/")):
                at = next_head(part, begin)
                yield header, part[begin : at if at >= 0 else len(part)].removesuffix(b"\r\n\r\n"), "truncated" if stop >= 0 else "no length"
            else:
                yield header, part[begin:stop], None
                at = part.find(b"WARC/", stop)


def next_head(data: bytes, begin: int) -> int:
    """Where the next record's first line begins, or -1."""
    found = HEAD.search(data, begin)
    return -1 if found is None else found.start()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record, header, block, error) of all records of the WARC files at ``path``, read through Spark.

    A file is one task's work and must be below Spark's 2 GB limit for a value, as crawl files are.
    ``error`` is null for whole records; broken ones are returned with what could be read of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.int64(), pa.binary(), pa.binary(), pa.string()
        for b in batches:
            for i in range(b.num_rows):
                for record in enumerate(split_records(b.column(0)[i].as_py())):
                    values = record[0], *record[1]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["record", "header", "block", "error"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record long, header binary, block binary, error string")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files. Their blocks are UTF-8, as derivatives' are; each file is one gzip member."""
    header = F.concat(F.lit("WARC/1.0" + CRLF), F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit(CRLF))), ""), F.lit(CRLF))
    records.select(F.concat(header, F.decode("block", "UTF-8")).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as WARC response records: page_id, header, block. Null pages have an empty payload."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http.cast("binary"), payload)
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))))
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: "), urn, F.lit(f"{CRLF}WARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-IP-Address: 192.0.2.1{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF)
    )
    return pages.select(F.col(id_col).alias("page_id"), header.alias("header"), block.alias("block"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = build_derivatives(responses(table(spark, sf_dir, "pages")), "page_id")
    return made.withColumnRenamed("source_id", "page_id").withColumn("block", F.decode("block", "UTF-8")).withColumn("headers", F.to_json("headers"))


#: Record ids and digests by name are beyond SQL here: tested against a direct computation and by rereading.
ORACLE_SQL = None
