"""WARC derivatives: each response record gives a metadata record and a plain-text conversion record.

Both refer to the response's record id and carry its target and date on. The metadata record holds the response's own
headers and HTTP headers, all of them in their order, its digests, title and links; the conversion record names the
source's payload digest beside its own. What is no whole response record gives an error instead of records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, with_arrow

DATE = "2025-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard namespace of URLs
CRLF = b"\r\n"
#: Bytes of pages or records that are worked on together; a longer one is alone.
TOGETHER = 4 << 20

HIDDEN = frozenset(("script", "style", "noscript", "template"))
BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav title blockquote pre main aside td th hr form option dd dt dl".split())
LINKING = frozenset(("a", "area", "link", "img", "script", "iframe", "form"))
_OPEN = re.compile(r"<(?:(!--)|(/?)([A-Za-z][A-Za-z0-9:-]*)|[!?/])")
_ADDRESS = re.compile(r"""(?:^|[\s"'/])(href|src|action)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*HIDDEN, "title")}
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, chr(10).join(parts))}>"


def record(headers: Headers, block: bytes) -> bytes:
    """A record; line breaks in header values become spaces, so a value cannot end its header."""
    lines = [b"WARC/1.0"]
    for name, value in [*headers, ("Content-Length", str(len(block)))]:
        lines.append(f"{name}: {' '.join(value.split())}".encode("utf-8", "surrogatepass"))
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def pairs(lines: list[str]) -> Headers:
    """Name and value of each header line, repeated ones too; a line that starts with a blank continues the one above."""
    out: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif line.strip():
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def value_of(headers: Headers, name: str, default: str | None = None) -> str | None:
    """The first value of a header, whatever its name's case."""
    return next((v for n, v in headers if n.lower() == name.lower()), default)


def parse(data: bytes) -> tuple[Headers, bytes]:
    """Headers and block of a record; ValueError says what is wrong with one that is not whole."""
    head, mark, rest = data.partition(CRLF * 2)
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/") or not mark:
        raise ValueError("not a WARC record")
    headers = pairs(lines)
    length = value_of(headers, "Content-Length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise ValueError("no valid Content-Length")
    if int(length) > len(rest):
        raise ValueError("record shorter than its Content-Length")
    return headers, rest[: int(length)]


def response(page_id, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """The response record of a page; the same page, address and text give the same record."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + CRLF * 2 + payload
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(headers, block)


def http_parts(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload; a block without an HTTP head is all payload."""
    head, mark, payload = block.partition(CRLF * 2)
    if not mark or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    return first, pairs(rest), payload


def read_page(page: str) -> tuple[str, str, list[dict[str, str]]]:
    """Text, title and links of a page, in one pass.

    Scripts, styles and comments are left out, block elements end lines, entities are resolved. A tag that no > ends
    is text; a hidden element or comment without its end is an ordinary tag. Each is looked for once, so no page takes
    more than time in proportion to its length.
    """
    text, links, title, endless, at = [], [], None, set(), 0
    while (m := _OPEN.search(page, at)) is not None:
        text.append(page[at : m.start()])
        if m[1] and "-->" not in endless:
            end = page.find("-->", m.end())
            if end >= 0:
                text.append(" ")
                at = end + 3
                continue
            endless.add("-->")
        end = page.find(">", m.end())
        if end < 0:
            at = m.start()
            break
        name, at = (m[3] or "").lower(), end + 1
        if name in BLOCKS:
            text.append("\n")
        if m[2]:
            continue
        if name in LINKING and (a := _ADDRESS.search(page[m.end() : end])):
            links.append({"path": f"{name}@{a[1].lower()}", "url": html.unescape(next(x for x in a.groups()[1:] if x is not None))})
        if name in _CLOSE and name not in endless and not (name == "title" and title is not None):
            close = _CLOSE[name].search(page, at)
            if close is None:
                endless.add(name)
            elif name == "title":
                title = page[at : close.start()]
            else:
                text.append(" ")
                at = close.end()
    text.append(page[at:])
    plain = _LINES.sub("\n", _BLANK.sub(" ", html.unescape("".join(text)))).strip()
    return plain, " ".join(html.unescape(title or "").split()), links


def derivatives(data: bytes) -> tuple[bytes, bytes]:
    """(metadata record, conversion record) of a response record; ValueError for anything else."""
    headers, block = parse(data)
    if (value_of(headers, "WARC-Type", "") or "").lower() != "response":
        raise ValueError("not a response record")
    source_id = value_of(headers, "WARC-Record-ID")
    if not source_id:
        raise ValueError("no WARC-Record-ID")
    status, http, payload = http_parts(block)
    text, title, links = read_page(payload.decode("utf-8", "replace"))
    about = [("WARC-Date", value_of(headers, "WARC-Date", "")), ("WARC-Target-URI", value_of(headers, "WARC-Target-URI", "")), ("WARC-Refers-To", source_id)]
    source_digest = value_of(headers, "WARC-Payload-Digest", digest(payload))
    facts = {
        "source": headers,
        "http": {"status": status, "headers": http},
        "payload": {"digest": digest(payload), "length": len(payload)},
        "html": {"title": title, "links": links},
    }
    meta = json.dumps(facts, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")
    plain = text.encode("utf-8", "surrogatepass")

    def of(kind: str, block: bytes, content: str, more: Headers) -> bytes:
        own = [("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(block)), ("Content-Type", content)]
        return record([("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source_id, digest(block))), *about, *more, *own], block)

    return of("metadata", meta, "application/json", []), of("conversion", plain, "text/plain; charset=utf-8", [("Source-Payload-Digest", source_digest)])


def slices(batch: pa.RecordBatch, column: str, size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of a column."""
    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(n // size)) + 1).tolist(), len(n)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e > s:
            yield batch.slice(s, e - s)


def with_responses(batch: pa.RecordBatch, date: str = DATE) -> pa.RecordBatch:
    rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
    return with_arrow(batch.select(["page_id"]), warc=pa.array([response(*r, date) for r in rows], pa.binary()))


def with_derivatives(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = []
    for data in batch.column("warc").to_pylist():
        try:
            made.append((*derivatives(data or b""), None))
        except ValueError as e:
            made.append((None, None, str(e)))
    return with_arrow(batch, metadata=pa.array([m[0] for m in made], pa.binary()), conversion=pa.array([m[1] for m in made], pa.binary()), error=pa.array([m[2] for m in made], pa.string()))


REPORT = "record_id string, metadata_id string, conversion_id string, target_uri string, payload_digest string, linked boolean, n_links long, title string, n_text_bytes long, text_sha256 string, error string"
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}


def _facts(data: bytes, metadata: bytes, conversion: bytes) -> tuple:
    source, _ = parse(data)
    (mh, mb), (ch, cb) = parse(metadata), parse(conversion)
    facts = json.loads(mb)
    id_, payload = value_of(source, "WARC-Record-ID"), value_of(source, "WARC-Payload-Digest")
    linked = value_of(mh, "WARC-Refers-To") == value_of(ch, "WARC-Refers-To") == id_ and value_of(mh, "WARC-Block-Digest") == digest(mb) and value_of(ch, "WARC-Block-Digest") == digest(cb)
    linked = linked and facts["payload"]["digest"] == value_of(ch, "Source-Payload-Digest") == (payload or facts["payload"]["digest"]) and facts["source"] == [list(p) for p in source]
    return (id_, value_of(mh, "WARC-Record-ID"), value_of(ch, "WARC-Record-ID"), value_of(ch, "WARC-Target-URI"), value_of(ch, "Source-Payload-Digest"), linked, len(facts["html"]["links"]), facts["html"]["title"], len(cb), hashlib.sha256(cb).hexdigest(), None)


def with_report(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = zip(*(batch.column(c).to_pylist() for c in ("warc", "metadata", "conversion", "error")), strict=True)
    made = [_facts(w, m, c) if e is None else (None,) * 5 + (False,) + (None,) * 4 + (e,) for w, m, c, e in rows]
    columns = [f.split() for f in REPORT.split(", ")]
    return with_arrow(batch.select(["page_id"]), **{name: pa.array([r[k] for r in made], _TYPES[kind]) for k, (name, kind) in enumerate(columns)})


def _mapped(df: DataFrame, column: str, schema: str, *steps: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """The steps in one pass over ``df``, some rows at a time; page_id passes as it is, null and large ones too."""
    small_batches(df.sparkSession)
    kind = df.schema["page_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in slices(whole, column):
                for step in steps:
                    b = step(b)
                yield b

    return df.mapInArrow(run, f"page_id {kind}, {schema}")


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, warc: the response record of each row; null urls and pages are empty. Empty table: no rows."""
    return _mapped(_pages(pages), "html", "warc binary", lambda b: with_responses(b, date))


def built(warcs: DataFrame) -> DataFrame:
    """page_id, warc, metadata, conversion, error: the two derived records of each response record.

    Null, broken and other records give null derivatives and an error; they stop nothing.
    """
    return _mapped(warcs.select("page_id", "warc"), "warc", "warc binary, metadata binary, conversion binary, error string", with_derivatives)


def report(records: DataFrame) -> DataFrame:
    """A row per record, read back from the derived records' bytes; linked: both refer to the response, their digests
    fit their blocks, and all headers and the payload digest are the response's."""
    return _mapped(records.select("page_id", "warc", "metadata", "conversion", "error"), "warc", REPORT, with_report)


def op8_warc_derivatives(spark, sf_dir):
    """``report(built(responses(pages)))`` in one pass."""
    return _mapped(_pages(table(spark, sf_dir, "pages")), "html", REPORT, with_responses, with_derivatives, with_report)
