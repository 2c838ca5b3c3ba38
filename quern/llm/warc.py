"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Each response gives a ``metadata`` record (application/warc-fields: title, language, links, the source's
HTTP headers and digest) and a ``conversion`` record (text/plain). Both name the response in WARC-Refers-To,
carry its target URI and date, and have their own record id and SHA-1 block digest. Ids are name-based
UUIDs, so a redone task writes the same bytes. Chunked, gzip and deflate bodies are undone before they are
decoded; a body in another coding, or of a type that is no text, gives a row with the reason instead of records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivative")
_HIDDEN = re.compile(r"<!--|<!doctype[^>]*>|<(script|style|noscript|template)\b[^>]*>", re.I)
_ENDS = {"": re.compile("-->"), **{t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template")}}
#: Types of bodies that have text to convert, as beginnings; a body without a type counts as such.
TEXT_TYPES = ("text/", "application/xhtml", "application/xml", "application/json")
_BLOCK = re.compile(r"<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|br|title|head|body|blockquote|pre)\b[^>]*)>", re.I)
_TAG = re.compile(r"<[a-zA-Z/][^>]*>")
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""", re.I)
_GAP = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _shown(page: str) -> str:
    """The page with a blank for each comment, document type and element without visible text; what is never closed stays, and is sought once only."""
    out, at, unclosed = [], 0, set()
    while m := _HIDDEN.search(page, at):
        kind = (m[1] or "").lower()
        if m[0].startswith("<!") and m[0] != "<!--":
            end = m.end()
        else:
            close = None if kind in unclosed else _ENDS[kind].search(page, m.end())
            if close is None:
                unclosed.add(kind)
                out.append(page[at : m.end()])
                at = m.end()
                continue
            end = close.end()
        out += [page[at : m.start()], " "]
        at = end
    return "".join(out) + page[at:]


def plain_text(page: str) -> str:
    """Visible text, a line a block element; entities decoded, blanks folded."""
    text = _TAG.sub("", _BLOCK.sub("\n", _shown(page)))
    return _LINES.sub("\n", _GAP.sub(" ", entities.unescape(text))).strip()


def _fold(text: str) -> str:
    return " ".join(text.split())


def record(kind: str, fields: list[tuple[str, str]], block: bytes, content_type: str) -> tuple[str, bytes]:
    """(record id, record bytes) with block digest and length; the id names the fields and the block."""
    digest = sha1(block)
    rid = f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join([kind, digest, *(f'{k}={v}' for k, v in fields)]))}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), *fields, ("WARC-Block-Digest", digest), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {_fold(v)}\r\n" for k, v in head)
    return rid, b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, block) of one record; ValueError if malformed."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    size = int(fields.get("content-length", "-1"))
    if size < 0 or len(rest) < size:
        raise ValueError("the block is shorter than its length")
    return fields, rest[:size]


def response(key: object, url: str | None, page: str | None) -> bytes:
    """The response record of a stored page; a null page has an empty payload, a null URL an empty one."""
    body = (page or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", url or ""), ("WARC-Date", DATE), ("WARC-Payload-Digest", sha1(body)), ("X-Source-Key", str(key))]
    return record("response", fields, head + body, "application/http; msgtype=response")[1]


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunked body without its last chunk")
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            raise ValueError("a chunk without its size") from None
        if not size:
            return b"".join(out)
        if len(body) < end + 2 + size:
            raise ValueError("a chunk shorter than its size")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _inflated(body: bytes, coding: str) -> bytes:
    """Bodies of several gzip members are read to the end; deflate is taken with or without its zlib header."""
    try:
        if coding != "deflate":
            return gzip.decompress(body)
        try:
            return zlib.decompress(body)
        except zlib.error:
            return zlib.decompress(body, -15)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(f"{coding} body: {e}") from None


def payload_text(headers: list[str], body: bytes) -> str:
    """The body's text, as the HTTP headers say it is to be read; ValueError where it has none."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in headers)}
    for name, known in (("transfer-encoding", ("chunked",)), ("content-encoding", ("gzip", "x-gzip", "deflate"))):
        for coding in reversed([c.strip().lower() for c in fields.get(name, "").split(",")]):
            if coding in ("", "identity"):
                continue
            if coding not in known and coding not in ("gzip", "x-gzip", "deflate"):
                raise ValueError(f"unsupported {name}: {coding}")
            body = _unchunked(body) if coding == "chunked" else _inflated(body, coding)
    kind = fields.get("content-type", "").lower()
    if kind and not kind.startswith(TEXT_TYPES):
        raise ValueError(f"no text in content of type {kind.split(';')[0]}")
    charset = re.search(r"charset=[\"']?([\w-]+)", kind)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive(data: bytes) -> list[tuple[str, str, bytes]]:
    """(type, record id, record) of the metadata and the conversion record of a response record."""
    fields, block = parse_record(data)
    if fields.get("warc-type") != "response":
        raise ValueError("not a response record")
    head, _, body = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("latin-1").split("\r\n")
    page = payload_text(headers, body)
    common_fields = [("WARC-Refers-To", fields["warc-record-id"]), ("WARC-Target-URI", fields.get("warc-target-uri", "")), ("WARC-Date", fields.get("warc-date", DATE))]
    title = _TITLE.search(page)
    lang = _LANG.search(page)
    links = [_fold(entities.unescape(x.strip("\"'"))) for x in _LINK.findall(_shown(page))]
    payload = fields.get("warc-payload-digest") or sha1(body)
    info = [("title", _fold(entities.unescape(title[1])) if title else ""), ("languages-html", lang[1] if lang else ""), ("http-status", status)]
    info += [("http-header", h) for h in headers if h] + [("source-payload-digest", payload), ("source-block-digest", fields.get("warc-block-digest") or sha1(block))]
    info += [("outlink", x) for x in links]
    meta = "".join(f"{k}: {v}\r\n" for k, v in info).encode()
    rid, rec = record("metadata", common_fields, meta, "application/warc-fields")
    tid, text = record("conversion", [*common_fields, ("WARC-Source-Payload-Digest", payload)], plain_text(page).encode(), "text/plain; charset=utf-8")
    return [("metadata", rid, rec), ("conversion", tid, text)]


def derivatives(responses: DataFrame, record_col: str = "record", key_col: str = "key") -> DataFrame:
    """``key, type, record_id, refers_to, record, error``: two rows a response record; one, with the reason, for null or malformed ones
    and bodies that cannot be converted.

    Repeated records give equal rows again, with equal ids; a null key stays null; an empty table gives none. Other
    columns are not looked at, whatever their names.
    """
    common.ship(responses.sparkSession)
    src = responses.select(F.col(key_col).cast("long").alias("key"), F.col(record_col).cast("binary").alias("record"))
    ddl = "key long, type string, record_id string, refers_to string, record binary, error string"
    schema = common.arrow_schema(ddl)

    def run(batches):
        for b in batches:
            out = {k: [] for k in schema.names}
            for key, data in zip(b.column("key").to_pylist(), b.column("record").to_pylist()):
                try:
                    source = parse_record(data or b"")[0].get("warc-record-id")
                    rows = [(key, kind, rid, source, rec, None) for kind, rid, rec in derive(data)]
                except (ValueError, KeyError) as e:
                    rows = [(key, None, None, None, None, str(e))]
                for row in rows:
                    for name, v in zip(schema.names, row):
                        out[name].append(v)
            yield common.emit(out, schema)

    return src.mapInArrow(common.tidy(run), ddl)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``key, record``: a response record for every row of a table of pages; null pages have an empty payload, repeated rows equal records."""
    common.ship(pages.sparkSession)
    src = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    ddl = "key long, record binary"
    schema = common.arrow_schema(ddl)

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("key", "url", "html")))
            yield common.emit({"key": b.column("key").to_pylist(), "record": [response(*r) for r in rows]}, schema)

    return src.mapInArrow(common.tidy(run), ddl)


def derivative_digests(pages: DataFrame) -> DataFrame:
    """Two rows a page: the parsed fields of each derivative, read back from its record, and its digests.

    Null and empty pages have records of empty text; null ids stay null; repeated rows and empty tables as in :func:`derivatives`.
    """
    made = derivatives(responses(pages))
    ddl = "page_id long, type string, record_id string, refers_to string, target_uri string, block_digest string, source_digest string, content_length long, n_outlinks long, record_sha256 string"
    schema = common.arrow_schema(ddl)

    def run(batches):
        for b in batches:
            out = {k: [] for k in schema.names}
            for key, kind, data in zip(*(b.column(c).to_pylist() for c in ("key", "type", "record"))):
                f, block = parse_record(data)
                source = f.get("warc-source-payload-digest") or re.search(rb"source-payload-digest: (\S+)", block)[1].decode()
                row = (key, kind, f["warc-record-id"], f["warc-refers-to"], f.get("warc-target-uri"), f["warc-block-digest"], source, len(block), len(re.findall(rb"(?m)^outlink: ", block)) if kind == "metadata" else 0, hashlib.sha256(data).hexdigest())
                for name, v in zip(schema.names, row):
                    out[name].append(v)
            yield common.emit(out, schema)

    return made.select("key", "type", "record").mapInArrow(common.tidy(run), ddl)
