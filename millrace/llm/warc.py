"""WARC files: writing and reading records, and deriving metadata and plain text.

A response record holds a page as it came over HTTP. Its derivatives are a metadata record
(JSON: the response's own headers, the HTTP status and headers, title, links) and a
conversion record (the page's text). Each names the response in ``WARC-Refers-To``, keeps its
target and date, and has digests of its own block; the response's digests are checked on
reading and kept in the metadata.

Files are rows of gzip members, one record each, so a file is read one record at a time. A
task writes files named for the attempt; only those of attempts that Spark counts get into
the manifest and are read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import slices
from millrace.llm.shared import new_folder, written

DATE = "2024-01-01T00:00:00Z"
NO_TARGET = "about:blank"
CHUNK = 1 << 16
LEVEL = 3  # of gzip: files of the pages of sf0.1 are 2 % larger than at 6, and sooner made

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """An id that a retried task makes again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def target(url: str | None) -> str:
    """``url`` as a header may hold it: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or NO_TARGET


def record(headers: Headers, block: bytes, level: int = LEVEL, of_block: str | None = None) -> bytes:
    """One record, in a gzip member of its own; ``of_block``: its block's digest, if known."""
    of_block = of_block or digest(block)
    lines = [f"{k}: {v}\r\n" for k, v in headers]
    end = f"WARC-Block-Digest: {of_block}\r\nContent-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = b"".join(("WARC/1.1\r\n".encode(), "".join(lines).encode(), end.encode(), block, b"\r\n\r\n"))
    return pack.compress(whole) + pack.flush()


def parsed(data: bytes) -> tuple[Headers, bytes]:
    """Headers and block of a record; fails if it is cut short or its digest differs."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = [(k, v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    told = {k.lower(): v for k, v in headers}
    block = rest[: int(told["content-length"])]
    if len(block) != int(told["content-length"]):
        raise ValueError(f"{told.get('warc-record-id')} is cut short")
    if (said := told.get("warc-block-digest")) and not _agrees(said, block):
        raise ValueError(f"{told.get('warc-record-id')} does not have its digest")
    return headers, block


_HEX = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}


def _agrees(said: str, data: bytes) -> bool:
    """Whether ``data`` has the digest that a header gives; one of an unknown kind says nothing."""
    kind, _, value = said.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in _HEX:
        return True
    made = hashlib.new(kind, data)
    if len(value) == _HEX[kind]:
        return value.lower() == made.hexdigest()
    return value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def members(stream) -> Iterator[bytes]:
    """What each gzip member of a file holds."""
    unpack, out = zlib.decompressobj(31), []
    data = stream.read(CHUNK)
    while data:
        out.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(out)
            data, unpack, out = unpack.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(CHUNK)
        else:
            data = stream.read(CHUNK)
    if out:
        raise ValueError("the last record is cut short")


# Quoted values have any length, in linear time: a tag ends at a < outside its quotes, and a
# quote changes what two tags read from different states into different states again, so at
# most three tags that begin at different places read the same part of a page.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^'"<>]++)*+)>"""
    r"""|<[a-z/!?][^<>]*>""",
    re.S | re.I,
)
#: Elements of HTML that begin a line of their own.
_LINES = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre "
    "section table tbody td tfoot th thead title tr ul".split()
)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def page_text(page: str) -> tuple[str, str, list[str]]:
    """Text, title and links of an HTML page, in one pass over its tags.

    Comments, scripts and styles are left out, an element that begins a line begins one,
    other tags vanish; references are resolved, white space is one space, and empty lines go.
    """
    parts, links, title, at, title_at = [], [], None, 0, None
    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if not (name := m[3]):
            continue
        name = name.lower()
        if name in _LINES:
            parts.append("\n")
        if name == "title" and title is None:
            if m[2]:
                title = page[title_at : m.start()] if title_at is not None else None
            else:
                title_at = m.end()
        elif name == "a" and not m[2] and (href := _HREF.search(m[4])):
            links.append(html.unescape(href[1] or href[2] or href[3] or ""))
    parts.append(page[at:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(parts)).split("\n"))
    return "\n".join(filter(None, lines)), " ".join(html.unescape(title or "").split()), links


def response(
    page_id: int | None, url: str | None, page: str | None, date: str, level: int = LEVEL
) -> bytes:
    """The response record of a page; a null page is an empty one."""
    payload = (page or "").encode()
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n%b" % (len(payload), payload)
    )
    of_payload, where = digest(payload), target(url)
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", page_id, where, of_payload)),
        ("WARC-Date", date),
        ("WARC-Target-URI", where),
        ("WARC-Payload-Digest", of_payload),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("Page-Id", str(page_id)))
    return record(headers, block, level)


def unchunked(body: bytes) -> bytes | None:
    """A body that came in chunks, in one; None if it isn't one that did."""
    parts, at = [], 0
    while True:
        stop = body.find(b"\n", at)
        size = re.match(rb"\s*([0-9a-fA-F]+)\s*(?:;.*)?\r?$", body[at:stop], re.S) if stop >= 0 else None
        if size is None:
            return None
        n = int(size[1], 16)
        if n == 0:
            return b"".join(parts)
        if stop + 1 + n > len(body):
            return None
        parts.append(body[stop + 1 : stop + 1 + n])
        at = stop + 1 + n
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"


def _unpacked(body: bytes, encoding: str) -> bytes | None:
    """``body`` without its content encoding; None if that is unknown.

    A body that isn't so encoded, as of an archive that decoded it before, is taken as it is.
    """
    if encoding in ("", "identity"):
        return body
    if encoding not in ("gzip", "x-gzip", "deflate"):
        return None
    for bits in (47, -15):  # gzip or zlib by its header, or bare
        if bits == 47 or encoding == "deflate":
            try:
                pack = zlib.decompressobj(bits)
                return pack.decompress(body) + pack.flush()
            except zlib.error:
                continue
    return body


def page_of(http: dict[str, str], body: bytes) -> tuple[str, str, list[str]]:
    """Text, title and links of a body, by its HTTP headers (names in lower case).

    HTML, and what has no type, is read as a page; other text is taken as it is; other types
    and unknown encodings have no text.
    """
    if "chunked" in http.get("transfer-encoding", "").lower():
        plain = unchunked(body)
        body = body if plain is None else plain
    for encoding in reversed(http.get("content-encoding", "").split(",")):
        if (body := _unpacked(body, encoding.strip().lower())) is None:
            return "", "", []
    told = http.get("content-type", "")
    kind = told.partition(";")[0].strip().lower()
    charset = re.search(r"""charset\s*=\s*["']?\s*([^\s"';]+)""", told, re.I)
    try:
        text = body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):  # an unknown name, or a codec that isn't one of text
        text = body.decode("utf-8", "replace")
    if kind in ("", "text/html", "application/xhtml+xml"):
        return page_text(text)
    if kind.startswith("text/") or kind.endswith(("json", "xml")):
        return text, "", []
    return "", "", []


def derived(headers: Headers, block: bytes, level: int = LEVEL) -> tuple[dict, bytes, bytes]:
    """What a response's derivatives are called and hold, and the two records.

    A response has the headers ``WARC-Record-ID`` and, by the standard, a date and a target;
    derivatives repeat those that are there. A block that isn't of HTTP is all payload.
    """
    told = {k.lower(): v for k, v in headers}
    status, http, payload = "", [], block
    if told.get("content-type", "application/http").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        status, *lines = head.decode("latin-1").split("\r\n")
        http = [tuple(p.strip() for p in x.partition(":")[::2]) for x in lines]
    else:
        http = [("Content-Type", told["content-type"])]
    by_name = {k.lower(): v for k, v in http}
    of_payload = digest(payload)
    said = told.get("warc-payload-digest", of_payload)
    if said != of_payload and not _agrees(said, payload):
        # Some writers digest the payload without its chunks.
        plain = unchunked(payload) if "chunked" in by_name.get("transfer-encoding", "").lower() else None
        if plain is None or not _agrees(said, plain):
            raise ValueError(f"{told['warc-record-id']} does not have its payload's digest")
    text, title, links = page_of(by_name, payload)
    source = told["warc-record-id"]
    common = [
        ("WARC-Refers-To", source),
        *((k, told[k.lower()]) for k in ("WARC-Date", "WARC-Target-URI") if k.lower() in told),
    ]
    content = {
        "WARC-Headers": headers,
        "HTTP-Status": status,
        "HTTP-Headers": http,
        "Payload-Digest": of_payload,
        "Payload-Length": len(payload),
        "Title": title,
        "Links": links,
    }
    meta = json.dumps(content, ensure_ascii=False).encode()
    plain = text.encode("utf-8", "replace")  # a charset may give half of a surrogate pair
    ids = {k: record_id(k, source) for k in ("metadata", "conversion")}
    kinds = {"metadata": "application/json", "conversion": "text/plain; charset=utf-8"}
    blocks = {"metadata": (meta, digest(meta)), "conversion": (plain, digest(plain))}
    records = [
        record(
            [("WARC-Type", k), ("WARC-Record-ID", ids[k]), *common, ("Content-Type", kinds[k])],
            b,
            level,
            of_block,
        )
        for k, (b, of_block) in blocks.items()
    ]
    row = {
        "page_id": int(told["page-id"]) if "page-id" in told else None,
        "url": told.get("warc-target-uri"),
        "response_id": source,
        "metadata_id": ids["metadata"],
        "conversion_id": ids["conversion"],
        "payload_digest": of_payload,
        "metadata_digest": blocks["metadata"][1],
        "text_digest": blocks["conversion"][1],
        "title": title,
        "n_links": len(links),
        "n_chars": len(text),
    }
    return row, *records


ROW = (
    "page_id bigint, url string, response_id string, metadata_id string, conversion_id string, "
    "payload_digest string, metadata_digest string, text_digest string, title string, "
    "n_links bigint, n_chars bigint, metadata_path string, metadata_offset bigint, "
    "conversion_path string, conversion_offset bigint"
)


class _File:
    """A file of this attempt, made when it gets its first record."""

    def __init__(self, folder: str, kind: str):
        self.fs, root = FileSystem.from_uri(folder)
        self.fs.create_dir(root)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{kind}.warc.gz"
        self.local, self.path, self.size, self.out = f"{root}/{name}", f"{folder}/{name}", 0, None

    def add(self, data: bytes) -> int:
        """Where in the file the record ``data`` begins."""
        if self.out is None:
            self.out = self.fs.open_output_stream(self.local, compression=None)
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def write_responses(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = DATE,
    level: int = LEVEL,
) -> DataFrame:
    """Write a response record for each row of ``pages``; give ``path, n_records``, a row a file.

    Files are those of the input's partitions; nothing is shuffled. A null page is empty, a
    null or empty url ``about:blank``, a null id left out. Repeated rows give repeated
    records, which then share an id. No rows make no file. ``level`` is that of gzip.
    """
    folder = new_folder(pages.sparkSession, "warc")
    narrow = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        out, n = _File(folder, "response"), 0
        for batch in batches:
            for part in slices(batch, "html"):
                for row in part.to_pylist():
                    out.add(response(row["page_id"], row["url"], row["html"], date, level))
                    n += 1
        out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"path": [out.path], "n_records": [n]})

    return written(narrow.mapInArrow(run, "path string, n_records bigint"), "warc-files")


def read_responses(paths: Iterable[str]) -> Iterator[tuple[Headers, bytes]]:
    """Headers and blocks of the response records in files, one at a time."""
    for path in paths:
        fs, local = FileSystem.from_uri(path)
        with fs.open_input_stream(local, compression=None) as stream:
            for data in members(stream):
                headers, block = parsed(data)
                if ("WARC-Type", "response") in headers:
                    yield headers, block


def derive(files: DataFrame, level: int = LEVEL) -> DataFrame:
    """Write the derivatives of all responses in ``files (path)``; a row for each response.

    The rows have ids, digests, title, counts of links and of the text's characters, and
    where each derivative is: its file and its offset there. Records of other types are
    passed over. A damaged record fails. Bodies in chunks or packed by gzip or deflate are
    read as what they hold, in the charset that their type names (else UTF-8); what isn't
    text has an empty text. A missing target is null. A task reads files one after the
    other, and holds one record.
    """
    folder = new_folder(files.sparkSession, "derived")
    names = [c.split()[0] for c in ROW.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in ROW.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names
        )

    def run(batches) -> Iterator[pa.RecordBatch]:
        meta, text, rows = _File(folder, "metadata"), _File(folder, "conversion"), []
        for batch in batches:
            for headers, block in read_responses(batch["path"].to_pylist()):
                row, *records = derived(headers, block, level)
                for name, file, data in zip(("metadata", "conversion"), (meta, text), records, strict=True):
                    row |= {f"{name}_offset": file.add(data), f"{name}_path": file.path}
                rows.append(row)
                if len(rows) == 1000:
                    yield batch_of(rows)
                    rows = []
        meta.close()
        text.close()
        yield batch_of(rows)

    n = max(1, files.count())
    return written(files.select("path").repartition(n).mapInArrow(run, ROW), "derivatives")


def read_at(path: str, offset: int) -> tuple[Headers, bytes]:
    """The record that begins at ``offset`` of a file."""
    fs, local = FileSystem.from_uri(path)
    with fs.open_input_file(local) as f:
        f.seek(offset)
        return parsed(next(members(f)))
