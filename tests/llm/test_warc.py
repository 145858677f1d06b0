import base64
import gzip
import hashlib
import io
import json
import zlib
from html.parser import HTMLParser

import pytest
from cases import collected
from pyspark.sql import functions as F

from millrace.llm.warc import (
    derive,
    derived,
    members,
    page_text,
    parsed,
    read_at,
    read_responses,
    record,
    response,
    target,
    write_responses,
)

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><style>p{x}</style>
<script>var t="</p>"; if (a<b) c();</script></head><body><!-- <p>no</p> -->
<p>One<b>two</b> <a href="/x?a=1&amp;b=2">three</a><p>Fo&uuml;r<br>five
six</p><a class=k href=/y title="a>b">seven</a><a name=z>eight</a> 1 < 2 & 3 > 2</body></html>"""

ROWS = [
    (1, "http://a.example/x y\r\nEvil: 1", PAGE),
    (2, "http://b.example/", ""),
    (2, "http://b.example/", ""),
    (3, None, "<p>no url"),
    (4, "http://c.example/", None),
    (None, "http://d.example/", "no id <script>open"),
    (5, "", "<p>" + "long words " * 50_000),
]


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages(spark, rows):
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return frame.withColumns({c: F.lit("x") for c in ("path", "text", "title", "n_records")})


def test_text_title_and_links():
    text, title, links = page_text(PAGE)
    assert text == "A & B\nOnetwo three\nFoür\nfive\nsix\nseveneight 1 < 2 & 3 > 2"
    assert title == "A & B" and links == ["/x?a=1&b=2", "/y"]
    assert page_text("") == ("", "", []) and page_text("<<<>>><p") == ("<<<>>><p", "", [])


@pytest.mark.parametrize("page", ["<a " * 30000, '<a href="' * 20000, "<script>" * 20000, "<!--" * 20000, "<title>" * 9000])
def test_broken_pages_end(page):
    page_text(page)


@pytest.mark.parametrize("quote", "\"'")
def test_attributes_of_any_length(quote):
    value = f"{quote}{'x<p>y ' * 2000}{quote}"
    page = f"one<div data-x={value}>two</div><a data-x={value} href={quote}/y{quote}>three</a><a href={value}>"
    assert page_text(page) == ("one\ntwo\nthree", "", ["/y", "x<p>y " * 2000])


@pytest.mark.parametrize("unit", ["<a '\"", "<a \"'\"' x=", "<a x='", "<a \"", "<a '\"'\"'\" ", "<" + "a" * 50 + " '"])
def test_quotes_that_do_not_end_take_linear_time(unit):
    page_text(unit * (2_000_000 // len(unit)))
    page_text("<a x='" + "<a \"" * 100_000)


def test_a_record_is_what_any_reader_of_gzip_finds():
    data = gzip.decompress(record([("WARC-Type", "metadata"), ("X", "ü")], b"block"))
    head, block = data.split(b"\r\n\r\n")[:2]
    assert head.decode().split("\r\n") == [
        "WARC/1.1", "WARC-Type: metadata", "X: ü", f"WARC-Block-Digest: {sha(b'block')}", "Content-Length: 5",
    ]
    assert block == b"block" and data.endswith(b"block\r\n\r\n")


def test_damage_is_found_out():
    good = gzip.decompress(response(1, "http://x/", "page", "2024-01-01T00:00:00Z"))
    with pytest.raises(ValueError, match="digest"):
        parsed(good.replace(b"page", b"pige"))
    with pytest.raises(ValueError, match="cut short"):
        parsed(good[:-9])
    with pytest.raises(ValueError, match="not a WARC record"):
        parsed(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(ValueError, match="cut short"):
        list(members(io.BytesIO(gzip.compress(good)[:-20])))


def test_a_header_holds_no_line_ends():
    assert target("a b\r\nX: 1") == "a%20b%0D%0AX:%201" and target(None) == target("") == "about:blank"


def test_derivatives_keep_what_they_come_from():
    headers, block = parsed(gzip.decompress(response(7, "http://x/", PAGE, "2024-05-06T07:08:09Z")))
    row, *records = derived(headers, block)
    told = dict(headers)
    for kind, data in zip(("metadata", "conversion"), records, strict=True):
        own, content = parsed(gzip.decompress(data))
        own = dict(own)
        assert own["WARC-Type"] == kind and own["WARC-Record-ID"] == row[f"{kind}_id"]
        assert own["WARC-Refers-To"] == told["WARC-Record-ID"] == row["response_id"]
        assert (own["WARC-Date"], own["WARC-Target-URI"]) == ("2024-05-06T07:08:09Z", "http://x/")
        assert own["WARC-Block-Digest"] == sha(content)
    meta = json.loads(parsed(gzip.decompress(records[0]))[1])
    assert [tuple(h) for h in meta["WARC-Headers"]] == headers
    assert meta["HTTP-Status"] == "HTTP/1.1 200 OK" and meta["Links"] == ["/x?a=1&b=2", "/y"]
    assert meta["Payload-Digest"] == told["WARC-Payload-Digest"] == sha(PAGE.encode())
    assert len({row["response_id"], row["metadata_id"], row["conversion_id"]}) == 3


def test_rows_of_all_kinds(spark):
    files = write_responses(pages(spark, ROWS).repartition(3))
    paths = [r.path for r in files.collect()]
    assert sum(r.n_records for r in files.collect()) == len(ROWS)
    sources = {dict(h)["WARC-Record-ID"]: b for h, b in read_responses(paths)}
    assert len(sources) == len(ROWS) - 1  # the repeated row has its twin's id
    rows = derive(files).collect()
    by_id = {r.page_id: r for r in rows}
    assert len(rows) == len(ROWS) and set(by_id) == {1, 2, 3, 4, 5, None}
    for r in rows:
        page = next(p or "" for k, _, p in ROWS if k == r.page_id)
        assert r.payload_digest == sha(page.encode())
        text, title, links = page_text(page)
        assert (r.text_digest, r.title, r.n_links, r.n_chars) == (sha(text.encode()), title, len(links), len(text))
        headers, block = read_at(r.conversion_path, r.conversion_offset)
        assert block.decode() == text and dict(headers)["WARC-Record-ID"] == r.conversion_id
        headers, block = read_at(r.metadata_path, r.metadata_offset)
        assert sha(block) == r.metadata_digest and dict(headers)["WARC-Refers-To"] == r.response_id
        assert sources[r.response_id].endswith(page.encode())
    assert by_id[3].url == by_id[5].url == "about:blank"
    assert collected(derive(write_responses(pages(spark, [])))) == []


class Twin(HTMLParser):
    """Text, title and links of a page, by the parser of Python's library."""

    LINES = set(
        "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure "
        "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre "
        "section table tbody td tfoot th thead title tr ul".split()
    )

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.title, self.in_title, self.hidden = [], [], None, None, None
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in ("script", "style", "noscript", "template"):
            self.hidden = tag
        if tag in self.LINES:
            self.parts.append("\n")
        if tag == "title":
            self.in_title = ""
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
            return
        if tag in self.LINES:
            self.parts.append("\n")
        if tag == "title" and self.title is None:
            self.title = self.in_title

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.in_title is not None and self.title is None:
                self.in_title += data

    def told(self):
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(filter(None, lines)), " ".join((self.title or "").split()), self.links


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_pages_read_as_the_library_reads_them(spark, scale):
    rows = spark.read.parquet(f"/root/testdata/{scale}/pages.parquet").select("html").collect()
    assert len(rows) >= 250
    for r in rows:
        assert page_text(r.html) == Twin(r.html).told()


def http(headers, body, **warc):
    block = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + body
    told = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "WARC-Date": "2024-01-01T00:00:00Z"} | warc
    return derived([(k.replace("_", "-"), v) for k, v in told.items()], block)


def text_of(headers, body, **warc):
    row, _, conversion = http(headers, body, **warc)
    content = parsed(gzip.decompress(conversion))[1]
    assert row["n_chars"] == len(content.decode()) and row["text_digest"] == sha(content)
    return content.decode()


def test_responses_of_others():
    page = "<p>Café</p>"
    html = ("Content-Type", 'text/html; charset="iso-8859-1"')
    assert text_of([html], page.encode("latin-1")) == "Café"
    assert text_of([("content-type", "text/html;Charset=UTF-8")], page.encode()) == "Café"
    assert text_of([("Content-Type", "text/html; charset=no-such")], page.encode()) == "Café"
    assert text_of([("Content-Type", "text/html; charset=base64")], page.encode()) == "Café"
    for encoding, body in (
        ("gzip", gzip.compress(page.encode())),
        ("GZIP", page.encode()),  # decoded before it was archived
        ("deflate", zlib.compress(page.encode())),
        ("deflate", zlib.compress(page.encode())[2:-4]),
        ("identity", page.encode()),
        ("deflate, gzip", gzip.compress(zlib.compress(page.encode()))),
    ):
        assert text_of([("Content-Encoding", encoding)], body) == "Café", encoding
    assert text_of([("Content-Encoding", "br")], b"\x8b\x05\x80") == ""
    raw = page.encode()
    chunks = b"4\r\n" + raw[:4] + b"\r\n%X;x=1\r\n" % (len(raw) - 4) + raw[4:] + b"\r\n0\r\n\r\n"
    chunked = ("Transfer-Encoding", "chunked")
    assert text_of([chunked], chunks) == "Café"
    assert text_of([chunked], raw) == "Café"  # joined before it was archived
    assert text_of([chunked], chunks, WARC_Payload_Digest=sha(raw)) == "Café"
    assert text_of([chunked], chunks, WARC_Payload_Digest=sha(chunks)) == "Café"
    packed = gzip.compress(raw)
    assert text_of([chunked, ("Content-Encoding", "gzip")], b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n") == "Café"
    with pytest.raises(ValueError, match="payload"):
        http([html], raw, WARC_Payload_Digest=sha(b"other"))
    assert text_of([], raw, WARC_Payload_Digest="sha256:" + hashlib.sha256(raw).hexdigest()) == "Café"
    assert text_of([("Content-Type", "image/png")], b"\x89PNG") == ""
    assert text_of([("Content-Type", "text/plain")], b"a <b> c") == "a <b> c"
    row, meta, _ = http([], raw)
    assert row["url"] is None and "WARC-Target-URI" not in dict(parsed(gzip.decompress(meta))[0])
    told = [("WARC-Record-ID", "<urn:y>"), ("Content-Type", "text/dns")]
    row, *_ = derived(told, b"20240101\r\n\r\nx")
    assert (row["n_chars"], row["payload_digest"]) == (13, sha(b"20240101\r\n\r\nx"))


def test_any_level_of_gzip(spark):
    for level in (1, 9):
        rows = derive(write_responses(pages(spark, ROWS), level=level), level=level).collect()
        assert len(rows) == len(ROWS)
