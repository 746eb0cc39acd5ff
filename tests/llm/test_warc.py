import hashlib
import json
import time
from html.parser import HTMLParser

from loomwork.llm import queries, warc

SF = "/root/testdata/sf0.01"


class Plain(HTMLParser):
    """Text and links by the standard parser."""

    def __init__(self):
        super().__init__()
        self.words, self.links, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "template", "noscript")
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])
        self.words.append(" " if tag not in ("b", "i", "a", "em", "strong", "span", "u") else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "template", "noscript")
        self.words.append(" " if tag not in ("b", "i", "a", "em", "strong", "span", "u") else "")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_whole_table_against_parser(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    made = warc.derivatives(warc.responses(spark.read.parquet(f"{SF}/pages.parquet"))).collect()
    assert len(made) == 2 * len(pages)
    same = 0
    for r in made:
        headers, block = warc.parse(bytes(r.record))
        page = pages[r.page_id]
        plain = Plain()
        plain.feed(page.html)
        assert headers["WARC-Refers-To"] == r.refers_to == warc.record_id("response", str(page.page_id), page.url, warc.digest(page.html.encode()))
        assert headers["WARC-Block-Digest"] == r.block_digest == warc.digest(block)
        assert headers["WARC-Payload-Digest"] == warc.digest(page.html.encode())
        assert headers["WARC-Target-URI"] == page.url == r.target_uri and int(headers["Content-Length"]) == len(block)
        if r.warc_type == "conversion":
            same += block.decode().split() == "".join(plain.words).split()
        else:
            meta = json.loads(block)["Envelope"]
            assert meta["WARC-Header-Metadata"]["WARC-Record-ID"] == r.refers_to
            http = meta["Payload-Metadata"]["HTTP-Response-Metadata"]
            assert http["Response-Message"] == "HTTP/1.1 200 OK" and http["Headers"]["Content-Length"] == str(len(page.html.encode()))
            assert http["HTML-Metadata"]["Links"] == plain.links
    assert same >= 0.98 * len(pages)
    assert len({r.record_id for r in made}) == len(made)


def test_query_columns(spark):
    rows = queries.op8_warc(spark, SF).collect()
    assert {r.warc_type for r in rows} == {"metadata", "conversion"} and all(len(r.record_sha256) == 64 for r in rows)


def test_two_captures_differ():
    one, two = (warc.parse(warc.response("7", "http://a/", body))[0]["WARC-Record-ID"] for body in (b"x", b"y"))
    assert one != two


def test_scan():
    page = '<title>A &amp; B</title><!-- <a href="no"> --><p>1 < 2 <a class=x HREF = "u?a=1&amp;b=2">go</a><a href=\'v>w\'>x</a><a href=plain>y</a><style>p > q</style><script>var a = "</scripty>";</script >end<a name=z>'
    text, title, links = warc.scan(page)
    assert title == "A &amp; B" and links == ["u?a=1&b=2", "v>w", "plain"]
    assert warc.tidy(text) == "A & B\n1 < 2 gow'>xy end"
    assert warc.scan("a<!-- b")[0].strip() == "a" and warc.tidy(warc.scan("<script>kept")[0]) == "kept" and warc.scan("")[0] == ""


def test_hostile_pages_are_linear():
    for piece in ("<a ", "<script>", "<a href='", '<a href="x>', "<!--", "<title>", "</script", "<script></scripty>", "<a '\">", "<", "&lt", " \n"):
        page = piece * (1_000_000 // len(piece))
        began = time.process_time()
        warc.derive(warc.response("1", "http://a/", page.encode()))
        assert time.process_time() - began < 4, piece


def test_edges(spark):
    rows = [(1, None, None, "x"), (None, "http://a/\r\nX: 1", "<p>caf&eacute;<br>two</p><script>no</script>", "y"), (1, None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 6
    texts = [warc.parse(bytes(r.record))[1].decode() for r in made if r.warc_type == "conversion"]
    assert sorted(texts) == ["", "", "café\ntwo"]
    bad = spark.createDataFrame([(1, None), (2, b"nonsense"), (3, warc.record("request", {}, b"x"))], "page_id long, record binary")
    assert warc.derivatives(bad).count() == 0
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    assert warc.parse_headers(b"L\r\nA: 1\r\n  2\r\nB:3")[1] == {"A": "1 2", "B": "3"}
    assert warc.digest(b"") == "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"").digest()).decode()
