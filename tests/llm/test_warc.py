"""Derivatives of hand-made responses."""

import gzip
import hashlib
import time
from pathlib import Path

from tripleweave.llm import warc

PAGE = (
    '<html lang="en"><head><title>A\n title </title><style>p{}</style></head><body><nav>menu</nav><!-- <p>no</p> -->'
    '<p>One &amp;amp; <b>two</b></p><script>var t="</p>";</script><p>é &lt;3</p><a href="/x">link</a></body></html>'
)


def test_derivatives_of_a_page(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", PAGE, "x"), (None, None, None, None)], "page_id bigint, url string, html string, block string")
    responses = warc.responses(pages)
    source = {r.uri: r for r in responses.collect()}
    made = {(r.uri, r.type): r for r in warc.derive(responses).collect()}
    assert len(made) == 4
    text, about = made["http://a.b/c", "conversion"], made["http://a.b/c", "metadata"]
    assert bytes(text.block).decode() == "One &amp; two\né <3\nlink"
    assert text.block_digest == "sha256:" + hashlib.sha256(bytes(text.block)).hexdigest()
    origin = source["http://a.b/c"]
    assert text.refers_to == about.refers_to == origin.record_id
    assert about.concurrent_to == text.record_id
    lines = bytes(about.block).decode().split("\r\n")
    assert lines == [
        "http-status: 200",
        "http-content-type: text/html; charset=utf-8",
        "http-header: Content-Type: text/html; charset=utf-8",
        f"http-header: Content-Length: {len(PAGE.encode())}",
        f"source-block-digest: {origin.block_digest}",
        "source-payload-digest: sha256:" + hashlib.sha256(PAGE.encode()).hexdigest(),
        "title: A title",
        "language: en",
        "outlink: /x",
        "",
    ]
    assert bytes(made[None, "conversion"].block) == b""
    assert warc.derive(responses.limit(0)).count() == 0


def test_blocks_that_are_no_response(spark):
    rows = [("<r>", "response", "u", "d", bytearray(b"plain \xff bytes\r\n\r\nmore")), ("<q>", "request", "u", "d", bytearray(b"x"))]
    schema = "record_id string, type string, uri string, date string, block binary"
    records = spark.createDataFrame(rows, schema).selectExpr(
        "*", "CAST(NULL AS STRING) AS block_digest", "CAST(NULL AS STRING) AS payload_digest"
    )
    made = {r.type: r for r in warc.derive(records).collect()}
    assert set(made) == {"conversion", "metadata"}
    assert bytes(made["conversion"].block).decode() == "plain \ufffd bytes more"
    assert b"http-status" not in bytes(made["metadata"].block)


def test_written_files_are_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", PAGE) for i in range(5)], "page_id bigint, url string, html string")
    made = warc.derive(warc.responses(pages))
    warc.write(made, str(tmp_path / "out"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path / "out").glob("*.gz")))
    seen = []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        block, data = data[:size], data[size:]
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert data.startswith(b"\r\n\r\n")
        data = data[4:]
        seen.append(fields["WARC-Record-ID"])
    assert sorted(seen) == sorted(r.record_id for r in made.collect())


def made_of(spark, blocks):
    rows = [(str(i), "response", "u", "d", bytearray(b)) for i, b in enumerate(blocks)]
    schema = "record_id string, type string, uri string, date string, block binary"
    records = spark.createDataFrame(rows, schema).selectExpr(
        "*", "CAST(NULL AS STRING) AS block_digest", "CAST(NULL AS STRING) AS payload_digest"
    )
    return {(int(r.refers_to), r.type): bytes(r.block).decode() for r in warc.derive(records).collect()}


def test_marks_left_open(spark):
    pages = [
        b"<p>a</p><!-- b <p>c</p>",
        b"<p>a</p><script>b <p>c</p>",
        b"<head><title>t<p>a</p>",
        b"<nav>a</nav>b<nav>c",
        b"<p>1 < 2</p> 3 < 4",
        b"<script>x = '<!--'</script><p>a</p>",
        b"<a>x</a><A title=\"y\" href=\"/z\">y</a><a href=\"/open",
    ]
    found = made_of(spark, pages)
    texts = [found[i, "conversion"] for i in range(len(pages))]
    assert texts == ["a", "a", "t\na", "bc", "1 < 2\n3 < 4", "a", "xy<a href=\"/open"]
    assert [x for x in found[6, "metadata"].split("\r\n") if x.startswith("outlink")] == ["outlink: /z"]


def test_long_pages_of_open_marks(spark):
    marks = ["<!--x", "<script ", "<style ", "<head ", "<nav ", "<title ", "<html ", "<a ", "<p ", "<", 'href="', "> <a "]
    began = time.monotonic()
    found = made_of(spark, [(m * (1_000_000 // len(m))).encode() for m in marks])
    assert len(found) == 2 * len(marks)
    assert time.monotonic() - began < 60


def test_charsets_and_repeated_rows(spark):
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={}\r\n\r\n"
    latin = head.format('"ISO-8859-1"').encode() + b"caf\xe9 \x80"
    found = made_of(spark, [latin, head.format("utf-8").encode() + "é".encode(), head.format("x-none").encode() + b"\xff"])
    assert [found[i, "conversion"] for i in range(3)] == ["café €", "é", "\ufffd"]
    pages = spark.createDataFrame([(1, "u", PAGE)] * 3, "page_id bigint, url string, html string")
    assert warc.derive(warc.responses(pages)).count() == 6


def test_each_step_of_the_text_is_in_the_plan_once(spark):
    pages = spark.createDataFrame([(1, "u", "a \t\n <p> b</p>\r\n\r\n c  d <br>\x0b e")], "page_id bigint, url string, html string")
    texts = pages.select(warc.page_text(pages["html"]).alias("text"))
    assert texts.first().text == "a\nb\nc d\ne"
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<script") + plan.count("script\\b") <= 2
