"""Headers of foreign responses are kept whole."""

from tripleweave.llm import warc


def test_all_headers_in_order_with_repeats(spark):
    lines = [
        "Date: Mon, 01 Jan 2024 00:00:00 GMT",
        "Content-Type: text/html",
        "Set-Cookie: a=1",
        "Content-Language: fr",
        "set-cookie: b=2",
        "ETag: \"x\"",
        "Content-Length: 999",
    ]
    block = "\r\n".join(["HTTP/1.1 301 Moved", *lines]) + "\r\n\r\n<p>x</p>"
    folded = "HTTP/1.1 200 OK\r\nX-Long: one\r\n  two\r\n\r\nX-Body: no"
    wrong = "HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nx"
    schema = "record_id string, type string, uri string, date string, block binary"
    rows = [(k, "response", "u", "d", bytearray(b.encode())) for k, b in (("a", block), ("b", folded), ("c", wrong))]
    records = spark.createDataFrame(rows, schema).selectExpr("*", "CAST(NULL AS STRING) AS block_digest", "CAST(NULL AS STRING) AS payload_digest")
    found = {r.refers_to: bytes(r.block).decode().split("\r\n") for r in warc.derive(records).filter("type = 'metadata'").collect()}
    kept = {k: [x.removeprefix("http-header: ") for x in v if x.startswith("http-header: ")] for k, v in found.items()}
    assert kept == {"a": lines, "b": ["X-Long: one two"], "c": ["Content-Length: 5"]}
