"""WARC derivatives: metadata and plain-text conversion records for response records.

Records are rows: ``record_id, type, uri, date, content_type, refers_to, concurrent_to, block_digest,
payload_digest, block`` with the block as binary. From each response come one conversion record with the
text of its page and one metadata record with what the response said about itself: status, headers, digests
and the page's title, language and links. All header lines are written as ``http-header``, in order, with
repeats and with continued lines joined. Both name the response in ``refers_to``; the metadata record also
names the conversion, as made at the same time. Ids are hashes of what they stand for, so that a task that
runs twice makes the same records. Everything is DataFrame functions, row by row, without a shuffle.

Text is found in time that grows with the length of the page, whatever is left open in it: a comment, script
or style without an end goes on to the end of the page; a ``head`` or ``nav`` without an end hides nothing, and
a ``<`` with no ``>`` after it is text. A tag ends at its first ``>``; links are the double-quoted ``href`` of
``a`` tags, the language is that of the first ``html`` tag.

Defined cases: a null html is a response with an empty body, and has an empty conversion. A null url leaves
the target out. Repeated pages give repeated records; a null page id counts as empty in the id. Blocks that
are no HTTP response have no headers, and all of the block as body. Other columns are ignored. Empty tables
give no records. A body is read as Windows-1252 where its Content-Type names one of ``LATIN``, else as UTF-8,
with bytes that are none replaced; digests are always of the bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
FIELDS = {
    "type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "concurrent_to": "WARC-Concurrent-To",
    "block_digest": "WARC-Block-Digest",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
# Elements whose content is not text of the page, and elements that start a new line.
RAW = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script>|\z)|style\b.*?(?:</style>|\z))"
SILENT = ["head", "nav"]
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|main|body|html)\b[^>]*>"
# The entities of markup itself and the commonest other one.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
# Names that stand for Windows-1252, and its characters from byte 0x80 on (undefined ones stay).
LATIN = ["windows-1252", "cp1252", "iso-8859-1", "iso8859-1", "latin1", "us-ascii", "ascii"]
LATIN_80 = bytes(range(0x80, 0xA0)).decode("latin-1")
WINDOWS_80 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(kind: str, *parts: Column) -> Column:
    """A URN of a UUID's form from a hash of the parts, each with its length before it."""
    texts = (F.coalesce(p.cast("string"), F.lit("")) for p in parts)
    hashed = F.md5(F.concat(F.lit(kind), *(F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts)))
    form = F.regexp_replace(hashed, r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5")
    return F.concat(F.lit("<urn:uuid:"), form, F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of ``pages(page_id, url, html)``, as a server would have answered."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF + CRLF),
    )
    made = pages.select("page_id", "url", body.alias("body"), F.concat(head.cast("binary"), body).alias("block"))
    return made.select(
        record_id("response", F.col("page_id"), F.col("url"), F.sha2("block", 256)).alias("record_id"),
        F.lit("response").alias("type"),
        F.col("url").alias("uri"),
        F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("string").alias("concurrent_to"),
        digest(F.col("block")).alias("block_digest"),
        digest(F.col("body")).alias("payload_digest"),
        "block",
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _tags(text: Column) -> Column:
    """The text up to its last ``>``."""
    return F.substr(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, ">", -1)))


def _replace_closed(text: Column, end: str, pattern: str, by: str) -> Column:
    """Replace a pattern that ends in ``end``, searched only where an end still follows.

    So no search runs to the end of the text in vain, and again from the next opening mark.
    """
    joined = lambda t, closed: F.concat(F.regexp_replace(closed, pattern, by), F.substr(t, F.length(closed) + 1))
    return _once(text, lambda t: _once(F.regexp_extract(t, f"(?is)^.*{end}", 0), lambda closed: joined(t, closed)))


def page_text(html: Column) -> Column:
    """The text of a page: one line per block, white space collapsed, markup's entities resolved once."""
    out = F.regexp_replace(html, RAW, " ")
    for name in SILENT:
        out = _replace_closed(out, f"</{name}>", rf"(?is)<{name}\b.*?</{name}>", " ")
    out = F.regexp_replace(out, r"[\r\n\t\x0b\x0c]", " ")
    marked = lambda t: F.regexp_replace(F.regexp_replace(_tags(t), BREAKS, "\n"), "<[^>]*>", "")
    out = _once(out, lambda t: F.concat(marked(t), F.substring_index(t, ">", -1)))
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    # A search that starts at line breaks only is quicker than one that starts at every space.
    out = F.replace(F.regexp_replace(out, " {2,}", " "), F.lit(" \n"), F.lit("\n"))
    out = F.regexp_replace(out, r"\n[ \n]+", "\n")
    return F.trim(out, F.lit(" \n"))


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)\r\n{name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def derive(records: DataFrame) -> DataFrame:
    """Conversion and metadata records of the response records among ``records``."""
    # Bytes are searched as they are; the head's length in bytes tells where the body begins.
    before = F.substring_index(F.col("block").cast("string"), CRLF + CRLF, 1)
    split = F.octet_length(before)
    http = before.startswith("HTTP/") & (split < F.octet_length("block"))
    parts = (
        records.filter("type = 'response'")
        .withColumn("__head", F.when(http, F.concat(before, F.lit(CRLF))).otherwise(""))
        .withColumn("__body", F.when(http, F.substr("block", split + 5)).otherwise(F.col("block")))
        .withColumn("__kind", _utf8(_header(F.col("__head"), "Content-Type")))
        .withColumn("__html", _decoded(F.col("__body"), F.col("__kind")))
        .withColumn("__tags", _tags(F.col("__html")))
    )
    after_title = F.regexp_extract("__tags", r"(?is)<title\b[^>]*>(.*)", 1)
    first_html = F.regexp_extract("__tags", r"(?i)<html\b([^>]*)>", 1)
    anchors = F.regexp_extract_all("__tags", F.lit(r"(?i)<a\b([^>]*)>"), F.lit(1))
    href = r'(?is)^.*\bhref="([^"]*)"'
    said = parts.select(
        "record_id",
        "uri",
        "date",
        "block_digest",
        F.coalesce("payload_digest", digest(F.col("__body"))).alias("payload_digest"),
        F.regexp_extract("__head", r"^HTTP/[0-9.]+ ([0-9]+)", 1).alias("status"),
        F.col("__kind").alias("kind"),
        *(_utf8(_header(F.col("__head"), n)).alias(k) for k, n in (("server", "Server"), ("changed", "Last-Modified"))),
        F.regexp_extract_all(F.regexp_replace(_utf8(F.col("__head")), r"\r\n[ \t]+", " "), F.lit(r"\r\n([^\r\n]+)"), F.lit(1)).alias("headers"),
        F.regexp_extract(after_title, r"(?is)^(.*?)</title>", 1).alias("title"),
        F.regexp_extract(first_html, r'(?is)^.*\blang="([^"]*)"', 1).alias("lang"),
        F.transform(
            F.filter(anchors, lambda x: x.rlike(href)), lambda x: F.regexp_extract(x, href, 1)
        ).alias("links"),
        page_text(F.col("__html")).alias("text"),
    )
    told = said.withColumn("conversion_id", record_id("conversion", F.col("record_id"))).withColumn(
        "block", F.col("text").cast("binary")
    )
    line = lambda name, value: F.when(
        value != "", F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r" *[\r\n]+ *", " "), F.lit(CRLF))
    )
    about = F.concat_ws(
        "",
        line("http-status", F.col("status")),
        line("http-content-type", F.col("kind")),
        line("http-server", F.col("server")),
        line("http-last-modified", F.col("changed")),
        F.array_join(F.transform("headers", lambda x: F.concat(F.lit("http-header: "), x, F.lit(CRLF))), ""),
        line("source-block-digest", F.col("block_digest")),
        line("source-payload-digest", F.col("payload_digest")),
        line("title", F.trim("title")),
        line("language", F.col("lang")),
        F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r" *[\r\n]+ *", " "), F.lit(CRLF))), ""),
    )
    kinds = F.array(
        F.struct(
            F.col("conversion_id").alias("record_id"),
            F.lit("conversion").alias("type"),
            F.lit("text/plain; charset=utf-8").alias("content_type"),
            F.lit(None).cast("string").alias("concurrent_to"),
            F.col("block").alias("block"),
        ),
        F.struct(
            record_id("metadata", F.col("record_id")).alias("record_id"),
            F.lit("metadata").alias("type"),
            F.lit("application/warc-fields").alias("content_type"),
            F.col("conversion_id").alias("concurrent_to"),
            about.cast("binary").alias("block"),
        ),
    )
    made = told.select(F.col("record_id").alias("refers_to"), "uri", "date", F.explode(kinds).alias("k"))
    return made.select(
        "k.record_id",
        "k.type",
        "uri",
        "date",
        "k.content_type",
        "refers_to",
        "k.concurrent_to",
        digest(F.col("k.block")).alias("block_digest"),
        F.lit(None).cast("string").alias("payload_digest"),
        "k.block",
    )


def _utf8(data: Column) -> Column:
    """Bytes as text, what is no UTF-8 replaced."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.make_valid_utf8(data.cast("string")))


def _decoded(body: Column, kind: Column) -> Column:
    """A body as text, by the charset of its Content-Type."""
    charset = F.lower(F.regexp_extract(F.coalesce(kind, F.lit("")), r"""(?i)charset *= *["']?([^\s;"']+)""", 1))
    latin = F.translate(F.decode(body, "ISO-8859-1"), LATIN_80, WINDOWS_80)
    return F.when(charset.isin(LATIN), latin).otherwise(_utf8(body))


def serialise(records: DataFrame) -> DataFrame:
    """``(record_id, record)``: every record as the bytes of a WARC file, ready to be joined in any order."""
    named = (
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.regexp_replace(c, r" *[\r\n]+ *", " "), F.lit(CRLF)))
        for c, n in FIELDS.items()
    )
    length = F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF))
    head = F.concat(F.concat_ws("", F.lit(VERSION + CRLF), *named), length)
    end = F.lit(CRLF + CRLF).cast("binary")
    return records.select("record_id", F.concat(head.cast("binary"), F.col("block"), end).alias("record"))


def write(records: DataFrame, path: str) -> None:
    """Write records of text blocks as compressed WARC files; conversion and metadata records always are."""
    body = F.expr("substring(record, 1, octet_length(record) - 1)")
    serialise(records).select(body.cast("string").alias("value")).write.option("compression", "gzip").text(path)
