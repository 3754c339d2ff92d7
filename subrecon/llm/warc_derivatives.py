r"""WARC derivatives: metadata and plain-text conversion records of responses.

From each response (target URI, date, HTTP header lines, payload) two linked
records are made: a ``metadata`` record describing it and a ``conversion``
record holding its plain text. Both name the response in ``WARC-Refers-To``,
carry its URI and date, and have block digests of their own; the response's
payload digest and HTTP header lines are kept in the metadata block, and the
conversion names them too. Record identifiers are name-based: the same
response always gives the same identifiers, so a lost task that runs again
writes the same records.

Everything is a projection of built-in functions: no shuffle, no state.

Defined results: a null URI, header or date leaves its header line out; a
null or empty payload gives an empty block (Content-Length 0), whose digest
is that of no bytes; responses without an identifier get one from URI, date
and payload; repeated rows give repeated records; a payload of any length is read whole, at a cost in
proportion to it, and elements, comments and tags without an end are closed by the end of the text; other columns are left out;
an empty table gives no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
RECORD_COLUMNS = ("record_id", "record_type", "refers_to", "target_uri", "date", "content_type",
                  "content_length", "block_digest", "source_payload_digest", "block")

#: Elements whose content is no text of the page.
HIDDEN = ("script", "style", "title", "noscript", "template")
#: Steps from HTML to text, in order: comments and hidden elements (whichever begins first; without an end they reach
#: to the end of the text), block ends, other tags (a tag begins with a letter, ``/`` and a letter, ``!`` or ``?``).
#: No pattern looks at a character more than a few times, whatever the text.
TAG_STEPS = (
    ("(?is)<!--(?:.*?-->|.*)" + "".join(rf"|<{e}(?:[\s/>].*?</{e}\s*>|[\s/>].*|$)" for e in HIDDEN), " "),
    (r"(?i)<br\s*/?>|</(p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer)\s*>", "\n"),
    (r"</?[A-Za-z!?][^<>]*>?", ""),
)
#: Named character references that are decoded, the ampersand last.
NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
SPACE_STEPS = (
    (r"[ \t\r]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numeric_references(text: Column) -> Column:
    """``&#38;`` and ``&#x26;`` as the characters that they stand for.

    Numbers that are no character (0, surrogates, beyond 10FFFF) stay as they are written.
    """
    def decoded(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"^0*([0-9]{1,7});", 1)
        hexadecimal = F.regexp_extract(piece, r"^[xX]0*([0-9A-Fa-f]{1,6});", 1)
        number = F.when(decimal != "", decimal.cast("long")).when(
            hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long"))
        known = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, number)), 8, "0")), "UTF-32")
        return F.when(known, F.concat(char, F.regexp_replace(piece, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), piece))

    return _once(F.split(text, "&#", -1), lambda pieces: F.concat(F.get(pieces, F.lit(0)), F.array_join(
        F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded), "")))


def html_text(html: Column) -> Column:
    """Plain text of an HTML payload; null counts as empty."""
    out = F.coalesce(html, F.lit(""))
    for pattern, to in TAG_STEPS:
        out = F.regexp_replace(out, pattern, to)
    out = _once(out, lambda x: F.when(F.contains(x, F.lit("&#")), numeric_references(x)).otherwise(x))
    for name, to in NAMED:
        out = F.replace(out, F.lit(name), F.lit(to))
    for pattern, to in SPACE_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return out


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_uuid(*parts: Column) -> Column:
    """A name-based identifier ``<urn:uuid:...>`` from the parts."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")


def derive(responses: DataFrame, uri: str = "target_uri", payload: str = "payload", date: str = "date",
           http_headers: str = "http_headers", record_id: str = "record_id") -> DataFrame:
    """Two rows per response (``RECORD_COLUMNS``): its metadata and its conversion."""
    c = {k: F.col(f"`{v}`") for k, v in
         {"uri": uri, "payload": payload, "date": date, "http": http_headers}.items()}
    source = F.coalesce(F.col(f"`{record_id}`"), record_uuid(F.lit("response"), c["uri"], c["date"], c["payload"]))
    r = responses.select(
        source.alias("refers_to"), c["uri"].alias("target_uri"), c["date"].alias("date"),
        digest(F.coalesce(c["payload"], F.lit(""))).alias("source_payload_digest"),
        F.coalesce(c["http"], F.lit("")).alias("__http"), html_text(c["payload"]).alias("__text"),
        F.octet_length(F.coalesce(c["payload"], F.lit(""))).cast("string").alias("__length"))
    meta = F.concat(
        _line("source-content-length", F.col("__length")), _line("source-payload-digest", F.col("source_payload_digest")),
        _line("converted-content-length", F.octet_length("__text").cast("string")),
        F.when(F.col("__http") == "", "").otherwise(F.concat(F.regexp_replace(
            F.col("__http"), r"(?m)^(?=[^\r\n])", "source-header: "), F.lit(CRLF))))
    both = r.select("refers_to", "target_uri", "date", "source_payload_digest", F.explode(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"),
                 meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"),
                 F.col("__text").alias("block")))).alias("x")).select("*", "x.*")
    return both.select(
        record_uuid(F.col("record_type"), F.col("refers_to")).alias("record_id"), "record_type", "refers_to",
        "target_uri", "date", "content_type", F.octet_length("block").cast("long").alias("content_length"),
        digest(F.col("block")).alias("block_digest"), "source_payload_digest", "block")


def render(records: DataFrame) -> DataFrame:
    """Adds ``warc``: each record as the text of a WARC/1.1 record."""
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Refers-To", F.col("refers_to")), _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Date", F.col("date")), _line("WARC-Block-Digest", F.col("block_digest")),
        _line("Content-Type", F.col("content_type")), _line("Content-Length", F.col("content_length").cast("string")))
    return records.withColumn("warc", F.concat(head, F.lit(CRLF), F.col("block"), F.lit(CRLF * 2)))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the rendered records as WARC files, one a partition."""
    # the two line ends that close each record are the writer's separator
    body = F.expr("substring(warc, 1, length(warc) - 4)")
    render(records).select(body).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)
