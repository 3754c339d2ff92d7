import hashlib

from subrecon.llm import warc_derivatives as wd

SCHEMA = "record_id string, target_uri string, date string, http_headers string, payload string"


def parse(text):
    head, _, rest = text.partition("\r\n\r\n")
    lines = head.split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    raw = rest.encode()
    n = int(fields["Content-Length"])
    assert lines[0] == "WARC/1.1" and raw[n:] == b"\r\n\r\n"
    return fields, raw[:n]


def test_round_trip(spark):
    rows = [("<urn:uuid:1>", "http://a/é", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX: y", "<p>Hi &amp; é</p><script>x</script>"),
            (None, None, None, None, None), ("<urn:uuid:3>", "http://b/", None, "", ""), (None, "http://c/", None, None, "x" * 200_000)]
    records = wd.render(wd.derive(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(records) == 2 * len(rows)
    ids = {r["record_id"] for r in records}
    assert len(ids) == len(records)
    for r in records:
        fields, block = parse(r["warc"])
        assert block.decode() == r["block"] and len(block) == r["content_length"]
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert fields["WARC-Refers-To"] == r["refers_to"]
        assert ("WARC-Target-URI" in fields) == (r["target_uri"] is not None)
    one = {r["record_type"]: r for r in records if r["refers_to"] == "<urn:uuid:1>"}
    assert one["conversion"]["block"] == "Hi & é"
    assert "source-header: HTTP/1.1 200 OK\r\nsource-header: X: y\r\n" in one["metadata"]["block"]
    assert one["metadata"]["source_payload_digest"] == "sha256:" + hashlib.sha256(rows[0][4].encode()).hexdigest()


def test_written_files_hold_the_records(spark, tmp_path):
    import gzip

    rows = [(f"<urn:uuid:{i}>", f"http://a/{i}", None, None, f"<p>text {i}\n\nline</p>") for i in range(20)]
    wd.write(wd.derive(spark.createDataFrame(rows, SCHEMA)).coalesce(1), str(tmp_path / "w"))
    raw = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("part-*"))
    at = n = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at) + 4
        size = int(dict(x.split(b": ", 1) for x in raw[at:end - 4].split(b"\r\n")[1:])[b"Content-Length"])
        at, n = end + size + 4, n + 1
    assert n == 40


def test_repeats_empty_table_extra_columns(spark):
    row = (None, "http://a/", None, None, "<p>x</p>")
    df = spark.createDataFrame([row, row], SCHEMA).selectExpr("*", "1 AS block", "2 AS refers_to")
    got = wd.derive(df).collect()
    assert len(got) == 4 and len({r["record_id"] for r in got}) == 2
    assert wd.derive(df.limit(0)).count() == 0


def texts(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, h string")
    return [r[0] for r in df.orderBy("i").select(wd.html_text(df["h"])).collect()]


def test_text_of_pages(spark):
    cases = {
        "<head><style>a > b</style><title>MYTITLE</title></head>hi": "hi",
        '<script>var s="</style>"; LEAKED=1</script>seen': "seen",
        "5 < 6 and 7 > 3": "5 < 6 and 7 > 3",
        "a<!-- <script> -->b<script><!-- </script>c": "a b c",
        "x<!-- never closed": "x", "x<script>never closed": "x", "x<SCRIPT": "x", "<scripty>y</scripty>": "y",
        "<p>one</p><p>two<br/>three</p>": "one\ntwo\nthree",
        "&lt;b&gt; &amp;amp; &amp;#39; &#39;&#x41;&#x1F600;&#233;&nbsp;&quot;&apos;": "<b> &amp; &#39; 'A\U0001F600é \"'",
        "&#0; &#xD800; &#1114112; &#99999999; &#x; &# &#65": "&#0; &#xD800; &#1114112; &#99999999; &#x; &# &#65",
        "<!DOCTYPE html><html lang='é'>é</html><?xml version?>": "é", "a <b": "a", "<": "<", "": "", None: "",
        "  a \t b \r\n \n c  ": "a b\nc",
    }
    assert dict(zip(cases, texts(spark, list(cases)))) == cases


def test_long_payloads_cost_their_length(spark):
    import time

    began = time.time()
    n = 1_000_000
    got = texts(spark, ["<" * n, "<!--" * (n // 4), "<script" * (n // 7), "<script>" * (n // 8), "<a" * (n // 2), "&#" * (n // 2),
                        "</script " * (n // 9), "<b " + "x " * n, " \n" * (n // 2), "&#39;" * (n // 5), "<p>" + "w </p>" * (n // 6)])
    assert time.time() - began < 60
    assert [len(x) for x in got] == [n, 0, 0, 0, 0, n, 0, 0, 0, n // 5, 2 * (n // 6) - 1]
