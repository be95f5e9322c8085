import json

from pyspark.sql import functions as F

from lattica.llm import warc as W

PAGES = [
    (1, "http://a.example/x", '<html><head><title>A &amp; "B"</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><p>One<br>two &lt;3</p><a class="k" href="/y?a=1">link\n here</a></body></html>'),
    (2, None, None),
    (3, "http://b.example/", ""),
    (3, "http://b.example/", ""),
    (None, "http://c.example/", "plain é 🙂 text\\ \t"),
    (4, "http://d.example/", "<p>" + "long word " * 60_000 + "</p>"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as block", "1 as record_id")


def test_derivatives_refer_to_their_response(spark):
    responses = W.responses(pages(spark))
    out = W.derive(responses, ["page_id"]).collect()
    source = {r["record_id"]: r for r in responses.collect()}
    assert len(out) == 2 * len(PAGES)
    for r in out:
        s = source[r["refers_to"]]
        assert (r["target_uri"], r["date"], r["payload_digest"]) == (s["target_uri"], s["date"], s["payload_digest"])
        assert r["content_length"] == len(r["block"].encode()) and r["record_id"] != r["refers_to"]
    by = {(r["page_id"], r["record_type"]): r["block"] for r in out}
    meta = json.loads(by[1, "metadata"])
    assert meta["status"] == "200" and meta["title"] == 'A & "B"' and meta["links"] == ["/y?a=1"] and meta["content_type"] == "text/html; charset=utf-8"
    assert by[1, "conversion"] == 'A & "B"\nOne\ntwo <3\nlink\nhere'
    assert by[2, "conversion"] == by[3, "conversion"] == "" and by[None, "conversion"] == "plain é 🙂 text\\"
    assert len(by[4, "conversion"]) == len(("long word " * 60_000).strip())
    for (_, kind), block in by.items():
        if kind == "metadata":
            json.loads(block)


def test_records_survive_a_round_trip_through_files(spark, tmp_path):
    responses = W.responses(pages(spark))
    both = responses.select(*W.FIELDS).unionByName(W.derive(responses, ["page_id"]).select(*W.FIELDS)).repartition(2)
    for compression in ("gzip", None):
        W.write_warc(both, f"{tmp_path}/{compression}", compression)
        back = W.read_warc(spark, f"{tmp_path}/{compression}")
        raw = lambda v: bytes(v) if isinstance(v, bytearray) else v.encode() if isinstance(v, str) else v or b""
        key = lambda rows: sorted((tuple(raw(r[c]) for c in W.FIELDS) for r in rows), key=str)
        want = [r for r in both.collect()]
        assert key(back.collect()) == key(want)
        again = W.derive(back.drop("headers"), []).select(*W.FIELDS)
        assert key(again.collect()) == key(W.derive(responses, []).collect())


def test_a_cut_block_is_null(spark, tmp_path):
    rec = W.responses(pages(spark)).filter("page_id = 1").withColumn("content_length", F.lit(7).cast("long"))
    W.write_warc(rec, f"{tmp_path}/w", None)
    assert [r["block"] for r in W.read_warc(spark, f"{tmp_path}/w").collect()] == [None]


def test_no_pages(spark):
    assert W.derive(W.responses(pages(spark).limit(0)), ["page_id"]).count() == 0


def response(block, **more):
    return {"record_type": "response", "record_id": "<urn:uuid:1>", "refers_to": None, "target_uri": "http://x.example/", "date": "2024-05-05T00:00:00Z", "content_type": "application/http; msgtype=response", "payload_digest": "sha1:Z", "block_digest": "sha1:Y", "content_length": len(block), "block": block} | more


KIND = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, content_length long, block binary"


def test_blocks_may_hold_any_bytes(spark, tmp_path):
    """Blocks with the separator, a whole record head, bytes that are not UTF-8, bare line ends, and nothing."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    blocks = [head + b"<p>a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb</p>", head + b"<p>caf\xe9 \xff\xfe</p>", head + b"\r\n\r\n", b"", b"\n\nx\n", bytes(range(256)) * 300]
    df = spark.createDataFrame([response(b, record_id=f"<urn:uuid:{i}>") for i, b in enumerate(blocks)], KIND)
    for compression in ("gzip", None):
        W.write_warc(df.coalesce(1), f"{tmp_path}/{compression}", compression)
        back = W.read_warc(spark, f"{tmp_path}/{compression}")
        assert {r["record_id"]: bytes(r["block"]) for r in back.collect()} == {f"<urn:uuid:{i}>": b for i, b in enumerate(blocks)}
        text = {r["refers_to"]: r["block"] for r in W.derive(back, []).filter("record_type = 'conversion'").collect()}
        assert text["<urn:uuid:1>"] == "caf\ufffd \ufffd\ufffd" and text["<urn:uuid:3>"] == ""
        meta = {r["refers_to"]: json.loads(r["block"]) for r in W.derive(back, []).filter("record_type = 'metadata'").collect()}
        assert meta["<urn:uuid:1>"]["body_bytes"] == len(blocks[1]) - len(head)
        assert {"name": "WARC-Payload-Digest", "value": "sha1:Z"} in meta["<urn:uuid:0>"]["warc_headers"]


def test_cut_and_damaged_files_keep_what_came_before():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    wrong = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nabcd\r\n\r\n"
    nothing = b"WARC/1.1\r\nWARC-Type: y\r\n\r\nabcd\r\n\r\n"
    blocks = lambda data: [b for _, b in W.records_of(data)]
    assert blocks(one + wrong + nothing + one) == [b"abcd", None, None, b"abcd"]
    assert blocks(one + one[:-7]) == [b"abcd", None]
    assert blocks(gzip.compress(one) + gzip.compress(one)) == [b"abcd"] * 2
    assert blocks(gzip.compress(one) + gzip.compress(one)[:-12])[:1] == [b"abcd"]
    assert blocks(b"") == [] and blocks(b"junk\r\n" + one) == [b"abcd"]


def test_all_source_headers_links_and_references_are_kept(spark):
    head = "HTTP/1.1 404 Not Found\r\nServer: a:b\r\nLast-Modified: Mon, 1 Jan 2024\r\nLink: <x>;\r\n  rel=next\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nContent-Type: text/html\r\n\r\n"
    body = """<title>a\x01&#8217;s</title><a href='/one'>1</a><a class=x href=/two>2</a><A data-href="/no" HREF = "/three?a=1&amp;b=2">3</A><a name=q>4</a>
<p>&#x1F642; &eacute; &amp;lt; &nosuch; &#0; &#xD800; & &Omega;</p>"""
    df = spark.createDataFrame([response((head + body).encode())], KIND)
    for records in (df, df.withColumn("block", F.col("block").cast("string"))):
        by = {r["record_type"]: r["block"] for r in W.derive(records, []).collect()}
        meta = json.loads(by["metadata"])
        assert meta["status"] == "404" and meta["title"] == "a\x01\u2019s" and meta["links"] == ["/one", "/two", "/three?a=1&b=2"]
        assert [(h["name"], h["value"]) for h in meta["http_headers"]] == [("Server", "a:b"), ("Last-Modified", "Mon, 1 Jan 2024"), ("Link", "<x>; rel=next"), ("Set-Cookie", "a=1"), ("Set-Cookie", "b=2"), ("Content-Type", "text/html")]
        assert by["conversion"].split("\n")[-1] == "\U0001f642 é &lt; &nosuch; \ufffd \ufffd & Ω"
