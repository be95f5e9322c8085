"""WARC derivatives: metadata and plain-text conversion records of responses.

`responses` makes response records of fetched pages; `parse_responses` reads response blocks (HTTP head and
body) from records; `derive` builds, for each response, a `metadata` record (JSON: status, every header of the source, title, links,
sizes) and a `conversion` record (plain text).  Both name the response in WARC-Refers-To, carry its target, date and
payload digest, and have an id derived from it, so that a second run gives the same records.  `record_text` is
the record as it stands in a file; `write_warc` and `read_warc` store and read records with Spark.  Reading follows each
record's Content-Length, so a block may hold any bytes, line ends and record heads among them.

`derive` is DataFrame functions on single rows: no shuffle, no memory beyond a row.  Blocks may be text or binary; bytes of a body
that are not UTF-8 become U+FFFD in derived text only.  Null html counts as empty, null url as an empty target; very long pages are
read whole; pages with equal ids give records with equal ids, repeated rows repeated records; an empty table gives none; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRLF = "\r\n"
SPACE = r"[ \t\n\x0B\f\r]"
FIELDS = ["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "content_length", "block"]


def _uuid(text: Column) -> Column:
    h = F.md5(text)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record for each page: the columns of FIELDS after id_col."""
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    key = F.concat_ws("|", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF * 2))
    out = pages.select(F.col(id_col), _uuid(key).alias("record_id"), url.alias("target_uri"), _digest(html).alias("payload_digest"), F.concat(head, html).alias("block"))
    return out.select(
        id_col, F.lit("response").alias("record_type"), "record_id", F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"), "payload_digest", _digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"), "block",
    )


ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,15});"
ENTITY_NAMES = sorted(name2codepoint)  # HTML 4, from the standard library


def read_entities(text: Column) -> Column:
    """Numeric and named character references as characters, in one pass (so `&amp;lt;` is `&lt;`); others stay as they are."""
    names, points = F.array(*(F.lit(n) for n in ENTITY_NAMES)), F.array(*(F.lit(name2codepoint[n]).cast("long") for n in ENTITY_NAMES))

    def named(p: Column) -> Column:
        return F.struct(p.alias("part"), F.regexp_extract(p, ENTITY, 1).alias("name"))

    def numbered(c: Column) -> Column:
        name = c["name"]
        known = F.element_at(points, F.nullif(F.array_position(names, name), F.lit(0)).cast("int"))
        point = F.when(name == "", None).when(F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substr(name, F.lit(3)), 16, 10).cast("long")).when(F.startswith(name, F.lit("#")), F.substr(name, F.lit(2)).cast("long")).otherwise(known)
        return F.struct(c["part"].alias("part"), F.length(name).alias("n"), point.alias("point"))

    def read(c: Column) -> Column:
        bad = (c["point"] == 0) | c["point"].between(0xD800, 0xDFFF) | (c["point"] > 0x10FFFF)
        point = F.when(bad, 0xFFFD).when(c["point"] == 160, 32).otherwise(c["point"])
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(c["point"].isNull(), F.concat(F.lit("&"), c["part"])).otherwise(F.concat(char, F.substr(c["part"], c["n"] + 2)))

    def joined(parts: Column) -> Column:
        rest = F.transform(F.transform(F.transform(F.slice(parts, F.lit(2), F.size(parts)), named), numbered), read)
        return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))

    # a lambda's argument is split once, where a column that is named three times would be split three times
    return F.when(F.instr(text, "&") > 0, F.element_at(F.transform(F.array(F.split(text, "&", -1)), joined), 1)).otherwise(text)


HIDDEN = r"(?is)<(?:!--.*?-->|script[^>]*>.*?</script>|style[^>]*>.*?</style>)"
BLOCK_END = r"(?i)<(?:br[^>]*>|/(?:p|h1|h2|h3|h4|h5|h6|li|div|title|tr|ul|ol|nav|article|footer|header|section)>)"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LINK = rf"(?i)<a{SPACE}([^>]*?[ \t\n\x0B\f\r\"'])?href{SPACE}*={SPACE}*(\"[^\"]*\"|'[^']*'|[^ \t\n\x0B\f\r\"'>]+)"


def without_tags(html: Column) -> Column:
    """Comments, scripts and styles go, block ends become line ends, other tags spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BLOCK_END, "\n"), "<[^>]*>", " ")


def without_gaps(text: Column) -> Column:
    """Runs of blanks become one space and runs of line ends one.  A single space is no match: most are."""
    t = F.regexp_replace(text, r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")
    return F.btrim(F.regexp_replace(t, r" \n[ \n]*|\n[ \n]+", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """Text of a page, with its character references read."""
    return without_gaps(read_entities(without_tags(html)))


def page_title(html: Column) -> Column:
    """The title as it stands in the page, on one line."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, TITLE, 1), SPACE + "+", " "))


def page_links(html: Column) -> Column:
    """Targets of links as they stand in the page, in whatever quotes, in their order."""
    return F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(2)), lambda v: F.when(F.left(v, F.lit(1)).isin("\"", "'"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))


def header_lines(head: Column) -> Column:
    """array<struct<name, value>> of the header lines of an HTTP head (without the status line), in their order; a value that is
    continued on further lines is one value."""
    lines = F.split(F.regexp_replace(head, r"\r?\n[ \t]+", " "), r"\r?\n")
    lines = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.instr(x, ":") > 0)
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))


def parse_responses(records: DataFrame, id_cols: list[str]) -> DataFrame:
    """Response records with their HTTP parts: http_head, body (text) and body_bytes.  A block without an empty line is all body."""
    more = ["headers"] if "headers" in records.columns else []
    own = records.filter(F.col("record_type") == "response").select(*id_cols, "record_id", "target_uri", "date", "payload_digest", *more, "block")
    kept = [*id_cols, "record_id", "target_uri", "date", "payload_digest", *more]
    if isinstance(records.schema["block"].dataType, T.BinaryType):
        own = own.select(*kept, F.coalesce("block", F.lit(b"")).alias("raw"))
        own = own.withColumn("at", F.instr(F.col("raw").cast("string"), CRLF * 2))
        head = F.when(F.col("at") > 0, F.substring(F.col("raw").cast("string"), F.lit(1), F.col("at") - 1)).otherwise("")
        own = own.select(*kept, "raw", "at", head.alias("http_head"))
        body = F.when(F.col("at") > 0, F.substring(F.col("raw"), F.octet_length("http_head") + 5, F.octet_length("raw"))).otherwise(F.col("raw"))
        own = own.select(*kept, F.make_valid_utf8("http_head").alias("http_head"), body.alias("raw"))
        return own.select(*kept, "http_head", F.make_valid_utf8(F.col("raw").cast("string")).alias("body"), F.octet_length("raw").alias("body_bytes"))
    own = own.select(*kept, F.coalesce("block", F.lit("")).alias("block")).withColumn("at", F.instr("block", CRLF * 2))
    head = F.when(F.col("at") > 0, F.substring(F.col("block"), F.lit(1), F.col("at") - 1)).otherwise("")
    body = F.when(F.col("at") > 0, F.substring(F.col("block"), F.col("at") + 4, F.length("block"))).otherwise(F.col("block"))
    return own.select(*kept, head.alias("http_head"), body.alias("body")).withColumn("body_bytes", F.octet_length("body"))


def derive(records: DataFrame, id_cols: list[str]) -> DataFrame:
    """Two records for each response of `records` (the columns of FIELDS after id_cols).  The metadata hold all HTTP headers of
    the source and, if the records have a column `headers`, the source record's own."""
    r = parse_responses(records, id_cols)
    source_type = F.trim(F.regexp_extract("http_head", r"(?i)\nContent-Type:([^\r\n]*)", 1))
    status = F.regexp_extract("http_head", r"^HTTP/[0-9.]+ ([0-9]+)", 1)
    # in steps, each column of which is named several times by the next one and computed once
    r = r.withColumns({"text": without_tags(F.col("body")), "title": page_title(F.col("body")), "links": page_links(F.col("body"))})
    r = r.withColumns({"text": without_gaps(read_entities(F.col("text"))), "title": read_entities(F.col("title")), "links": F.transform("links", read_entities)})
    more = [F.col("headers").alias("warc_headers")] if "headers" in r.columns else []
    meta = F.to_json(F.struct(
        F.coalesce("target_uri", F.lit("")).alias("url"), status.alias("status"), source_type.alias("content_type"), header_lines(F.col("http_head")).alias("http_headers"), *more,
        F.col("title"), F.size("links").alias("n_links"), F.col("links"), F.col("body_bytes"), F.octet_length("text").alias("text_bytes"),
    ))
    pair = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/json").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    )
    out = r.select(*id_cols, F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.explode(pair).alias("d"))
    return out.select(
        *id_cols, F.col("d.record_type").alias("record_type"), _uuid(F.concat_ws("|", "d.record_type", "refers_to")).alias("record_id"), "refers_to", "target_uri", "date",
        F.col("d.content_type").alias("content_type"), "payload_digest", _digest(F.col("d.block")).alias("block_digest"),
        F.octet_length("d.block").cast("long").alias("content_length"), F.col("d.block").alias("block"),
    )


def headers() -> Column:
    """The WARC head of a record."""
    named = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(c).cast("string"))) for n, c in named]
    return F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines)


def record_text() -> Column:
    return F.concat(headers(), F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2))


def write_warc(records: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """One file for each partition; each record ends in two line ends.  Blocks may be text or binary: their bytes are written."""
    out = records.select(F.concat(headers(), F.lit(CRLF * 2), F.col("block").cast("string"), F.lit(CRLF)).alias("value"))
    out.write.option("lineSep", CRLF).option("compression", compression or "none").text(path)


NAMED = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest", "content_length": "Content-Length"}


def records_of(content: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes | None]]:
    """(headers, block) of the records of a file, plain or gzip, one at a time.  A block ends where its Content-Length says; if the
    file ends before, the length is missing or no record end follows, the block is None and reading goes on at the next head."""
    f = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    named: list[tuple[str, str]] = []
    try:
        line = f.readline()
        while line:
            if not line.startswith(b"WARC/"):
                line = f.readline()
                continue
            named = []
            while (line := f.readline()).strip():
                if line[:1] in b" \t" and named:
                    named[-1] = (named[-1][0], f"{named[-1][1]} {line.decode('utf-8', 'replace').strip()}")
                else:
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    named.append((name.strip(), value.strip()))
            size = next((v for n, v in named if n.lower() == "content-length"), "")
            block = f.read(int(size)) if size.isdigit() else None
            if block is not None and len(block) < int(size):
                block = None
            line = f.readline()
            if line.strip() and not line.startswith(b"WARC/"):
                block = None  # the record goes on: its length is wrong
            done, named = named, []
            yield done, block
    except (EOFError, OSError, zlib.error):  # a cut or damaged archive: what came before it stands
        if named:
            yield named, None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: the columns of FIELDS, with a binary block, and `headers`, all header lines as array<struct<name,
    value>>.  A record that is cut short or whose Content-Length is wrong has a null block.  A file is one row of
    Spark's binary source (2 GB at most as stored) and is unpacked a record at a time."""
    kind = ", ".join(f"{c} {'long' if c == 'content_length' else 'binary' if c == 'block' else 'string'}" for c in FIELDS) + ", headers array<struct<name:string,value:string>>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows, size = [], 0
                for named, block in records_of(content):
                    first: dict[str, str] = {}
                    for n, v in named:
                        first.setdefault(n.lower(), v)
                    row = {c: first.get(n.lower()) for c, n in NAMED.items()}
                    row["content_length"] = int(row["content_length"]) if (row["content_length"] or "").isdigit() else None
                    rows.append(row | {"block": block, "headers": [{"name": n, "value": v} for n, v in named]})
                    size += len(block or b"")
                    if size > 16 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*FIELDS, "headers"], dtype=object)
        return out.astype({"content_length": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, kind)
