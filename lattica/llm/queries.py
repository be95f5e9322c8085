"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac, htmltext, langid, merkle, mixing, packing, quality, secrets, simhash, topk, toxicity, warc, whitening
from .common import cut, fold, table
from .merkle_sql import merkle_sql
from .mixing_sql import mixing_sql

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    return str(public_tokenizers.path(TOKENIZER))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as 8-bit FLAC, decoded to PCM blocks; digests and features of what was read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    n = F.octet_length("raw")
    padded = F.greatest(F.ceil(n / 64), F.lit(1)).cast("int") * 64
    docs = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat("raw", F.substring(F.lit(bytes(64)), F.lit(1), padded - n)).alias("payload"))
    read = flac.store_and_read(docs, "payload", ["doc_id", "n_bytes"])
    read = read.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "error", F.col("pcm").alias("payload"), "blocks")
    ends = F.transform("blocks", lambda b: F.concat_ws(":", b["sample_offset"], b["n_samples"], F.crc32(b["pcm"])))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), F.octet_length("payload") - 63, F.lit(64))).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat(F.lit("blocks="), F.size("blocks").cast("string"), F.lit(";seek="), F.sha2(F.array_join(ends, ","), 256)).alias("feature"), "error",
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.filter(fold("doc_id", 3) != 1))
    out = langid.identify_languages(docs, model)
    mixture = F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["lang"], F.round(x["share"], 4))), ",")
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", mixture.alias("mixture"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = warc.derive(warc.responses(pages), ["page_id"])
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length", F.sha2(warc.record_text(), 256).alias("record_sha256"), "block")


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str, train_rows: int = 20_000) -> DataFrame:
    """Training rows (text, toxic) of the learning fold, for the train_rows labels with the least hashes at most.

    The labels are thinned before they meet the documents, so what is broadcast has that bound and texts are not
    shuffled; the texts found are written once."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("__id"), "toxic").filter("toxic is not null and doc_id is not null")
    labels = labels.filter(fold("__id", 4) != 2).distinct().withColumn("__turn", F.xxhash64("__id", F.lit(7))).orderBy("__turn", "__id", "toxic").limit(train_rows)
    return cut(docs.select("doc_id", "text").join(F.broadcast(labels), F.col("doc_id") == F.col("__id")).select("text", "toxic"), "labelled")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(labelled(spark, docs, sf_dir))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), tokenizer_path())
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces, ["doc_id", "start", "ids_crc32"])


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("id % 50 = 0"), k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out, name = mixing.mix(docs, repeats=2.0)
    of = lambda c: F.col(f"{name}.{c}")
    return out.select("doc_id", "source", of("tokens").alias("tokens"), F.round(of("weight"), 9).alias("weight"), *(of(c).alias(c) for c in ("epoch", "block", "turn")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.integer_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    fit = whitening.fit_whitening(rows)
    white = whitening.whiten(rows, fit)
    k = min(8, len(fit.values))
    explained = F.array(*(F.lit(float(v) / fit.trace) for v in fit.values[:k])).cast("array<double>")
    out = white.select(F.col("key").alias("vec_id"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(whitening.identity_error(white, k)).alias("identity_error"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf; half of the ids are read back with their line breaks deleted."""
    docs = table(spark, sf_dir, "documents")
    digest = lambda text: merkle.h(*(merkle.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), merkle.field(text))
    tampered = F.col("doc_id").isNotNull() & (fold("doc_id", 2) == 0) & F.contains("text", F.lit("\n"))
    leaf = digest(F.col("text"))
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(tampered, digest(F.replace("text", F.lit("\n"), F.lit("")))).alias("other"))
    out = merkle.manifest(rows.withColumn("seen", F.coalesce("other", "leaf")), "source", "doc_id", "leaf", "seen")
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", htmltext.extract_text("html", spark).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_flac, op2_simhash, op3_langid, op4_warc, op5_toxicity, op6_secrets, op7_packing, op8_topk, op9_mixing, op10_quality, op11_whitening, op12_merkle, op13_html)
}


def _warc_sql() -> str:
    """Derivatives of pages in DuckDB's dialect."""
    crlf, space = "chr(13) || chr(10)", r"[ \t\n\x0B\f\r]"

    def uuid(text: str) -> str:
        return f"'<urn:uuid:' || " + " || '-' || ".join(f"substr(md5({text}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    names = "[" + ", ".join(f"'{n}'" for n in sorted(name2codepoint)) + "]"
    points = "[" + ", ".join(str(name2codepoint[n]) for n in sorted(name2codepoint)) + "]"

    def entities(t: str) -> str:
        name = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,15});', 1)"
        point = f"""case when c.n = '' then null when c.n[1:2] in ('#x', '#X') then cast('0x' || c.n[3:] as bigint)
          when c.n[1] = '#' then cast(c.n[2:] as bigint) else list_extract({points}, list_position({names}, c.n)) end"""
        char = "chr(cast(case when d.x = 0 or d.x between 55296 and 57343 or d.x > 1114111 then 65533 when d.x = 160 then 32 else d.x end as integer))"
        steps = f"list_transform(string_split({t}, '&')[2:], lambda p: {{'p': p, 'n': {name}}})"
        steps = f"list_transform({steps}, lambda c: {{'p': c.p, 'k': length(c.n), 'x': {point}}})"
        steps = f"list_transform({steps}, lambda d: case when d.x is null then '&' || d.p else {char} || d.p[d.k + 2:] end)"
        return f"(string_split({t}, '&')[1] || array_to_string({steps}, ''))"

    text = "html"
    for pattern, new in (
        (r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "' '"),
        (r"(?i)<br[^>]*>|</(p|h1|h2|h3|h4|h5|h6|li|div|title|tr|ul|ol|nav|article|footer|header|section)>", "chr(10)"), (r"<[^>]*>", "' '"),
    ):
        text = f"regexp_replace({text}, '{pattern}', {new}, 'g')"
    clean = rf"regexp_replace({entities('bare')}, '[ \t\x0B\f\r]+', ' ', 'g')"
    clean = rf"regexp_replace(regexp_replace({clean}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    title = rf"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{space}+', ' ', 'g'))"
    link = rf"""(?i)<a{space}([^>]*?[ \t\n\x0B\f\r"''])?href{space}*={space}*("[^"]*"|''[^'']*''|[^ \t\n\x0B\f\r"''>]+)"""
    links = f"""list_transform(regexp_extract_all(html, '{link}', 2), lambda v: regexp_replace(v, '^["'']|["'']$', '', 'g'))"""
    meta = """to_json({'url': url, 'status': '200', 'content_type': 'text/html; charset=utf-8',
      'http_headers': [{'name': 'Content-Type', 'value': 'text/html; charset=utf-8'}, {'name': 'Content-Length', 'value': cast(strlen(html) as varchar)}],
      'title': title, 'n_links': len(links), 'links': links, 'body_bytes': strlen(html), 'text_bytes': strlen(text)})"""
    head = " || ".join(f"'{n}: ' || {c} || {crlf}" for n, c in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "'2024-01-01T00:00:00Z'"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "kind"), ("Content-Length", "content_length")))
    return f"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
b as (select *, {text} as bare, {title} as raw_title, {links} as raw_links from p),
t as (
  select *, {clean} as text, {entities('raw_title')} as title, list_transform(raw_links, lambda v: {entities('v')}) as links,
    {uuid("'response|' || coalesce(cast(page_id as varchar), '') || '|' || url")} as refers_to, 'sha256:' || sha256(html) as payload_digest
  from b
), d as (
  select page_id, 'metadata' as record_type, 'application/json' as kind, refers_to, url as target_uri, payload_digest, cast({meta} as varchar) as block from t
  union all select page_id, 'conversion', 'text/plain', refers_to, url, payload_digest, text from t
), r as (select *, {uuid("record_type || '|' || refers_to")} as record_id, 'sha256:' || sha256(block) as block_digest, cast(strlen(block) as bigint) as content_length from d)
select page_id, record_type, record_id, refers_to, target_uri, payload_digest, block_digest, content_length,
  sha256('WARC/1.1' || {crlf} || {head} || {crlf} || block || {crlf} || {crlf}) as record_sha256, block
from r"""


SQL: dict[str, str] = {
    "op4_warc": _warc_sql(),
    "op9_mixing": mixing_sql(),
    "op12_merkle": merkle_sql(),
    "op8_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from (select distinct vec_id, v from v) q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5""",
}
