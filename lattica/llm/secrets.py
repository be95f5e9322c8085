"""Secret scan with DataFrame functions only: three patterns and a battery of randomness tests.

Patterns (leftmost, not overlapping, per kind): `assign` (a keyword, a sign, a value of 6 or more), `access` (a
key of 20 or more after AKIA) and `hex` (24 or more hex digits).  The battery adds `random` spans.  Its candidates
are runs of 20 or more of [A-Za-z0-9+/_=-] with a letter that no pattern span touches.  The encoding (hex, base32, base64)
is inferred from the characters, and against "its symbols are drawn evenly and independently" stand

- chi-squared over cells of the alphabet (Wilson-Hilferty): the 16 symbols of hex; vowels, frequent and other consonants
  (by case in base64), digits and signs,
- runs above and below the middle of the alphabet (Wald-Wolfowitz),
- correlation of neighbouring symbols,

combined by Fisher's method to a score: near 1 for a key, near 0 for words.  How high ordinary text scores by chance depends on
length, so it is measured: every document gives DECOYS pieces of its own words, joined as identifiers, paths and titles are,
to each of which the same battery is applied (a few from a fixed list of words stand beside them, for tables with little text).
A candidate's p-value is the share of the decoys of its class of length that score as high, and Benjamini-Hochberg within each class
decides what is reported: in each class at most a share `fdr` of the reported spans is expected to be ordinary text.  A token whose
score is below REJECTED is never reported: one key in a thousand scores so low.
Counts for it cover all candidates and all documents of the table, in bins of a tenth of a decade of the score, so what reaches the
driver is bounded (classes x bins).

Positions are code points, end exclusive.  Null text counts as empty; it has no spans.  Very long texts are scanned whole.  Spans
with equal starts come by kind; repeated rows are judged each; an empty table gives an empty result.  Other columns are ignored by
`scan` and kept by `redact`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

# The patterns; letters of the keywords come in either case.
ASSIGN = r"""(?=[PpSsTtAa])([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LENGTHS = [20, 28, 40, 64]  # lower ends of the classes of length
BINS = 200
DECOYS = 2  # of each document
REJECTED = 1e-3  # score from which on a token can be random
WORDS = "the house of many small rivers and long roads was built by people who came from other places with their families after years of work in fields under warm weather"
CELLS64 = [0 if c in "aeiou" else 1 if c in "tnshrdl" else 2 if c.islower() else 3 if c.isupper() else 4 if c.isdigit() else 5 for c in BASE64]
CELLS32 = [0 if c in "AEIOU" else 1 if c in "TNSHRDL" else 2 if c.isupper() else 3 for c in BASE64[:26] + "234567"]
SHARES = {16: [1 / 16] * 16, 32: [CELLS32.count(i) / 32 for i in range(4)], 64: [CELLS64.count(i) / 64 for i in range(6)]}
NONE = "array<struct<start:int,kind:int,end:int>>"
TOKENS = "array<struct<start:int,kind:int,end:int,token:string>>"
CHUNK = 4096  # characters; a piece of a text is cut out of these, as finding a place in a text reads all before it


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], least: int) -> Column:
    """Running combination (a sum or a maximum) of an array of integers.

    An array that grows by one is copied by every step, so the array is cut into about sqrt(n) blocks of sqrt(n): each is combined by itself, then the
    last values of the blocks, and these go into the blocks behind them.  n ** 1.5 copies in all, a second or so for 100,000."""

    def plain(part: Column) -> Column:
        step = lambda out, x: F.concat(out, F.array(combine(x, F.coalesce(F.get(out, F.size(out) - 1), F.lit(least)))))
        return F.aggregate(part, F.array().cast("array<int>"), step)

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        parts = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda i: plain(F.slice(v, i * w + 1, w))))
        before = lambda tops, i: F.when(i > 0, F.get(tops, i - 1)).otherwise(least)
        joined = lambda p, tops: F.transform(p, lambda part, i: let(before(tops, i), lambda top: F.transform(part, lambda x: combine(x, top))))
        return let(parts, lambda p: let(plain(F.transform(p, lambda part: F.element_at(part, -1))), lambda tops: F.flatten(joined(p, tops))))

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(v))


def _sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


def _tops(values: Column, least: int = 0) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), least)


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1, token: bool = False) -> Column:
    """array<struct<start, kind, end>> (and the token) of the matches whose group has `least` characters or more.

    Text between the matches (split) and the matches alternate; the running sum of their lengths gives positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    own = lambda c: [c["hit"].alias("token")] if token else []

    def sized(hits: Column) -> Column:
        cells = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"), (values if group else hits).alias("value"))
        return F.transform(cells, lambda c: F.struct(F.length(c["gap"]).alias("gap"), F.length(c["hit"]).alias("n"), F.length(c["value"]).alias("value"), *own(c)))

    def placed(cells: Column) -> Column:
        ends = _sums(F.transform(cells, lambda c: c["gap"] + c["n"]))
        more = lambda c: [c["token"].alias("token")] if token else []
        each = F.zip_with(cells, ends, lambda c, end: F.when(c["value"] >= least, F.struct((end - c["n"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *more(c))))
        return F.filter(each, lambda x: x.isNotNull())

    out = let(let(found, sized), placed)
    return F.when(F.regexp_instr(text, F.lit(pattern)) > 0, out).otherwise(F.array().cast(TOKENS if token else NONE))


def free_of(candidates: Column, base: Column) -> Column:
    """The candidates that no base span touches.  Both are merged by start; the furthest end of the base spans so far and the start of the next one
    decide, so the work is that of sorting."""
    far = (1 << 31) - 1
    one = lambda s, kind, token: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), token.alias("token"))
    merged = F.array_sort(F.concat(F.transform(base, lambda b: one(b, 0, F.lit(""))), F.transform(candidates, lambda c: one(c, 1, c["token"]))))

    def apart(m: Column) -> Column:
        reach = _tops(F.transform(m, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(0)))
        ahead = F.reverse(_tops(F.reverse(F.transform(m, lambda x: F.when(x["kind"] == 0, -x["start"]).otherwise(-far))), -far))
        both = F.arrays_zip(m.alias("c"), reach.alias("reach"), ahead.alias("ahead"))
        kept = F.filter(both, lambda x: (x["c"]["kind"] == 1) & (x["reach"] <= x["c"]["start"]) & (-x["ahead"] >= x["c"]["end"]))
        return F.transform(kept, lambda x: F.struct(x["c"]["start"].alias("start"), F.lit(3).alias("kind"), x["c"]["end"].alias("end"), x["c"]["token"].alias("token")))

    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), let(merged, apart)).otherwise(candidates)


# ---------------------------------------------------------------- the battery


def upper_tail(z: Column) -> Column:
    """P(N > z) by the Abramowitz-Stegun approximation 7.1.26 of erf; from 1e-30 to 1."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-30))


def battery(tokens: Column) -> Column:
    """array<struct<start, end, size, p>> for an array<struct<start, kind, end, token>>: the class of length and
    the combined p-value of each token, in steps so that each part is computed once."""

    def encoded(c: Column) -> Column:
        body = F.translate(F.rtrim(c["token"], F.lit("=")), "-_=", "+//")
        hexed = body.rlike("^([0-9a-f]+|[0-9A-F]+)$")
        kind = F.when(hexed, 16).when(body.rlike("^[A-Z2-7]+$"), 32).otherwise(64)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.when(hexed, F.lower(body)).otherwise(body).alias("body"), kind.alias("base"))

    def valued(c: Column) -> Column:
        alphabet = F.when(c["base"] == 16, "0123456789abcdef").when(c["base"] == 32, BASE64[:26] + "234567").otherwise(BASE64)
        chars = F.filter(F.split(c["body"], ""), lambda ch: ch != "")
        v = F.transform(chars, lambda ch: F.position(ch, alphabet) - 1)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), v.alias("v"), F.size(v).alias("n"))

    numbers = lambda values: F.array(*(F.lit(x) for x in values))

    def counted(c: Column) -> Column:
        cells = F.when(c["base"] == 16, numbers(range(16))).when(c["base"] == 32, numbers(CELLS32)).otherwise(numbers(CELLS64))
        shares = F.when(c["base"] == 16, numbers(SHARES[16])).when(c["base"] == 32, numbers(SHARES[32])).otherwise(numbers(SHARES[64]))
        high = F.transform(c["v"], lambda x: (x * 2 >= c["base"]).cast("int"))
        return F.struct(
            *(c[k].alias(k) for k in ("start", "end", "base", "v", "n")),
            F.transform(c["v"], lambda x: F.element_at(cells, x + 1)).alias("cell"), shares.alias("shares"), high.alias("high"),
            F.aggregate(c["v"], F.lit(0.0), lambda a, x: a + x).alias("sum"),
        )

    def tested(c: Column) -> Column:
        def term(share: Column, j: Column) -> Column:
            expected = c["n"] * share
            seen = F.size(F.filter(c["cell"], lambda x: x == j))
            return (seen - expected) * (seen - expected) / expected

        chi = F.aggregate(F.transform(c["shares"], term), F.lit(0.0), lambda a, x: a + x)
        pairs = F.arrays_zip(F.slice(c["high"], 1, c["n"] - 1).alias("a"), F.slice(c["high"], 2, c["n"] - 1).alias("b"))
        runs = F.aggregate(pairs, F.lit(1), lambda a, p: a + F.abs(p["a"] - p["b"]))
        mean = c["sum"] / c["n"]
        near = F.arrays_zip(F.slice(c["v"], 1, c["n"] - 1).alias("a"), F.slice(c["v"], 2, c["n"] - 1).alias("b"))
        cov = F.aggregate(near, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        var = F.aggregate(c["v"], F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        ups = F.aggregate(c["high"], F.lit(0), lambda a, x: a + x)
        return F.struct(*(c[k].alias(k) for k in ("start", "end", "n")), (F.size(c["shares"]) - 1).alias("df"), chi.alias("chi"), runs.alias("runs"), ups.alias("n1"), (c["n"] - ups).alias("n2"), cov.alias("cov"), var.alias("var"))

    def scored(c: Column) -> Column:
        df, n = c["df"].cast("double"), c["n"].cast("double")
        chi = (F.pow(c["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        n1, n2 = c["n1"].cast("double"), c["n2"].cast("double")
        mu = 2 * n1 * n2 / n + 1
        sigma2 = F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9))
        even = F.when((n1 > 0) & (n2 > 0), F.abs(c["runs"] - mu) / F.sqrt(sigma2)).otherwise(6.0)
        serial = F.when(c["var"] > 0, F.abs(c["cov"] / c["var"] + 1 / n) * F.sqrt(n)).otherwise(6.0)
        return F.struct(*(c[k].alias(k) for k in ("start", "end", "n")), upper_tail(chi).alias("p1"), F.least(2 * upper_tail(even), F.lit(1.0)).alias("p2"), F.least(2 * upper_tail(serial), F.lit(1.0)).alias("p3"))

    def fisher(c: Column) -> Column:
        half = -(F.log(c["p1"]) + F.log(c["p2"]) + F.log(c["p3"]))
        p = F.exp(-half) * (1 + half + half * half / 2)
        size = F.greatest(sum((c["n"] >= lower).cast("int") for lower in LENGTHS), F.lit(1))  # padding left aside
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), size.alias("size"), F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-20)).alias("p"))

    out = F.filter(F.transform(F.transform(tokens, encoded), valued), lambda c: c["n"] >= 12)
    for part in (counted, tested, scored, fisher):
        out = F.transform(out, part)
    return out


def _joined(words: Column, how: Column) -> Column:
    """Words (space between them) as an identifier, a path or a title."""
    glued = F.replace(F.initcap(words), F.lit(" "), F.lit(""))
    return F.when(how == 0, F.translate(words, " ", "-")).when(how == 1, F.translate(words, " ", "_")).when(how == 2, F.translate(words, " ", "/")).otherwise(glued)


def decoys(text: Column, n: int = DECOYS) -> Column:
    """array<struct<start, kind, end, token>>: up to n pieces of the text's words at places, of lengths and in spellings that a hash
    of the text picks."""

    def piece(h: Column) -> Column:
        size = F.element_at(F.array(*(F.lit(x) for x in LENGTHS)), (h % len(LENGTHS) + 1).cast("int")) + (F.shiftright(h, 8) % 12).cast("int")
        at = F.shiftright(h, 20) % F.greatest(F.length(text) - 2 * size, F.lit(1)) + 1
        return F.struct(size.alias("size"), (F.shiftright(h, 4) % 4).alias("how"), F.substring(text, at.cast("int"), size * 2 + 16).alias("part"))

    def named(c: Column) -> Column:
        words = F.trim(F.regexp_replace(c["part"], "[^A-Za-z0-9]+", " "))
        return F.struct(F.lit(0).alias("start"), F.lit(3).alias("kind"), c["size"].alias("end"), F.substring(_joined(words, c["how"]), F.lit(1), c["size"]).alias("token"))

    hashes = F.array(*(F.xxhash64(text, F.lit(i)).bitwiseAND(F.lit((1 << 60) - 1)) for i in range(n)))
    return F.filter(F.transform(F.transform(hashes, piece), named), lambda c: F.length(c["token"]) == c["end"])


def findings(docs: DataFrame, text_col: str, keep: list[str]) -> tuple[DataFrame, str, str, str]:
    """keep, base spans (sorted by start, kind), tested candidates and tested decoys of each row, written to the shared
    folder; the names of the three columns."""
    base, tried, ordinary, text = (fresh(docs, c) for c in ("base", "tried", "ordinary", "text"))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn(text, whole)
    t = F.col(text)
    hits = F.concat(spans(t, ASSIGN, 0, 2, 6), spans(t, ACCESS, 1), spans(t, HEX, 2))
    out = out.select(*keep, text, F.array_sort(hits).alias(base))
    out = out.withColumn(tried, spans(F.col(text), CANDIDATE, 3, token=True))
    tokens = free_of(F.col(tried), F.col(base))
    bins = F.transform(battery(decoys(F.col(text))), lambda c: F.struct(c["size"].alias("size"), _bin(c["p"]).alias("bin")))
    return cut(out.select(*keep, base, battery(tokens).alias(tried), bins.alias(ordinary)), "secrets"), base, tried, ordinary


def _bin(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(p)).cast("int"), F.lit(BINS))


def reported_to(found: DataFrame, tried: str, ordinary: str, fdr: float) -> dict[int, int]:
    """For each class of length the last bin that is reported (no entry: none is)."""
    spark = found.sparkSession
    words = F.split(F.lit(WORDS), " ")
    rows = spark.range(100).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.element_at(words, (F.pmod(F.col("id") * 7 + i * (F.col("id") % 5 + 1), F.size(words)) + 1).cast("int"))), " ").alias("t"))
    fixed = rows.select(F.explode(battery(decoys(F.col("t"), 4))).alias("c")).select(F.lit(1).alias("plain"), F.col("c.size").alias("size"), _bin(F.col("c.p")).alias("bin"))
    of = lambda c, plain: found.select(F.explode(c).alias("c")).select(F.lit(plain).alias("plain"), F.col("c.size").alias("size"), (F.col("c.bin") if plain else _bin(F.col("c.p"))).alias("bin"))
    counts = of(tried, 0).unionByName(of(ordinary, 1)).unionByName(fixed).groupBy("plain", "size", "bin").count().collect()  # at most 2 x 4 x 201 rows
    out: dict[int, int] = {}
    for size in {r["size"] for r in counts}:
        own, plain = ({r["bin"]: r["count"] for r in counts if r["size"] == size and r["plain"] == k} for k in (0, 1))
        above, chance = 0, 1
        for b in sorted(b for b in {*own, *plain} if b < -10 * math.log10(REJECTED)):
            above, chance = above + own.get(b, 0), chance + plain.get(b, 0)
            if above and chance / (1 + sum(plain.values())) * sum(own.values()) <= fdr * above:
                out[size] = b
    return out


def all_spans(base: str, tried: str, reported: dict[int, int]) -> Column:
    """Pattern spans, and the candidates that are reported, by start and kind."""
    kept = F.filter(tried, lambda c: _bin(c["p"]) <= _limit(c["size"], reported, F.lit(-1)))
    more = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return F.array_sort(F.concat(F.col(base), more.cast(NONE)))


def _limit(size: Column, reported: dict[int, int], rest: Column) -> Column:
    out = rest
    for k, b in sorted(reported.items()):
        out = F.when(size == k, b).otherwise(out)
    return out


def as_text(found: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """id_col, base and spans (array<struct<start, kind, end>>): a row for each row of docs."""
    found, base, tried, ordinary = findings(docs.select(id_col, text_col), text_col, [id_col])
    return found.select(id_col, F.col(base).alias("base"), all_spans(base, tried, reported_to(found, tried, ordinary, fdr)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", fdr: float = 0.05, mark: str = "[secret]") -> DataFrame:
    """docs with every span of the text replaced by the mark (overlapping spans by one); other columns and
    texts without spans stay as they are."""
    found, base, tried, ordinary = findings(docs, text_col, docs.columns)
    name = fresh(docs, "spans")
    out = found.withColumn(name, all_spans(base, tried, reported_to(found, tried, ordinary, fdr)))
    text, where = F.col(text_col), F.col(name)

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        """Characters a to b (exclusive, from 0) of the text."""
        first = lambda k: F.greatest(a - k * CHUNK, F.lit(0))
        parts = F.transform(F.sequence(F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")), lambda k: F.substring(F.get(chunks, k), first(k) + 1, F.least(b - k * CHUNK, F.lit(CHUNK)) - first(k)))
        return F.when(b > a, F.array_join(parts, "")).otherwise("")

    def cleaned(chunks: Column) -> Column:
        tops = _tops(F.transform(where, lambda s: s["end"]))

        def joined(ends: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            each = F.transform(where, lambda s, i: let(before(i), lambda at: F.when(s["start"] >= at, F.concat(piece(chunks, at, s["start"]), F.lit(mark))).otherwise("")))
            return F.concat(F.array_join(each, ""), piece(chunks, F.element_at(ends, -1), F.length(text)))

        return let(tops, joined)

    new = F.when(F.size(where) > 0, let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0)), cleaned)).otherwise(text)
    return out.select(*(new.alias(c) if c == text_col else F.col(c) for c in docs.columns))
