"""Temperature mixing of sources.

Source weights are token shares raised to an exponent and normalised; the exponent (1: as the corpus
is, 0: all sources alike) is bisected until the weights meet a target entropy, or until no source is read more than
`repeats` times for each time that the least-read one is.  Five halvings are settled by one pass over
the table of sources, which is never gathered.  The budget (tokens) is given, or the least for which every
document is read once.

The weights become blocks: a hash deals each source's documents to BLOCKS blocks; in every epoch a source's blocks
come in another permutation, until its share of the budget is spent.  Whole blocks are counted by their sums; only in
the block in which the budget ends a cut by hash decides, so documents themselves are only mapped, not
sorted or gathered, however large a source is.

Tokens of a document: a quarter of its UTF-8 bytes, rounded up, 1 at least (null text: 1).  A null
source is a source of its own.  Repeated rows have one hash and are taken together, as are documents whose hashes tie; blocks
whose turns tie come by number.  Very long texts are counted by their length, never copied.  An empty table gives an empty mix.
Columns of the table may have any names: the ones added here are named apart from them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh

BLOCKS = 1024
BROADCAST_ROWS = 100_000  # rows of the block plan that may be broadcast; beyond, Spark joins as it likes


def document_tokens(text: Column) -> Column:
    return F.greatest(F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4), F.lit(1)).cast("long")


def _number(digits: int, *parts: Column | str) -> Column:
    """A number from the first hex digits of an MD5 of parts (null parts count as empty)."""
    text = F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def document_key(id_col: str, text_col: str) -> Column:
    """60 bits that place a document in its source's blocks."""
    return _number(15, id_col, text_col)


def block_turn(source: Column, block: Column, epoch: Column, seed: int) -> Column:
    """Place of a block in the permutation of an epoch (from 0) of its source."""
    return _number(10, source, block, epoch, F.lit(seed))


@dataclass
class Exponent:
    alpha: float
    total: int  # tokens of the corpus
    norm: float  # sum of share^alpha
    budget: int


def fit_exponent(sources: DataFrame, repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None) -> Exponent:
    """sources: tokens of each (column tokens).  entropy is in nats.  The least alpha in [0, 1] under the
    repetition limit, or the alpha whose entropy is the target; a target that no alpha in [0, 1] has is an error."""
    if (repeats is None) == (entropy is None):
        raise ValueError("give either repeats or entropy")
    total, n, low, high = sources.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return Exponent(1.0, 0, 1.0, budget or 0)
    share = F.col("tokens") / F.lit(float(total))

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        row = sources.agg(*(F.sum(F.pow(share, F.lit(a))) for a in alphas), *(F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in alphas)).first()
        return list(zip(row[: len(alphas)], row[len(alphas) :], strict=True))

    def enough(alpha: float, z: float, zlog: float) -> bool:
        """Whether alpha is at or above the one that is looked for."""
        if repeats is not None:
            return (high / low) ** (1 - alpha) <= repeats * (1 + 1e-12)
        return math.log(z) - alpha * zlog / z <= entropy  # entropy falls as alpha rises

    a, b = 0.0, 1.0
    ends = sums([0.0, 1.0])
    if entropy is not None:
        most, least = (math.log(z) - x * zlog / z for x, (z, zlog) in zip((0.0, 1.0), ends, strict=True))
        if not least - 1e-9 <= entropy <= most + 1e-9:
            raise ValueError(f"the entropy must be between {least:.6f} (as the sources are) and {most:.6f} (all alike)")
    if enough(0.0, *ends[0]):
        b = 0.0
    elif enough(1.0, *ends[1]):
        for _ in range(6):  # 30 halvings
            steps = [a + (b - a) * i / 32 for i in range(33)]
            at = next(i for i, (x, s) in enumerate(zip(steps, [None, *sums(steps[1:])], strict=True)) if i and enough(x, *s))
            a, b = steps[at - 1], steps[at]
    z = sums([b])[0][0]
    least = max(share_of * 1.0 for share_of in ((high / total) ** (1 - b) * z, (low / total) ** (1 - b) * z))
    return Exponent(b, total, z, budget if budget is not None else math.ceil(total * least))


def mix_plan(docs: DataFrame, source: Column, key: Column, tokens: Column, repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 42) -> DataFrame:
    """The plan: source, block, weight, quota, epochs (times that the whole block is read), cut (documents of
    the block whose key is at or below it are read once more)."""
    slim = cut(docs.select(source.alias("source"), key.alias("key"), tokens.alias("tokens")), "mix")
    slim = slim.withColumn("block", F.pmod("key", F.lit(BLOCKS)).cast("int"))
    blocks = cut(slim.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    sources = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    e = fit_exponent(sources, repeats, entropy, budget)
    weight = F.pow(F.col("all") / F.lit(float(max(e.total, 1))), F.lit(e.alpha)) / F.lit(e.norm)
    own = Window.partitionBy("source")
    plan = blocks.withColumn("all", F.sum("tokens").over(own)).withColumn("weight", weight).withColumn("quota", F.floor(F.col("weight") * e.budget + 1e-6))
    # the least budget reads each document once: its rounding must not take one away
    quota = F.greatest("quota", "all") if budget is None else F.col("quota")
    plan = plan.withColumn("quota", quota).withColumn("full", F.floor(F.col("quota") / F.col("all")))
    last = Window.partitionBy("source").orderBy(block_turn(F.col("source"), F.col("block"), F.col("full"), seed), "block").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("quota") - F.col("full") * F.col("all") - (F.sum("tokens").over(last) - F.col("tokens"))
    plan = plan.withColumn("room", room).withColumn("epochs", (F.col("full") + (F.col("room") >= F.col("tokens")).cast("long")).cast("int"))
    plan = plan.withColumn("room", F.when((F.col("room") > 0) & (F.col("room") < F.col("tokens")), F.col("room")))
    plan = cut(plan.select("source", "block", "weight", "quota", "epochs", "room"), "plan")
    # one block of each source at most has room for a part of its documents.  Its cut is found among sums of 2^20 cells of keys, and
    # only the keys of the cell in which the room ends are sorted, each with the sum of its documents (repeated rows share one)
    part = plan.filter("room is not null").select(F.col("source").alias("s"), F.col("block").alias("b"), "room")
    inside = slim.join(part, slim.source.eqNullSafe(part.s) & (slim.block == part.b)).withColumn("cell", F.shiftright("key", 40))
    cells = inside.groupBy("s", "b", "room", "cell").agg(F.sum("tokens").alias("tokens"), F.max("key").alias("key"))
    cells = cells.withColumn("upto", F.sum("tokens").over(Window.partitionBy("s", "b").orderBy("cell")))
    whole = cells.filter("upto <= room").select("s", "b", "key")
    edge = cells.filter("upto > room and upto - tokens <= room").select(F.col("s").alias("es"), F.col("b").alias("eb"), F.col("cell").alias("ec"), (F.col("upto") - F.col("tokens")).alias("before"))
    ended = inside.join(edge, inside.s.eqNullSafe(edge.es) & (inside.b == edge.eb) & (inside.cell == edge.ec))
    ended = ended.groupBy("s", "b", "room", "before", "key").agg(F.sum("tokens").alias("tokens"))
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("s", "b").orderBy("key"))
    cuts = ended.withColumn("upto", upto).filter("upto <= room").select("s", "b", "key").unionByName(whole).groupBy("s", "b").agg(F.max("key").alias("cut"))
    return cut(plan.join(cuts, plan.source.eqNullSafe(cuts.s) & (plan.block == cuts.b), "left").select("source", "block", "weight", "quota", "epochs", "cut"), "plan")


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 42) -> tuple[DataFrame, str]:
    """docs with a struct column (its name comes second): source_tokens, weight, epoch, block, turn.  A document
    comes once for each epoch in which it is read.  Reading order: epoch, then turn (the place of its
    block in that epoch's permutation of its source), then any."""
    name, w = fresh(docs, "mix"), {k: fresh(docs, k) for k in ("key", "tokens", "source", "block", "weight", "quota", "epochs", "cut")}
    key = document_key(id_col, text_col)
    plan = mix_plan(docs, F.col(source_col).cast("string"), key, document_tokens(F.col(text_col)), repeats, entropy, budget, seed)
    small = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    plan = plan.select(*(F.col(c).alias(w[c]) for c in plan.columns))
    at = docs.withColumn(w["key"], key)
    on = at[source_col].cast("string").eqNullSafe(plan[w["source"]]) & (F.pmod(at[w["key"]], F.lit(BLOCKS)).cast("int") == plan[w["block"]])
    both = at.join(F.broadcast(plan) if small else plan, on)
    copies = F.col(w["epochs"]) + F.coalesce((F.col(w["key"]) <= F.col(w["cut"])).cast("int"), F.lit(0))
    epoch = F.explode(F.sequence(F.lit(1), copies))
    turn = lambda e: block_turn(F.col(source_col), F.col(w["block"]), e - 1, seed)
    one = both.filter(copies > 0).select(*docs.columns, *(F.col(w[c]) for c in ("key", "weight", "block")), epoch.alias(w["epochs"]))
    cell = F.struct(document_tokens(F.col(text_col)).alias("tokens"), F.col(w["weight"]).alias("weight"), F.col(w["epochs"]).alias("epoch"), F.col(w["block"]).alias("block"), turn(F.col(w["epochs"])).alias("turn"))
    return one.select(*docs.columns, cell.alias(name)), name
