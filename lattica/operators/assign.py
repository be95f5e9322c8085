"""Assignment of markers to genomes, and clusters, in rounds of locally dominant rows.

The greedy rules read links by falling count (ties: marker, then genome) and depend on what was assigned before.  A link depends only on earlier
links of its marker, on those earlier links of its genome that may still be accepted, and, where it could be a short copy, on
links of its marker's near-identical markers.  Each round decides every link that has none of these left, in joins and windows over all
undecided links at once, so a component of links that holds everything is many tasks.  What can no longer matter leaves early: all links of a marker that is taken or
retired, and links whose marker differs from a marker that their genome holds.  The first undecided link of all is always
decidable, so rounds end; each writes its state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import cut
from .links import with_identity


def _clashing(links: DataFrame, ident: DataFrame, cutoff: float, min_links: int) -> DataFrame:
    """genome, marker, n: the tied best markers of genomes where a pair of them has an identity of `cutoff` or less."""
    w = Window.partitionBy("genome").orderBy(F.desc("n"))
    best = links.filter(F.col("n") >= min_links).withColumn("rank", F.rank().over(w)).filter("rank = 1").select("genome", "marker", "n").distinct()
    pairs = best.select("genome", "marker").join(best.select("genome", F.col("marker").alias("other")), "genome").filter("marker < other")
    bad = with_identity(pairs, "marker", "other", ident).groupBy("genome").agg(F.min("iden").alias("least")).filter(F.col("least") <= cutoff).select("genome")
    return best.join(bad, "genome", "left_semi")


def _near(ident: DataFrame, cutoff: float) -> DataFrame:
    """marker, other, iden: pairs of identity `cutoff` or more, both ways."""
    close = ident.filter(F.col("iden") >= cutoff)
    return close.select(F.col("a").alias("marker"), F.col("b").alias("other"), "iden").unionByName(close.select(F.col("b").alias("marker"), F.col("a").alias("other"), "iden"))


def ambiguous_best(links: DataFrame, ident: DataFrame, cutoff: float = 99.0, min_links: int = 3) -> DataFrame:
    """(kind, id): `genome` whose best markers tie and include a pair of identity `cutoff` or less, `best` those markers,
    `all` every marker of identity `cutoff` or more to one of them."""
    clash = _clashing(links, ident, cutoff, min_links)
    tied = clash.select("marker").distinct()
    near = _near(ident, cutoff).join(tied, "marker", "left_semi").select("other").distinct()
    tag = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return tag(clash.select("genome").distinct(), "genome", "genome").unionByName(tag(tied, "best", "marker")).unionByName(tag(near, "all", "other"))


# the order in which links are read; structs compare field by field
def _place() -> Column:
    return F.struct((-F.col("n")).alias("down"), "marker", "genome")


def _rounds(links: DataFrame, near: DataFrame, cutoff: float, share: float, short_by: int, against_all: bool, most_rounds: int) -> DataFrame:
    """Accepted links.  links: marker, genome, n, length, short (may be a short copy), check (only ever that; never accepted).
    near: marker, other, iden, length (of the other)."""
    spark, kept, best = links.sparkSession, [], F.col("best")
    open_links = cut(links.withColumn("n", F.col("n").cast("long")).withColumns({"place": _place(), "best": F.lit(None).cast("long")}), "links")
    of_marker = Window.partitionBy("marker").orderBy("place")
    earlier = Window.partitionBy("genome").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    like = near.filter(F.col("iden") >= 99)
    taken = spark.createDataFrame([], "taken string, taken_place struct<down:long,marker:string,genome:string>")
    for _ in range(most_rounds):
        if open_links.isEmpty():
            return _union(kept, links)
        may = ~F.col("check") & (best.isNull() | (F.col("n") * 100 / best >= share))  # may still be accepted
        first = open_links.withColumn("may", may).withColumn("before", F.coalesce(F.sum(F.col("may").cast("int")).over(earlier), F.lit(0)))
        first = first.withColumn("k", F.row_number().over(of_marker)).filter("k = 1")
        # a possible short copy waits for earlier links of markers like it, then looks at the most similar one that is taken
        short = first.filter("short").join(like.select("marker", "other", "iden", F.col("length").alias("other_length")), "marker")
        ahead = first.select(F.col("marker").alias("other"), F.col("place").alias("other_place"))
        waits = short.join(ahead, "other").filter(F.col("other_place") < F.col("place")).select("marker", F.lit(True).alias("waits")).distinct()
        had = short.join(taken, (F.col("other") == F.col("taken")) & (F.col("taken_place") < F.col("place")))
        had = had.groupBy("marker").agg(F.max(F.struct("iden", "other", (F.col("other_length") - F.col("length") >= short_by).alias("copy"))).alias("top"))
        judged = first.join(waits, "marker", "left").join(had.select("marker", F.col("top.copy").alias("copy")), "marker", "left")
        verdict = (
            F.when(F.col("waits"), None).when(F.col("copy"), "retire").when(F.col("check"), "drop")
            .when(F.col("before") > 0, None).when(F.col("may"), "accept").otherwise("retire")
        )
        done = cut(judged.withColumn("verdict", verdict).filter("verdict is not null").select("marker", "genome", "n", "place", "verdict"), "verdicts")
        new = done.filter("verdict = 'accept'")
        kept.append(new.select("marker", "genome", "n"))
        taken = taken.unionByName(new.select(F.col("marker").alias("taken"), F.col("place").alias("taken_place")))
        rest = open_links.join(done.filter("verdict <> 'drop'").select("marker"), "marker", "left_anti")
        rest = rest.join(done.filter("verdict = 'drop'").select("marker", "genome"), ["marker", "genome"], "left_anti")
        # one marker at most is new in a genome; links of markers that differ from it can no longer be accepted
        rest = rest.join(new.select("genome", F.col("marker").alias("other"), F.col("n").alias("new_n")), "genome", "left").join(near.select("marker", "other", "iden"), ["marker", "other"], "left")
        compare = F.col("other").isNotNull() & (F.lit(True) if against_all else best.isNull())
        differs = compare & (F.coalesce("iden", F.lit(0.0)) < cutoff)
        rest = rest.withColumn("check", F.col("check") | differs).filter(F.col("short") | ~F.col("check"))
        open_links = cut(rest.withColumn("best", F.coalesce("best", "new_n")).select(*open_links.columns), "links")
    raise RuntimeError("the assignment did not settle")


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.select("marker", "genome", "n").limit(0)
    for p in parts:
        out = out.unionByName(p)
    return out


def greedy_assign(
    links: DataFrame, lengths: DataFrame, ident: DataFrame, clips: DataFrame | None = None, cutoff: float = 99.0, min_links: int = 9, share: float = 80.0, short_by: int = 200, most_rounds: int = 1000
) -> DataFrame:
    """Accepted links (marker, genome, n) of the first round.  lengths: marker, ref_len.  clips: marker, genome, clip_l,
    clip_r (percentages of clipped alignments); without it no marker counts as a short copy."""
    sizes = lengths.select("marker", F.col("ref_len").alias("length"))
    near = cut(_near(ident, min(cutoff, 99.0)).join(sizes.select(F.col("marker").alias("other"), "length"), "other"), "near")
    full = links.filter(F.col("n") >= min_links).join(sizes, "marker")
    if clips is None:
        full = full.withColumn("short", F.lit(False))
    else:
        longer = near.filter(F.col("iden") >= 99).groupBy("marker").agg(F.max("length").alias("longest"))
        clipped = clips.filter((F.col("clip_l") >= 60) & (F.col("clip_r") >= 60)).select("marker", "genome", F.lit(True).alias("clipped"))
        full = full.join(clipped, ["marker", "genome"], "left").join(longer, "marker", "left")
        full = full.withColumn("short", F.coalesce(F.col("clipped") & (F.col("longest") - F.col("length") >= short_by), F.lit(False)))
    # genomes whose best markers clash get none; markers like one of these get none from where that count is reached
    clash = cut(_clashing(links, ident, cutoff, min_links), "clash")
    shadow = near.filter(F.col("iden") >= cutoff).join(clash.select(F.col("marker").alias("other"), F.col("n").alias("top")), "other").groupBy("marker").agg(F.max("top").alias("shadow"))
    full = full.join(clash.select("genome", F.lit(True).alias("reached")).distinct(), "genome", "left").join(shadow, "marker", "left")
    full = full.withColumn("check", F.col("reached").isNotNull() | F.coalesce(F.col("n") <= F.col("shadow"), F.lit(False))).filter(F.col("short") | ~F.col("check"))
    return _rounds(full.select("marker", "genome", "n", "length", "short", "check"), near, cutoff, share, short_by, True, most_rounds)


def greedy_assign_simple(links: DataFrame, ident: DataFrame, cutoff: float = 99.0, min_links: int = 9, share: float = 80.0, min_unique: int = 3, most_rounds: int = 1000) -> DataFrame:
    """The simpler rule of the second round: a later marker of a genome is compared with the genome's best one only, and a marker with several
    genomes needs min_links, another one min_unique."""
    fan = links.filter("n > 1").groupBy("marker").agg(F.count_distinct("genome").alias("fan"))
    rows = links.join(fan, "marker", "left").filter(F.col("n") >= F.when(F.col("fan") > 1, min_links).otherwise(min_unique))
    rows = rows.select("marker", "genome", "n", F.lit(0).alias("length"), F.lit(False).alias("short"), F.lit(False).alias("check"))
    near = cut(_near(ident, cutoff).withColumn("length", F.lit(0)), "near")
    return _rounds(rows, near, cutoff, share, 0, False, most_rounds)


def greedy_assign_mini(links: DataFrame, left: str, right: str, min_links: int = 3, share: float = 0.8) -> DataFrame:
    """One link for each `left`: its first by falling count (ties: right); it stays if it has `share` of the best count that
    its `right` gets.  A left item is used up by its first link, so windows give what the loop gives."""
    rows = links.filter(F.col("n") >= min_links)
    first = Window.partitionBy(left).orderBy(F.desc("n"), right)
    rows = rows.withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")
    best = F.max("n").over(Window.partitionBy(right))
    return rows.withColumn("__best", best).filter(F.col("n") >= F.col("__best") * share).drop("__best")


def best_hit_per_query(hits: DataFrame, query: str = "query", score: str = "bitscore", order: str = "ord") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc(score), order)
    return hits.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def similarity_cluster(members: DataFrame, similar: DataFrame, cutoff: float, most_rounds: int = 1000) -> DataFrame:
    """(id, centroid): members (id, size) read by falling size (ties: id) join the most similar earlier centroid of `cutoff` or more
    (ties: the earlier one), or become one.  similar: a, b, sim.

    Centroids are an independent set by priority, found in rounds over the undecided pairs: who has no undecided earlier neighbour becomes one, and
    who neighbours an earlier one is a member at once.  Members choose when all centroids are known."""
    ids = cut(members.select(F.col("id").cast("string").alias("id"), "size").withColumn("place", F.struct((-F.col("size")).alias("down"), "id")), "members")
    close = similar.filter(F.col("sim") >= cutoff).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "sim")
    at = lambda name: ids.select(F.col("id").alias(name), F.col("place").alias(f"place_{name}"))
    pairs = close.join(at("a"), "a").join(at("b"), "b")
    swap = F.col("place_a") < F.col("place_b")
    pairs = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("later"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("earlier"), "sim", F.least("place_a", "place_b").alias("place"))
    pairs = cut(pairs.filter("later <> earlier"), "pairs")
    lone = ids.select("id").join(pairs.select(F.col("later").alias("id")), "id", "left_anti").join(pairs.select(F.col("earlier").alias("id")), "id", "left_anti")
    centroids, undecided = [lone], pairs.select("later", "earlier").distinct()
    for _ in range(most_rounds):
        if undecided.isEmpty():
            break
        new = undecided.select(F.col("earlier").alias("id")).distinct().join(undecided.select(F.col("later").alias("id")), "id", "left_anti")
        new = cut(new, "centroids")
        centroids.append(new)
        joined = undecided.join(new.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("id")).distinct()
        gone = cut(joined.unionByName(new), "decided")
        # pairs whose later one is decided mean nothing more; whose earlier one is a member, neither.  Their later ones may be free now
        rest = undecided.join(gone.withColumnRenamed("id", "later"), "later", "left_anti")
        left = cut(rest.join(gone.withColumnRenamed("id", "earlier"), "earlier", "left_anti"), "undecided")
        free = rest.select(F.col("later").alias("id")).distinct().join(left.select(F.col("later").alias("id")), "id", "left_anti").join(left.select(F.col("earlier").alias("id")), "id", "left_anti")
        centroids.append(cut(free, "centroids"))  # nobody undecided is left beside them
        undecided = left
    else:
        raise RuntimeError("the clusters did not settle")
    heads = centroids[0]
    for c in centroids[1:]:
        heads = heads.unionByName(c)
    chosen = pairs.join(heads.withColumnRenamed("id", "earlier"), "earlier", "left_semi").join(heads.withColumnRenamed("id", "later"), "later", "left_anti")
    chosen = chosen.groupBy(F.col("later").alias("id")).agg(F.min_by("earlier", F.struct(-F.col("sim"), "place")).alias("centroid"))
    return chosen.unionByName(heads.select("id", F.col("id").alias("centroid")))
