"""Variable and conserved regions of a marker.  regions: seq_id, ref_len, v (1 to 9), l, r (null: not found)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def all_regions(regions: DataFrame) -> DataFrame:
    """seq_id, ref_len, ord, kind, l, r: C1 V1 C2 ... V9 C10 in order.  A conserved region lies between its variable
    neighbours and is null if it is narrower than two or a neighbour is."""
    w = Window.partitionBy("seq_id").orderBy("v")
    v = regions.withColumn("before", F.lag("r").over(w)).withColumn("here", F.col("v"))
    left = F.when(F.col("v") == 1, F.lit(1)).otherwise(F.col("before") + 1)
    c = v.select("seq_id", "ref_len", (F.col("v") * 2 - 1).alias("ord"), F.lit("c").alias("kind"), left.alias("l"), (F.col("l") - 1).alias("r"))
    last = regions.filter("v = 9").select("seq_id", "ref_len", F.lit(19).cast("long").alias("ord"), F.lit("c").alias("kind"), (F.col("r") + 1).alias("l"), F.col("ref_len").alias("r"))
    both = c.unionByName(last)
    fine = F.col("r") - F.col("l") >= 1
    both = both.withColumn("ok", F.coalesce(fine, F.lit(False))).select("seq_id", "ref_len", "ord", "kind", F.when(F.col("ok"), F.col("l")).alias("l"), F.when(F.col("ok"), F.col("r")).alias("r"))
    return both.unionByName(regions.select("seq_id", "ref_len", (F.col("v") * 2).alias("ord"), F.lit("v").alias("kind"), "l", "r"))


def conserved_regions(regions: DataFrame) -> DataFrame:
    return all_regions(regions).filter("kind = 'c'")


def trim_regions(spans: DataFrame, share: float = 0.25, ends: int = 200, least: int = 25) -> DataFrame:
    """A share off both sides, the sequence's ends left out; null if fewer than `least` positions stay."""
    cut = F.floor((F.col("r") - F.col("l") + 1) * share).cast("int")
    l, r = F.greatest(F.col("l") + cut, F.lit(ends + 1)), F.least(F.col("r") - cut, F.col("ref_len") - ends)
    t = spans.withColumns({"__l": l, "__r": r}).withColumn("__ok", F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("__r") - F.col("__l") + 1 >= least))
    return t.select("seq_id", "ref_len", "ord", "kind", F.when(F.col("__ok"), F.col("__l")).alias("l"), F.when(F.col("__ok"), F.col("__r")).alias("r"))


def flank_filter(spans: DataFrame) -> DataFrame:
    """Null for a region both of whose neighbours are null (the outermost count as having a null one outside)."""
    w = Window.partitionBy("seq_id").orderBy("ord")
    alone = F.lag("l").over(w).isNull() & F.lead("l").over(w).isNull()
    s = spans.withColumn("__alone", alone)
    return s.select("seq_id", "ref_len", "ord", "kind", F.when(~F.col("__alone"), F.col("l")).alias("l"), F.when(~F.col("__alone"), F.col("r")).alias("r"))


def region_spans(spans: DataFrame) -> DataFrame:
    """seq_id, kind, l, r of the regions that are left."""
    return spans.filter("l is not null and r is not null").select("seq_id", "kind", "l", "r")


def region_positions(spans: DataFrame, compat: bool = False) -> DataFrame:
    """seq_id, kind, pos of the regions that are left.  compat: positions one lower, as in results that count from zero here and
    from one in depths."""
    at = F.explode(F.sequence("l", "r")) if not compat else F.explode(F.sequence(F.col("l") - 1, F.col("r") - 1))
    return spans.filter("l is not null and r is not null").select("seq_id", "kind", at.alias("pos"))
