"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

`H` is the lowercase hex SHA-256 of its inputs' concatenation.  Within a tree the leaves are numbered by rank from 0, and while several
nodes remain, every `arity` consecutive ones (the last run may be shorter, even one) become their H.  A node is labelled with its level and
the interval of leaf ranks that it covers, [lo, hi].  Intervals nest, so a node is an ancestor of what its interval contains, and the siblings of a node are what
its parent's interval holds besides its own.

Levels are taken in buckets of `deep`: one row holds the nodes of a bucket's levels over arity ** deep nodes, so a row has a fixed size
however many leaves a group has.  Bottom-up, each bucket's top nodes are the next bucket's leaves; top-down, a containment join on
(group, number of the enclosing block) hands each block the siblings on its way to the root.  What is shuffled is about one
digest and a half for each row, and a path for each block of 81 leaves.

Nulls: a null field is `-`, a null group is a group of its own and comes first, a null key comes first and is never tampered with.
Repeated keys: by digest, then by tampered digest; equal rows are interchangeable.  Very long texts are hashed whole, where they are read.  An
empty table has no trees and no rows.  Other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions

ARITY, DEEP = 3, 3


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """`-` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `rank` (from 0, by `order` within the group) and `n`, the group's size.

    Rows are dealt by range of (group, order), so a group that holds a third of them is many tasks; a group's count in each part gives
    where the part begins.  Written once, because bounds of ranges may differ from run to run."""
    dealt = rows.withColumn("__row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(rows.sparkSession), *group, *order, "__row").withColumn("__part", F.spark_partition_id())
    dealt = cut(dealt, name)
    own = Window.partitionBy(*group)
    counts = dealt.groupBy(*group, "__part").agg(F.count("*").alias("__c"))
    counts = counts.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("__part").alias("__p"), F.sum("__c").over(own).alias("n"), (F.sum("__c").over(own.orderBy("__part")) - F.col("__c")).alias("__before"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    place = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order, "__row")) - 1
    numbered = dealt.withColumn("__place", place).join(counts, [F.col("__part") == F.col("__p"), *same])
    return numbered.withColumn("rank", F.col("__before") + F.col("__place")).select(*rows.columns, "rank", "n")


def _joined(run: Column) -> Column:
    """One node above the nodes of a run."""
    text = F.array_join(F.transform(run, lambda x: x["hash"]), "")
    return F.struct(F.element_at(run, 1)["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), F.sha2(text.cast("binary"), 256).alias("hash"))


def _levels(blocks: DataFrame, base: int, arity: int, deep: int) -> DataFrame:
    """blocks (l0: their nodes at level base) with the nodes of the next levels, as far as their trees go (null above)."""

    def above(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
        return F.transform(runs, lambda j: _joined(F.slice(nodes, j * arity + 1, F.lit(arity))))

    for i in range(deep):
        nodes = F.col(f"l{i}")
        blocks = blocks.withColumn(f"l{i + 1}", F.when(nodes.isNotNull() & (F.col("n") > arity ** (base + i)), above(nodes)))
    return blocks


def _way(levels: list[Column], lo: Column, hi: Column) -> Column:
    """For each level of a block, from the lowest: the digests on both sides of the node that covers [lo, hi], within its parent."""

    def step(nodes: Column, parents: Column) -> Column:
        up = F.element_at(F.filter(parents, lambda x: (x["lo"] <= lo) & (hi <= x["hi"])), 1)
        inside = F.filter(nodes, lambda x: (up["lo"] <= x["lo"]) & (x["hi"] <= up["hi"]) & ~((x["lo"] <= lo) & (hi <= x["hi"])))
        text = lambda keep: F.array_join(F.transform(F.filter(inside, keep), lambda x: x["hash"]), "")
        return F.struct(text(lambda x: x["hi"] < lo).alias("left"), text(lambda x: x["lo"] > hi).alias("right"))

    return F.array_compact(F.array(*(F.when(b.isNotNull(), step(a, b)) for a, b in zip(levels, levels[1:], strict=False))))


def grow(leaves: DataFrame, group: list[str], payload: list[str], name: str, arity: int = ARITY, deep: int = DEEP) -> list[DataFrame]:
    """The blocks of all trees, one frame for each bucket of levels: group, n, base, block, lo, hi, l0 to l{deep} (and rows, the payload of
    leaves, in the lowest).  leaves: group, rank, n, hash and the payload."""
    most, out, base = leaves.agg(F.max("n")).first()[0] or 0, [], 0
    nodes = leaves.withColumns({"lo": F.col("rank"), "hi": F.col("rank")})
    while True:
        width = arity ** (base + deep)
        own = [F.array_sort(F.collect_list(F.struct("lo", "hi", "hash"))).alias("l0")]
        if payload:
            own.append(F.array_sort(F.collect_list(F.struct("rank", *payload))).alias("rows"))
            payload = []
        blocks = nodes.groupBy(*group, F.floor(F.col("lo") / width).alias("block")).agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *own)
        out.append(cut(_levels(blocks, base, arity, deep), name))
        if most <= width:
            return out
        top = F.element_at(F.col(f"l{deep}"), 1)
        nodes = out[-1].filter(F.col("n") > width).select(*group, "n", "lo", "hi", top["hash"].alias("hash"))
        base += deep


def roots(buckets: list[DataFrame], group: list[str], arity: int = ARITY, deep: int = DEEP) -> DataFrame:
    """group, hash: the last node of each tree."""
    out = None
    for i, b in enumerate(buckets):
        last = F.element_at(F.coalesce(*(F.col(f"l{k}") for k in range(deep, -1, -1))), 1)["hash"]
        own = b.filter(F.col("n") <= arity ** ((i + 1) * deep)).select(*group, last.alias("hash"))
        out = own if out is None else out.unionByName(own)
    return out


def descend(buckets: list[DataFrame], group: list[str], above: DataFrame, carry: list[str], arity: int = ARITY, deep: int = DEEP) -> DataFrame:
    """The lowest blocks with `path`, the siblings above them, and the columns `carry` of their group.  above: group, path, carry."""
    names = [f"l{k}" for k in range(deep + 1)]
    renamed = lambda df, cols: df.select(*(F.col(c).alias(f"__{c}") for c in cols))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    parents = None
    for i in range(len(buckets) - 1, -1, -1):
        own, width = buckets[i], arity ** ((i + 1) * deep)
        done = own.filter(F.col("n") <= width).join(renamed(above, [*group, "path", *carry]), same)
        done = done.select(*own.columns, *(F.col(f"__{c}").alias(c) for c in ["path", *carry]))
        if parents is not None:
            p = renamed(parents, [*group, "block", "lo", "hi", *names, "path", *carry])
            inside = [*same, F.floor(F.col("lo") / (width * arity**deep)) == F.col("__block"), (F.col("__lo") <= F.col("lo")) & (F.col("hi") <= F.col("__hi"))]
            lower = own.filter(F.col("n") > width).join(p, inside)
            way = F.concat(_way([F.col(f"__{c}") for c in names], F.col("lo"), F.col("hi")), F.col("__path"))
            done = done.unionByName(lower.select(*own.columns, way.alias("path"), *(F.col(f"__{c}").alias(c) for c in carry)))
        parents = done
    return parents


def manifest(rows: DataFrame, group: str, key: str, leaf: str, seen: str, arity: int = ARITY, deep: int = DEEP) -> DataFrame:
    """key, group, leaf, rank, subroot, root, proof (digest of the siblings from the leaf to the root), folded (the root recomputed from
    the digest `seen` and the siblings).  Groups' subroots, by group, are the leaves of the last tree."""
    leaves = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(leaf).alias("hash"), F.col(seen).alias("seen"))
    leaves = ranked(leaves, ["group"], ["key", "hash", "seen"], "leaves")
    trees = grow(leaves, ["group"], ["key", "hash", "seen"], "tree", arity, deep)

    tops = ranked(roots(trees, ["group"], arity, deep).withColumn("one", F.lit(0)), ["one"], ["group"], "subroots")
    top = grow(tops, ["one"], ["group", "hash"], "roots", arity, deep)
    root = roots(top, ["one"], arity, deep).select("one", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("hash").alias("root"))
    names = [F.col(f"l{k}") for k in range(deep + 1)]
    groups = descend(top, ["one"], root, ["root"], arity, deep)
    each = F.explode(F.transform("rows", lambda r: F.struct(r["group"].alias("group"), r["hash"].alias("subroot"), F.concat(_way(names, r["rank"], r["rank"]), F.col("path")).alias("path"))))
    groups = cut(groups.select("root", each.alias("g")).select("g.*", "root"), "groups")

    low = descend(trees, ["group"], groups, ["subroot", "root"], arity, deep)
    each = F.explode(F.transform("rows", lambda r: F.struct(r["key"].alias("key"), r["hash"].alias("leaf"), r["seen"].alias("seen"), r["rank"].alias("rank"), F.concat(_way(names, r["rank"], r["rank"]), F.col("path")).alias("path"))))
    out = low.select("group", "subroot", "root", each.alias("r")).select("r.*", "group", "subroot", "root")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)
    folded = F.aggregate("path", F.col("seen"), lambda acc, p: h(p["left"], acc, p["right"]))
    return out.select("key", "group", "leaf", "rank", "subroot", "root", proof.alias("proof"), folded.alias("folded"))
