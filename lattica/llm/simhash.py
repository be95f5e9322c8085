"""SimHash near-duplicates: fingerprints, BK-trees over shards, connected groups.

Fingerprints link at `radius` or fewer differing bits; a group is what links connect.  The search never
compares all pairs: cut into radius + 2 blocks, two linked fingerprints agree in two whole blocks
at least, so every fingerprint goes to one shard for each pair of blocks (six for radius 2), and a
shard that still holds more than `split_above` fingerprints is dealt again by the blocks of its
remaining bits, which loses no link and bounds a shard by its bits.  In each shard a BK-tree (children
keyed by their integer distance to the parent) is grown one fingerprint at a time; before it is added,
a fingerprint follows only the edges within the radius of its distance to the node.  A shard's tree
stays where its rows are: the trees of all documents have no proven size bound, so they are not sent
through the driver.  A shard returns one link for each fingerprint to its local group, not pairs.

Equal fingerprints are one node from the start, so a group of copies of any size costs one row.
Groups come from alternating large-star and small-star steps over distinct fingerprints, each
written to the shared folder.

`similar_groups` is the same for whole documents of a Jaccard index of five-word shingles: see there.

Null text counts as empty, empty text has fingerprint zero and links like any other.  A null doc_id
takes part in its group but never names it (component_id is null if no document of the group has
an id).  Very long texts are read whole, a chunk of shingles at a time.  Repeated rows come back as often as they went in; equal
fingerprints are one node whatever their ids, and a group is named by its least id, so ties have no say.  An empty table
gives an empty result; other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.groups import components
from .common import cut, wide_rows

CHUNK = 1 << 16  # shingles whose bits are counted at once


WORDS = 4  # 64-bit words of the wide fingerprint
WIDE = 64 * WORDS
SHORT = 128  # shingles of a set up to which rare shingles are its search keys
PARTS = 48  # part signatures of a longer set
LEVEL_BITS = 16
MIX = np.array([1, *(int(x) | 1 for x in np.random.default_rng(9).integers(1 << 62, 1 << 63, WORDS - 1))], np.uint64)


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of lower-cased (A-Z) words split at ASCII white space, repeats included, in chunks."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    hash64 = xxhash.xxh64_intdigest
    for a in range(0, n, CHUNK):
        yield np.fromiter([hash64(joined[i:j], seed) for i, j in zip(starts[a : a + CHUNK], ends[a : a + CHUNK], strict=True)], np.uint64)


def fingerprint_bytes(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: a bit is one if it is one in over half of the shingles' hashes."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, shingle, seed):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def shingle_set(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle, seed)]))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of a set in WORDS words; the first is the 64-bit fingerprint of the set."""
    ones = np.zeros(WIDE, np.int64)
    for a in range(0, len(h), CHUNK // 8):
        mixed = h[a : a + CHUNK // 8, None] * MIX
        mixed[:, 1:] ^= mixed[:, 1:] >> np.uint64(32)
        ones += np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(len(mixed), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view(">u8").astype(np.uint64)


def part_signatures(h: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Signatures of `parts` parts of a set (of twice as many near the edge of two sizes).

    Elements are dealt by their hashes to 2^k parts of three or four each (k follows the set's size; near the edge of two
    k, both), and a part's signature is the sum of its hashes.  Two sets of Jaccard index 0.8 agree in a part with a chance of
    0.3 or more, so that they agree in none of 48 with one of less than one in ten million."""
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    out = [np.zeros(0, np.uint64)]
    for k in sorted({max(0, int(np.floor(np.log2(max(len(h), 1) * f / 2.5)))) for f in (1 / 1.12, 1.12)}):
        part = (mixed >> np.uint64(24)) & np.uint64((1 << k) - 1)
        own = part < parts
        order = np.argsort(part[own], kind="stable")
        named = part[own][order]
        if len(named):
            first = np.concatenate([[0], np.nonzero(np.diff(named))[0] + 1])
            sums = np.add.reduceat((mixed ^ mixed >> np.uint64(31))[own][order], first)
            out.append((sums + np.uint64(k * 0x165667B19E3779F9 % (1 << 64)) + named[first] * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD))
    return np.concatenate(out)


def rare_shingles(h: np.ndarray, levels: np.ndarray, least_jaccard: float) -> np.ndarray:
    """The rarest elements of a set, as many as two sets of the index cannot both have without a common one: with all sets in
    one order, each needs its first n - ceil(n * index) + 1."""
    n = len(h) - int(np.ceil(len(h) * least_jaccard - 1e-9)) + 1
    return h[np.lexsort((h, levels[(h >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]))[:n]]


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a signed long; null text counts as empty."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint_bytes((t or "").encode("utf-8", "surrogatepass"), shingle, seed) for t in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- BK-tree


class BKTree:
    """Node: [value, {distance: child}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def near_then_add(self, value: int, radius: int) -> list[int]:
        """Values within the radius, then value itself is added (once)."""
        if self.root is None:
            self.root = [value, {}]
            return []
        found, stack = [], [self.root]
        while stack:
            v, children = stack.pop()
            d = (v ^ value).bit_count()
            if d <= radius:
                found.append(v)
            if children:
                for e in range(max(d - radius, 0), d + radius + 1):
                    if e in children:
                        stack.append(children[e])
        v, children = self.root
        while d := (v ^ value).bit_count():
            if d not in children:
                children[d] = [value, {}]
                break
            v, children = children[d]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, least value of its group within the shard) for all but the least ones."""
    if len(values) == 2:
        a, b = sorted(values)
        return [(b, a)] if (a ^ b).bit_count() <= radius else []
    tree, parent = BKTree(), {}

    def find(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = p = parent.setdefault(p, p)
            v = p
        return v

    for v in values:
        for u in tree.near_then_add(v, radius):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(v, r) for v in values if (r := find(v)) != v]


def _blocks(width: int, n: int) -> list[tuple[int, int]]:
    """(shift, mask) of n nearly equal blocks of width bits."""
    edges = [width * i // n for i in range(n + 1)]
    return [(a, (1 << b - a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _field(fp: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(mask))


def shard_rows(fps: DataFrame, radius: int) -> DataFrame:
    """(shard, rest, fp): a row for each pair of blocks.  rest holds the bits outside the two blocks."""
    cells = _blocks(64, radius + 2)
    keys = []
    for i in range(len(cells)):
        for j in range(i + 1, len(cells)):
            (a, m), (b, k) = cells[i], cells[j]
            # pair number | block | block: blocks have 22 bits at most, pair numbers 5
            key = F.shiftleft(F.lit(i * len(cells) + j).cast("long"), 48).bitwiseOR(F.shiftleft(_field(F.col("fp"), a, m), k.bit_length())).bitwiseOR(_field(F.col("fp"), b, k))
            keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("shard"), "fp")


def split_rows(big: DataFrame, radius: int) -> DataFrame:
    """Rows of large shards, dealt by radius + 1 blocks of the bits that the shard leaves open: linked
    fingerprints agree in one of them."""
    cells = _blocks(64, radius + 2)
    n, cases = len(cells), []
    for i in range(n):
        for j in range(i + 1, n):
            open_bits = [(s + t, 1) for k, (s, m) in enumerate(cells) if k not in (i, j) for t in range(m.bit_length())]
            subs = []
            for c, (s, m) in enumerate(_blocks(len(open_bits), radius + 1)):
                # contiguous runs of open bits, gathered field by field
                runs, value, at = [], F.lit(0).cast("long"), 0
                for bit, _ in open_bits[s : s + m.bit_length()]:
                    if runs and runs[-1][0] + runs[-1][1] == bit:
                        runs[-1][1] += 1
                    else:
                        runs.append([bit, 1])
                for bit, size in runs:
                    value = value.bitwiseOR(F.shiftleft(_field(F.col("fp"), bit, (1 << size) - 1), at))
                    at += size
                subs.append(F.struct(F.lit(c).alias("cell"), value.alias("bits")))
            cases.append((i * n + j, F.array(*subs)))
    which = F.shiftrightunsigned("shard", 48)
    picked = reduce(lambda rest, case: F.when(which == case[0], case[1]).otherwise(rest), cases[:-1], cases[-1][1])
    return big.select("shard", F.explode(picked).alias("sub"), "fp").select("shard", F.col("sub.cell").alias("cell"), F.col("sub.bits").alias("bits"), "fp")


def _link_shards(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links of each shard: rows meet by shard and are sorted, so a task holds one shard at a time."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            changes = (pdf[keys].values[1:] != pdf[keys].values[:-1]).any(1)
            edges = np.concatenate([[0], np.nonzero(changes)[0] + 1])
            yield links(pdf["fp"].to_numpy()[: edges[-1]], edges[:-1])
            rest = pdf.iloc[edges[-1] :]
        if rest is not None and len(rest):
            yield links(rest["fp"].to_numpy(), np.array([0]))

    def links(fp: np.ndarray, edges: np.ndarray) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(fp):
            ends = np.append(edges[1:], len(fp))
            for a, b in zip(edges[(many := ends - edges > 1)].tolist(), ends[many].tolist(), strict=True):
                out += shard_links(fp[a:b].view(np.uint64).tolist(), radius)
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(search, "a long, b long")


def near_links(fps: DataFrame, radius: int = 2, split_above: int = 512) -> DataFrame:
    """(a, b): links that connect just what the fingerprints of fps (column fp, distinct) within the
    radius connect.  Each fingerprint has a link to the least of its group in each of its shards."""
    if not 1 <= radius <= 3:
        raise ValueError("radius must be 1 to 3")
    rows = shard_rows(fps, radius)
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    rows = cut(rows.join(sizes, "shard"), "shards")
    small = _link_shards(rows.filter(F.col("n") <= split_above).select("shard", "fp"), ["shard"], radius)
    large = split_rows(rows.filter(F.col("n") > split_above).select("shard", "fp"), radius)
    return small.unionByName(_link_shards(large, ["shard", "cell", "bits"], radius)).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, extra: dict[str, Column] | None = None) -> DataFrame:
    """id_col, fp (long), component_id, group: one row for each row of docs, and columns of `extra`."""
    wide_rows(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp"), *(c.alias(n) for n, c in (extra or {}).items())), "fingerprints")
    links = near_links(rows.select("fp").distinct(), radius)
    return _name_groups(rows, links, id_col, list(extra or {}))


# ---------------------------------------------------------------- similar documents


def far(size: np.ndarray | int) -> np.ndarray:
    """Differing bits of wide fingerprints up to which two sets (the smaller of which has `size` elements) may be alike.

    An index of 0.8 is an angle of 27.3 degrees or less, a chance of 0.152 for a bit to differ, or 0.19 for sets so small that ties
    count; five standard deviations are allowed."""
    return np.where(np.asarray(size) < 32, int(0.19 * WIDE + 5 * np.sqrt(WIDE * 0.19 * 0.81)), int(0.152 * WIDE + 5 * np.sqrt(WIDE * 0.152 * 0.848)))


def block_pairs(hot: DataFrame, key: str, blocks: Column, *more: str) -> DataFrame:
    """(key, first, second, node, more): rows (key, node, more), dealt by a hash to `blocks` blocks of their key and repeated for each
    other block, so that any two of a key meet in some pair of blocks, whose size does not grow with the key's."""
    dealt = hot.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node", key), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select(key, F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "node", *more)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least_jaccard: float = 0.8, split_above: int = 1024, extra: dict[str, Column] | None = None) -> DataFrame:
    """id_col, fp, component_id, group, and columns of `extra`: groups of documents that are linked by an exact Jaccard index of
    least_jaccard (0.8 or more) of their sets of shingles.  Documents without words are one group.

    1. Each set gets a wide SimHash fingerprint and search keys.  A set of SHORT elements or fewer takes its rarest elements
       (two sets of the index share one of them for sure; how common an element is comes from counts over all short sets, so that
       common passages are no keys); a longer one takes part signatures.  Sets near SHORT take both.
    2. In the shard of each key a BK-tree over the fingerprints finds which sets are near enough to be alike (`far`); a shard
       returns links that connect those, not pairs.  What they connect is a family.
    3. A family's sets meet once, and links are pairs whose exact index is high enough.

    Shards and families of more than `split_above` sets are searched by pairs of blocks of half as many, so tasks are bounded at
    any size and no rule depends on the size.  Equal sets are one node."""
    if not 0.8 <= least_jaccard <= 1:
        raise ValueError("least_jaccard must be 0.8 to 1")
    wide_rows(docs.sparkSession)
    words = [f"w{i}" for i in range(WORDS)]
    kind = T.StructType().add("node", T.LongType()).add("hashes", T.ArrayType(T.LongType())).add("parts", T.ArrayType(T.LongType()))
    for w in words:
        kind = kind.add(w, T.LongType())

    @F.pandas_udf(kind)
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h = shingle_set(t.encode("utf-8", "surrogatepass"), shingle)
            parts = part_signatures(h) if len(h) > SHORT else np.zeros(0, np.uint64)
            node = np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64)
            out.append((node, h.view(np.int64), parts.view(np.int64), *wide_fingerprint(h).view(np.int64).tolist()))
        return pd.DataFrame(out, columns=kind.names)

    made = docs.select(F.col(id_col).alias("id"), sketch(F.coalesce(F.col(text_col), F.lit(""))).alias("s"), *(c.alias(n) for n, c in (extra or {}).items()))
    made = made.select("id", *(F.col(f"s.{c}").alias(c) for c in kind.names), *(extra or {}))
    rows = cut(made.select(*made.columns, F.size("hashes").alias("size"), F.monotonically_increasing_id().alias("row")), "sketches")
    short = rows.filter(F.col("size").between(1, int(SHORT / least_jaccard) + 1))
    counts = short.select(F.explode("hashes").alias("h")).select(F.shiftrightunsigned("h", 64 - LEVEL_BITS).alias("bucket")).groupBy("bucket").count().collect()  # 2^LEVEL_BITS rows at most
    levels = np.zeros(1 << LEVEL_BITS, np.uint8)  # counts by their powers of two
    for r in counts:
        levels[r["bucket"]] = r["count"].bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def rare(hashes: pd.Series) -> pd.Series:
        return pd.Series([rare_shingles(np.asarray(h, np.int64).view(np.uint64), shared.value, least_jaccard).view(np.int64) for h in hashes])

    keys = short.select("node", F.explode(rare("hashes")).alias("shard")).unionByName(rows.filter(F.size("parts") > 0).select("node", F.explode("parts").alias("shard")))
    cells = keys.distinct()
    sizes = cells.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    facts = rows.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), *(F.first(w).alias(w) for w in words))
    dealt = block_pairs(cells.join(sizes, "shard"), "shard", F.when(F.col("n") > split_above, F.ceil(F.col("n") * 2 / split_above)).otherwise(1))
    near = components(cut(_in_groups(dealt.join(facts, "node"), "shard", ["size", *words], _near).distinct(), "near")).withColumnRenamed("component", "root")

    # one row stands for each set, so copies of a text go no further than their fingerprint
    member = cut(near.join(facts, "node").select("node", "root", "row", "size"), "members")
    family = member.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    member = cut(member.join(family, "root").select("row", "root", "node", "n", "held"), "members")
    few = member.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then sets that are in no family are not moved
    sets = rows.select("row", "hashes").join(F.broadcast(member) if few else member, "row")
    blocks = F.greatest(F.when(F.col("n") > split_above, F.ceil(F.col("n") * 2 / split_above)).otherwise(1), F.ceil(F.col("held") / ELEMENTS))
    met = block_pairs(sets, "root", F.least(blocks, F.col("n")), "hashes")
    links = cut(_in_groups(met, "root", ["hashes"], lambda *cols: _alike(*cols, least_jaccard)).distinct(), "links")
    return _name_groups(rows.withColumnRenamed("w0", "fp"), links, id_col, list(extra or {}), "node")


ELEMENTS = 1 << 18  # of the sets of a block
BROADCAST_ROWS = 500_000  # members of families (40 bytes each) that may be broadcast; beyond, Spark joins as it likes


def _in_groups(rows: DataFrame, key: str, cols: list[str], search: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what search(node, *cols) gives for each group (key, first, second) of rows.  Rows are sorted, so a task holds a
    batch and one group at a time."""
    keys = [key, "first", "second"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            changes = (pdf[keys].values[1:] != pdf[keys].values[:-1]).any(1)
            edges = [0, *(np.nonzero(changes)[0] + 1).tolist(), len(pdf)]
            if held and (pdf[keys].iloc[0].values != held[-1][keys].iloc[0].values).any():
                yield told([pd.concat(held, ignore_index=True)] if len(held) > 1 else held, None)
                held = []
            if len(edges) == 2:  # one group: it may go on
                held.append(pdf)
                continue
            if held:
                yield told([pd.concat([*held, pdf.iloc[: edges[1]]], ignore_index=True)], None)
                edges = edges[1:]
            yield told([pdf], edges[:-1])
            held = [pdf.iloc[edges[-2] :]]
        if held:
            yield told([pd.concat(held, ignore_index=True)], None)

    def told(frames: list[pd.DataFrame], edges: list[int] | None) -> pd.DataFrame:
        pdf, out = frames[0], []
        edges = edges or [0, len(pdf)]
        values = [pdf[c].to_numpy() for c in ("node", *cols)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                out += search(*(v[a:b] for v in values))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.select(*keys, "node", *cols).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


class Groups:
    """Rows and the group of each."""

    def __init__(self, node: np.ndarray):
        self.node, self.label, self.links = node, np.arange(len(node)), []

    def join(self, i: int, others: np.ndarray) -> None:
        """Joins row i with the groups of the other rows, by one link to each that is new."""
        labels, first = np.unique(self.label[others], return_index=True)
        new = labels != self.label[i]
        for j in others[first[new]].tolist():
            self.links.append((int(self.node[i]), int(self.node[j])))
        if new.any():
            self.label[np.isin(self.label, labels[new])] = self.label[i]


def _near(node: np.ndarray, size: np.ndarray, *words: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the nodes of a shard whose sizes and fingerprints allow the index.

    A BK-tree: up to 32 nodes are added one by one; beyond, the root's children, keyed by their distances to it, are held as sorted
    arrays and a node is compared with those on edges within the radius."""
    n, radius = len(node), int(far(0))
    if n <= 32:
        values = [sum(int(w[i]) % (1 << 64) << 64 * k for k, w in enumerate(words)) for i in range(n)]
        groups, sizes, tree, at = Groups(node), size.tolist(), BKTree(), {}
        for i, v in enumerate(values):
            fits = []
            for u in tree.near_then_add(v, radius):
                for j in at[u]:
                    small, large = sorted((sizes[i], sizes[j]))
                    if small >= 0.8 * large - 1e-9 and (u ^ v).bit_count() <= far(small):
                        fits.append(j)
            at.setdefault(v, []).append(i)
            if fits:
                groups.join(i, np.array(fits))
        return groups.links
    bits = np.stack([w.astype(np.int64).view(np.uint64) for w in words], 1)
    distance = np.bitwise_count(bits ^ bits[0]).sum(1, dtype=np.int64)
    order = np.argsort(distance, kind="stable")
    size, bits, distance = size[order].astype(np.int64), bits[order], distance[order]
    groups, step = Groups(node[order]), max(1, CHUNK * 4 // n)
    for a in range(0, n, step):
        e = min(a + step, n)
        low = int(np.searchsorted(distance, distance[a] - radius))
        differ = sum(np.bitwise_count(bits[a:e, None, k] ^ bits[low:e, k]).astype(np.int16) for k in range(bits.shape[1]))
        small, large = np.minimum(size[a:e, None], size[low:e]), np.maximum(size[a:e, None], size[low:e])
        fits = (differ <= far(small)) & (small >= 0.8 * large - 1e-9) & (np.arange(low, e) < np.arange(a, e)[:, None])
        for i in np.nonzero(fits.any(1))[0].tolist():
            groups.join(a + i, low + np.nonzero(fits[i])[0])
    return groups.links


def _alike(node: np.ndarray, hashes: np.ndarray, least_jaccard: float) -> list[tuple[int, int]]:
    """Links that connect the sets of a group whose exact index is least_jaccard or more.

    Common elements are counted by lists of the sets that hold each element, for one set at a time against the smaller ones."""
    n = len(node)
    sizes = np.array([len(h) for h in hashes], np.int64)
    order = np.argsort(sizes, kind="stable")
    groups, hashes, sizes = Groups(node[order]), [hashes[i] for i in order], sizes[order]
    _, name = np.unique(np.concatenate(hashes), return_inverse=True)
    by_name = np.argsort(name, kind="stable")
    holders = np.repeat(np.arange(n), sizes)[by_name]
    starts = np.searchsorted(name[by_name], np.arange(name.max(initial=-1) + 2))
    ends, low = np.cumsum(sizes), np.searchsorted(sizes, least_jaccard * sizes - 1e-9)
    for i in range(1, n):
        own = name[ends[i] - sizes[i] : ends[i]]
        lengths = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(holders[at], minlength=n)[low[i] : i]
        j = low[i] + np.nonzero(both >= least_jaccard * (sizes[low[i] : i] + sizes[i] - both) - 1e-9)[0]
        if len(j):
            groups.join(i, j)
    return groups.links


SALTS = 8  # tasks that a group's names are dealt to


def _name_groups(rows: DataFrame, links: DataFrame, id_col: str, more: list[str], key: str = "fp") -> DataFrame:
    """id_col, fp, component_id, group (a number that no other group has) and more.  Only linked keys look up their group's name;
    the keys of a large group do so in SALTS tasks."""
    keys = rows.groupBy(F.col(key).alias("key")).agg(F.min("id").alias("least"))
    named = cut(keys.join(components(links).withColumnRenamed("component", "root"), F.col("key") == F.col("node"), "left").select("key", "least", "root"), "named")
    linked = named.filter("root is not null").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    names = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    parts = linked.join(names, ["root", "salt"]).select(F.col("key").alias(key), "component_id", F.col("root").alias("group"))
    alone = named.filter("root is null").select(F.col("key").alias(key), F.col("least").alias("component_id"), F.col("key").alias("group"))
    parts = cut(parts.unionByName(alone), "components")
    return rows.select("id", *dict.fromkeys(["fp", key]), *more).join(parts, key).select(F.col("id").alias(id_col), "fp", "component_id", "group", *more)
