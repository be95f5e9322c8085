"""Clusters, pivots, statistics and k-mer joins over plain tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cigar import percent
from ..functions.sequence import reverse_complement
from .groups import cut


def cluster_members(df: DataFrame, cluster: str, member: str) -> DataFrame:
    """Sorted, comma-joined members of each cluster."""
    return df.groupBy(cluster).agg(F.array_join(F.sort_array(F.collect_set(F.col(member).cast("string"))), ",").alias("members"))


def cluster_longest(df: DataFrame, cluster: str, length: str, order: str) -> DataFrame:
    """The longest row of each cluster; the first by `order` wins ties.  One partial aggregate instead of a sort."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(length), -F.col(order)))
    return df.groupBy(cluster).agg(best.alias("b")).select("b.*")


def exact_dereplicate(df: DataFrame, text: str, member: str) -> DataFrame:
    """(digest, representative, n): equal texts, named by their least member."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("digest")).agg(F.min(member).alias("representative"), F.count("*").alias("n"))


def pivot_counts(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0)


def relative_abundance(df: DataFrame, ids: str, sample: str, values: list, sep: str = ":") -> DataFrame:
    """Share of each id of a multi-valued column in each sample, one column for each sample."""
    one = df.select(F.explode(F.split(ids, sep)).alias("id"), sample).groupBy("id", sample).agg(F.count("*").alias("n"))
    share = one.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(sample)))
    return share.groupBy("id").pivot(sample, values).agg(F.first("share")).fillna(0.0)


def subset_nonzero_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    keep = F.greatest(*columns) > 0 if len(columns) > 1 else F.col(columns[0]) > 0
    return df.select(key, *columns).filter(keep)


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    c = lambda f: F.expr(f"{f}({y}, {x})")
    return df.agg(c("regr_slope").alias("slope"), c("regr_intercept").alias("intercept"), c("regr_r2").alias("r2"))


def running_counts(counts: DataFrame, col: str, n: str, name: str) -> DataFrame:
    """counts (a row for each distinct value of col) with the sum of n before it, by ranges of col: no single task sorts all values."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: the bounds of ranges come from samples and may differ from run to run
    dealt = cut(counts.repartitionByRange(parts, col).withColumn("__p", F.spark_partition_id()), "ranks")
    sums = {r["__p"]: r["s"] for r in dealt.groupBy("__p").agg(F.sum(n).alias("s")).collect()}  # a row for each partition
    before, at = {}, 0
    for p in sorted(sums):
        before[p] = at
        at += sums[p]
    if not before:
        return counts.withColumn(name, F.lit(0).cast("long"))
    base = F.element_at(F.create_map(*(x for p, b in before.items() for x in (F.lit(p), F.lit(b).cast("long")))), F.col("__p"))
    return dealt.withColumn(name, base + F.sum(n).over(Window.partitionBy("__p").orderBy(col)) - F.col(n)).drop("__p")


def average_rank(df: DataFrame, col: str, name: str) -> DataFrame:
    """df with the average rank of col (ties share theirs).  Ranks come from counts of distinct values, which
    partial aggregation shrinks first, and their running sum by ranges."""
    counts = running_counts(df.groupBy(col).agg(F.count("*").alias("__c")), col, "__c", "__before")
    ranks = counts.select(F.col(col).alias("__v"), (F.col("__before") + (F.col("__c") + 1) / 2).alias(name))
    return df.join(ranks, df[col] == ranks["__v"]).drop("__v")


def spearman(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Rank correlation over the union of keys; a missing value is 0."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full_outer").fillna(0, ["x", "y"])
    ranked = average_rank(average_rank(both, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def normal_tail(z: Column) -> Column:
    """P(|N| > |z|), by the Abramowitz-Stegun approximation 7.1.26 of erf (off by 1.5e-7 at most)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def mann_whitney_u(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """n1, n2, u of the first sample, z of its normal approximation and the two-sided p-value.

    The variance is corrected for ties, the difference from the mean is drawn in by a half (continuity).  Both samples are counted by distinct value first, so
    ranks and ties come from counts; without any spread p is 1."""
    one = lambda df, x, y: df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")).filter("v is not null").select("v", (F.col("c") * x).alias("x"), (F.col("c") * y).alias("y"))
    counts = one(a, 1, 0).unionByName(one(b, 0, 1)).groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    ranked = running_counts(counts.withColumn("t", F.col("x") + F.col("y")), "v", "t", "before")
    t = F.col("t").cast("double")
    r = ranked.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n1"), F.coalesce(F.sum("y"), F.lit(0)).alias("n2"), F.sum(F.col("x") * (F.col("before") + (t + 1) / 2)).alias("sum"), F.sum(t * t * t - t).alias("ties"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    r = r.withColumn("u", F.col("sum") - n1 * (n1 + 1) / 2)
    off, spread = F.col("u") - n1 * n2 / 2, n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.when(spread > 0, F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / F.sqrt(spread)).otherwise(F.when((n1 > 0) & (n2 > 0), 0.0))
    return r.select("n1", "n2", "u", z.alias("z")).withColumn("p", normal_tail(F.col("z")))


def histogram_filtered(df: DataFrame, value: str, confidence: str, least: float, width: float, high: float = 90.0) -> DataFrame:
    """bin, n, high_pct: counts by bins of `width` for rows whose confidence is `least` or more, and of all those rows the
    percentage whose value is `high` or more."""
    own = df.filter(F.col(confidence) >= least)
    bins = own.groupBy((F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col(value) >= high).alias("__high"))
    every = Window.partitionBy(F.lit(0))  # over bins, not rows
    return bins.select("bin", "n", percent(F.sum("__high").over(every), F.sum("n").over(every)).alias("high_pct"))


def feature_count_per_genome(contigs: DataFrame, features: DataFrame) -> DataFrame:
    """genome, n: features on the contigs of each genome, 0 included."""
    f = features.groupBy("contig").agg(F.count("*").alias("__k"))
    return contigs.select("contig", "genome").join(f, "contig", "left").groupBy("genome").agg(F.coalesce(F.sum("__k"), F.lit(0)).alias("n"))


def spurious_share(hits: DataFrame, rate: str, query: str, good: Column) -> DataFrame:
    """rate, n, share: for each sampling rate the percentage of queries none of whose hits is good."""
    q = hits.groupBy(rate, query).agg(F.max(good.cast("int")).alias("__good"))
    return q.groupBy(rate).agg(percent(F.sum(1 - F.col("__good")), F.count("*")).alias("share"), F.count("*").alias("n"))


def insert_size_share(df: DataFrame, value: Column, cutoffs: list[float]) -> DataFrame:
    """cutoff, n, share: pairs at or above each cutoff, and their percentage."""
    v = df.select(value.alias("__v"), F.explode(F.array(*(F.lit(c) for c in cutoffs))).alias("cutoff"))
    n = F.sum((F.col("__v") >= F.col("cutoff")).cast("int"))
    return v.groupBy("cutoff").agg(n.alias("n"), percent(n, F.count("*")).alias("share"))


def share_at_least(value: Column, cutoff: float) -> tuple[Column, Column]:
    n = F.sum((value >= cutoff).cast("int"))
    return n, percent(n, F.count("*"))


def feature_index(features: DataFrame, genome: str) -> DataFrame:
    """Names `{genome}_16S_{i}` in order of position, with the feature's length."""
    w = Window.partitionBy(genome).orderBy("contig", "l", "r")
    return features.select(F.concat(F.col(genome), F.lit("_16S_"), F.row_number().over(w).cast("string")).alias("name"), "contig", "l", "r", (F.col("r") - F.col("l") + 1).alias("len"))


def one_per_taxon(df: DataFrame, taxon: str, order: str) -> DataFrame:
    w = Window.partitionBy(taxon).orderBy(order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def well_assigned(hits: DataFrame, ref: str = "ref_id", read: str = "read_base") -> DataFrame:
    """(a, b, n, share): of the reads of reference a, how many also hit b, relative to a's own."""
    h = hits.select(ref, read).distinct()
    pairs = h.select(F.col(ref).alias("a"), read).join(h.select(F.col(ref).alias("b"), read), read).groupBy("a", "b").agg(F.count("*").alias("n"))
    own = F.max(F.when(F.col("a") == F.col("b"), F.col("n"))).over(Window.partitionBy("a"))
    return pairs.withColumn("share", percent(F.col("n"), own))


# ---------------------------------------------------------------- k-mers


def canonical_kmers(seq: Column, k: int) -> Column:
    """Distinct hashes of a sequence's k-mers, each the lesser of itself and its reverse complement, so that both strands agree."""
    own = F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))
    each = F.transform(own, lambda s: F.xxhash64(F.least(s, reverse_complement(s))))  # of the k-mer alone: a lambda's body is computed for each, with all that it names
    return F.when(F.length(seq) >= k, F.array_distinct(each))


def kmers(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, kmer), distinct within a row; both strands alike."""
    return df.filter(F.length(seq) >= k).select(key, F.explode(canonical_kmers(F.col(seq), k)).alias("kmer"))


def sequence_classes(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, representative): the least key with the same sequence."""
    least = df.groupBy(F.xxhash64(seq).alias("__h"), seq).agg(F.min(key).alias("representative"))
    return df.select(key, F.xxhash64(seq).alias("__h"), seq).join(least, ["__h", seq]).select(key, "representative")


# pairs that meet at a k-mer are rows up to FEW_PAIRS; a block's index takes about BLOCK_BYTES and is made in steps of STEP_LETTERS letters; 1 << CELL_BITS
# neighbours are counted together first
FEW_PAIRS, FEWEST_BLOCKS, BLOCK_BYTES, STEP_LETTERS, CELL_BITS, TOGETHER = 10_000_000, 12, 1 << 28, 1 << 20, 3, 1 << 16


def kmer_similarity_join(df: DataFrame, key: str, seq: str, k: int, least: float, block: int = 512, few: int = FEW_PAIRS) -> DataFrame:
    """(a, b, sim) with a < b: pairs of sequences whose sets of canonical k-mers have a Jaccard index of `least` or more, on either strand.  Equal sequences are one,
    named by their least key (sequence_classes says who belongs to it), so copies do not multiply.

    How many pairs meet at a k-mer says which way is taken; both are exact.  Up to `few` (or 64 a sequence): prefix filtering.  More, as with short k-mers,
    which unrelated sequences share: no pair that only meets is written; blocks of sequences count what they have in common (_in_blocks)."""
    one = cut(df.filter(F.length(seq) >= k).groupBy(seq).agg(F.min(key).alias(key)).select(key, seq), "sequences")
    meetings, distinct = _holders(one, seq, k).agg(F.sum(F.col("df") * (F.col("df") - 1) / 2), F.count("*")).first()
    if (meetings or 0) > few:
        rows, letters = one.agg(F.count("*"), F.sum(F.length(seq))).first()
        if meetings > 64 * rows:
            return _in_blocks(one, key, seq, k, least, max(FEWEST_BLOCKS, -(-letters // _block_letters(distinct))))
    return _by_prefix(one, key, seq, k, least, block)


def _by_prefix(one: DataFrame, key: str, seq: str, k: int, least: float, block: int) -> DataFrame:
    """Pairs by their rarest k-mers.

    Prefix filtering: by rarest k-mer first, a set's first n - ceil(least * n) + 1 k-mers must meet one of the other's, so only
    those are joined, and k-mers that everything holds stay out of the join.  Positional filtering: a pair's first common k-mer leaves room for one
    more than the rest of either set; if that is too little for the index, the pair is dropped where it is found.  A k-mer in the prefixes of
    more than `block` sequences is dealt to pairs of blocks of about that size, so no key of the join is larger, whatever a family of
    near-equal sequences shares.  Pairs that are left are verified on their whole sets."""
    sets = cut(one.select(key, canonical_kmers(F.col(seq), k).alias("set")).select(key, "set", F.size("set").alias("n")), "kmers")
    rows = sets.select(key, "n", F.explode("set").alias("kmer"))
    seen = rows.groupBy("kmer").agg(F.count("*").alias("df")).filter("df > 1")
    # k-mers of one row only come first; they match nothing, so only their number matters
    order = Window.partitionBy(key).orderBy("df", "kmer")
    ranked = rows.join(seen, "kmer").withColumn("shared", F.count("*").over(Window.partitionBy(key))).withColumn("i", F.row_number().over(order) + F.col("n") - F.col("shared"))
    blocks = F.ceil(F.col("df") / block).cast("int")
    prefix = ranked.filter(F.col("i") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(F.col(key).alias("key"), "kmer", "n", "i", blocks.alias("blocks"), F.pmod(F.xxhash64(F.col(key)), blocks).cast("int").alias("own"))
    prefix = cut(prefix, "prefixes")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = prefix.select(F.col("key").alias("a"), "kmer", F.col("own").alias("x"), every.alias("y"), F.col("n").alias("na"), F.col("i").alias("ia"))
    b = prefix.select(F.col("key").alias("b"), "kmer", every.alias("x"), F.col("own").alias("y"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    room = 1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * least) & (room * (1 + least) >= (F.col("na") + F.col("nb")) * least - 1e-9)
    found = a.join(b, ["kmer", "x", "y"]).filter((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    of = lambda side: sets.select(F.col(key).alias(side), F.col("set").alias(f"set_{side}"), F.col("n").alias(f"n{side}"))
    common = found.join(of("a"), "a").join(of("b"), "b").withColumn("c", F.size(F.array_intersect("set_a", "set_b")))
    return common.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("sim")).filter(F.col("sim") >= least)


def _strand_hashes(seqs: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each k-mer: the lesser of the 64-bit hashes of itself and its reverse complement, so hashes agree where canonical k-mers do."""
    if not sum(map(len, seqs)) >= k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    letters = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32)
    other = np.arange(128, dtype=np.uint32)
    other[[ord(c) for c in "ACGTacgt"]] = [ord(c) for c in "TGCAtgca"]
    back = np.where(letters < 128, other[np.minimum(letters, 127)], letters)
    n, hashes = len(letters) - k + 1, []
    for own, order in ((letters, range(k)), (back, range(k - 1, -1, -1))):
        code = (own.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
        h = np.zeros(n, np.uint64)
        for j in order:
            h *= np.uint64(0xD1342543DE82EF95)
            h += code[j : j + n]
        hashes.append(h ^ (h >> np.uint64(31)))
    row = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    whole = row[:n] == row[k - 1 :]
    return row[:n][whole], np.minimum(*hashes)[whole]


def _steps(seqs: list[str], letters: int, most: int = 1 << 16) -> Iterator[slice]:
    """Slices of about `letters` letters and `most` sequences at most."""
    at = size = 0
    for i, s in enumerate(seqs):
        size += len(s)
        if size >= letters or i + 1 - at == most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(seqs):
        yield slice(at, len(seqs))


def _hashes(seqs: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """_strand_hashes in short steps, so that what it makes by the way stays small."""
    parts = [(part.start, *_strand_hashes(seqs[part], k)) for part in _steps(seqs, 1 << 15)] or [(0, *_strand_hashes([], k))]
    return np.concatenate([r + at for at, r, _ in parts]), np.concatenate([h for _, _, h in parts])


def _distinct(sorted_values: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return sorted_values[new]


def _spots(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """searchsorted(known, h) for hashes, whose first bits nearly say where they are."""
    bits = np.uint64(64 - min(max(len(known).bit_length(), 1), 20))
    spots = np.searchsorted(known, np.arange(1 << 64 - int(bits), dtype=np.uint64) << bits)[h >> bits]
    some = np.arange(len(h) if len(known) else 0)
    while len(some):
        some = some[(spots[some] < len(known)) & (known[np.minimum(spots[some], len(known) - 1)] < h[some])]
        spots[some] += 1
    return spots


def _grouped(major: np.ndarray, minor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct minor numbers of each major number below n: where each one's begin, and all of them."""
    both = _distinct(np.sort(major.astype(np.uint64) << np.uint64(32) | minor.astype(np.uint64)))
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=n), out=starts[1:])
    return starts, (both & np.uint64(0xFFFFFFFF)).astype(np.int32)


def _holders(one: DataFrame, seq: str, k: int) -> DataFrame:
    """(kmer, df): how many sequences hold each canonical k-mer.  Counted in tasks first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seqs = batch["seq"].tolist()
            for part in _steps(seqs, STEP_LETTERS):
                known, starts, _ = _step(seqs[part], k)
                yield pd.DataFrame({"kmer": known.view(np.int64), "df": np.diff(starts)})

    return one.select(F.col(seq).alias("seq")).mapInPandas(count, "kmer long, df long").groupBy("kmer").agg(F.sum("df").alias("df"))


def _step(seqs: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct k-mers of a step's sequences, where each one's holders begin, and all of these."""
    row, h = _hashes(seqs, k)
    known = _distinct(np.sort(h))
    return known, *_grouped(_spots(known, h), row, len(known))


def _block_letters(distinct: int) -> int:
    """How many letters a block may have, if all sequences have so many distinct k-mers.  Of its index a letter takes 10 bytes (its holder in the step and in the
    whole, and itself where a block meets itself), a k-mer of a step 16 and one of the block 28."""
    each = 10 + 16 * min(distinct, STEP_LETTERS) / STEP_LETTERS
    return max(BLOCK_BYTES // 54, int((BLOCK_BYTES - 28 * distinct) / each))


class _Block:
    """A block's sequences by the k-mers that they hold.  Steps are sorted one by one as rows come and put together before the first question, so that little more
    than the lists of holders is in memory at any time."""

    def __init__(self, k: int, least: float):
        self.k, self.least, self.steps, self.names, self.sizes = k, least, [], [], []

    def add(self, rows: pd.DataFrame) -> None:
        seqs = rows["seq"].tolist()
        self.names.append(rows["key"].to_numpy())
        for part in _steps(seqs, STEP_LETTERS):
            known, starts, holders = _step(seqs[part], self.k)
            self.sizes.append(np.bincount(holders).astype(np.int32))
            self.steps.append((known, starts, holders.astype(np.uint16)))

    def _close(self) -> None:
        self.known = np.empty(0, np.uint64)
        for known, _, _ in self.steps:
            self.known = _distinct(np.sort(np.concatenate([self.known, known])))
        self.starts = np.zeros(len(self.known) + 1, np.int64)
        for known, starts, _ in self.steps:
            self.starts[np.searchsorted(self.known, known) + 1] += np.diff(starts)
        np.cumsum(self.starts, out=self.starts)
        self.holders, free, first = np.empty(int(self.starts[-1]), np.int32), self.starts[:-1].copy(), 0
        for i, (known, starts, holders) in enumerate(self.steps):
            spots, sizes = np.searchsorted(self.known, known), np.diff(starts)
            self.holders[np.repeat(free[spots] - starts[:-1], sizes) + np.arange(len(holders))] = holders + np.int32(first)
            free[spots] += sizes
            first += len(self.sizes[i])
            self.steps[i] = None
        self.steps, self.names, self.sizes = [], [np.concatenate(self.names)], [np.concatenate(self.sizes)]

    def meet(self, rows: pd.DataFrame, first: int | None = None) -> Iterator[pd.DataFrame]:
        """(a, b, sim) of the block's sequences and others.  first: they are the block's own from there on, and meet those after them."""
        if not self.names:
            return
        if self.steps:
            self._close()
        seqs, names = rows["seq"].tolist(), rows["key"].to_numpy()
        for part in _steps(seqs, STEP_LETTERS):
            yield from self._counted(seqs[part], names[part], None if first is None else first + part.start)

    def within(self, rows: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(a, b, sim) of the block's sequences, which rows are."""
        first = 0
        for part in rows:
            yield from self.meet(part, first)
            first += len(part)

    def _counted(self, seqs: list[str], asks: np.ndarray, first: int | None) -> Iterator[pd.DataFrame]:
        """A sequence's k-mers name the lists of the sequences that hold them; how often each stands in those lists is what it has in common.  Neighbours are
        counted together first: where all of a cell have too little, none has enough."""
        row, h = _hashes(seqs, self.k)
        own = _distinct(np.sort(h))
        begins, kmers = _grouped(row, _spots(own, h), len(seqs))
        spots = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        held = self.known[spots] == own
        lists, each = self.starts[spots], np.where(held, self.starts[spots + 1] - self.starts[spots], 0)[kmers]
        lists = lists[kmers]
        n, upto, sizes, names = np.diff(begins), np.append(0, np.cumsum(each)), self.sizes[0], self.names[0]
        ends = upto[begins]
        need = np.maximum(self.least / (1 + self.least) * (n + int(sizes.min())) - 1e-6, 1)
        width, ramp = (len(sizes) - 1 >> CELL_BITS) + 1, np.arange(max(TOGETHER, int(np.diff(ends).max())))
        ready, found, i = 0, [], 0
        while i < len(seqs):  # as many at once as have TOGETHER hits and cells, one at least
            j = int(np.searchsorted(ends, ends[i] + TOGETHER, side="right")) - 1
            j = max(i + 1, min(j, i + TOGETHER // width, len(seqs)))
            part, hits = slice(begins[i], begins[j]), (ends[i : j + 1] - ends[i]).tolist()
            spots = np.repeat(lists[part] - upto[part] + ends[i], each[part])
            spots += ramp[: hits[-1]]
            ids = self.holders.take(spots, mode="clip")
            cells = ids >> CELL_BITS
            for x in range(1, j - i):
                cells[hits[x] : hits[x + 1]] += x * width
            together = np.bincount(cells, minlength=(j - i) * width).reshape(-1, width)
            for x in np.flatnonzero(together.max(axis=1) >= need[i:j]).tolist():
                own = slice(hits[x], hits[x + 1])
                near, common = np.unique(ids[own][(together[x] >= need[i + x]).take(cells[own] - x * width)], return_counts=True)
                sim = common / (n[i + x] + sizes[near] - common)
                good = sim >= self.least if first is None else (sim >= self.least) & (near > first + i + x)
                if good.any():
                    found.append((np.repeat(asks[i + x : i + x + 1], good.sum()), names[near[good]], sim[good]))
                    ready += len(found[-1][2])
            i = j
            if ready > 100_000 or found and i == len(seqs):
                yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(("a", "b", "sim"), zip(*found, strict=True), strict=True)})
                ready, found = 0, []


def _pairs_of_blocks(batches: Iterator[pd.DataFrame], k: int, least: float) -> Iterator[pd.DataFrame]:
    """(a, b, sim) of rows (pair, role, key, seq), ordered by pair and falling role: 2 a block's own where it meets itself, 1 of the block that is held, 0 of the one that asks."""
    at, block, same = None, _Block(k, least), []
    for batch in batches:
        for (pair, role), rows in batch.groupby(["pair", "role"], sort=False):
            if pair != at:
                yield from block.within(same)
                at, block, same = pair, _Block(k, least), []
            if role:
                block.add(rows)
            else:
                yield from block.meet(rows)
            if role == 2:
                same.append(rows[["key", "seq"]])
    yield from block.within(same)


def _in_blocks(one: DataFrame, key: str, seq: str, k: int, least: float, blocks: int) -> DataFrame:
    """Pairs by counting: sequences are dealt to blocks, and each two blocks (and each with itself) meet in one task.  It holds the lists of one block, whose rows come
    first; the other's are asked as they come.  A sequence is shuffled once for each block, as letters, so what is written grows with the sequences as long as
    FEWEST_BLOCKS are enough; the work is a count for each k-mer that two sequences share, quadratic but without a row for it."""
    own = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(blocks)).cast("int")
    dealt = one.select(F.col(key).alias("key"), F.col(seq).alias("seq"), own.alias("own")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("y"))
    low, high = F.least("own", "y"), F.greatest("own", "y")
    role = F.when(F.col("own") == F.col("y"), 2).when(F.col("own") > F.col("y"), 1).otherwise(0)
    dealt = dealt.select((F.floor(high * (high + 1) / 2) + low).cast("int").alias("pair"), role.alias("role"), "key", "seq")
    dealt = dealt.repartitionById(blocks * (blocks + 1) // 2, F.col("pair")).sortWithinPartitions("pair", F.desc("role"))  # by hash, some tasks would get several pairs

    kind = one.schema[key].dataType.simpleString()
    found = dealt.mapInPandas(lambda batches: _pairs_of_blocks(batches, k, least), f"a {kind}, b {kind}, sim double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").filter(F.col("sim") >= least)


BLOOM_BITS, BLOOM_HASHES = 1 << 27, 4  # at most 16 MB are broadcast


def member_count(values: DataFrame, column: str, most_bits: int = BLOOM_BITS) -> Callable[[Column], Column] | None:
    """A function that counts, of an array of 64-bit hashes, those that `values` (distinct) hold; None if all of them, 64 bits each, are more than most_bits.
    What reaches the driver has that bound."""
    most = most_bits // 64
    found = values.select(column).limit(most + 1).toPandas()[column].to_numpy(np.int64)
    if len(found) > most:
        return None
    shared = values.sparkSession.sparkContext.broadcast(np.sort(found))

    @F.pandas_udf("long")
    def count(arrays: pd.Series) -> pd.Series:
        sizes = np.array([0 if a is None else len(a) for a in arrays], np.int64)
        known = shared.value
        if not sizes.sum() or not len(known):
            return pd.Series(np.zeros(len(sizes), np.int64))
        h = np.concatenate([a for a in arrays if a is not None]).astype(np.int64)
        held = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        return pd.Series(np.bincount(np.repeat(np.arange(len(sizes)), sizes), held, len(sizes)).astype(np.int64))

    return count


def bloom_filter(values: DataFrame, column: str, bits_each: int = 10, most_bits: int = BLOOM_BITS) -> Callable[[Column], Column] | None:
    """A function that keeps, of an array of 64-bit hashes, those that `values` may hold (about one in a hundred of the others); None if the filter
    would need more than most_bits.  Words of bits are joined where their hashes are; what reaches the driver has that bound."""
    spark = values.sparkSession
    n = values.agg(F.approx_count_distinct(column)).first()[0]
    bits = (n * bits_each // 64 + 1) * 64
    if bits > most_bits:
        return None
    low, high = F.col(column).bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(column, 33)
    spots = F.explode(F.array(*((low + high * i) % bits for i in range(BLOOM_HASHES))))
    words = values.select(spots.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(table.view(np.uint64))

    @F.pandas_udf("array<long>")
    def kept(arrays: pd.Series) -> pd.Series:
        sizes = [0 if a is None else len(a) for a in arrays]
        if not sum(sizes):
            return pd.Series([[] for _ in sizes], dtype=object)
        h = np.concatenate([a for a in arrays if a is not None]).astype(np.int64).view(np.uint64)
        low, high, fine = h & np.uint64(0x7FFFFFFF), h >> np.uint64(33), np.ones(len(h), bool)
        for i in range(BLOOM_HASHES):
            p = (low + high * np.uint64(i)) % np.uint64(bits)
            fine &= (shared.value[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        cuts = np.cumsum(sizes)[:-1]
        return pd.Series([v[f] for v, f in zip(np.split(h.view(np.int64), cuts), np.split(fine, cuts), strict=True)], dtype=object)

    return kept


def recruit_reads(reads: DataFrame, refs: DataFrame, key: str, seq: str, k: int, least: int, most_bits: int = BLOOM_BITS) -> DataFrame:
    """(key, n): rows that share `least` canonical k-mers or more with any of the references, on either strand.

    References with few distinct k-mers (16 MB at most) go to the reads, which count their own, so no k-mer of a read is a row.  With more, a Bloom filter of them
    goes, so that k-mers of unrelated reads are dropped where they are and never shuffled; so are reads with fewer than `least` left, and an exact join decides on
    the rest.  References too many for the filter's bound meet the reads by the join alone."""
    known = cut(kmers(refs, key, seq, k).select("kmer").distinct(), "references")
    sets = reads.filter(F.length(seq) >= k).select(key, canonical_kmers(F.col(seq), k).alias("set"))
    count = member_count(known, "kmer", most_bits)
    if count is not None:
        return sets.select(key, count(F.col("set")).alias("n")).groupBy(key).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    may = bloom_filter(known, "kmer", most_bits=most_bits)
    if may is not None:
        sets = sets.select(key, may(F.col("set")).alias("set")).filter(F.size("set") >= least)
    return sets.select(key, F.explode("set").alias("kmer")).join(known, "kmer", "left_semi").groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def msa_sparse_column_filter(rows: DataFrame, key: str, seq: str, window: int = 25, least: float = 0.01) -> DataFrame:
    """Aligned rows without those that fill a sparse stretch.  A window of columns, at every start that leaves it whole, is sparse if under a share of
    `least` of all rows (as a percentage of three decimals) have a letter in it; rows with a letter in a sparse window go.

    A row's letters make islands, which gaps of `window` columns or more part; an island from a to b is in the windows that start at
    a - window + 1 to b.  So a row is a few intervals of starts, not a row for each window: their ends are counted by column, a running
    sum over columns (as many as the alignment is wide) gives the rows in each window, and sparse starts are joined to spans again."""
    at = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when((c != "-") & (c != ""), i + 1)), lambda i: i.isNotNull())
    last = F.length(seq) - window + 1
    firsts = F.filter(F.transform("__at", lambda p, i: F.when((i == 0) | (p - F.coalesce(F.get("__at", i - 1), F.lit(0)) > window), p)), lambda p: p.isNotNull())
    lasts = F.filter(F.transform("__at", lambda p, i: F.when((i == F.size("__at") - 1) | (F.coalesce(F.get("__at", i + 1), F.lit(0)) - p > window), p)), lambda p: p.isNotNull())
    spans = F.filter(F.zip_with(firsts, lasts, lambda a, b: F.struct(F.greatest(a - window + 1, F.lit(1)).alias("l"), F.least(b, last).alias("r"))), lambda x: x["l"] <= x["r"])
    found = rows.select(key, last.alias("__last"), at.alias("__at"), seq).select(key, F.explode(spans).alias("s")).select(key, "s.l", "s.r")
    events = found.select(F.explode(F.array(F.struct(F.col("l").alias("at"), F.lit(1).alias("d")), F.struct((F.col("r") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    events = events.groupBy("e.at").agg(F.sum("e.d").alias("d"))
    columns = Window.partitionBy(F.lit(0)).orderBy("at")  # over columns, not rows
    runs = events.select("at", F.sum("d").over(columns).alias("n"), (F.lead("at").over(columns) - 1).alias("to"))
    total = rows.agg(F.count("*").alias("total"))
    sparse = runs.join(F.broadcast(total)).filter((F.col("n") > 0) & (F.floor((F.col("n") * 200_000 + F.col("total")) / (F.col("total") * 2)) < least * 100_000))
    spots = sparse.agg(F.collect_list(F.struct("at", "to")).alias("__spots"))  # one row, bounded by the width of the alignment
    bad = found.join(F.broadcast(spots)).filter(F.exists("__spots", lambda x: (x["at"] <= F.col("r")) & (F.col("l") <= x["to"])))
    return rows.join(bad.select(key).distinct(), key, "left_anti")
