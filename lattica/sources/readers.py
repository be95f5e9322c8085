"""Readers and writers of the text formats of sequences, alignments and tables.

All of them read folders or globs with Spark's text reader, so that files are split over tasks; none collects lines on the
driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.groups import cut, shared_dir
from .fastq import FastqSource, list_files


def stored(df: DataFrame, write: Callable[[DataFrame, str], None], name: str) -> str:
    """df written to a new place in the shared folder; the place."""
    path = f"{shared_dir(df.sparkSession)}/lattica-{name}-{uuid.uuid4().hex}"
    write(df, path)
    return path


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Running numbers from 1 by a global order, without a single-partition window: rows are dealt by range and sorted,
    partitions are counted, and each adds what stands before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: the bounds of ranges come from samples and may differ from run to run
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = cut(dealt.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "numbers")
    sizes = {r["__p"]: r["n"] for r in parts.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, at = {}, 0
    for p in sorted(sizes):
        before[p] = at
        at += sizes[p]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    starts = F.create_map(*(x for p, b in before.items() for x in (F.lit(p), F.lit(b).cast("long"))))
    return parts.withColumn(name, F.col("__i").bitwiseAND((1 << 33) - 1) + 1 + F.element_at(starts, F.col("__p"))).drop("__p", "__i")


def dedupe_ids(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """new_id: the id, with _2, _3 ... from its second row on."""
    k = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    return df.withColumn("new_id", F.concat(F.col(id_col), F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise("")))


# ---------------------------------------------------------------- sequences


def _records(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("file", F.col("_metadata.file_name"))
    v = F.regexp_replace("value", r"^>|\s+$", "")
    head = F.split(v, "\n", 2)
    name = F.element_at(head, 1)
    seq = F.regexp_replace(F.coalesce(F.try_element_at(head, F.lit(2)), F.lit("")), r"\s", "")
    ident = F.regexp_extract(name, r"^(\S*)", 1)
    return raw.filter(v != "").select("file", ident.alias("id"), F.regexp_replace(name, r"^\S*\s*", "").alias("description"), seq.alias("seq"), F.length(seq).cast("long").alias("len"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq, len."""
    return _records(spark, path).drop("file")


def write_fasta(df: DataFrame, path: str) -> None:
    title = F.concat_ws(" ", "id", "description") if "description" in df.columns else F.col("id")
    df.select(F.concat(F.lit(">"), title, F.lit("\n"), F.col("seq"))).write.text(path)


def read_genome_dir(spark: SparkSession, path: str) -> DataFrame:
    """genome, contig, seq, len for a folder of FASTA files, or of one folder `genome=...` each."""
    base = f"{path}/*"
    raw = _records_by_path(spark, base)
    return raw.select("genome", F.concat_ws("___C___", "genome", "id").alias("contig"), "seq", "len")


def _records_by_path(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n>").text(path)
    file = F.col("_metadata.file_path")
    genome = F.when(file.contains("/genome="), F.regexp_extract(file, r"/genome=([^/]*)/", 1)).otherwise(F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", ""))
    v = F.regexp_replace("value", r"^>|\s+$", "")
    head = F.split(v, "\n", 2)
    seq = F.regexp_replace(F.coalesce(F.try_element_at(head, F.lit(2)), F.lit("")), r"\s", "")
    return raw.filter(v != "").select(genome.alias("genome"), F.regexp_extract(F.element_at(head, 1), r"^(\S*)", 1).alias("id"), seq.alias("seq"), F.length(seq).cast("long").alias("len"))


def write_genome_dir(df: DataFrame, path: str) -> None:
    df.select("genome", F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value")).write.partitionBy("genome").text(path)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """id, seq, qual of the four-line records of a file, folder or glob, in one pass: byte ranges of split_bytes are tasks (see fastq)."""
    spark.dataSource.register(FastqSource)
    return spark.read.format(FastqSource.name()).option("files", json.dumps(list_files(spark, path))).option("split", split_bytes).load()


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.text(path)


# ---------------------------------------------------------------- alignments


def read_sam(spark: SparkSession, path: str, unmapped: bool = True) -> DataFrame:
    """read_base, mate, flag, ref_id, pos, cigar, seq.  Header lines are left out, rows with CIGAR `*` on request."""
    c = F.split("value", "\t")
    get = lambda i: F.try_element_at(c, F.lit(i))
    out = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        F.regexp_extract(get(1), r"^(.*)\.([^.]*)$", 1).cast("long").alias("read_base"), F.regexp_extract(get(1), r"^(.*)\.([^.]*)$", 2).cast("int").alias("mate"),
        get(2).cast("int").alias("flag"), get(3).alias("ref_id"), get(4).cast("int").alias("pos"), get(6).alias("cigar"), get(10).alias("seq"),
    )
    return out if unmapped else out.filter("cigar <> '*'")


def read_sam_refs(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, ref_len of the @SQ lines."""
    v = F.col("value")
    return spark.read.text(path).filter(v.startswith("@SQ\t")).select(F.regexp_extract(v, r"\tSN:([^\t]*)", 1).alias("ref_id"), F.regexp_extract(v, r"\tLN:(\d+)", 1).cast("int").alias("ref_len")).distinct()


def write_sam(aln: DataFrame, path: str) -> None:
    refs = aln.select("ref_id", "ref_len").distinct().select(F.concat(F.lit("@SQ\tSN:"), "ref_id", F.lit("\tLN:"), F.col("ref_len").cast("string")).alias("value"))
    name = F.concat_ws(".", "read_base", "mate")
    rows = aln.select(F.concat_ws("\t", name, F.lit("0"), "ref_id", "pos", F.lit("255"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*")).alias("value"))
    refs.unionByName(rows).write.text(path)


def sort_alignments(aln: DataFrame, by_name: bool = True) -> DataFrame:
    """Sorted by read, or by reference and position: dealt by range, then sorted within partitions."""
    keys = ["read_base", "mate", "ref_id", "pos"] if by_name else ["ref_id", "pos", "read_base", "mate"]
    return aln.repartitionByRange(*keys).sortWithinPartitions(*keys)


# ---------------------------------------------------------------- tables


def read_gff(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """contig, l, r, attributes."""
    schema = "contig string, source string, type string, l int, r int, score string, strand string, phase string, attributes string"
    out = spark.read.csv(path, sep="\t", comment="#", schema=schema).filter("r is not null")
    out = out if feature is None else out.filter(F.col("attributes").contains(feature))
    return out.select("contig", "l", "r", "attributes")


def write_gff(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "contig", F.lit("x"), F.lit("rRNA"), "l", "r", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("Name="), "feature")).alias("value")).write.text(path)


BLAST6 = "query string, subject string, iden double, aln_len int, mismatches int, gaps int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int, slen int"


def read_blast6(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=BLAST6)


def write_blast6(df: DataFrame, path: str) -> None:
    names = [c.split()[0] for c in BLAST6.split(", ")]
    df.select(*(F.col(c) if c in df.columns else F.lit(0).alias(c) for c in names)).write.csv(path, sep="\t")


def read_uc(spark: SparkSession, path: str) -> DataFrame:
    """cluster, id: columns 2 and 9 of the cluster file, the id up to its first space; cluster lines repeat ids."""
    out = spark.read.csv(path, sep="\t", schema=", ".join(f"c{i} string" for i in range(10))).filter("c0 <> 'C'")
    return out.select(F.col("c1").cast("long").alias("cluster"), F.element_at(F.split("c8", " "), 1).alias("id")).distinct()


def write_uc(df: DataFrame, path: str) -> None:
    df.select(F.lit("H").alias("c0"), "cluster", *(F.lit("*").alias(f"c{i}") for i in range(2, 8)), F.concat("id", F.lit(" from x")).alias("c8"), F.lit("*").alias("c9")).write.csv(path, sep="\t")


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="ref_id string, pos int, depth int")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t")


def read_regions_csv(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, v, l, r of found regions.  Columns 38 to 46 are V1 to V9 as `a-b`; other values are not found."""
    v = F.translate("value", '"', "")
    raw = spark.read.text(path).filter(~v.rlike("^(Command:|Options:|Sequence,)") & (v != "")).select(F.split(v, ",").alias("c"))
    out = raw.select(F.element_at("c", 1).alias("seq_id"), F.posexplode(F.slice("c", 38, 9)).alias("i", "s")).filter(F.col("s").rlike(r"^\d+-\d+$"))
    ends = F.array_sort(F.transform(F.split("s", "-"), lambda x: x.cast("int")))
    return out.select("seq_id", (F.col("i") + 1).cast("long").alias("v"), F.element_at(ends, 1).alias("l"), F.element_at(ends, 2).alias("r"))


def write_regions_csv(regions: DataFrame, path: str) -> None:
    span = F.coalesce(F.concat_ws("-", F.col("l").cast("string"), F.col("r").cast("string")), F.lit("notfound"))
    cell = F.when(F.col("l").isNull(), F.lit("notfound")).otherwise(span)
    rows = regions.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", cell.alias("s")))), lambda x: x["s"]).alias("s"))
    line = F.concat_ws(",", F.concat(F.lit('"'), F.col("seq_id").cast("string"), F.lit('"')), F.array_repeat(F.lit("x"), 36), F.col("s"))
    rows.select(line.alias("value")).write.text(path)


def read_links_tsv(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.csv(path, sep="\t", header=True, schema="MarkerGene string, GenomicSeq string, Linkage long, Round string")
    return out.toDF("marker", "genome", "n", "round")


def write_links_tsv(links: DataFrame, path: str) -> None:
    links.select(F.col("marker").alias("MarkerGene"), F.col("genome").alias("GenomicSeq"), F.col("n").alias("Linkage"), F.col("round").alias("Round")).write.csv(path, sep="\t", header=True)


def read_provided_cn(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="genome string, n double")


# ---------------------------------------------------------------- tables that links are held against


def _columns(spark: SparkSession, path: str, sep: str, at: dict[str, int], skip: str | None = None) -> DataFrame:
    """Columns by their places in a separated text file without quoting; lines that begin with `skip` (a header) are left out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if skip:
        lines = lines.filter(~F.startswith("value", F.lit(skip)))
    cells = F.split("value", sep, -1)
    return lines.select(*(F.trim(F.get(cells, F.lit(i))).alias(name) for name, i in at.items()))


def read_genome_clusters(spark: SparkSession, path: str) -> DataFrame:
    """genome, cluster of a table of clustered genome files (CSV: file, cluster); the file's extension goes."""
    out = _columns(spark, path, ",", {"genome": 0, "cluster": 1}, "genome,")
    return out.withColumn("genome", F.regexp_replace("genome", r"\.[^.]*$", ""))


def read_genome_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """genome, taxon, closest of a classification table (TSV: genome, taxonomy, ..., closest reference in the eighth column)."""
    return _columns(spark, path, "\t", {"genome": 0, "taxon": 1, "closest": 7}, "user_genome\t")


def read_marker_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """marker, iden, aln_len, taxon (TSV: marker, hit, identity, aligned length, taxonomy with notes in brackets behind it)."""
    out = _columns(spark, path, "\t", {"marker": 0, "iden": 2, "aln_len": 3, "taxon": 4})
    return out.select("marker", F.col("iden").try_cast("double").alias("iden"), F.col("aln_len").try_cast("int").alias("aln_len"), F.substring_index("taxon", " [", 1).alias("taxon"))


def read_completeness(spark: SparkSession, path: str) -> DataFrame:
    """genome, completeness of a quality table (CSV)."""
    return _columns(spark, path, ",", {"genome": 0, "completeness": 1}).select("genome", F.col("completeness").try_cast("double").alias("completeness"))


def read_genome_depth(spark: SparkSession, path: str) -> DataFrame:
    """genome, depth (TSV: genome, length, mean depth)."""
    return _columns(spark, path, "\t", {"genome": 0, "depth": 2}).select("genome", F.col("depth").try_cast("double").alias("depth"))


def read_genome_markers(spark: SparkSession, path: str) -> DataFrame:
    """genome, marker_len of a table of own markers (TSV: genome, marker, length)."""
    return _columns(spark, path, "\t", {"genome": 0, "marker_len": 2}, "Genome\t16S").select("genome", F.col("marker_len").try_cast("int").alias("marker_len"))


def read_gene_to_genome(spark: SparkSession, path: str) -> DataFrame:
    """genome, gene (TSV: genome, genes separated by commas), a row for each gene."""
    out = _columns(spark, path, "\t", {"genome": 0, "genes": 1})
    return out.select("genome", F.explode(F.filter(F.split("genes", ","), lambda g: F.trim(g) != "")).alias("gene")).select("genome", F.trim("gene").alias("gene"))


def write_lines(df: DataFrame, path: str, sep: str, cols: list[str], header: str | None = None) -> None:
    """Columns as separated text, null as empty; with a header each file begins with it."""
    out = df.select(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)).alias(header or "value"))
    if header is None:
        out.write.text(path)
    else:
        out.write.option("header", True).option("quote", "\u0000").option("sep", "\u0001").csv(path)
