"""From documents to packed training sequences: toxicity, near duplicates, secrets, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the columns of documents.  A stage begins by deleting the
intermediates of the one before, whose output is stored by then.

Stages keep rows with a null id or text unless they say otherwise; an empty table gives an empty result.  Very long texts are handled
whole in every stage.  Repeated rows are judged each by toxicity and secrets, become one among near copies, and are repeated together
by mixing.  Ties: a score equal to THRESHOLD rejects; of a group's rows with the least id, the one with the least hash of its text stays.
Further columns of documents are carried along, whatever their names; only packing returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import mixing, packing, secrets, simhash, toxicity
from lattica.llm.common import cut, fresh
from lattica.llm.queries import labelled, tokenizer_path
from lattica.operators.groups import release, written

THRESHOLD = 0.3  # toxicity from which a document is rejected


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the factorization machine, fitted on labelled ones of docs, scores THRESHOLD or more."""
    model = toxicity.fit_toxicity(labelled(spark, docs, sf_dir))
    name = fresh(docs, "score")
    out = docs.withColumn(name, toxicity.toxicity_score(F.col("text"), model, spark))
    return out.filter(F.col(name) < THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (an exact Jaccard index of 0.8 or more of their
    five-word shingles).  Repeated rows become one; rows with null id have no name to be kept by and stay."""
    groups = simhash.similar_groups(docs, shingle=5, least_jaccard=0.8, extra={"content": F.xxhash64("text")})
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("group").agg(F.min(F.struct("doc_id", "content")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__id"), F.col("k.content").alias("__content"))
    name = fresh(docs, "content")
    own = docs.filter("doc_id is not null").withColumn(name, F.xxhash64("text"))
    out = own.join(kept, (own.doc_id == kept["__id"]) & (own[name] == kept["__content"]), "left_semi").dropDuplicates(["doc_id", name])
    return out.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in texts; n_chars follows."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(kind))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their sources' weights: each is read at least once, none more than twice."""
    out, name = mixing.mix(docs, repeats=2.0)
    return out.drop(name).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    pieces = packing.tokenise(docs, tokenizer_path())
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces, ["doc_id", "start", "ids_crc32"])


_left: list[str] = []  # intermediates of the stage before


def freeing(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first deletes what the stage before it wrote for its own use: its docs are that stage's stored output."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        before = set(written())
        out = stage(spark, docs, sf_dir)
        _left[:] = [p for p in written() if p not in before]
        return out

    return run_stage


STAGES = [("toxicity", toxic_out), ("near duplicates", one_of_each), ("secrets", secrets_out), ("mixing", mixed), ("packing", packed)]
STAGES = [(name, freeing(stage)) for name, stage in STAGES]

ORACLE_SQL = None  # a fitted model, groups and packing have no SQL; tests hold stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
