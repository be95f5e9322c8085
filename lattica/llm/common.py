"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import cut, shared_dir

__all__ = ["cut", "distinct_sample", "fold", "fresh", "partitions", "shared_dir", "table", "wide_rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have (Spark compares names without case)."""
    taken, name = {c.lower() for c in df.columns}, f"__lattica_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def wide_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Lets the session hand rows to Python `rows` at a time at most (Spark's own default is 10,000): rows that hold whole texts or
    sets of hashes are wide, and a batch of them is held by the executor and by its Python worker at once."""
    if int(spark.conf.get(BATCH)) > rows:
        spark.conf.set(BATCH, rows)


def fold(id_col: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def distinct_sample(rows: DataFrame, text_col: str, most: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Distinct rows (text_col and the columns `by`), `most` at most: those whose texts have the least hashes.

    Copies of a text share a hash, so rows are thinned by distinct texts, not by rows, and a text that a third of the
    rows hold is one row of the sample.  The limit is a hard one, so what is gathered from it has that bound."""
    name = fresh(rows, "hash")
    hashed = rows.select(text_col, *(by or []), F.xxhash64(text_col, F.lit(seed)).alias(name))
    n = hashed.agg(F.approx_count_distinct(name)).first()[0]
    if n > 1.2 * most:  # leaves a fifth more than needed, so that the error of the count cannot leave too few; below, all are left
        hashed = hashed.filter(F.col(name) < int(-(1 << 63) + 1.2 * most / n * (1 << 64)))
    keys = [name, *(by or [])]
    return hashed.groupBy(*keys).agg(F.first(text_col).alias(text_col)).orderBy(*keys).limit(most).select(text_col, *(by or []))
