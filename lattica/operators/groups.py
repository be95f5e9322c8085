"""Connected groups of a link graph, by large-star and small-star steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees (spark.checkpoint.dir).  Where it is unset on one machine, as in tests, a temporary
    one; on a cluster that is an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lattica.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("lattica.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[str] = []


def written() -> list[str]:
    """The intermediates that this process has written and not released."""
    return list(_written)


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Deletes intermediates that this process has written (all of them, or those of `paths`), and says how many.  For when the results that
    are read from them are stored: frames are lazy, so only the caller knows."""
    jvm = spark.sparkContext._jvm
    gone = written() if paths is None else [p for p in paths if p in _written]
    for path in gone:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        _written.remove(path)
    return len(gone)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/lattica-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stars(e: DataFrame) -> bool:
    """Whether every node has one lesser neighbour at most, which has none itself: then that is its component."""
    if not e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return False
    return e.select("v").distinct().join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b); loops name single nodes."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = e.filter("u <> v")
    for _ in range(most_rounds + 1):
        if _stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))
        small = large.join(least, "u").select(pair.alias("e"))
        e = cut(small.select(F.greatest("e.v", "e.m").alias("u"), F.least("e.v", "e.m").alias("v")).filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("the components did not settle")
    root = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
