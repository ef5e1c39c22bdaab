"""Scratch tables, bounded broadcasts, connected components and shared text patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squadron.functions.session import shared_folder

#: ASCII white space, as every contract of this subpackage has it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many ids (8 bytes each, about 64 MB hashed) may be broadcast; beyond it the join shuffles.
MAX_BROADCAST_IDS = 1_000_000
#: Bytes of a table of strings that may be broadcast.
MAX_BROADCAST_BYTES = 64 << 20
#: Rows of an Arrow batch: texts are long, and a batch stands in memory on both sides.
BATCH_ROWS = "2000"


class Scratch:
    """Tables in the shared folder of ``spark.checkpoint.dir``; they cut lineage and outlive executors.

    Where that is unset only a local session gets a temporary folder. Arrow batches of the session are set to
    ``BATCH_ROWS``, since results are read after the operators have returned.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = shared_folder(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(df.schema, name)

    def read(self, schema, name: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keep_ids(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of ``df`` with distinct ``ids``; broadcast only after a count shows that they are few.

    ``ids`` should read a written table, as it is counted first.
    """
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, how)


def words_in(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` bound to a lambda variable, as an expression in an inner lambda is evaluated anew for
    every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps, each two shuffles on the node; every step is written, so a lost
    executor costs one step. Stars stay stars, so it ends after a few steps whatever a group's size. Self-loops and
    nulls are ignored; an empty input gives an empty table.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    step = 0
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"large-{step}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        e = scratch.save(small.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct(), f"small-{step}")
        if step:
            scratch.drop(f"large-{step - 1}")
            scratch.drop(f"small-{step - 1}")
        # Stars: a node has one root, and no root has a root.
        two = e.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v <> w").select("u")
        if two.union(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        step += 1
