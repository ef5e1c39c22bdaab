"""Exact dedup by stateful streaming: keyed state on disk without expiry, full bytes compared on every hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadron.llm.common import SPACE, Scratch, keep_ids

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "false",
    # Else every partition sets some MB of disk aside for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


#: Groups of more rows than this are dealt to several tasks.
SALT_ROWS = 2000
#: So many large groups (about 200 bytes each) may be broadcast.
MAX_LARGE = 100_000
ROW = ["file", "row"]


def fingerprints(docs: DataFrame, digest) -> DataFrame:
    """(doc_id, n_points, text_sha256, digest, file, row); the last two locate the row's content."""
    d = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    d = d.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"), *ROW)
    return d.withColumn("digest", digest(F.col("text_sha256")))


def stream_groups(spark: SparkSession, path: str, state: str, digest, files_per_batch: int = 1000) -> DataFrame:
    """Reads ``path`` as a stream; state keeps, for each digest, the id of the row that stays, its locator and the count.

    Returns (digest, keep_id, keep_file, keep_row, group_size). Each micro-batch writes the groups it changed; counts only
    rise, so the row with the largest count is a group's last state. Checkpoint and states stand in the folder ``state``:
    a run after a failure resumes there, and one over a table that has grown reads the new files alone. A batch that is
    written again overwrites itself.
    """
    schema = spark.read.parquet(path).schema
    # A pattern for the last letter: the stream reader takes a single file only as a pattern's match.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    best = F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("neg_id"), *ROW))
    groups = fingerprints(rows, digest).groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    out = f"{state}/states"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = groups.writeStream.outputMode("update").option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = "batch int, digest string, best struct<n_points: int, known: boolean, neg_id: bigint, file: string, row: bigint>, group_size bigint"
    last = F.max(F.struct("group_size", "best")).alias("s")
    try:
        states = spark.read.schema(kind).parquet(out)
    except Exception as e:  # a stream without rows starts no batch and leaves no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        states = spark.createDataFrame([], kind)
    found = states.groupBy("digest").agg(last)
    return found.select("digest", (-F.col("s.best.neg_id")).alias("keep_id"), F.col("s.best.file").alias("keep_file"), F.col("s.best.row").alias("keep_row"), F.col("s.group_size").alias("group_size"))


def grouped(prints: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``prints`` with the columns of their group where it has several rows.

    Large groups are few by their size; where a count shows it they are broadcast, and their rows take no part in the
    shuffle by digest.
    """
    large = scratch.save(groups.where(F.col("group_size") > SALT_ROWS), "large")
    some = groups.where(F.col("group_size").between(2, SALT_ROWS))
    if large.limit(MAX_LARGE + 1).count() > MAX_LARGE:
        return prints.join(groups.where("group_size > 1"), "digest", "left")
    columns = ["keep_id", "keep_file", "keep_row", "group_size"]
    a = prints.join(F.broadcast(large.withColumnsRenamed({c: f"large_{c}" for c in columns})), "digest", "left")
    own = F.concat_ws(":", F.lit("row"), *ROW)
    a = a.withColumn("key", F.when(F.col("large_group_size").isNull(), F.col("digest")).otherwise(own))
    a = a.join(some.withColumnRenamed("digest", "key"), "key", "left").drop("key")
    return a.select(*prints.columns, *(F.coalesce(f"large_{c}", c).alias(c) for c in columns))


def exact_dedup(spark: SparkSession, path: str, state: str | None = None, digest=lambda sha: sha) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256) for every row of the Parquet table ``path``.

    Texts are equal if identical without ASCII white space; of a group the text with the most code points, then the
    smallest doc_id stays. Null text counts as empty, so null, empty and blank rows form one group. Rows that repeat
    the doc_id that stays are all kept. A null doc_id ranks after all others. Columns other than doc_id and text are
    never looked at. A row whose bytes differ from those of the row its digest points to is grouped with the rows of
    its own bytes. ``state`` is a folder that keeps the stream's state for later runs over a table that grows; without
    one the state lasts for this run. ``digest`` makes the key of the state from the text's SHA-256.
    """
    path, scratch = path.rstrip("/"), Scratch(spark, "exact-dedup")
    groups = scratch.save(stream_groups(spark, path, state or scratch.path("state"), digest), "groups")
    if state is None:
        scratch.drop("state")
    docs = spark.read.parquet(path)
    found = scratch.save(grouped(fingerprints(docs, digest), groups, scratch), "found")
    rid = F.xxhash64(*ROW).alias("rid")
    stays = F.col("file").eqNullSafe(F.col("keep_file")) & F.col("row").eqNullSafe(F.col("keep_row"))
    hits = found.where("group_size > 1").select(*ROW, "doc_id", "n_points", "digest", F.ceil(F.col("group_size") / SALT_ROWS).cast("int").alias("salts"), stays.alias("stays"))
    ids = scratch.save(hits.select(rid).distinct(), "hit-ids")
    texts = docs.select("text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).withColumn("rid", rid)
    texts = keep_ids(texts, ids, "rid").select(*ROW, normalised(F.col("text")).alias("norm")).join(hits, ROW)
    # Full bytes against those of the row that stays, which goes to each of the tasks that share a large group.
    kept = texts.where("stays").select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("norm").alias("keep_norm"))
    others = texts.where("not stays").withColumn("salt", F.pmod(F.xxhash64(*ROW), F.col("salts")).cast("int"))
    differ = scratch.save(others.join(kept, ["digest", "salt"]).where("norm <> keep_norm").select(*ROW, "doc_id", "n_points", "norm", "digest"), "differ")
    alone = F.col("group_size").isNull()
    out = found.withColumn("keep", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("size", F.coalesce("group_size", F.lit(1)))
    if not differ.isEmpty():
        own = differ.groupBy("digest", "norm").agg(F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("neg_id"))).alias("b"), F.count("*").alias("own_size"))
        own = differ.join(own, ["digest", "norm"]).select(*ROW, F.lit(True).alias("own"), (-F.col("b.neg_id")).alias("own_id"), "own_size")
        lost = differ.groupBy("digest").agg(F.count("*").alias("lost"))
        out = out.join(own, ROW, "left").join(lost, "digest", "left")
        out = out.withColumn("keep", F.when(F.col("own"), F.col("own_id")).otherwise(F.col("keep"))).withColumn("size", F.coalesce("own_size", F.col("size") - F.coalesce("lost", F.lit(0))))
    return out.select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep")).alias("kept"), "text_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
