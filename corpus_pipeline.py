"""The corpus pipeline: each stage calls one operator of squadron.llm on all that the stage before it kept.

All stages but the last return the columns of ``documents``. Near duplicates take five-word shingles and a similarity of
0.8. Stages drop rows by their doc_id, so rows without one stay, rows that repeat one go together, and other columns are
never looked at; empty tables give empty tables. Null and empty texts are clean, have no near duplicates, hold no item,
take no words of the mix and so end before the token files. Nothing in it can be put in SQL as a whole (nearest examples, a tokenizer), so ORACLE_SQL is None; tests hold each
stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadron.llm import decontamination, minhash_dedup, mixing, token_output, toxicity
from squadron.llm.common import Scratch, keep_ids


def without(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows of these ids; they are written and counted before the join chooses how to send them."""
    return keep_ids(docs, scratch.save(ids.select("doc_id").distinct(), "rejected"), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not vote toxic."""
    scratch = Scratch(spark, "stage-toxicity")
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch)
    return without(docs, scored.where("predicted = 1"), scratch)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near duplicates."""
    scratch = Scratch(spark, "stage-minhash")
    return without(docs, minhash_dedup.near_dedup(docs, scratch).where(~F.col("kept")), scratch)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    scratch = Scratch(spark, "stage-decontamination")
    return without(docs, decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch), scratch)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole pass of a document and one for its picked blocks."""
    return mixing.mixed(docs, Scratch(spark, "stage-mixing"))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; returns what is read back of each row: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_output.token_output(docs, Scratch(spark, "stage-tokens"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_token_files),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
