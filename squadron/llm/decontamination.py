"""Benchmark decontamination: size-partitioned containment MinHash, verified by exact shingle containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.llm.common import MAX_BROADCAST_BYTES, Scratch, documents, keep_ids, once

SHINGLE, CONTAINMENT = 5, 0.8
#: All that is neither a letter nor a digit in ASCII parts words; what is not ASCII belongs to words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def clean(text):
    """Words, A-Z lower-cased, joined by one space."""
    return F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), BETWEEN, " "))


def split_words(text):
    joined = clean(text)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def shingle_list(words, size: int, make):
    """``make`` of the ``size`` words from each place on; a shorter text has none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: make(*(F.get(words, i + j) for j in range(size))))
    return F.when(n >= size, many)


def hashes(words, size: int):
    return shingle_list(words, size, lambda *w: F.xxhash64(*w))


def strings(words, size: int):
    return shingle_list(words, size, lambda *w: F.concat_ws(" ", *w))


def item_sets(benchmark: DataFrame, size: int) -> DataFrame:
    both = once(split_words(F.col("text")), lambda w: F.arrays_zip(hashes(w, size).alias("h"), strings(w, size).alias("s")))
    s = benchmark.where("item_id is not null").select("item_id", F.explode(both).alias("x"))
    s = s.select("item_id", "x.h", "x.s").distinct()
    return s.withColumn("item_shingles", F.count("*").over(W.partitionBy("item_id")))


def witnesses(items: DataFrame, containment: float) -> DataFrame:
    """Bottom-k MinHash of each item; k by size class, so that no document over the threshold can miss all of them.

    A document with ``containment`` of an item's n shingles lacks n - ceil(containment n) of them at most; any one more
    than that must meet it. Items are partitioned by size in powers of two, and k is taken at the class's upper end.
    """
    top = F.pow(F.lit(2.0), F.floor(F.log2("item_shingles")) + 1) - 1
    k = top - F.ceil(top * containment - 1e-9) + 1
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.xxhash64(F.lit(17), "h"), "s"))
    return items.withColumn("r", rank).where(F.col("r") <= k).select("item_id", "h", "item_shingles")


def sized(benchmark: DataFrame, scratch: Scratch, size: int) -> dict[int, DataFrame]:
    """Items by the words of their shingles: ``size``, or all words of an item that has fewer."""
    n = F.least(F.size(split_words(F.col("text"))), F.lit(size))
    per = benchmark.where("item_id is not null").groupBy("item_id").agg(F.max(n).alias("words"))
    per = scratch.save(per.where("words > 0"), "item-words")
    return {r.words: benchmark.join(per.where(per.words == r.words).select("item_id"), "item_id", "left_semi") for r in per.select("words").distinct().collect()}


def contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, size: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared, containment) with ``containment`` or more of the item's shingles.

    Words are runs of letters and digits, A-Z lower-cased. An item of fewer words than ``size`` is one shingle of all its
    words, and documents are searched for runs of as many words, so it is found anywhere in a text. Empty and null texts
    have no shingles and meet nothing. Rows that repeat a doc_id or an item_id count as one text with the shingles of all,
    an item's of the size that its longest row allows; a document of no id is found with a null doc_id, all of them as one
    text; items without an id are left out. Other columns are ignored. Every candidate is verified on the strings of all
    shingles of the whole document.
    """
    parts = [of_size(docs, items, scratch, n, containment) for n, items in sorted(sized(benchmark, scratch, size).items())]
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, item_shingles long, shared long, containment double")
    return reduce(DataFrame.union, parts)


def of_size(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, size: int, containment: float) -> DataFrame:
    items = scratch.save(item_sets(benchmark, size), f"items-{size}")
    wit = scratch.save(witnesses(items, containment), f"witnesses-{size}")
    bounded = items.agg(F.sum(F.length("s") + F.lit(40))).first()[0] or 0
    small = F.broadcast if bounded <= MAX_BROADCAST_BYTES else (lambda x: x)
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc")]
    d = docs.select(*key, once(split_words(F.col("text")), lambda w: hashes(w, size)).alias("hs"))
    # The number is taken before the list is exploded: no row of the explosion carries the text or its words. An outer
    # explosion, as the filter that Catalyst puts under an inner one makes the list a second time.
    d = d.select("no_id", "doc", F.size("hs").alias("n"), "hs").select("no_id", "doc", "n", F.explode_outer("hs").alias("h"))
    need = F.ceil(F.col("item_shingles") * containment - 1e-9)
    met = d.join(small(wit), "h").select("no_id", "doc", "item_id").distinct()
    met = scratch.save(met, f"candidates-{size}")
    ids = scratch.save(met.select("no_id", "doc").distinct(), f"candidate-ids-{size}")
    texts = keep_ids(docs.select(*key, "text"), ids, ["no_id", "doc"]).select("no_id", "doc", F.explode(F.array_distinct(once(split_words(F.col("text")), lambda w: strings(w, size)))).alias("s"))
    pairs = texts.join(small(items.select("item_id", "s", "item_shingles")), "s").groupBy("no_id", "doc", "item_id", "item_shingles").agg(F.countDistinct("s").alias("shared"))
    pairs = pairs.where(F.col("shared") >= need).join(met, ["no_id", "doc", "item_id"], "left_semi")
    return pairs.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "item_id", "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "decontamination"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(5, len(w)) AS z FROM i WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, z, array_to_string(w[j + 1 : j + z], ' ') AS s FROM (SELECT *, unnest(range(len(w) - z + 1)) AS j FROM k)),
x AS (SELECT DISTINCT doc_id, z, array_to_string(w[j + 1 : j + z], ' ') AS s FROM (SELECT doc_id, w, z, unnest(range(len(w) - z + 1)) AS j FROM d, (SELECT DISTINCT z FROM k) WHERE len(w) >= z)),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS shared, count(*) / item_shingles AS containment
FROM x JOIN b USING (z, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING 10 * count(*) >= 8 * item_shingles
"""
