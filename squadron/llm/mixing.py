"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.llm.common import WORD, Scratch, documents, once, words_in

WEIGHTS = (3, 1, 2)
SHARE, TOP = 1.5, 2
BLOCK_WORDS = 128
#: A shard of a source holds about so many words; a source has so many shards at most.
SHARD_WORDS, MAX_SHARDS = 1 << 17, 1 << 16


def targets(sizes: DataFrame, share: float = SHARE, top: int = TOP) -> DataFrame:
    """(source, source_size) -> + weight, target: ``share`` of all words by weight, none above ``top`` times its size.

    The excess of capped sources is shared again by weight until none is above: with sources in the order of cap by
    weight, the capped ones come first, so one pass of running sums finds the level. The table has a row per source.
    """
    one = F.lit(1)
    w = sizes.withColumn("rank", F.row_number().over(W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("weight", F.array(*map(F.lit, WEIGHTS))[(F.col("rank") - 1) % len(WEIGHTS)])
    w = w.withColumn("cap", (F.col("source_size") * top).cast("double"))
    by = W.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), "rank")
    w = w.withColumn("all", F.sum("source_size").over(W.partitionBy(one)) * F.lit(share))
    w = w.withColumn("spent", F.sum("cap").over(by) - F.col("cap")).withColumn("open", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    w = w.withColumn("level", (F.col("all") - F.col("spent")) / F.col("open"))
    full = F.col("cap") / F.col("weight") <= F.col("level")
    at = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return w.withColumn("at", at).select("source", "source_size", "weight", F.when(full, F.col("cap")).otherwise(F.col("at") * F.col("weight")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: integer seats by highest quotients votes / (2a + 1), ties to the smaller ``party``.

    A party is sure of the seats below a bound on how far the divisor can lie from votes per seat, so only about four
    quotients per party are ranked, however many seats there are.
    """
    key = [F.col(g) for g in group] or [F.lit(1)]
    a = W.partitionBy(*key)
    p = parties.withColumn("_n", F.count("*").over(a)).withColumn("_v", F.sum(votes).over(a))
    p = p.withColumn("_q", F.when(F.col("_v") > 0, F.col(seats) * (F.col(votes) / F.col("_v"))).otherwise(F.lit(0.0)))
    slack = F.col("_q") * F.col("_n") / (2.0 * F.greatest(F.col(seats), F.lit(1))) + 1
    p = p.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_q") - slack) - 1).cast("long")).withColumn("_most", (F.ceil(F.col("_q") + slack) + 1).cast("long"))
    p = p.withColumn("_rest", F.col(seats) - F.sum("_sure").over(a))
    tries = p.where((F.col(votes) > 0) & (F.col(seats) > 0)).withColumn("_a", F.explode(F.sequence("_sure", "_most")))
    rank = F.row_number().over(a.orderBy((F.col(votes) / (2 * F.col("_a") + 1)).desc(), party, "_a"))
    won = tries.withColumn("_k", rank).where("_k <= _rest").groupBy(*group, party).agg(F.count("*").alias("_won"))
    keys = [*group, party]
    won = won.withColumnsRenamed({c: f"_{c}" for c in keys})
    out = p.join(won, [p[c].eqNullSafe(won[f"_{c}"]) for c in keys], "left").drop(*(f"_{c}" for c in keys))
    return out.withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_n", "_v", "_q", "_sure", "_most", "_rest", "_won")


def draw(seed: int, *parts) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts]))


def mix_plan(docs: DataFrame, scratch: Scratch, seed: int = 0, share: float = SHARE, top: int = TOP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows (doc_id, dup, source, size, source_size, target, epochs, picked, taken), one for each row of ``docs``.

    ``epochs`` whole passes and then the blocks ``picked`` [(block, words)] of the document are taken. Each source's
    blocks are shared among its hash shards by Sainte-Lague as well, so no shard needs more than its own rows, and a
    hot source has many shards. Null or empty text has size 0 and takes nothing; the null source counts as a source,
    last in order; rows that repeat a doc_id are told apart by ``dup``; other columns are ignored.
    """
    d = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))
    d = d.withColumn("dup", F.row_number().over(W.partitionBy("doc_id").orderBy("source", "size")))
    d = scratch.save(d, "sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sizes, share, top)
    t = t.withColumn("blocks", F.round(F.sum("target").over(W.partitionBy(F.lit(1))) / block_words).cast("long")).withColumn("name", F.struct(F.col("source").isNull(), "source"))
    t = sainte_lague(t, [], "name", "target", "blocks").drop("name", "blocks").withColumnRenamed("quota", "source_quota")
    t = scratch.save(t.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / shard_words))).cast("long")), "targets")
    d = d.withColumnRenamed("source", "src")
    d = d.join(t, d.src.eqNullSafe(t.source)).drop("src")
    d = d.withColumn("shard", F.conv(F.substring(draw(seed, "doc_id"), 1, 12), 16, 10).cast("long") % F.col("shards"))
    name = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    d = d.withColumn("src", name)
    per = d.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    per = sainte_lague(per, ["src"], "shard", "shard_size", "source_quota")
    want = F.least(F.col("quota") * block_words, F.col("shard_size") * top)
    per = per.withColumn("epochs", F.when(F.col("shard_size") > 0, F.floor(want / F.col("shard_size"))).otherwise(0).cast("long"))
    per = scratch.save(per.select("src", "shard", "epochs", (want - F.col("epochs") * F.col("shard_size")).alias("rest")), "shards")
    d = scratch.save(d.join(per, ["src", "shard"]).select("doc_id", "dup", "source", "src", "shard", "size", "source_size", "target", "epochs", "rest"), "rows")
    b = d.where("rest > 0 and size > 0").withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / block_words) - 1).cast("int"))))
    b = b.withColumn("n", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words)).withColumn("draw", draw(seed, "doc_id", "dup", "block"))
    order = W.partitionBy("src", "shard").orderBy("draw", "doc_id", "dup", "block").rowsBetween(W.unboundedPreceding, 0)
    b = b.select("doc_id", "dup", "src", "shard", "block", "n", "rest", "draw").withColumn("before", F.sum("n").over(order) - F.col("n")).where("before < rest")
    b = b.withColumn("words", F.least("n", F.col("rest") - F.col("before")))
    picked = b.groupBy("doc_id", "dup").agg(F.sort_array(F.collect_list(F.struct("block", "words"))).alias("picked"), F.sum("words").alias("part"))
    picked = picked.withColumnsRenamed({"doc_id": "_id", "dup": "_dup"})
    out = d.join(picked, d.doc_id.eqNullSafe(picked._id) & (d.dup == picked._dup), "left")
    taken = (F.col("epochs") * F.col("size") + F.coalesce("part", F.lit(0))).alias("taken")
    return out.select("doc_id", "dup", "source", "size", "source_size", "target", "epochs", "picked", taken)


def mixed(docs: DataFrame, scratch: Scratch, block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole pass of a text and one for its picked blocks.

    A part's text has its words joined by one space; n_chars, where there is such a column, follows the text.
    """
    plan = mix_plan(docs, scratch, block_words=block_words, **options).where("taken > 0").selectExpr("doc_id", "dup as _mix_dup", "epochs as _mix_epochs", "picked as _mix_picked")
    plan = scratch.save(plan, "plan")
    if plan.where("_mix_dup > 1 or doc_id is null").isEmpty():
        rows = docs.join(plan.drop("_mix_dup"), "doc_id")
    else:
        plan = plan.withColumnRenamed("doc_id", "_mix_id")
        rows = docs.withColumn("_mix_n", F.row_number().over(W.partitionBy("doc_id").orderBy("source", words_in(F.col("text")))))
        rows = rows.join(plan, rows.doc_id.eqNullSafe(plan._mix_id) & (rows._mix_n == plan._mix_dup))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    cut = lambda w: F.flatten(F.transform("_mix_picked", lambda p: F.slice(w, p["block"] * block_words + 1, p["words"].cast("int"))))
    part = F.array_join(once(words, cut), " ")
    parts = F.concat(F.array_repeat(F.col("text"), F.col("_mix_epochs").cast("int")), F.when(F.col("_mix_picked").isNotNull(), F.array(part)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("text", F.explode(parts))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir), Scratch(spark, "mixing"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")
