"""Line dedup: suffix order of line-id sequences by distributed prefix doubling, exact common prefixes, later copies go.

Doubling gives every suffix its class, in suffix order, for each prefix of 2**k lines that occurs twice. These classes are
the intervals of suffixes with a common prefix of such a length; the exact length up to which a suffix has an earlier one
in its interval lies between two powers and is found bit by bit, from pairs of ranks at overlapping places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.llm.common import WORD, Scratch, documents, keep_ids

#: A maximal repeated run of so many lines or of so many words is deleted, and a whole text that is one.
MIN_LINES, MIN_WORDS = 2, 8
#: A text: its id, in order with null last, and its hash, since ids may repeat.
TEXT = ["no_id", "doc", "text_hash"]


def lines_of(text):
    """The lines of a text without white space at their ends; blank lines are no lines."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r"))), lambda x: x != "")


def place() -> Column:
    return F.struct(*TEXT, "line")


def text_key() -> dict[str, Column]:
    return {"no_id": F.col("doc_id").isNull(), "doc": F.coalesce("doc_id", F.lit(0)).cast("long"), "text_hash": F.xxhash64("text")}


def ranked(pairs: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The classes of equal ``keys`` with two places or more, ranked in the order of the keys.

    The sort is a range exchange of the classes; ids that rise with partition and row give ranks without one task that
    sees them all. The table is written, so ranks do not change if an executor is lost.
    """
    found = pairs.groupBy(*keys).agg(F.min(place()).alias("first"), F.max(place()).alias("last")).where("first <> last")
    return scratch.save(found.select(*keys, "first").orderBy(*keys).withColumn("next", F.monotonically_increasing_id()), name)


def suffix_ranks(docs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For each k, rows (k, text, line, rank, first): the prefixes of 2**k lines that occur twice, and where they do first."""
    rows = docs.select(*(c.alias(n) for n, c in text_key().items()), lines_of(F.col("text")).alias("lines"))
    rows = rows.select(*TEXT, F.posexplode_outer("lines").alias("line", "words")).where("words is not null")
    s = scratch.save(rows.select(*TEXT, "line", F.unhex(F.md5(F.encode("words", "utf-8"))).alias("key")), "lines")
    by, keys, levels = W.partitionBy(*TEXT).orderBy("line"), ["key"], []
    while True:
        k = len(levels)
        classes = ranked(s, keys, scratch, f"classes-{k}")
        if classes.isEmpty():
            break
        level = scratch.save(s.join(classes, keys).select(F.lit(k).alias("k"), *TEXT, "line", F.col("next").alias("rank"), "first"), f"level-{k}")
        levels.append(level)
        # Rows that repeat a text stand twice at a place; one of them is enough.
        s = level.withColumn("other", F.max("rank").over(by.rangeBetween(1 << k, 1 << k))).where("other is not null").select(*TEXT, "line", "rank", "other")
        keys = ["rank", "other"]
    return levels


def bit_by_bit(top: DataFrame, ranks: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (text, line, length) for ``top`` (text, line, k, rank): the most lines that also start at an earlier place.

    Between 2**k and twice that, each smaller bit is set where the prefix that has it starts earlier too: such a prefix
    is known by the ranks of its first and of its last 2**k lines. All k go through the same step together.
    """
    now = scratch.save(top.select(*TEXT, "line", "k", "rank", F.call_function("shiftleft", F.lit(1), F.col("k")).alias("length")), f"{name}-lengths")
    at = ranks.select("k", *TEXT, F.col("line").alias("tail"), F.col("rank").alias("other"))
    bits = now.agg(F.max("k")).first()[0] or 0
    tail = (F.col("line") + F.col("longer") - F.call_function("shiftleft", F.lit(1), F.col("k"))).alias("tail")
    for bit in reversed(range(bits)):
        here = at.where(F.col("k") > bit)
        ask = now.where(F.col("k") > bit).withColumn("longer", F.col("length") + (1 << bit))
        ask = scratch.save(ask.select(*TEXT, "line", "k", "rank", "longer", tail).join(here, ["k", *TEXT, "tail"]).distinct(), f"{name}-ask-{bit}")
        members = ranks.where(F.col("k") > bit).join(ask.select("k", "rank", "longer").distinct(), ["k", "rank"])
        members = scratch.save(members.select(*TEXT, "line", "k", "rank", "longer", tail), f"{name}-members-{bit}")
        begin = members.join(here, ["k", *TEXT, "tail"]).groupBy("k", "rank", "longer", "other").agg(F.min(place()).alias("begin"))
        good = ask.join(begin, ["k", "rank", "longer", "other"]).where(place() > F.col("begin")).select(*TEXT, "line", "longer")
        now = now.join(good, [*TEXT, "line"], "left").withColumn("length", F.coalesce("longer", "length")).drop("longer")
        now = scratch.save(now, f"{name}-lengths-{bit}")
    return now.select(*TEXT, "line", "length")


def repeated_runs(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Rows (text, line, length) of the runs: as many lines as also start at an earlier place, from where that is more
    than the rest of the run before.

    ``line + length`` never falls from a line to the next, so what the ranks say of the lines around bounds it from both
    sides. Lengths are sought bit by bit where a run surely begins, and then where the bounds still differ.
    """
    later = reduce(DataFrame.union, [x.where(place() > F.col("first")).select(*TEXT, "line", "k", "rank") for x in levels])
    top = later.groupBy(*TEXT, "line").agg(F.max("k").alias("k"), F.max_by("rank", "k").alias("rank"))
    top = top.withColumn("island", F.col("line") - F.row_number().over(W.partitionBy(*TEXT).orderBy("line")))
    by = W.partitionBy(*TEXT, "island").orderBy("line")
    power = F.call_function("shiftleft", F.lit(1), F.col("k"))
    over = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(0, W.unboundedFollowing)
    top = top.withColumn("low", F.max(F.col("line") + power).over(over[0])).withColumn("high", F.least(F.min(F.col("line") + 2 * power - 1).over(over[1]), F.max("line").over(over[1]) + 1))
    top = scratch.save(top.withColumn("starts", F.coalesce(F.lag("k").over(by) < F.col("k"), F.lit(True))), "tops")
    if len(levels) > 1:
        ranks = reduce(DataFrame.union, [x.drop("first") for x in levels[1:]])
        ranks = scratch.save(ranks.repartition(*TEXT), "ranks")
        known = bit_by_bit(top.where("starts and low < high"), ranks, scratch, "sure")
        top = top.join(known, [*TEXT, "line"], "left").withColumn("low", F.max(F.greatest("low", F.col("line") + F.coalesce("length", F.lit(0)))).over(over[0])).drop("length")
        open_ = scratch.save(top.withColumn("sought", F.col("starts") & (F.col("low") < F.col("high"))), "bounded")
        rest = open_.where("low < high and not sought")
        known = bit_by_bit(rest, ranks, scratch, "rest") if not rest.isEmpty() else known.limit(0)
        top = open_.join(known, [*TEXT, "line"], "left").withColumn("low", F.max(F.greatest("low", F.col("line") + F.coalesce("length", F.lit(0)))).over(over[0]))
    before = F.lag("low").over(by)
    return top.withColumn("before", before).where("before is null or low > before").select(*TEXT, "line", (F.col("low") - F.col("line")).alias("length"))


def line_dedup(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text) with the lines left as ``kept_text``, and counts.

    A run is as many lines as also start at an earlier place, in the order of (doc_id, text hash, line), unless it is the
    rest of the run that begins a line before. Runs of ``min_lines`` lines, of ``min_words`` words, or of all lines of
    their text are deleted; the first copy stays. A run may overlap its own copy. ``n_runs`` counts the runs deleted and
    ``longest_run`` has the lines of the longest. Blank lines and white space at the ends of lines are dropped and do not
    part a run. Null and empty texts have no lines. Rows that repeat doc_id and text count as one, and each gets its
    result. A null doc_id comes last in the order; such texts are told apart by their hash. Other columns are ignored.
    """
    levels = suffix_ranks(docs, scratch)
    base = docs.select("doc_id", "text").withColumns(text_key())
    kind = "array<struct<line: int, length: int>>"
    none = F.array().cast(kind)
    if not levels:
        out = base.withColumn("runs", none)
    else:
        runs = repeated_runs(levels, scratch)
        runs = runs.groupBy(*TEXT).agg(F.sort_array(F.collect_set(F.struct(F.col("line").cast("int").alias("line"), F.col("length").cast("int").alias("length")))).alias("runs"))
        runs = scratch.save(runs, "runs")
        keys = scratch.save(runs.select(*TEXT), "run-texts")
        # Only texts with a run are moved to the lists of these, by a shuffle at every size.
        some = keep_ids(base, keys, TEXT).join(runs.hint("merge"), TEXT)
        rest = keep_ids(base, keys, TEXT, "left_anti").withColumn("runs", none)
        out = some.select("doc_id", "text", "runs").unionByName(rest.select("doc_id", "text", "runs"))
    out = out.select("doc_id", lines_of(F.col("text")).alias("lines"), "runs")

    def goes(r: Column) -> Column:
        words = F.regexp_count(F.array_join(F.slice("lines", r["line"] + 1, r["length"]), "\n"), F.lit(WORD))
        return (r["length"] >= min_lines) | (r["length"] == F.size("lines")) | (words >= min_words)

    out = out.select("doc_id", "lines", F.filter("runs", goes).alias("runs"))
    kept = F.when(F.size("runs") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.exists("runs", lambda r: (r["line"] <= i) & (i < r["line"] + r["length"]))))
    out = out.select("doc_id", "lines", "runs", kept.alias("kept"))
    return out.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.size("runs").cast("long").alias("n_runs"),
        F.coalesce(F.array_max(F.transform("runs", lambda r: r["length"])), F.lit(0)).cast("long").alias("longest_run"), F.array_join("kept", "\n").alias("kept_text"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir), Scratch(spark, "line-dedup"))
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*', chr(10), 'g'), '\n') AS parts FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines FROM d),
l AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS x FROM t),
p AS (SELECT a.doc_id AS d, a.i AS i, b.doc_id AS e, b.i AS j FROM l a JOIN l b ON a.x = b.x AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.i < a.i)),
q AS (SELECT *, i - row_number() OVER (PARTITION BY d, e, i - j ORDER BY i) AS island FROM p),
s AS (SELECT d, i, max(z - i + 1) AS n FROM (SELECT *, max(i) OVER (PARTITION BY d, e, i - j, island) AS z FROM q) GROUP BY d, i),
r AS (SELECT x.d, x.i, x.n FROM s x LEFT JOIN s y ON y.d = x.d AND y.i = x.i - 1 WHERE y.n IS NULL OR x.n >= y.n),
g AS (SELECT doc_id, i, n FROM r JOIN t ON t.doc_id = r.d WHERE n >= 2 OR n = len(lines) OR len(regexp_extract_all(array_to_string(lines[i + 1 : i + n], chr(10)), '[^\x20\x09-\x0D]+')) >= 8),
c AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM g) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run FROM g GROUP BY doc_id)
SELECT t.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run,
sha256(coalesce(list_aggregate(list_transform(list_filter(range(len(lines)), lambda v: NOT list_contains(coalesce(gone, []), v)), lambda v: lines[v + 1]), 'string_agg', chr(10)), '')) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
