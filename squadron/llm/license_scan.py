"""License scans: an exact set-similarity join of text blocks with license templates, and base phrases.

A block for a template is a run of words a quarter longer than the template, wherever it begins and whatever lines it
crosses. Template words are ordered by their counts in all documents; the rarest ones, of which every block over the
threshold has one, are the keys of the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.llm.common import Scratch, documents, keep_ids
from squadron.llm.decontamination import clean

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label and text of each template; the longest notices of each license that stand in one block.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("cc-by", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
CONTAINMENT = 0.8
#: Words of a block for each word of the template.
STRETCH = 1.25
#: Templates of so many bytes in all are broadcast; more are joined by a shuffle.
MAX_TEMPLATE_BYTES = 8 << 20
KEY = ["no_id", "doc", "text_hash"]


def count_words(joined: Column) -> Column:
    return F.when(joined == "", F.lit(0)).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("long")


def base_columns(joined: Column) -> dict[str, Column]:
    """Places of the base phrases. In ``fenced`` every word has spaces of its own, so places next to each other count."""
    fenced = F.concat(F.lit(" "), F.replace(joined, F.lit(" "), F.lit("  ")), F.lit(" "))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    some, n, first, last, labels = F.lit(False), F.lit(0), [], [], []
    for phrase, label in PHRASES.items():
        mark, length = f" {phrase.replace(' ', '  ')} ", len(phrase.split())
        here = F.contains(joined, F.lit(phrase))
        places = F.when(here, (F.length(fenced) - F.length(F.replace(fenced, F.lit(mark), F.lit("")))) / len(mark)).otherwise(0).cast("long")
        n = n + places
        some = some | here
        before = spaces(F.substring_index(fenced, mark, 1)) / 2
        after = spaces(F.substring_index(fenced, mark, -1)) / 2
        first.append(F.when(places > 0, before.cast("long")))
        last.append(F.when(places > 0, (count_words(joined) - after - length).cast("long")))
        labels.append(F.when(places > 0, F.lit(label)))
    return {"n_base": n, "first_word": F.least(*first), "last_word": F.greatest(*last), "base": F.array_compact(F.array(*labels))}


def exploded(docs: DataFrame) -> DataFrame:
    """(key, i, token): every word of every text with its place."""
    return docs.select(*KEY, F.posexplode(F.split(clean(F.col("text")), " ")).alias("i", "token"))


def template_tokens(docs: DataFrame, templates, containment: float, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(tid, label, n, need, width, token, at) for each distinct word of a template, ``at`` from its rarest word on.

    Counts run over every word of all documents. The second value tells whether the table may be broadcast.
    """
    spark, small = docs.sparkSession, sum(len(t.encode()) for _, t in templates) <= MAX_TEMPLATE_BYTES
    rows = F.array(*(F.struct(F.lit(k).alias("tid"), F.lit(label).alias("label"), F.lit(t).alias("text")) for k, (label, t) in enumerate(templates)))
    t = spark.range(1).select(F.explode(rows).alias("t")).select("t.*").withColumn("words", F.split(clean(F.col("text")), " "))
    t = t.where(F.col("words")[0] != "").withColumns({"tokens": F.array_distinct("words"), "width": F.ceil(F.size("words") * F.lit(STRETCH)).cast("int")})
    t = t.withColumn("n", F.size("tokens")).withColumn("need", F.ceil(F.col("n") * containment - 1e-9).cast("int"))
    t = t.select("tid", "label", "n", "need", "width", F.explode("tokens").alias("token"))
    vocabulary = t.select("token").distinct()
    counts = exploded(docs).join(F.broadcast(vocabulary) if small else vocabulary, "token").groupBy("token").agg(F.count("*").alias("count"))
    t = t.join(counts, "token", "left").withColumn("at", F.row_number().over(W.partitionBy("tid").orderBy(F.coalesce("count", F.lit(0)), "token")))
    return scratch.save(t.select("tid", "label", "n", "need", "width", "token", "at"), "tokens"), small


def met_templates(docs: DataFrame, templates, containment: float, scratch: Scratch) -> DataFrame | None:
    """(key, own, share): labels of the templates that some block of a text meets, and the largest containment.

    Prefix filter: a text has one of the n - need + 1 rarest words of the template. Positional filters: only words of the
    template no further than a block from a prefix word count, and a block begins where the words from there on can still
    be enough. Length filter: a block has as many template words as the overlap needs. Then the exact overlap.
    """
    if not templates:
        return None
    tokens, few = template_tokens(docs, templates, containment, scratch)
    small = F.broadcast if few else (lambda x: x)
    prefix = tokens.where("at <= n - need + 1")
    shown = scratch.save(exploded(docs).join(small(prefix.select("token", "tid")), "token").select(*KEY, "tid").distinct(), "shown")
    keys = scratch.save(shown.select(*KEY).distinct(), "shown-texts")
    places = exploded(keep_ids(docs, keys, KEY)).join(small(tokens), "token").join(shown, [*KEY, "tid"], "left_semi")
    places = places.withColumn("in_prefix", F.col("at") <= F.col("n") - F.col("need") + 1)
    found = []
    # A frame has one width, so templates go by powers of two of theirs.
    for top in sorted({1 << (r.width - 1).bit_length() for r in tokens.select("width").distinct().collect()}):
        by = W.partitionBy(*KEY, "tid").orderBy("i")
        p = places.where((F.col("width") <= top) & (2 * F.col("width") > top))
        near = F.max(F.when(F.col("in_prefix"), F.col("i"))).over(by.rangeBetween(1 - top, 0)), F.min(F.when(F.col("in_prefix"), F.col("i"))).over(by.rangeBetween(0, top - 1))
        p = p.withColumn("back", near[0]).withColumn("ahead", near[1]).where("i - back < width or ahead - i < width")
        block = F.collect_list(F.struct("i", "at")).over(by.rangeBetween(0, top - 1))
        p = p.withColumn("block", F.filter(block, lambda x: x["i"] < F.col("i") + F.col("width"))).where(F.size("block") >= F.col("need"))
        p = p.withColumn("overlap", F.size(F.array_distinct(F.transform("block", lambda x: x["at"])))).where("overlap >= need")
        found.append(p.select(*KEY, "label", (F.col("overlap") / F.col("n")).alias("share")))
    out = reduce(DataFrame.union, found).groupBy(*KEY).agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    return scratch.save(out, "met")


def license_scan(docs: DataFrame, scratch: Scratch, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): base phrases, and labels of all templates that a block meets.

    ``templates`` are pairs of label and text. A block is a run of consecutive words, ``STRETCH`` times as many as the
    template has; it meets the template with ``containment`` of the template's distinct words. The score is the largest
    containment met, 1 if a base phrase stands in the text, else 0. Null and empty texts have no words, no labels and
    score 0; repeated rows are each scanned; a null doc_id is scanned like others; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.xxhash64("text").alias("text_hash"))
    met = met_templates(docs, templates, containment, scratch)
    d = docs.select("doc_id", *KEY, clean(F.col("text")).alias("joined"))
    base = base_columns(F.col("joined"))
    d = d.select("doc_id", *KEY, count_words(F.col("joined")).alias("n_words"), *(c.alias(k) for k, c in base.items()))
    none = F.array().cast("array<string>")
    d = d.withColumns({"own": none, "share": F.lit(None).cast("double")}) if met is None else d.join(met, KEY, "left")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"),
        text(F.concat("base", F.coalesce("own", none))).alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark, "licenses"))


_T = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in dict.fromkeys(t.split()))}], {-(-5 * len(t.split()) // 4)})" for k, (label, t) in enumerate(TEMPLATES))
_P = ", ".join(f"('{v}', [{', '.join(repr(w) for w in k.split())}])" for k, v in PHRASES.items())
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(label, p) AS (VALUES {_P}), t(tid, label, t, width) AS (VALUES {_T}),
b AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) JOIN p ON w[i + 1 : i + len(p)] = p),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY doc_id),
o AS (SELECT doc_id, i, x, tid, label, width, n FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM d) JOIN (SELECT tid, label, width, len(t) AS n, unnest(t) AS x FROM t) USING (x)),
k AS (SELECT a.doc_id, a.label, a.n, count(DISTINCT c.x) AS shared FROM o a JOIN o c ON c.doc_id = a.doc_id AND c.tid = a.tid AND c.i >= a.i AND c.i < a.i + a.width GROUP BY a.doc_id, a.tid, a.label, a.n, a.i),
m AS (SELECT doc_id, list(DISTINCT label) AS own, max(shared / n) AS score FROM k WHERE 10 * shared >= 8 * n GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)
"""
