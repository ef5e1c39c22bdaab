"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures, links confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadron.llm.common import MAX_BROADCAST_IDS, Scratch, components, documents, keep_ids, shuffle_partitions
from squadron.llm.textkit import Words, distinct, drop_kept, mix, pieces, shingles

#: Signatures have CHUNKS chunks of WIDTH values of 16 bits. One value of a chunk may differ, so by the pigeonhole rule
#: all pairs that differ in 2 * CHUNKS - 1 values or fewer share a key. A pair of similarity 0.8 shares none with
#: probability (1 - 0.8**7 - 7 * 0.2 * 0.8**6) ** 14, about 6e-6. Unlike texts share a key of six values with the sixth
#: power of their similarity (0.03 to 0.04 here), so they hardly meet; a corpus of 10**10 texts wants wider chunks.
CHUNKS, WIDTH = 14, 7
VALUES = CHUNKS * WIDTH
#: Pairs found that differ in more values than this (similarity 0.8: over 6 deviations) are not compared in full.
FAR = 45
#: Rounds in which a text is compared with so many leaders at most, before the components left are compared.
ROUNDS, LEADERS = 2, 8
#: Documents whose sets a task of the last comparison holds at a time, and documents that stream against them.
HOST_BLOCK, GUEST_BLOCK = 250, 1000
SALT_ROWS = 2000

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 1 << 32, VALUES, np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, VALUES, np.uint64).astype(np.uint32)


SIGNED = "doc_id long, n_shingles long, sum_a long, sum_b long, sig binary"


def sets_of(values, size: int):
    drop_kept()
    for i, j, raw, off in pieces(values):
        h, first = shingles(Words(raw, off, lower=True), size)
        yield i, j - i, *distinct(h, first)


def signatures(size: int):
    """(doc_id, n_shingles, set sums, signature): equal sums of two mixes of all hashes stand for equal sets."""

    def each(batches):
        for b in batches:
            for i, m, h, first in sets_of(b.column("text"), size):
                n = np.diff(first)
                some = np.flatnonzero(n)
                at = first[some]
                sums = [np.zeros(m, np.uint64), np.zeros(m, np.uint64)]
                sig = np.zeros((m, VALUES), np.uint16)
                if len(some):
                    for s, salt in zip(sums, (0x1234567, 0x89ABCDEF01), strict=True):
                        s[some] = np.add.reduceat(mix(h ^ np.uint64(salt)), at)
                    low = (h >> np.uint64(32)).astype(np.uint32)
                    for k in range(VALUES):
                        sig[some, k] = mix(np.minimum.reduceat(low * _FACTORS[k] + _SHIFTS[k], at).astype(np.uint64)).astype(np.uint16)
                yield pa.record_batch(
                    [b.column("doc_id").slice(i, m), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([x.tobytes() for x in sig])],
                    ["doc_id", "n_shingles", "sum_a", "sum_b", "sig"],
                )

    return each


def bucket_keys(batches):
    """A row (key, doc_id, sig) for each chunk and each of its values left out: the enumerated chunk errors."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        keys = []
        for c in range(CHUNKS):
            for gap in range(WIDTH):
                k = np.full(len(sig), c * WIDTH + gap + 1, np.uint64)
                for v in range(WIDTH):
                    if v != gap:
                        k = mix(k * np.uint64(0x100000001B3) + sig[:, c, v])
                keys.append(k)
        key = np.stack(keys, 1).reshape(-1)
        doc = np.repeat(b.column("doc_id").to_numpy(), len(keys))
        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(doc)], ["key", "doc_id"])


def far_apart(a, b):
    """Number of 16-bit values in which two signatures differ, on Arrow columns of bytes."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, VALUES) for c in (a, b))
    return (x != y).sum(1)


def near_pairs(batches):
    for b in batches:
        if b.num_rows:
            keep = pa.array(far_apart(b.column("sig_a"), b.column("sig_b")) <= FAR)
            b = b.filter(keep)
        yield b.select(["a", "b"])


def salted(pairs: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (a, b, ...) with a salt, and rows (a, salt): every ``a`` once for each of its salts.

    An ``a`` of very many pairs is dealt to groups of some ``SALT_ROWS``. Only such leaders are joined to the pairs, by
    broadcast where a count shows that they are few, so no join has a hot key.
    """
    counts = scratch.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")), f"{name}-salts")
    hot = counts.where("salts > 1")
    few = hot.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    dealt = pairs.join(F.broadcast(hot) if few else hot, "a", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"), F.lit(0))
    each = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return dealt.withColumn("salt", salt).drop("salts"), each


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    ``a`` is the leader and may have any number of pairs; a ``b`` has few. Texts of ``b`` go to their ``a`` in salted
    groups; a task has one text of ``a`` at a time and streams the others against it, so a leader of very many rows is
    spread over many tasks.
    """
    other, leads = salted(pairs, scratch, name)
    other = other.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "text")
    lead = leads.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = lead.union(other).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def each(batches):
        a, own = None, None
        for x in batches:
            ids, others = x.column("a").to_numpy(), x.column("b")
            for i, m, h, first in sets_of(x.column("text"), size):
                left, right = [], []
                for r in range(m):
                    s = h[first[r] : first[r + 1]]
                    if not others[i + r].is_valid:
                        a, own = ids[i + r], s
                        continue
                    assert a == ids[i + r]
                    n = len(s) + len(own)
                    common = n - len(np.unique(np.concatenate([s, own])))
                    if 100 * common >= percent * (n - common):
                        left.append(int(a))
                        right.append(others[i + r].as_py())
                yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.mapInArrow(each, "a long, b long")


def component_links(rows: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components that share a bucket, from open rows (key, doc_id, root).

    Neither documents nor components are paired. In each bucket the largest component is the host and the others are its
    guests. The documents of a host and of all its guests are dealt into blocks, and those of the guests into visits;
    each visit meets every block in a task of its own, where a document is compared with all full sets of other
    components at once. So tasks are bounded, and rows grow with documents times blocks.
    """
    member = rows.select("root", "doc_id").distinct()
    sized = scratch.save(member.groupBy("root").agg(F.count("*").alias("size")), "open-sizes")
    own = rows.select("key", "root").distinct().join(sized, "root")
    rank = F.max(F.struct("size", (-F.col("root")).alias("neg"))).alias("h")
    hosts = own.groupBy("key").agg(rank).select("key", (-F.col("h.neg")).alias("host"))
    meet = scratch.save(own.join(hosts, "key").where("root <> host").select("host", "root", "size").distinct(), "open-guests")
    total = meet.groupBy("host").agg(F.sum("size").alias("guests")).join(sized.withColumnsRenamed({"root": "host", "size": "own"}), "host")
    total = total.select("host", F.ceil((F.col("guests") + F.col("own")) / HOST_BLOCK).cast("int").alias("blocks"), F.ceil(F.col("guests") / GUEST_BLOCK).cast("int").alias("visits"))
    all_ = meet.select("host", "root", F.lit(True).alias("guest")).union(meet.select("host", F.col("host").alias("root"), F.lit(False)).distinct())
    all_ = all_.join(total, "host").join(member, "root")
    block, visit = F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"), F.pmod(F.xxhash64(F.lit(2), "doc_id"), "visits").cast("int").alias("visit")
    each_of = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    stay = all_.select("host", block, each_of("visits", "visit"), F.lit(0).alias("kind"), "root", "doc_id")
    come = all_.where("guest").select("host", each_of("blocks", "block"), visit, F.lit(1).alias("kind"), "root", "doc_id")
    ids = scratch.save(member.select("doc_id").distinct(), "open-ids")
    few = keep_ids(texts, ids, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    dealt = stay.union(come).join(few, "doc_id").repartition("host", "block", "visit").sortWithinPartitions("host", "block", "visit", "kind", "doc_id")

    def each(batches):
        at, docs, sets, index = None, [], [], None
        for b in batches:
            host, block, visit, kind, root, doc = (b.column(c).to_pylist() for c in ("host", "block", "visit", "kind", "root", "doc_id"))
            left, right = [], []
            for i, m, h, first in sets_of(b.column("text"), size):
                for r in range(m):
                    k, s = i + r, h[first[r] : first[r + 1]]
                    if at != (host[k], block[k], visit[k]):
                        at, docs, sets, index = (host[k], block[k], visit[k]), [], [], None
                    if kind[k] == 0:
                        docs.append((root[k], doc[k]))
                        sets.append(s)
                        continue
                    if not docs:  # no document was dealt to this block
                        continue
                    if index is None:
                        flat, n = np.concatenate(sets), np.array([len(t) for t in sets])
                        roots = np.array([d[0] for d in docs])
                        order = np.argsort(flat, kind="stable")
                        index = flat[order], np.repeat(np.arange(len(n)), n)[order], n
                    flat, owner, n = index
                    a, z = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                    hit = a < z
                    span = (z - a)[hit]
                    place = np.repeat(a[hit] - (np.cumsum(span) - span), span) + np.arange(span.sum())
                    common = np.bincount(owner[place], minlength=len(n))
                    near = np.flatnonzero((100 * common >= percent * (n + len(s) - common)) & (roots != root[k]))
                    # One link to each component is enough: its documents are joined already.
                    for q in near[np.unique(roots[near], return_index=True)[1]].tolist():
                        left.append(docs[q][1])
                        right.append(doc[k])
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(each, "a long, b long")


def near_dedup(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Sets are the distinct ``size``-word shingles of the text with A-Z lower-cased; with fewer words the whole sequence is
    the one shingle. Sets of ``percent`` similarity or more are linked; component_id is the smallest doc_id reachable.
    Texts without words, null ones too, have no set, no link, and stay. Rows that repeat a doc_id count as links of that
    id's other rows and each give a row; rows with a null doc_id are returned unlinked and kept. Other columns are ignored.

    Documents of equal set sums, whose full sets are then found equal to those of the first of them, are one class from the
    start. Each class is compared with a leader of its buckets, then with
    some more; links found join classes to components, and a bucket stays only while it has several. At the end the
    components left in a bucket are compared in full: no link between components is lost, and a group of copies never
    meets in all its pairs.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    sig = scratch.save(texts.mapInArrow(signatures(size), SIGNED), "signatures")
    some = sig.where("n_shingles > 0")
    same = ["n_shingles", "sum_a", "sum_b"]
    reps = scratch.save(some.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("sig").alias("sig")), "classes")
    copies = some.join(reps.where("members > 1").select(*same, "rep"), same).where("doc_id <> rep")
    # An id of several rows has several texts; such rows are classed by their sums alone.
    several = scratch.save(some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    copies = keep_ids(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), several.withColumnRenamed("doc_id", "b"), "b", "left_anti")
    copies = scratch.save(keep_ids(copies, several.withColumnRenamed("doc_id", "a"), "a", "left_anti"), "copies")
    ids = scratch.save(copies.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "copy-ids")
    equal = scratch.save(confirm(copies, keep_ids(texts, ids, "doc_id"), size, 100, scratch, "copies").distinct(), "equal")
    # Documents of equal sums and other sets are classes of their own; so are none but by chance of 2**-128.
    odd = scratch.save(copies.join(equal, ["a", "b"], "left_anti").select(F.col("b").alias("doc_id")).distinct(), "odd")
    if not odd.isEmpty():
        sig = scratch.save(sig.join(odd.withColumn("odd", F.lit(True)), "doc_id", "left").withColumn("sum_a", F.when(F.col("odd"), F.xxhash64("sum_a", "doc_id")).otherwise(F.col("sum_a"))).drop("odd"), "signatures-apart")
        reps = scratch.save(sig.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("sig").alias("sig")), "classes-apart")
    reps = reps.drop("members")
    keys = reps.select(F.col("rep").alias("doc_id"), "sig").repartition(shuffle_partitions(spark)).mapInArrow(bucket_keys, "key long, doc_id long")
    sizes = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("cnt")).where("low <> high").select("key", "cnt")
    signed = reps.select(F.col("rep").alias("doc_id"), "sig", "n_shingles")
    rows = scratch.save(keys.join(sizes, "key").select("key", "doc_id", "cnt"), "buckets")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (leader a, b) that the length filter, the signatures and then the full sets confirm."""
        p, leads = salted(pairs, scratch, f"{name}-sig")
        leads = leads.join(signed.selectExpr("doc_id as a", "sig as sig_a", "n_shingles as n_a"), "a")
        p = p.join(signed.selectExpr("doc_id as b", "sig as sig_b", "n_shingles as n_b"), "b").join(leads, ["a", "salt"])
        p = p.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")
        p = scratch.save(p.mapInArrow(near_pairs, "a long, b long"), f"{name}-near")
        ids = scratch.save(p.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
        few = keep_ids(texts, ids, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
        return scratch.save(confirm(p, few, size, percent, scratch, name), f"{name}-links")

    links, roots, done = None, None, None
    for step in range(ROUNDS + 1):
        if step == 0:
            # The class with the most company leads its buckets: of near copies of a text, the one nearest to all.
            weight = rows.groupBy("doc_id").agg(F.sum("cnt").alias("weight"))
            w = rows.join(weight, "doc_id").select("key", "doc_id", F.struct("weight", (-F.col("doc_id")).alias("neg")).alias("rank"))
            lead = w.groupBy("key").agg(F.max("rank").alias("lead"))
            pairs = w.join(lead, "key").where("doc_id <> -lead.neg").groupBy("doc_id").agg((-F.max("lead")["neg"]).alias("lead"))
        else:
            open_ = rows.join(roots, rows.doc_id == roots.node, "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
            lead = F.min(F.struct(F.xxhash64(F.lit(step), "key", "doc_id").alias("h"), F.col("doc_id").alias("lead"), F.col("root").alias("lead_root"))).alias("l")
            mixed = open_.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), lead).where("r <> s").select("key", "l.lead", "l.lead_root")
            rows = scratch.save(open_.join(mixed, "key"), f"open-{step}")
            if rows.isEmpty():
                break
            if step < ROUNDS:
                some_leads = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64(F.lit(step), "lead").alias("h"), "lead"))), 1, LEADERS)
                pairs = rows.where("root <> lead_root").groupBy("doc_id").agg(some_leads.alias("l")).select("doc_id", F.explode("l.lead").alias("lead"))
            else:
                links = links.union(scratch.save(component_links(rows.select("key", "doc_id", "root"), texts, size, percent, scratch), "last-links"))
                roots = components(links, scratch_part(scratch, step))
                break
            rows = rows.select("key", "doc_id")
        # Two documents may lead each other; they are one pair, compared in one round.
        pairs = pairs.groupBy(F.least("doc_id", "lead").alias("low"), F.greatest("doc_id", "lead").alias("high")).agg(F.min("lead").alias("a"))
        pairs = pairs if done is None else pairs.join(done, ["low", "high"], "left_anti")
        pairs = scratch.save(pairs.select("low", "high", "a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")), f"pairs-{step}")
        met = pairs.select("low", "high")
        done, pairs = met if done is None else done.union(met), pairs.select("a", "b")
        found = linked(pairs, f"round-{step}")
        links = found if links is None else links.union(found)
        roots = components(links, scratch_part(scratch, step))
    class_of = sig.join(reps.drop("sig"), same, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    out = class_of.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("root"))
    # Rows that repeat a doc_id may lie in several classes, which that id then joins.
    again = scratch.save(out.groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b"), "repeated")
    if not again.isEmpty():
        more = scratch.save(out.join(again.select("doc_id"), "doc_id", "left_semi").select("doc_id", "root").union(out.select("doc_id", "root")).select(F.col("root").alias("a"), F.col("doc_id").alias("b")), "all-links")
        final = components(more, scratch_part(scratch, "again"))
        out = out.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("root"))
    out = out.select("doc_id", "n_shingles", F.col("root").alias("component_id"), (F.col("doc_id") == F.col("root")).alias("kept"))
    lost = docs.where("doc_id is null").select("doc_id", "text").mapInArrow(signatures(size), SIGNED)
    return out.union(lost.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def scratch_part(scratch: Scratch, name) -> Scratch:
    part = object.__new__(Scratch)
    part.spark, part.root = scratch.spark, f"{scratch.root}/part-{name}"
    return part


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), Scratch(spark, "minhash"), size=2)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) > 1 THEN w[i + 1] || ' ' || w[i + 2] ELSE w[1] END AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y) SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, y AS component_id, w.doc_id = y AS kept FROM w JOIN r ON r.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
