"""Substring dedup: suffix automata of reference shards; documents stream against them for matching statistics.

The reference is what repeats, each repeated window of words once, where it first stands. It is found in two blocking
steps: windows that repeat share an anchor, a sampled run of words, and only windows with a repeated anchor are hashed.
A window's owner is the first unit (about a megabyte of texts) that has it; an owner's windows make one shard. Stretches
of a document whose windows have repeated anchors are its candidates; whole, in pieces that overlap by a window, they
stream against the automaton of each shard that a blocking hash points to. What the automaton matches for a window's
length or more is removed, and nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadron.llm.common import MAX_BROADCAST_IDS, Scratch, documents, keep_ids, shuffle_partitions
from squadron.llm.textkit import Words, column, pieces, run_hashes

WINDOW = 35
#: Words between ASCII white space only.
split = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Hashes that a bucket of the counting step has at most, about, and query words that a shard's task streams.
BUCKET, STREAM = 500_000, 100_000
#: Bytes of text in a unit, the bound of a reference shard.
UNIT = 1 << 20
#: Windows that begin in a piece of a candidate.
PIECE_STARTS = 512


def slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over each run of w values, in log2(w) passes."""
    n, k = len(a) - w + 1, 1
    if n <= 0:
        return a[:0]
    cur = a
    while 2 * k <= w:
        cur = op(cur[:-k], cur[k:])
        k *= 2
    return op(cur[:n], cur[w - k : w - k + n])


def starts_in_rows(w: Words, window: int) -> np.ndarray:
    """Which words begin a window that ends in the same row."""
    end = np.repeat(w.first[1:], w.counts)
    return np.arange(len(w.hash)) + window <= end


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the smallest half-window run of each window; equal windows have equal anchors."""
    k = (window + 1) // 2
    span = window - k + 1
    runs = run_hashes(w.hash, k)
    low = slide(runs, span, np.minimum)
    low = np.where(starts_in_rows(w, window)[: len(low)], low, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    high = slide(np.concatenate([pad, low, pad]), span, np.maximum) if len(low) else runs[:0]
    at = np.flatnonzero((high == runs[: len(high)]) & (high > 0))
    return at, runs[at]


def kept_texts(raw: np.ndarray, off: np.ndarray, w: Words, keep: np.ndarray) -> list[bytes]:
    """Each row's kept words joined by one space."""
    at = np.flatnonzero(keep)
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, w.starts[at], 1)
    np.add.at(inside, w.ends[at], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    row = w.row()[at]
    joint = at[:-1][row[:-1] == row[1:]] if len(at) else at
    blank = np.zeros(len(raw), bool)
    blank[w.ends[joint]] = True
    out = np.where(blank, np.uint8(32), raw)[inside | blank]
    cut = np.concatenate([[0], np.cumsum(inside | blank)])[off]
    return [out[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def digests(texts: Iterable[bytes]) -> list[str]:
    return [hashlib.sha256(t).hexdigest() for t in texts]


def scan(window: int):
    """A row for each piece: ids, word counts and digests of its texts; hashes and places of their anchors."""

    def each(batches):
        for b in batches:
            for i, j, raw, off in pieces(b.column("text")):
                w = Words(raw, off)
                at, h = anchors(w, window)
                shas = digests(kept_texts(raw, off, w, np.ones(len(w.hash), bool)))
                ids = b.column("doc_id").slice(i, j - i).to_pylist()
                gaps = np.diff(at, prepend=0).astype("<u4").tobytes()
                yield pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([w.counts.tolist()], pa.list_(pa.int64())), pa.array([shas]), pa.array([h.tobytes()]), pa.array([gaps]), pa.array([len(h)], pa.int64())], ["ids", "counts", "shas", "hashes", "gaps", "n"])

    return each


def deal(hashes: np.ndarray, bits: int):
    """Distinct hashes in buckets by their top bits: (bucket, hashes, whether each stands twice or more)."""
    u, n = np.unique(hashes, return_counts=True)
    bucket = (u >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(bucket[a]), u[a:z], n[a:z] > 1


def meet(own: bool):
    """Of a bucket, the hashes that stand in two units or twice in one: a row for each unit, with owners if ``own``."""

    def each(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        h = np.concatenate(lists)
        unit = np.repeat(table.column("unit").to_numpy(), [len(x) for x in lists])
        twice = np.frombuffer(b"".join(table.column("twice").to_pylist()), bool)
        order = np.lexsort((unit, h))
        h, unit, twice = h[order], unit[order], twice[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        live = ((size > 1) | np.logical_or.reduceat(twice, first))[group]
        owner = unit[first][group] if own else np.zeros(len(h), np.int64)
        h, unit, owner = h[live], unit[live], owner[live]
        order = np.argsort(unit, kind="stable")
        h, unit, owner = h[order], unit[order], owner[order]
        cut = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(h) else np.empty(0, np.int64)
        end = np.append(cut[1:], len(h))[: len(cut)]
        parts = list(zip(cut, end, strict=True))
        return pa.table({"unit": unit[cut], "hashes": pa.array([h[a:z].tobytes() for a, z in parts], pa.binary()), "owners": pa.array([owner[a:z].tobytes() if own else b"" for a, z in parts], pa.binary())})

    return each


def repeated(dealt: DataFrame, own: bool) -> DataFrame:
    return dealt.groupBy("bucket").applyInArrow(meet(own), "unit long, hashes binary, owners binary")


def bits_for(spark: SparkSession, total: int) -> int:
    return max(1, (max(4 * shuffle_partitions(spark), total // BUCKET) - 1).bit_length())


def live_documents(units: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, sha, places) of the documents with repeated anchors; a unit meets its repeated hashes one at a time."""
    a = units.select("unit", F.lit(0).alias("kind"), "ids", "counts", "shas", "hashes", "gaps")
    b = found.select("unit", F.lit(1).alias("kind"), F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<bigint>").alias("counts"), F.lit(None).cast("array<string>").alias("shas"), "hashes", F.lit(None).cast("binary").alias("gaps"))

    def done(head, lists):
        h, at = np.frombuffer(head["hashes"], np.uint64), np.cumsum(np.frombuffer(head["gaps"], "<u4"), dtype=np.int64)
        at = at[np.isin(h, np.concatenate(lists))]
        first = np.concatenate([[0], np.cumsum(head["counts"])])
        row = np.searchsorted(first, at, "right") - 1
        rows = np.unique(row)
        place = (at - first[row]).astype("<i4")
        cut = np.append(np.searchsorted(row, rows), len(row))
        ids = [head["ids"][r] for r in rows]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([head["shas"][r] for r in rows], pa.string()), pa.array([place[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "sha", "places"])

    return by_unit(a.union(b), lambda x: np.frombuffer(x["hashes"], np.uint64), done, "doc_id long, sha string, places binary")


def by_unit(rows: DataFrame, item, done, shape: str) -> DataFrame:
    """Streams each unit's head (kind 0) and then its items through ``done``; units without an item give nothing."""

    def each(batches):
        head, items = None, []
        for b in batches:
            for k in range(b.num_rows):
                x = b.slice(k, 1).to_pylist()[0]
                if x["kind"] == 0:
                    if items:
                        yield done(head, items)
                    head, items = x, []
                else:
                    items.append(item(x))
        if items:
            yield done(head, items)

    return rows.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(each, shape)


def text_units(window: int):
    """Units of live texts; rows whose words are not those of the digest (another row of the same id) are left out."""

    def each(batches):
        ids, shas, texts, places, size = [], [], [], [], 0
        for b in batches:
            want, at, own, all_ = (b.column(c).to_pylist() for c in ("sha", "places", "doc_id", "text"))
            for i, j, raw, off in pieces(b.column("text")):
                w = Words(raw, off)
                for r, sha in enumerate(digests(kept_texts(raw, off, w, np.ones(len(w.hash), bool))), i):
                    if sha != want[r]:
                        continue
                    ids, shas, texts, places, size = [*ids, own[r]], [*shas, sha], [*texts, all_[r]], [*places, at[r]], size + len(all_[r])
                    if size >= UNIT:
                        yield unit_batch(ids, shas, texts, places)
                        ids, shas, texts, places, size = [], [], [], [], 0
        if ids:
            yield unit_batch(ids, shas, texts, places)

    return each


def unit_batch(ids, shas, texts, places):
    return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([shas], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string())), pa.array([places], pa.list_(pa.binary()))], ["ids", "shas", "texts", "places"])


def live_windows(texts: list[str], places: list[bytes], window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, bytes and offsets of a unit's texts; starts and hashes of the windows that hold a live anchor."""
    ((_, _, raw, off),) = pieces_of_all(texts)
    w = Words(raw, off)
    k = (window + 1) // 2
    mark = np.zeros(len(w.hash) + 1, np.int32)
    for r, p in enumerate(places):
        at = w.first[r] + np.frombuffer(p, "<i4").astype(np.int64)
        np.add.at(mark, np.maximum(at - (window - k), w.first[r]), 1)
        np.add.at(mark, at + 1, -1)
    live = (np.cumsum(mark[:-1]) > 0) & starts_in_rows(w, window)
    h = run_hashes(w.hash, window)
    at = np.flatnonzero(live[: len(h)])
    return w, raw, off, at, h[at]


def pieces_of_all(texts: list[str]):
    raw, off = column(pa.array(texts, pa.large_string()))
    return [(0, len(texts), raw, off)]


def deal_windows(window: int, bits: int):
    def each(batches):
        for b in batches:
            for k in range(b.num_rows):
                x = b.slice(k, 1).to_pylist()[0]
                h = live_windows(x["texts"], x["places"], window)[-1]
                parts = list(deal(h, bits))
                yield pa.record_batch([pa.array([p[0] for p in parts], pa.int64()), pa.array([x["unit"]] * len(parts), pa.int64()), pa.array([p[1].tobytes() for p in parts], pa.binary()), pa.array([p[2].tobytes() for p in parts], pa.binary())], ["bucket", "unit", "hashes", "twice"])

    return each


def deal_anchors(bits: int):
    def each(batches):
        for b in batches:
            for unit, raw in zip(b.column("unit").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                parts = list(deal(np.frombuffer(raw, np.uint64), bits))
                yield pa.record_batch([pa.array([p[0] for p in parts], pa.int64()), pa.array([unit] * len(parts), pa.int64()), pa.array([p[1].tobytes() for p in parts], pa.binary()), pa.array([p[2].tobytes() for p in parts], pa.binary())], ["bucket", "unit", "hashes", "twice"])

    return each


def route(units: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Texts for the shards: (shard, kind, unit, row, start, n, words).

    Kind 0 is the reference: runs of consecutive repeated windows that the unit itself owns. Kind 1 are the pieces of the
    unit's candidates, whole stretches with repeated anchors, one for each shard that owns a window in it.
    """
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    a = units.select("unit", F.lit(0).alias("kind"), "texts", "places", null("binary", "hashes"), null("binary", "owners"))
    b = found.select("unit", F.lit(1).alias("kind"), null("array<string>", "texts"), null("array<binary>", "places"), "hashes", "owners")
    kinds = (("shard", pa.int64()), ("kind", pa.int32()), ("unit", pa.int64()), ("row", pa.int32()), ("start", pa.int32()), ("n", pa.int64()), ("words", pa.string()))

    def done(head, items):
        w, raw, off, at, h = live_windows(head["texts"], head["places"], window)
        known, owner = (np.concatenate(x) for x in zip(*items, strict=True))
        order = np.argsort(known)
        known, owner = known[order], owner[order]
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[place] == h
        row = np.searchsorted(w.first, at, "right") - 1
        begins = np.append(True, (np.diff(at) != 1) | (np.diff(row) != 0))[: len(at)]
        head_of = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(at) else at
        # A stretch is cut into pieces; each ends with the window of its last start.
        begins |= (np.arange(len(at)) - head_of) % PIECE_STARTS == 0
        piece, cut = np.cumsum(begins) - 1, np.flatnonzero(begins)
        end = np.append(cut[1:], len(at))[: len(cut)] - 1
        pairs = np.unique(np.stack([piece[hit], owner[place[hit]]]), axis=1).T
        spans = [(int(own), 1, int(cut[p]), int(end[p])) for p, own in pairs.tolist()]
        mine = np.flatnonzero(hit & (owner[place] == head["unit"]))
        first = np.flatnonzero(np.append(True, (np.diff(mine) != 1) | (np.diff(at[mine]) != 1) | (np.diff(row[mine]) != 0))[: len(mine)])
        last = np.append(first[1:], len(mine))[: len(first)] - 1
        spans += [(head["unit"], 0, int(mine[x]), int(mine[z])) for x, z in zip(first, last, strict=True)]
        out = []
        for shard, kind, x, z in spans:
            text = raw[w.starts[at[x]] : w.ends[at[z] + window - 1]].tobytes().decode()
            out.append((shard, kind, head["unit"], int(row[x]), int(at[x] - w.first[row[x]]), int(at[z] - at[x]) + window, text))
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], [k for k, _ in kinds])

    item = lambda x: (np.frombuffer(x["hashes"], np.uint64), np.frombuffer(x["owners"], np.int64))
    return by_unit(a.union(b), item, done, "shard long, kind int, unit long, row int, start int, n long, words string")


def salted(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """Texts with the salted task of their shard, (shard, salt, kind, ...): the reference goes to each of the tasks."""
    load = scratch.save(runs.where("kind = 1").groupBy("shard").agg(F.ceil(F.sum("n") / STREAM).cast("int").alias("salts")), "loads")
    few = load.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    d = runs.join(F.broadcast(load) if few else load, "shard")
    rest = ("kind", "unit", "row", "start", "words")
    asked = d.where("kind = 1").select("shard", F.pmod(F.xxhash64("unit", "row", "start"), "salts").cast("int").alias("salt"), *rest)
    known = d.where("kind = 0").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *rest)
    return asked.union(known)


class Automaton:
    """Suffix automaton of word sequences, each ended by a word of its own."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, words: Iterable) -> None:
        nxt, link, length, last = self.next, self.link, self.length, self.last
        for c in [*words, object()]:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.last = last

    def spans(self, words: list, window: int) -> list[tuple[int, int]]:
        """Spans covered by matches of ``window`` words or more, joined where they touch: [begin, end)."""
        nxt, link, length = self.next, self.link, self.length
        v, n, out = 0, 0, []
        for i, c in enumerate(words, 1):
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(c)
            if to is None:
                n = 0
                continue
            v, n = to, n + 1
            if n >= window:
                if out and i - window <= out[-1][1]:
                    out[-1][1] = i
                else:
                    out.append([i - window, i])
        return [(a, z) for a, z in out]


def match(window: int):
    def each(batches):
        shard, automaton = None, None
        for b in batches:
            out = []
            for s, k, kind, unit, row, start, text in zip(*(b.column(c).to_pylist() for c in ("shard", "salt", "kind", "unit", "row", "start", "words")), strict=True):
                words = split(text)
                if shard != (s, k):
                    shard, automaton = (s, k), Automaton()
                if kind == 0:
                    automaton.add(words)
                else:
                    out += [(unit, row, start + a, start + z) for a, z in automaton.spans(words, window)]
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["unit", "row", "begin", "end"])

    return each


def cut_out(units: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, sha, n_removed, kept_sha256) of the documents that lose words."""
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    a = units.select("unit", F.lit(0).alias("kind"), "ids", "shas", "texts", null("int", "row"), null("int", "begin"), null("int", "end"))
    b = spans.select("unit", F.lit(1).alias("kind"), null("array<bigint>", "ids"), null("array<string>", "shas"), null("array<string>", "texts"), "row", "begin", "end")

    def done(head, items):
        ((_, _, raw, off),) = pieces_of_all(head["texts"])
        w = Words(raw, off)
        row, begin, end = np.array(items, np.int64).T
        mark = np.zeros(len(w.hash) + 1, np.int32)
        np.add.at(mark, w.first[row] + begin, 1)
        np.add.at(mark, w.first[row] + end, -1)
        keep = np.cumsum(mark[:-1]) == 0
        kept = digests(kept_texts(raw, off, w, keep))
        gone = np.bincount(w.row()[~keep], minlength=len(off) - 1)
        rows = np.flatnonzero(gone)
        return pa.record_batch([pa.array([head["ids"][r] for r in rows], pa.int64()), pa.array([head["shas"][r] for r in rows], pa.string()), pa.array(gone[rows].astype(np.int64)), pa.array([kept[r] for r in rows], pa.string())], ["doc_id", "sha", "n_removed", "kept_sha256"])

    return by_unit(a.union(b), lambda x: (x["row"], x["begin"], x["end"]), done, "doc_id long, sha string, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text).

    Words stand between ASCII white space. Every word goes that lies in a window of ``window`` words which also starts
    elsewhere, in the same text or another; all copies go, the first too. Null, empty and shorter texts lose nothing.
    Texts of equal words are one text from the start: if they have a window they lose every word, and one of them stands
    for all in the search. Rows that repeat a doc_id are texts like others; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    piece = scratch.save(texts.mapInArrow(scan(window), "ids array<bigint>, counts array<bigint>, shas array<string>, hashes binary, gaps binary, n long").withColumn("unit", F.monotonically_increasing_id()), "pieces")
    base = piece.select(F.explode(F.arrays_zip("ids", "counts", "shas")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.counts").alias("n_words"), F.col("x.shas").alias("sha"))
    base = scratch.save(base, "base")
    same = scratch.save(base.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "same")
    bits = bits_for(spark, piece.agg(F.sum("n")).first()[0] or 0)
    shape = "bucket long, unit long, hashes binary, twice binary"
    found = repeated(piece.select("unit", "hashes").mapInArrow(deal_anchors(bits), shape), own=False)
    live = live_documents(piece, found).groupBy("doc_id", "sha").agg(F.first("places").alias("places"))
    reps = same.select("sha", F.col("rep").alias("doc_id"))
    live = scratch.save(live.join(reps, ["doc_id", "sha"]), "live")
    scratch.drop("pieces")
    ids = scratch.save(live.select("doc_id").distinct(), "live-ids")
    some = keep_ids(texts, ids, "doc_id").join(live, "doc_id")
    units = some.mapInArrow(text_units(window), "ids array<bigint>, shas array<string>, texts array<string>, places array<binary>")
    units = scratch.save(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    total = live.agg(F.sum(F.length("places"))).first()[0] or 0
    bits = bits_for(spark, total * (window - window // 2) // 8)
    found = repeated(units.select("unit", "texts", "places").mapInArrow(deal_windows(window, bits), shape), own=True)
    runs = salted(scratch.save(route(units, found, window), "runs"), scratch)
    order = runs.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "unit", "row", "start")
    spans = order.mapInArrow(match(window), "unit long, row int, begin int, end int")
    cut = scratch.save(cut_out(units, spans), "cut")
    none = hashlib.sha256(b"").hexdigest()
    out = base.join(same.where("copies > 1").select("sha", "copies"), "sha", "left")
    out = out.join(cut.withColumnRenamed("doc_id", "_id"), (out.doc_id.eqNullSafe(F.col("_id"))) & (out.sha == cut.sha), "left").drop(cut.sha)
    gone = F.when(F.col("copies").isNotNull(), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copies").isNotNull(), F.lit(none)).otherwise(F.coalesce("kept_sha256", "sha"))
    return out.select("doc_id", "n_words", gone.alias("n_removed"), kept.alias("kept_sha256"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), Scratch(spark, "substring"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM s) WHERE n > 1),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM r) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string(list_transform(list_filter(range(len(w)), lambda j: NOT list_contains(coalesce(gone, []), j)), lambda j: w[j + 1]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
