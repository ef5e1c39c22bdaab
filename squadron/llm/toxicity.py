"""Toxicity: nearest labelled examples by exact TF-IDF cosine over an inverted index of every word of the examples."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadron.llm.common import Scratch, documents, keep_ids
from squadron.llm.textkit import MARKS, Words, drop_kept, give_back, pieces

#: Bound of the sample of labelled rows, for each label.
SAMPLE = 4000
#: Every word of the examples is a term. A term that tells the labels apart by so large a G statistic and so many times
#: the share of documents has its whole weight, others have less, down to FAINT of it: a few words make a text toxic, and
#: by plain TF-IDF the subject outweighs them. Both factors count, since longer texts and other mixes of languages make
#: many common words significant, but not by much.
FULL_G, FULL_RATIO, FAINT = 24.0, 3.0, 0.02
NEIGHBOURS, PRIOR = 15, 0.25
EVIDENCE = 5
#: A list of more than the examples divided by so many is a long one; examples in a block.
LONG, BLOCK = 12, 32
MEMO = 20_000
#: So many examples of the largest bounds set the threshold for the rest.
FIRST = 192


def crc(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def held_out():
    return F.coalesce(crc() % 5 == 0, F.lit(False))


class Places:
    """Gives the places of hashes in ``terms`` (ascending), -1 for others: first by the hashes' upper bits, then step by step."""

    def __init__(self, terms: np.ndarray):
        self.n, self.terms = len(terms), np.append(terms, np.uint64(0))
        bits = max(1, min(22, self.n.bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(terms >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        head = (h >> self.shift).astype(np.int64)
        out, at, end = np.full(len(h), -1, np.int64), self.begin[head], self.begin[head + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            own, want = self.terms[at[left]], h[left]
            same = own == want
            out[left[same]] = at[left[same]]
            left = left[own < want]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def term_counts(values, places: Places | None = None):
    """For each piece: (first row, rows, distinct (row, term), times); a term is a word hash, or its place, others left out."""
    drop_kept()
    for i, j, raw, off in pieces(values):
        w = Words(raw, off, MARKS, lower=True)
        row, h = w.row(), w.hash
        if places is not None:
            at = places(h)
            hit = np.flatnonzero(at >= 0)
            both, n = np.unique(row[hit] * max(1, places.n) + at[hit], return_counts=True)
            yield i, j - i, *np.divmod(both, max(1, places.n)), n
            continue
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        yield i, j - i, row[at], h[at], np.diff(np.append(at, len(h)))


def sample_ids(labels: DataFrame, size: int) -> DataFrame:
    """Labelled rows outside the held-out fold, at most ``size`` of each label, by the smallest hashes."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    draw = F.xxhash64(F.lit(11), "doc_id")
    pick = lambda y: known.where(F.col("toxic") == y).orderBy(draw, "doc_id").limit(size)
    return pick(0).union(pick(1)), known.groupBy("toxic").agg(F.count("*").alias("n"))


def term_forces(texts: DataFrame, n0: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the examples, ascending, and how much each tells the labels apart, from FAINT to 1."""

    def each(batches):
        for b in batches:
            y = b.column("toxic").to_numpy(zero_copy_only=False)
            for i, _, row, h, _ in term_counts(b.column("text")):
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(y[i + row].astype(np.int32))], ["term", "toxic"])

    counts = texts.mapInArrow(each, "term long, toxic int").groupBy("term").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("a"))
    got = counts.toArrow()
    terms, a, b = (got.column(c).to_numpy() for c in ("term", "a", "b"))
    terms = terms.view(np.uint64)
    order = np.argsort(terms)
    terms, a, b, n = terms[order], a[order].astype(float), b[order].astype(float), float(n0 + n1)
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1) / np.maximum(e, 1e-300)), 0.0)
    g = sum(part(o, m * k / n) for o, m, k in ((a, a + b, n0), (b, a + b, n1), (n0 - a, n - a - b, n0), (n1 - b, n - a - b, n1))) * 2
    ratio = np.abs(np.log((a + 0.5) / (n0 + 1.0)) - np.log((b + 0.5) / (n1 + 1.0)))
    force = np.clip(g / FULL_G, 0, 1) * np.minimum(1, ratio / np.log(FULL_RATIO))
    return terms, FAINT + (1 - FAINT) * force**2


def document_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many of all documents each term stands, and at the end the number of documents."""

    def each(batches):
        n, places = np.zeros(len(terms) + 1, np.int64), Places(terms)
        for b in batches:
            n[-1] += b.num_rows
            for _, _, _, h, _ in term_counts(b.column("text"), places):
                n[:-1] += np.bincount(h.astype(np.int64), minlength=len(terms))
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], ["term", "n"])

    got = docs.select("text").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


class Index:
    """For each term the list of its examples with their weights; long lists have block maxima.

    Examples stand in an order that puts like ones side by side, in blocks of ``BLOCK``, so the largest weight of a block
    bounds its examples closely. A list with fewer postings than there would be in every block is its own bound.
    """

    def __init__(self, ids: list[int], toxic: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, weight: np.ndarray):
        self.idf = idf
        units = [self.unit(t, tf) for t, tf in vectors]
        size = np.array([len(t) for t, _ in units], np.int64)
        terms = np.concatenate([np.empty(0, np.int64), *(t.astype(np.int64) for t, _ in units)])
        values = np.concatenate([np.empty(0), *(v for _, v in units)])
        length = np.bincount(terms, minlength=len(idf))
        self.long = np.full(len(idf), -1, np.int32)
        often = np.flatnonzero(length > len(ids) / LONG)
        self.long[often] = np.arange(len(often))
        row = np.repeat(np.arange(len(ids)), size)
        rank = self.places(row, terms, values, len(ids), len(often))
        order = np.lexsort((rank[row], terms))
        self.examples = rank[row][order].astype(np.int32)
        self.shares = values[order]
        self.lists = np.append(0, np.cumsum(length))
        back = np.argsort(rank)
        self.ids, self.toxic, self.weight = [ids[k] for k in back.tolist()], toxic[back], weight[back]
        self.rank = rank
        all_, bad = weight.sum() if len(ids) else 0.0, (weight * toxic).sum() if len(ids) else 0.0
        self.base = (bad + 0.5) / (all_ + 1)
        #: A text without a term is like the examples without a term.
        blank = size == 0
        own = weight[blank]
        self.empty = float(((own * toxic[blank]).sum() + self.base) / (own.sum() + 1))

    def places(self, row: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int, often: int) -> np.ndarray:
        """The place of each example in the order of blocks: halves along the axes in which the long lists vary most."""
        rank = np.empty(n, np.int64)
        if not often or n <= BLOCK:
            rank[:] = np.arange(n)
            return rank
        x = np.zeros((n, often), np.float32)
        at = self.long[terms]
        x[row[at >= 0], at[at >= 0]] = values[at >= 0]
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
        axes = np.linalg.eigh((x.T @ x).astype(np.float64))[1][:, ::-1][:, :6]
        x = x @ axes.astype(np.float32)
        open_, at = [np.arange(n)], 0
        while open_:
            some = open_.pop()
            if len(some) <= BLOCK:
                rank[some] = at + np.arange(len(some))
                at += len(some)
                continue
            some = some[np.argsort(x[some, x[some].var(0).argmax()], kind="stable")]
            half = -(-len(some) // (2 * BLOCK)) * BLOCK
            open_ += [some[half:], some[:half]]
        return rank

    def tables(self) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Weights of the long lists by example in single precision, their block maxima, and the same weights in full as a
        list for each example (begins, columns, weights); made where they are first used."""
        if not hasattr(self, "_tops"):
            n, often = len(self.ids), int(self.long.max(initial=-1)) + 1
            term = np.repeat(np.arange(len(self.idf)), np.diff(self.lists))
            at = np.flatnonzero(self.long[term] >= 0)
            at = at[np.argsort(self.examples[at], kind="stable")]
            row, column, share = self.examples[at], self.long[term[at]], self.shares[at]
            blocks = -(-max(n, 1) // BLOCK)
            tops = np.zeros((often, blocks))
            np.maximum.at(tops, (column, row // BLOCK), share)
            self._rows = np.zeros((blocks * BLOCK, often), np.float32)
            self._rows[row, column] = share
            self._full = np.append(0, np.cumsum(np.bincount(row, minlength=len(self._rows)))), column, share
            self._tops = tops
        return self._rows, self._tops, self._full

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "_tops", "_full")}

    def unit(self, t: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(tf)) * self.idf[t]
        norm = np.sqrt((v * v).sum())
        return (t, v / norm) if norm > 0 else (t[:0], v[:0])

    def nearest(self, t: np.ndarray, v: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, places) of all examples with a cosine as large as the k-th largest, descending; exactly.

        Postings of short lists are summed. The long lists are bounded by their block maxima; the examples of the largest
        bounds set a threshold, and sums in single precision, whose error is bounded, are taken only where the bound
        reaches it. Sums in full are taken of those that these leave.
        """
        rows, tops, (begins, column, share) = self.tables()
        n = len(self.ids)
        often = self.long[t]
        few = often < 0
        begin = self.lists[t[few]]
        size = self.lists[t[few] + 1] - begin
        end = np.cumsum(size)
        at = np.repeat(begin - (end - size), size)
        at += np.arange(len(at))
        part = np.repeat(v[few], size)
        part *= self.shares.take(at)
        s = np.bincount(self.examples.take(at), weights=part, minlength=len(rows))
        columns, x = often[~few], v[~few]
        full = (s.reshape(-1, BLOCK) + (x @ tops[columns])[:, None]).reshape(-1)
        full[n:] = -1.0
        if without >= 0:
            full[without] = -1.0
        q = np.zeros(tops.shape[0])
        q[columns] = x
        single = q.astype(np.float32)
        # Both vectors are of length 1 at most, so a sum of so many products is off by no more than this.
        slack = (len(q) + 4) * 2.0**-23 + 1e-9
        first = np.argpartition(full, n - FIRST)[-FIRST:] if n > FIRST else np.arange(n)
        first = first[full[first] >= 0]
        own = s[first] + rows.take(first, 0) @ single
        least = max(1e-12, np.partition(own, len(own) - k)[len(own) - k] - slack if len(own) >= k else 0.0)
        some = np.flatnonzero(full >= least)
        if len(some) > k:
            near = s[some] + rows.take(some, 0) @ single
            some = some[near >= np.partition(near, len(near) - k)[len(near) - k] - 2 * slack]
        size = begins[some + 1] - begins[some]
        end = np.cumsum(size)
        at = np.repeat(begins[some] - (end - size), size)
        at += np.arange(len(at))
        cosine = np.round(s[some] + np.bincount(np.repeat(np.arange(len(some)), size), weights=share[at] * q[column[at]], minlength=len(some)), 12)
        if len(some) > k:
            keep = cosine >= np.partition(cosine, len(some) - k)[len(some) - k]
            some, cosine = some[keep], cosine[keep]
        some, cosine = some[cosine > 0], cosine[cosine > 0]
        order = np.argsort(-cosine, kind="stable")
        return cosine[order], some[order]

    def vote(self, cosine: np.ndarray, near: np.ndarray, k: int) -> float:
        """Share of the toxic among the k nearest, by squared cosine; those tied for the last places share them evenly."""
        if not len(near):
            return self.empty
        part = np.ones(len(near))
        if len(near) > k:
            tied = cosine == cosine[-1]
            part[tied] = (k - (~tied).sum()) / tied.sum()
        w = cosine * cosine * self.weight[near] * part
        p = PRIOR * self.weight.min()
        return float(((w * self.toxic[near]).sum() + p * self.base) / (w.sum() + p))


def rising(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of y on x by pooling neighbours that fall."""
    order = np.argsort(x, kind="stable")
    pool: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pool.append([a * c, b * c, c])
        while len(pool) > 1 and pool[-2][1] * pool[-1][2] >= pool[-1][1] * pool[-2][2]:
            top = pool.pop()
            pool[-1] = [p + q for p, q in zip(pool[-1], top, strict=True)]
    return np.array([p[0] / p[2] for p in pool]), np.array([p[1] / p[2] for p in pool])


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int):
    """Terms and index of the examples, both broadcast, and the calibration of their votes."""
    spark = docs.sparkSession
    pick, counts = sample_ids(labels, sample)
    pick = scratch.save(pick, "sample")
    n = {r.toxic: r.n for r in counts.collect()}
    texts = keep_ids(docs.where("doc_id is not null").select("doc_id", "text"), pick, "doc_id", "inner")
    texts = scratch.save(texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "examples")
    drawn = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen, force = term_forces(texts, drawn.get(0, 0), drawn.get(1, 0))
    count = document_counts(docs, chosen)
    idf = (np.log((count[-1] + 1) / (count[:-1] + 1)) + 0.1) * force

    def vectors(batches):
        places = Places(chosen)
        for b in batches:
            for i, m, row, h, tf in term_counts(b.column("text"), places):
                cut = pa.array(np.searchsorted(row, np.arange(m + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (h, tf)]
                yield pa.record_batch([b.column("doc_id").slice(i, m), b.column("toxic").slice(i, m), *lists], ["doc_id", "toxic", "terms", "times"])

    listed = scratch.save(texts.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, times array<int>"), "vectors")
    got = listed.toArrow().sort_by("doc_id")
    ids, toxic = got.column("doc_id").to_pylist(), got.column("toxic").to_numpy().astype(float)
    # A label of which fewer rows were drawn counts for more, so votes follow the labels as they are in all rows.
    weight = np.array([n[int(y)] / drawn[int(y)] for y in toxic], float)
    each = zip(got.column("terms"), got.column("times"), strict=True)
    index = Index(ids, toxic, [(t.values.to_numpy(), tf.values.to_numpy().astype(float)) for t, tf in each], idf, weight)
    model = spark.sparkContext.broadcast((chosen, index))
    if not ids:
        return model, np.array([0.0]), np.array([0.0])
    place = {d: int(r) for d, r in zip(ids, index.rank, strict=True)}

    def judge(batches):
        _, index = model.value
        for b in batches:
            own, votes = b.column("doc_id").to_pylist(), []
            for d, h, tf in zip(own, b.column("terms"), b.column("times"), strict=True):
                t, v = index.unit(h.values.to_numpy(), tf.values.to_numpy().astype(float))
                votes.append(index.vote(*index.nearest(t, v, NEIGHBOURS, place[d]), NEIGHBOURS) if len(t) else index.empty)
            yield pa.record_batch([b.column("doc_id"), pa.array(votes, pa.float64())], ["doc_id", "vote"])

    votes = listed.repartition(-(-len(ids) // 250), "doc_id").mapInArrow(judge, "doc_id long, vote double").toArrow().sort_by("doc_id")
    return model, *rising(votes.column("vote").to_numpy(), toxic, weight)


def toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, evidence) for every row of ``docs`` (doc_id, text).

    Examples are at most ``sample`` rows of each label outside the held-out fold; all their words are terms, and document
    counts of these run over all documents. The weight of a term is TF-IDF times how much it tells the labels of the
    examples apart; words of no example have no weight. The votes of the nearest examples, weighted by squared cosine, are
    calibrated by an isotonic fit on the examples, each judged by the others; examples tied for the last of the places
    share these evenly, so no id or order reaches a score. ``evidence`` has the nearest examples' ids and cosines, of tied
    ones the smaller ids. Texts without a term, null and empty ones too, have the rate of such examples; with no examples the score
    is 0.5 / 1 at most and nothing is predicted toxic. Of labels that repeat a doc_id the larger counts, other labels than
    0 and 1 are left out; repeated documents are each scored; a null doc_id is not held out; other columns are ignored.
    """
    model, x, y = learn(docs, labels, scratch, sample)
    give_back()

    def score(batches):
        chosen, index = model.value
        memo: dict[bytes, tuple[float, list]] = {}
        places = Places(chosen)
        for b in batches:
            for i, m, row, h, tf in term_counts(b.column("text"), places):
                cut = np.searchsorted(row, np.arange(m + 1)).tolist()
                scores, shown = [], []
                for a, z in zip(cut[:-1], cut[1:], strict=True):
                    key = hashlib.blake2b(h[a:z].astype("<i4").tobytes() + tf[a:z].astype("<i4").tobytes(), digest_size=16).digest()
                    if key not in memo:
                        if len(memo) > MEMO:
                            memo.clear()
                        t, v = index.unit(h[a:z].astype(int), tf[a:z].astype(float))
                        cosine, near = index.nearest(t, v, NEIGHBOURS) if len(t) else (v[:0], t[:0])
                        shown_of = sorted((-c, index.ids[e]) for c, e in zip(cosine.tolist(), near.tolist(), strict=True))[:EVIDENCE]
                        memo[key] = min(1.0, max(0.0, float(np.interp(index.vote(cosine, near, NEIGHBOURS), x, y)))), [{"example": e, "cosine": -c} for c, e in shown_of]
                    p, e = memo[key]
                    scores.append(p)
                    shown.append(e)
                kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64())]))
                yield pa.record_batch([b.column("doc_id").slice(i, m), b.column("held_out").slice(i, m), pa.array(scores, pa.float64()), pa.array([int(p >= 0.5) for p in scores], pa.int32()), pa.array(shown, kind)], ["doc_id", "held_out", "score", "predicted", "evidence"])

    shape = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<example: bigint, cosine: double>>"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, shape)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "toxicity"))
