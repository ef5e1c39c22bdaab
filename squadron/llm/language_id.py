"""Language id: blended-spectrum n-gram presence kernel, Nystrom landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.llm.common import Scratch, documents, keep_ids
from squadron.llm.textkit import LOWER, pieces

ORDERS, BITS = (1, 2, 3, 4), 16
#: Bound of the training sample: rows over all languages; at least LEAST of each.
SAMPLE, LEAST = 2400, 8
LANDMARKS, RIDGE, SHARP = 256, 1e-2, 4.0
ROWS = 64
LETTER = regex.compile(r"\p{L}")
UND = "und"


def presence(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x 2**BITS: whether a row has an n-gram of UTF-8 bytes, ASCII lower-cased, in the bucket of its hash."""
    raw = LOWER[raw].astype(np.uint64)
    out = np.zeros((len(off) - 1, 1 << BITS), bool)
    flat, row = out.reshape(-1), np.repeat(np.arange(len(off) - 1, dtype=np.int64) << BITS, np.diff(off))
    gram = raw.copy()
    for n in ORDERS:
        if n > 1:
            gram = (gram[:-1] << np.uint64(8)) | raw[n - 1 :]
        if not len(gram):
            break
        same = row[n - 1 :] == row[: len(gram)]
        bucket = ((gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        flat[(row[: len(gram)] + bucket.astype(np.int64))[same]] = True
    return out


def packed(batches):
    for b in batches:
        for i, j, raw, off in pieces(b.column("text")):
            for k in range(0, j - i, ROWS):
                o = off[k : k + ROWS + 1]
                bits = np.packbits(presence(raw[o[0] : o[-1]], o - o[0]), axis=1)
                yield pa.record_batch([b.column("doc_id").slice(i + k, len(bits)), b.column("lang").slice(i + k, len(bits)), pa.array([x.tobytes() for x in bits])], ["doc_id", "lang", "bits"])


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def kernel(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of rows, as packed bits, with landmarks; few rows are unpacked at a time."""
    out = []
    for k in range(0, len(bits), ROWS):
        x = unpacked(bits[k : k + ROWS])
        out.append((x @ marks.T) / np.sqrt(np.maximum(x.sum(1), 1))[:, None] / np.sqrt(np.maximum(marks.sum(1), 1)))
    return np.vstack(out)


def fit(bits: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Classes and the weight of each bucket for each class, from rows of packed bits.

    The kernel is linear in presence, so landmarks, their whitening and the ridge weights fold into one matrix: scores
    of a batch are one product, divided by the root of each text's n-gram count.
    """
    classes = sorted(set(langs))
    own = np.random.default_rng(0).permutation(len(bits))[:LANDMARKS]
    marks = unpacked(bits[own])
    values, vectors = np.linalg.eigh(kernel(bits[own], marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])
    phi = kernel(bits, marks) @ white
    y = np.where(np.array(langs)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(bits) * np.eye(phi.shape[1]) / 100, phi.T @ y)
    return classes, (marks.T / np.sqrt(np.maximum(marks.sum(1), 1))) @ (white @ w).astype(np.float32)


def training_ids(docs: DataFrame, scratch: Scratch, sample: int) -> DataFrame:
    """Ids of a bounded sample, as many of each language: first thinned by a hash, then the smallest hashes of each."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang")
    counts = scratch.save(rows.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    each = max(LEAST, sample // max(1, counts.count()))
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.join(counts, "lang").where(part < F.lit(2.0 * each + 50) / F.col("n"))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id"))
    return near.withColumn("r", first).where(F.col("r") <= each).select("doc_id").distinct()


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    Trained on a sample of at most about ``sample`` rows outside the held-out fold; whole texts are scored. A text that
    is null or has no letter is ``und`` with score 0, and so is every text where nothing can be learned. Ties go to the
    language that sorts first. Repeated rows are each scored; a null doc_id is not held out; other columns are ignored.
    """
    spark = docs.sparkSession
    ids = scratch.save(training_ids(docs, scratch, sample), "sample-ids")
    rows = keep_ids(docs.select("doc_id", "text", "lang"), ids, "doc_id").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.text", "r.lang")
    got = sorted(rows.mapInArrow(packed, "doc_id long, lang string, bits binary").collect())
    shape = "doc_id long, held_out boolean, lang_pred string, score double"
    inputs = docs.select("doc_id", held_out().alias("held_out"), "text")
    if not got:
        return inputs.select("doc_id", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    classes, weights = fit(np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1), [r.lang for r in got])
    model = spark.sparkContext.broadcast((classes, weights))

    def score(batches):
        names, m = model.value
        for b in batches:
            for i, j, raw, off in pieces(b.column("text")):
                letters = [bool(t and LETTER.search(t)) for t in b.column("text").slice(i, j - i).to_pylist()]
                pred, best = [], []
                for k in range(0, j - i, ROWS):
                    o = off[k : k + ROWS + 1]
                    p = presence(raw[o[0] : o[-1]], o - o[0])
                    f = (p.astype(np.float32) @ m) / np.sqrt(np.maximum(p.sum(1), 1))[:, None] * SHARP
                    e = np.exp(f - f.max(1, keepdims=True))
                    pred += [names[c] for c in f.argmax(1)]
                    best += (e.max(1) / e.sum(1)).astype(float).tolist()
                pred = [a if ok else UND for a, ok in zip(pred, letters, strict=True)]
                best = [a if ok else 0.0 for a, ok in zip(best, letters, strict=True)]
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), b.column("held_out").slice(i, j - i), pa.array(pred), pa.array(best)], ["doc_id", "held_out", "lang_pred", "score"])

    return inputs.mapInArrow(score, shape)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir), Scratch(spark, "language-id"))
