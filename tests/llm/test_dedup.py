import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from squadron.llm import exact_dedup, line_dedup, minhash_dedup, substring_dedup
from squadron.llm.common import Scratch, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_substring_windows(docs, rows, scratch):
    lists = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    count = Counter(tuple(w[i : i + 35]) for _, w in lists for i in range(len(w) - 34))
    want = []
    for d, w in lists:
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    got = [tuple(r) for r in substring_dedup.substring_dedup(docs, scratch).collect()]
    assert sorted(got) == sorted(want)
    assert any(g[2] for g in got)


def test_the_automaton_decides(docs, rows, scratch, monkeypatch):
    """Candidates go whole to the shards: without the automaton's spans all of them would be removed."""
    want = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs.where("doc_id <> 36"), scratch).collect()}
    lists = {r[0]: WORD.findall(r[1] or "") for r in rows}
    words = {i: [f"q{i}_{k}" for k in range(40)] for i in range(3)}
    shared = [f"s{k}" for k in range(30)]
    base = [(1, words[0] + shared + words[1]), (2, words[1][:20] + shared + words[0][:20]), (3, words[2] + shared + words[1])]
    d = docs.sparkSession.createDataFrame([(i, " ".join(w)) for i, w in base], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(d, scratch).collect()}
    assert got == {1: 70, 2: 0, 3: 70}
    assert any(0 < n < len(lists[i]) for i, n in want.items())

    spans = substring_dedup.Automaton.spans
    seen = []

    def watch(self, words, window):
        out = spans(self, words, window)
        seen.append(sum(b - a for a, b in out) < len(words))
        return out

    monkeypatch.setattr(substring_dedup.Automaton, "spans", watch)
    import pyarrow as pa

    at = ("shard", "salt", "kind", "unit", "row", "start", "words")
    text = [(0, 0, 0, 1, 0, 0, " ".join(shared + words[1])), (0, 0, 1, 2, 0, 5, " ".join(words[2] + shared + words[1][:10]))]
    (out,) = substring_dedup.match(35)([pa.RecordBatch.from_pylist([dict(zip(at, t, strict=True)) for t in text])])
    assert out.to_pylist() == [{"unit": 2, "row": 0, "begin": 45, "end": 85}] and seen == [True]


def test_automaton_finds_what_matches_cover():
    a = substring_dedup.Automaton()
    a.add("a b c d e".split())
    a.add("x b c y".split())
    assert a.spans("z b c d q b c y c d e".split(), 3) == [(1, 4), (5, 11)]
    assert a.spans("e x".split(), 2) == []


def text_hash(spark, texts):
    from pyspark.sql import functions as F

    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()]


def lines_brute(spark, rows, least, words):
    """Every place against all earlier ones, line by line."""

    def lines(text):
        return [x for x in (y.strip(" \t\x0b\x0c\r") for y in (text or "").split("\n")) if x]

    keys = [(d is None, d or 0, h) for (d, _), h in zip(rows, text_hash(spark, [t for _, t in rows]), strict=True)]
    texts = dict(sorted(zip(keys, (lines(t) for _, t in rows), strict=True)))
    starts, found = defaultdict(list), {}
    for k, w in texts.items():
        length = []
        for i, x in enumerate(w):
            best = 0
            for e, j in starts[x]:
                n, v = 0, texts[e]
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                best = max(best, n)
            length.append(best)
            starts[x].append((k, i))
        runs = [(i, n) for i, n in enumerate(length) if n and (i == 0 or length[i - 1] == 0 or n >= length[i - 1])]
        runs = [(i, n) for i, n in runs if n >= least or n == len(w) or sum(len(WORD.findall(x)) for x in w[i : i + n]) >= words]
        gone = {j for i, n in runs for j in range(i, i + n)}
        found[k] = (len(w), len(gone), len(runs), max((n for _, n in runs), default=0), "\n".join(x for i, x in enumerate(w) if i not in gone))
    return sorted(((d is not None, d or 0), found[k]) for (d, _), k in zip(rows, keys, strict=True))


def lines_got(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0), (r.n_lines, r.n_removed, r.n_runs, r.longest_run, r.kept_text)) for r in df.collect())


def test_lines(spark, docs, rows, scratch):
    got = lines_got(line_dedup.line_dedup(docs, scratch))
    assert got == lines_brute(spark, [r[:2] for r in rows], line_dedup.MIN_LINES, line_dedup.MIN_WORDS)
    assert any(g[1][3] > 2 for g in got)


@pytest.mark.parametrize(("least", "words", "scale"), [(1, 100, 0.1), (3, 5, 1)])
def test_runs_of_lines_of_any_length(spark, scratch, least, words, scale):
    """Overlaps, runs of 3, 5, 6, 7 and 1,100 lines, repeated ids and rows, and ids that are null."""
    import random

    rng = random.Random(8)
    long = [f"l{i} " + "w " * rng.randrange(4) for i in range(int(1100 * scale))]
    some = lambda n: [rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(n)]
    rows = [(1, "\n".join(long)), (2, "\n".join(["x", *long[3:], "y"])), (3, "\n".join(long[: int(700 * scale)] + ["z"] + long[int(500 * scale) : int(900 * scale)])), (4, "a\n" * 9), (5, None), (6, "")]
    rows += [(7 + i, "\n".join(some(rng.randrange(1, 40)))) for i in range(40)]
    rows += [(3, "\n".join(long[10:17])), (3, "\n".join(long[10:17])), (None, "\n".join(long[20:26])), (None, "\n".join(some(9))), (None, "\n".join(some(9))), (None, None), (60, long[30]), (61, "q q q q q q q q q"), (62, "r\nq q q q q q q q q\ns")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert lines_got(line_dedup.line_dedup(d, scratch, least, words)) == lines_brute(spark, rows, least, words)


def near_brute(rows, size):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append((r[0], {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()))
    root = {d: d for d, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(s), find(d), d == find(d)) for d, s in sets)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, scratch, size):
    got = sorted(tuple(r) for r in minhash_dedup.near_dedup(docs, scratch, size).collect())
    assert got == near_brute(rows, size)


def test_no_pair_at_the_threshold_is_missed(spark, scratch):
    """Planted pairs with a similarity from 0.80 to 0.82, of several sizes: all are linked."""
    import random

    rng, rows = random.Random(12), []
    for i in range(240):
        n = rng.choice((18, 45, 90, 180, 450))
        base = [f"p{i}_{k}" for k in range(n + 1)]
        # Words left out at the end of one text: n - m of n shingles are shared.
        m = int(n * rng.uniform(0.18, 0.2))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: n + 1 - m]))]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), scratch, 2).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_many_unlike_near_copies(spark, scratch, monkeypatch):
    """Components left in one bucket are compared in blocks and visits, leaders in salted groups; tasks of a few documents
    give the same links."""
    import random

    monkeypatch.setattr(minhash_dedup, "HOST_BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "GUEST_BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "SALT_ROWS", 2)
    monkeypatch.setattr(minhash_dedup, "ROUNDS", 1)
    rng = random.Random(4)
    base, rows = [f"b{k}" for k in range(60)], []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(3, 9)):
            w[rng.randrange(60)] = f"z{rng.randrange(500)}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in minhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), scratch, 2).collect())
    assert got == near_brute(rows, 2)


def test_chunks_meet_within_the_guaranteed_distance():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 16, (1, minhash_dedup.VALUES), np.uint64).astype(np.uint16)
    many = np.repeat(sig, 200, 0)
    for row in many[1:]:
        at = rng.choice(minhash_dedup.VALUES, 2 * minhash_dedup.CHUNKS - 1, replace=False)
        row[at] += 1
    batch = pa.record_batch([pa.array(range(200)), pa.array([x.tobytes() for x in many])], ["doc_id", "sig"])
    (out,) = minhash_dedup.bucket_keys([batch])
    keys = defaultdict(set)
    for k, d in zip(out.column("key").to_pylist(), out.column("doc_id").to_pylist(), strict=True):
        keys[d].add(k)
    assert all(keys[0] & keys[d] for d in range(200))


def test_components(spark, scratch):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, 7), (7, 3), (3, 3), (200, 100)] + [(300, i) for i in range(301, 340)] + [(None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {i: 10 for i in range(11, 61)} | {7: 3, 100: 3, 200: 3} | {i: 300 for i in range(301, 340)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "none")).count() == 0


def exact_brute(rows):
    norm = [(d, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for d, t in rows]
    best, size = {}, Counter(n for *_, n in norm)
    for d, t, n in norm:
        rank = (len(t), d is not None, -(d or 0))
        best[n] = max(best.get(n, (-1, False, 0)), rank)
    want = [(d, -best[n][2] if best[n][1] else None, size[n]) for d, _, n in norm]
    return sorted(((d, k, c, d == k, sha(n)) for (d, k, c), (*_, n) in zip(want, norm, strict=True)), key=str)


@pytest.mark.parametrize("letters", [64, 1, 0])
def test_exact(spark, docs, rows, tmp_path, monkeypatch, letters):
    """Also where texts of unlike bytes share a digest of one letter or none, and where large groups are dealt out."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 3)
    more = [(None, "no id"), (None, "n o id"), (None, "alone"), (90, "no id"), *((100 + i, "of many  " + " " * (i % 3)) for i in range(12))]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    d.withColumn("digest", F.lit(1)).withColumn("file", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = exact_dedup.exact_dedup(spark, str(tmp_path / "documents.parquet") + "/", digest=lambda c: F.substring(c, 1, letters)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == exact_brute([*(r[:2] for r in rows), *more])


def test_exact_resumes(spark, tmp_path):
    """A second run over a table that has grown starts from the state of the first."""
    path, state = str(tmp_path / "t.parquet"), str(tmp_path / "state")
    first, second = [(5, "a b"), (6, "c")], [(1, "ab"), (2, "a  b"), (3, "c"), (4, "d")]
    spark.createDataFrame(first, "doc_id long, text string").coalesce(1).write.parquet(path)
    assert sorted(map(tuple, exact_dedup.exact_dedup(spark, path, state).collect()), key=str) == exact_brute(first)
    spark.createDataFrame(second, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    assert sorted(map(tuple, exact_dedup.exact_dedup(spark, path, state).collect()), key=str) == exact_brute(first + second)
    batches = [p.name for p in (tmp_path / "state" / "states").iterdir() if p.name.startswith("batch=")]
    assert len(batches) >= 2


def test_empty_tables(spark, nothing, scratch, tmp_path):
    assert substring_dedup.substring_dedup(nothing, scratch).count() == 0
    assert line_dedup.line_dedup(nothing, scratch).count() == 0
    assert minhash_dedup.near_dedup(nothing, scratch).count() == 0
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "documents.parquet")).count() == 0


def test_null_ids(spark, scratch, tmp_path):
    d = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash_dedup.near_dedup(d, scratch).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False)]
    again = [(50, "x y z one"), (50, "k l m two"), (51, "x y z one"), (52, "k l m two"), (53, "X y z one"), (54, None)]
    e = spark.createDataFrame(again, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_dedup(e, scratch).collect()) == [(50, 50), (50, 50), (51, 50), (52, 50), (53, 50), (54, 54)]
    assert substring_dedup.substring_dedup(d, scratch).count() == 4
    d.write.parquet(str(tmp_path / "t.parquet"))
    assert {r.keep_id for r in exact_dedup.exact_dedup(spark, str(tmp_path / "t.parquet")).where("doc_id = 2").collect()} == {1}
