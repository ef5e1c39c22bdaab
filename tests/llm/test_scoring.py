import random
import zlib
from collections import Counter

import numpy as np
import pytest

from squadron.llm import decontamination, language_id, license_scan, toxicity


def test_containment(spark, docs, rows, scratch):
    import re

    def words(t):
        return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]

    def shingles(t, k):
        w = words(t)
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}

    long = rows[30][1].split(" ")
    items = [(0, " ".join(long[1000:1040])), (1, " ".join([*long[2000:2020], "other", *long[2021:2050]])), (2, "one"), (3, None), (4, ""), (5, " ".join(long[:8] + ["q"] * 8)), (1, " ".join(long[2000:2003])), (None, "one")]
    items += [(6, " ".join(long[300:304])), (7, "under THE mit"), (8, long[9]), (9, " ".join(long[40:42])), (10, "É x")]
    b = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, h string")
    more = spark.createDataFrame([(None, "one two"), (None, "under the mit"), (77, "say É x now"), (78, "é x")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.item_shingles, r.shared) for r in decontamination.contaminated(docs.select("doc_id", "text").union(more), b, scratch).collect())
    size, sets = {}, {}
    for i, t in items:
        if i is not None:
            size[i] = max(size.get(i, 0), min(5, len(words(t))))
    for i, t in items:
        if i is not None and size[i]:
            sets.setdefault(i, set()).update(shingles(t, size[i]))
    texts = {}
    for d, t in [*((r[0], r[1]) for r in rows), *((r.doc_id, r.text) for r in more.collect())]:
        for k in range(1, 6):
            texts.setdefault((-1 if d is None else d, k), set()).update(shingles(t, k))
    want = sorted((d, i, len(q), len(q & x)) for (d, k), x in texts.items() for i, q in sets.items() if k == size[i] and 10 * len(q & x) >= 8 * len(q))
    assert got == want
    assert {(g[0], g[1]) for g in got} >= {(30, 0), (30, 1), (3, 2), (4, 2), (30, 6), (35, 7), (-1, 7), (-1, 2), (77, 10)} and (78, 10) not in {g[:2] for g in got}


def test_containment_of_nothing(spark, docs, nothing, scratch):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, none, scratch).count() == 0
    assert decontamination.contaminated(nothing, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"), scratch).count() == 0


def test_licenses(docs, nothing, scratch):
    got = {}
    for r in license_scan.license_scan(docs, scratch).collect():
        got.setdefault(r.doc_id, r)
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].base_labels, got[0].labels, got[0].score) == (0, 0, None, "", "", 0.0)
    # ééé ñandú the | mit license | apache license | mit license | mit license
    r = got[34]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (11, 4, 3, 9, "apache,mit", "apache,mit", 1.0)
    r = got[35]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (12, 2, 3, 7, "cc-by,mit", "cc-by,mit")
    assert got[30].n_words == 30000 and got[30].score == 0.0
    assert license_scan.license_scan(nothing, scratch).count() == 0


def blocks_brute(text, templates):
    import re

    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    labels, score = {label for p, label in license_scan.PHRASES.items() if f" {p} " in f" {' '.join(w)} "}, 0.0
    if labels:
        score = 1.0
    for label, t in templates:
        q = set(t.split())
        width = -(-5 * len(t.split()) // 4)
        best = max((len(q & set(w[i : i + width])) for i in range(len(w))), default=0)
        if 10 * best >= 8 * len(q):
            labels.add(label)
            score = max(score, best / len(q))
    return labels, score


@pytest.mark.parametrize("many", [False, True])
def test_license_templates_by_brute_force(spark, scratch, many):
    rng = random.Random(5)
    templates = [*license_scan.TEMPLATES, *((f"l{k}", " ".join(f"w{rng.randrange(600)}" for _ in range(rng.randrange(1, 90)))) for k in range(300))] if many else license_scan.TEMPLATES
    rows = [(i, None if i == 7 else "") if i in (7, 8) else (i, "") for i in range(60)]
    for i in range(60):
        parts = []
        for _ in range(3):
            t = rng.choice(templates)[1].split()
            some = [w for w in t if rng.random() < rng.choice((0.7, 0.9, 1))]
            parts.append([x for w in some for x in ([w, f"x{rng.randrange(99)}"] if rng.random() < 0.1 else [w])] + [f"y{rng.randrange(50)}" for _ in range(rng.randrange(40))])
        if i not in (7, 8):
            rows[i] = (None if i == 9 else i // 2, " ".join(x.title() + rng.choice((" ", "\n", ", ", "  ")) for p in parts for x in p))
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), scratch, templates).collect()
    found = Counter((r.doc_id, r.labels, round(r.score, 9)) for r in got)
    want = Counter((d, ",".join(sorted(labels)), round(score, 9)) for d, (labels, score) in ((d, blocks_brute(t, templates)) for d, t in rows))
    assert found == want and sum(bool(r.labels) for r in got) > 20


def test_wrapped_notices(spark, scratch):
    """Notices over several lines are found; words spread over a long line are not."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    far = "released " + "so it is " * 30 + "under " + "so it is " * 30 + "the mit " + "so it is " * 30 + "license"
    d = spark.createDataFrame([(1, "/*\n" + mit + "\n*/ code"), (2, bsd), (3, far)], "doc_id long, text string")
    assert sorted((r.doc_id, r.labels) for r in license_scan.license_scan(d, scratch).collect()) == [(1, "mit"), (2, "bsd"), (3, "")]


LANGS = {"en": "the of and to in is that it was for", "fr": "le la les des une que pour dans est sur", "de": "der die das und ist nicht mit auf ein von"}


def speech(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randrange(3, 40))), lang) for i, lang in ((i, rng.choice(list(LANGS))) for i in range(n))]


def test_languages(spark, nothing, scratch):
    rows = speech(600)
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 ?!", "fr"), (1003, "der und nicht", None), (1000, "the of", "en"), (None, "les des pour dans", "fr")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = language_id.language_id(d, scratch).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:600]}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by = {(r.doc_id, r.score > 0): r.lang_pred for r in got}
    assert by[1001, False] == by[1002, False] == "und" and by[1003, True] == "de" and by[1000, False] == "und" and by[1000, True] == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.language_id(nothing, scratch).count() == 0
    untaught = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.language_id(untaught, scratch).collect()] == ["und"]


def test_language_kernel_folds_exactly():
    rng = np.random.default_rng(0)
    x = rng.random((40, 320)) < 0.2
    langs = ["a" if r[:20].sum() > 4 else "b" for r in x]
    classes, m = language_id.fit(np.packbits(x, axis=1), langs)
    f = x @ m / np.sqrt(x.sum(1))[:, None]
    assert np.mean([classes[c] == g for c, g in zip(f.argmax(1), langs, strict=True)]) > 0.9


def test_places_of_hashes():
    rng = np.random.default_rng(3)
    for terms in (np.empty(0, np.uint64), np.array([0, 1, 2, 3, 1 << 40, (1 << 64) - 1], np.uint64), np.unique(rng.integers(0, 1 << 64, 5000, np.uint64))):
        h = np.concatenate([terms, terms + np.uint64(1), rng.integers(0, 1 << 64, 500, np.uint64)])
        at = toxicity.Places(terms)(h)
        known = {int(x): k for k, x in enumerate(terms.tolist())}
        assert at.tolist() == [known.get(int(x), -1) for x in h.tolist()]


def test_few_sums_in_full(monkeypatch):
    """Bounds and single sums leave few examples for exact cosines; of many near alike all ties are still found."""
    rng = np.random.default_rng(4)
    n, terms = 3000, 120
    base = [(np.sort(rng.choice(terms, 40, replace=False)), rng.integers(1, 6, 40).astype(float)) for _ in range(60)]
    vectors = [base[k % 60] for k in range(n)]
    index = toxicity.Index(list(range(n)), rng.integers(0, 2, n).astype(float), vectors, rng.random(terms) + 0.5, np.ones(n))
    rows, _, (begins, _, _) = index.tables()
    assert rows.dtype == np.float32 and begins[-1] < rows.size / 2
    cosine, near = index.nearest(*index.unit(*base[7]), 15)
    assert len(near) == n // 60 and (cosine == 1).all() and {index.ids[k] % 60 for k in near.tolist()} == {7}


@pytest.mark.parametrize(("n", "terms"), [(700, 30), (700, 900), (40, 30)])
def test_nearest_examples_are_exact(n, terms):
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(n):
        t = np.sort(rng.choice(terms, rng.integers(0, 6), replace=False))
        vectors.append((t, rng.integers(1, 5, len(t)).astype(float)))
    index = toxicity.Index(list(range(n)), rng.integers(0, 2, n).astype(float), vectors, rng.random(terms) + 0.5, np.ones(n))
    dense = np.zeros((n, terms))
    for d, (t, tf) in enumerate(vectors):
        t, v = index.unit(t, tf)
        dense[d, t] = v
    for d in range(0, n, 7):
        t, v = index.unit(*vectors[d])
        if not len(t):
            continue
        for without in (-1, d):
            cosine, near = index.nearest(t, v, 15, -1 if without < 0 else int(index.rank[d]))
            cos = np.round(dense @ dense[d], 10)
            if without >= 0:
                cos[without] = 0
            least = max(np.sort(cos)[-15], 1e-9)
            want = {e: c for e, c in enumerate(cos) if c >= least}
            found = {index.ids[e]: c for c, e in zip(cosine.tolist(), near.tolist(), strict=True)}
            assert found.keys() == want.keys() and all(abs(found[e] - want[e]) < 1e-9 for e in want)


def test_toxicity_by_dense_brute_force(spark, scratch):
    """The whole score again with dicts and every pair of texts: weights, cosines, shared last places, calibration."""
    import math
    import re

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # Copies of an example and of its opposite make ties over the last places.
    extra = [(900000 + i, f"tied words of one text {'scum' if i % 3 else ''}") for i in range(40)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    labels = labels.select("doc_id", "toxic").union(spark.createDataFrame([(d, int(d % 2)) for d, _ in extra], "doc_id long, toxic int"))
    bag = {r.doc_id: Counter(x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if x) for r in docs.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in bag and r.toxic in (0, 1)}
    n = Counter(y.values())
    df = Counter(t for b in bag.values() for t in b)
    seen = {c: Counter(t for d, k in y.items() if k == c for t in bag[d]) for c in (0, 1)}
    idf = {}
    for t in seen[0] | seen[1]:
        a, b = seen[0][t], seen[1][t]
        g = 2 * sum(o * math.log(o / (m * k / len(y))) for o, m, k in ((a, a + b, n[0]), (b, a + b, n[1]), (n[0] - a, len(y) - a - b, n[0]), (n[1] - b, len(y) - a - b, n[1])) if o)
        ratio = abs(math.log((a + 0.5) / (n[0] + 1)) - math.log((b + 0.5) / (n[1] + 1)))
        force = toxicity.FAINT + (1 - toxicity.FAINT) * (min(1, max(0, g / toxicity.FULL_G)) * min(1, ratio / math.log(toxicity.FULL_RATIO))) ** 2
        idf[t] = (math.log((len(bag) + 1) / (df[t] + 1)) + 0.1) * force

    def unit(b):
        v = {t: (1 + math.log(k)) * idf[t] for t, k in b.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    unit_of = {d: unit(b) for d, b in bag.items()}
    base = (n[1] + 0.5) / (len(y) + 1)
    blank = [d for d in y if not unit_of[d]]
    empty = (sum(y[d] for d in blank) + base) / (len(blank) + 1)

    def vote(v, without=None):
        if not v:
            return empty
        cos = {e: round(sum(x * unit_of[e].get(t, 0) for t, x in v.items()), 11) for e in y if e != without}
        top = sorted((c for c in cos.values() if c > 0), reverse=True)
        if not top:
            return empty
        last = top[:15][-1]
        tied = sum(c == last for c in top)
        share = 1 if len(top) <= 15 else (15 - sum(c > last for c in top)) / tied
        w = {e: c * c * (share if c == last else 1) for e, c in cos.items() if c >= last}
        return (sum(x * y[e] for e, x in w.items()) + toxicity.PRIOR * base) / (sum(w.values()) + toxicity.PRIOR)

    known = sorted(y)
    line = toxicity.rising(np.array([vote(unit_of[d], d) for d in known]), np.array([float(y[d]) for d in known]), np.ones(len(known)))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, scratch).collect()}
    assert len(got) == len(bag) and len(set(got.values())) > 10
    assert all(abs(p - min(1, max(0, float(np.interp(vote(unit_of[d]), *line))))) < 1e-6 for d, p in got.items())


def test_isotonic():
    x, y = toxicity.rising(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert x.tolist() == [1.0, 2.5, 4.0] and y.tolist() == [0.0, 0.5, 1.0]


def test_toxicity(spark, nothing, scratch):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(800):
        bad = rng.random() < 0.2
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))]
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "SCUM,", "Moron."])
        rows.append((i, " ".join(w), 1))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None, 1), (2001, "", 1), (2001, "idiot", 1), (None, "idiot scum", 1)]
    labels += [(5000, 1, 1), (None, 1, 1), (3, 1, None), (4, 1, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, y, scratch).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels[:800]}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert {r.predicted for r in got if r.doc_id == 2000} == {0} and Counter(r.predicted for r in got if r.doc_id == 2001) == {0: 1, 1: 1}
    assert all(r.evidence for r in held if r.predicted)
    assert toxicity.toxicity(nothing, y, scratch).count() == 0
    none = toxicity.toxicity(d, y.where("false"), scratch).collect()
    assert len(none) == len(rows) and {r.predicted for r in none} <= {0, 1}


def test_toxicity_keeps_every_word(spark, scratch):
    """Also a text without any word that tells the labels apart has its nearest examples, by all words it shares."""
    plain = [f"a{i} b{i} c{i % 7}" for i in range(200)]
    rows = [(i, t + (" scum" if i % 4 == 0 else "")) for i, t in enumerate(plain)] + [(900, plain[21] + " new"), (901, "c3")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, y, scratch).collect()}
    kept = [i for i in range(200) if not got[i].held_out]
    assert all(got[i].evidence[0].example == i and got[i].evidence[0].cosine > 0.999 for i in kept)
    assert 21 in kept and got[900].evidence[0].example == 21 and got[900].evidence[0].cosine > 0.999 and got[900].predicted == 0
    assert {e.example % 7 for e in got[901].evidence} == {3}


@pytest.mark.parametrize("size", [2, 5])
def test_shingle_hashes(size):
    import pyarrow as pa

    from squadron.llm import textkit

    texts = ["The a  b\tc", None, "", "the A b c d the a B c d", "one", "é x y", " lead and trail "]
    ((_, _, raw, off),) = textkit.pieces(pa.array(texts))
    w = textkit.Words(raw, off, lower=True)
    h, first = textkit.shingles(w, size)
    seen = {}
    for r, t in enumerate(texts):
        words = "".join(c.lower() if c.isascii() else c for c in t or "").replace(" ", "￾").split()
        want = [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
        own = h[first[r] : first[r + 1]].tolist()
        assert len(own) == len(want)
        for a, b in zip(own, want, strict=True):
            assert seen.setdefault(b, a) == a
    assert len(set(seen.values())) == len(seen)
