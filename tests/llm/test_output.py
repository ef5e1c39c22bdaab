import zlib
from collections import defaultdict

import numpy as np
import pytest

from squadron.llm import mixing, token_output

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
LETTERS = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]


def plain(text, path=PATH, specials_as_text=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if specials_as_text:
        t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a  b", "a \n b", "I'm  here's\tx", "x\n\ny z", "<|endoftext|> is text", "naïve café 日本語 12 3.5", "a  b", "tab\t x", "end\n", "it 's odd", "\x1c a b"])
def test_words_encode_as_whole_texts(text):
    got, off = token_output.Encoder(PATH).encode(["the first", text, "a b."], 0)
    assert off.tolist()[0] == 0 and got[off[1] : off[2]].tolist() == [*plain(text), 0]
    assert got[off[2] :].tolist() == [*plain("a b."), 0]


def test_literal_end_token():
    text = "a<|endoftext|> is text <|endoftext|>"
    assert token_output.Encoder(PATH).encode([text], 0)[0].tolist() == [*plain(text), 0] and 50256 in plain(text)
    assert token_output.Encoder(PATH, True).encode([text], 0)[0].tolist() == [*plain(text, specials_as_text=True), 0]


def test_other_kinds_of_tokenizer_get_whole_texts():
    path = P.path("word_bpe_49k.json")
    texts = ["Some words  here", "", "and, more. <|endoftext|> x"]
    got, off = token_output.Encoder(path).encode(texts, 7)
    assert [got[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[*plain(t, path), 7] for t in texts]


def test_layout_of_the_files(spark, scratch, monkeypatch):
    """Footers: dictionary pages, bounded row groups, page indexes; a reader of one document touches few row groups."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setitem(token_output.LAYOUT, "parquet.block.size", str(256 << 10))
    monkeypatch.setitem(token_output.LAYOUT, "parquet.page.size", str(16 << 10))
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    token_output.write_tokens(d, scratch.path("laid"), PATH, file_bytes=500_000)
    files = sorted(glob.glob(scratch.path("laid") + "/*.parquet"))
    assert len(files) == 5  # 2.5 MB of text
    last, groups, holding = -1, 0, 0
    for f in files:
        m = pq.ParquetFile(f).metadata
        for g in range(m.num_row_groups):
            by = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c) for c in range(m.num_columns)}
            tokens = next(c for name, c in by.items() if name.startswith("tokens"))
            assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(tokens.encodings) and tokens.has_dictionary_page
            assert all(c.has_column_index and c.has_offset_index for c in by.values())
            assert m.row_group(g).total_byte_size < 2 << 20
            s = by["doc_id"].statistics
            assert s.min > last
            last, groups, holding = s.max, groups + 1, holding + (s.min <= 500 <= s.max)
    assert groups > len(files) and holding == 1


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(token_output, "STORE", 3)
    e = token_output.Encoder(PATH)
    for k in range(4):
        t = " ".join(f"word{i + k}, thing." for i in range(9))
        assert e.encode([t], 0)[0].tolist() == [*plain(t), 0] and len(e.store) <= 30


def test_units_of_mixed_texts_encode_as_whole_texts():
    """Marks, lines and digits end a unit; odd white space and characters beside them change no id, and the store stays small."""
    import random

    draw = random.Random(5)
    some = [" ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u180e", "a", "b", "s", "re", "'", "\u2019", "1", "23", ".", ",", "$$$", "é", "×", "ñ", "日", "\u2014", "\u0301", "½", "ж", "<|endoftext|>", "\x00", "the"]
    texts = ["".join(draw.choice(some) for _ in range(draw.randrange(14))) for _ in range(4000)]
    got, off = token_output.Encoder(PATH).encode(texts, 0)
    from tokenizers import Tokenizer

    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [got[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[*x, 0] for x in want]
    e = token_output.Encoder(PATH)
    e.encode(["It alpha, alpha. alpha\nBeta alpha$$$ alpha:\nAlpha alpha"], 0)
    assert {" alpha", ",", "\n", "Alpha"} <= set(e.store) and not any("alpha" in u for u in set(e.store) - {" alpha"})


def test_a_worker_keeps_few_units():
    text = " ".join(f"{a}{b}{c}" for a in LETTERS for b in LETTERS for c in LETTERS)
    e = token_output.Encoder(PATH)
    got = e.encode([text], 0)[0]
    assert len(got) == len(plain(text)) + 1 and got.tolist() == [*plain(text), 0]
    assert 100_000 < len(e.store) <= 200_000 and len(e.size) == len(e.store)


def test_files_round_trip(spark, docs, rows, scratch):
    got = sorted(token_output.token_output(docs, scratch, PATH).collect(), key=lambda r: r.start)
    want, at = [], 0
    for d, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0], len(r[1] or ""), r[1] or "")):
        ids = [*plain(text), 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    one = token_output.read_tokens(spark, scratch.path("tokens"), [34], ("doc_id", "tokens"))
    assert [r.tokens for r in one.collect()] == [[*plain(rows[34][1]), 0]]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()


def test_no_rows(nothing, scratch):
    assert token_output.token_output(nothing, scratch, PATH).count() == 0
    assert mixing.mix_plan(nothing, scratch).count() == 0
    assert mixing.mixed(nothing, scratch).count() == 0


def water(sizes, weights, share=1.5, top=2):
    total, target, open_ = share * sum(sizes.values()), {}, dict(weights)
    left = total
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if top * sizes[s] <= level * open_[s] + 1e-12]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = top * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix(docs, rows, scratch):
    got = mixing.mix_plan(docs, scratch, block_words=16, shard_words=500).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in order:
        assert abs(taken[s] - want[s]) <= 16 * 3, (s, taken[s], want[s])
    again = mixing.mix_plan(docs.repartition(7), scratch, block_words=16, shard_words=500).collect()
    key = lambda r: (r.doc_id, r.size, r.taken, r.epochs)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_sainte_lague(spark):
    rng = np.random.default_rng(1)
    for n, seats in ((3, 10), (7, 0), (5, 123), (1, 9), (40, 1000)):
        votes = rng.integers(0, 10000, n)
        votes[0] = 5000
        d = spark.createDataFrame([(i, int(v), seats) for i, v in enumerate(votes)], "p long, v long, s long")
        got = {r.p: r.quota for r in mixing.sainte_lague(d, [], "p", "v", "s").collect()}
        want = [0] * n
        for _ in range(seats):
            want[max(range(n), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert [got[i] for i in range(n)] == want


def test_mixed_texts_have_the_words_taken(docs, scratch):
    plan = mixing.mix_plan(docs, scratch, block_words=16, shard_words=500).collect()
    want = defaultdict(int)
    for r in plan:
        want[r.doc_id] += r.taken
    got = defaultdict(int)
    out = mixing.mixed(docs, scratch, block_words=16, shard_words=500)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += len((r.text or "").split())
        assert r.n_chars == len(r.text)
    assert dict(got) == {d: n for d, n in want.items() if n}
