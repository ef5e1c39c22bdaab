import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written as the pipeline's driver does."""
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(top / name))
        new = spark.read.parquet(str(top / name))
        out.append((docs.toPandas(), new.toPandas()))
        docs = new
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert list(after.columns) == list(before.columns)


def test_toxic_documents_go(spark, stages, scratch):
    from squadron.llm.toxicity import toxicity

    before, after = stages[0]
    scored = toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), scratch).toPandas()
    assert set(after.doc_id) == set(before.doc_id) - set(scored[scored.predicted == 1].doc_id)


def test_one_of_each_near_group_stays(stages):
    from test_dedup import near_brute

    before, after = stages[1]
    kept = {d for d, _, _, kept in near_brute([(r.doc_id, r.text) for r in before.itertuples()], 5) if kept}
    assert set(after.doc_id) == kept


def test_contaminated_documents_go(spark, stages):
    import re

    before, after = stages[2]

    def sets(t):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = [sets(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in before.itertuples() if any(q and 10 * len(q & sets(r.text)) >= 8 * len(q) for q in items)}
    assert set(after.doc_id) == set(before.doc_id) - bad


def test_mix_holds_only_words_of_its_documents(stages):
    before, after = stages[3]
    size = {r.doc_id: len((r.text or "").split()) for r in before.itertuples()}
    got = after.assign(n=after.text.str.split().str.len()).groupby("doc_id").n.sum().to_dict()
    assert all(n <= 2 * size[d] for d, n in got.items())
    assert abs(sum(got.values()) - 1.5 * sum(size.values())) <= 0.05 * sum(size.values())


def test_tokens_of_the_mix(stages):
    before, after = stages[4]
    assert len(after) == len(before) and sorted(after.doc_id) == sorted(before.doc_id)
    after = after.sort_values("start")
    assert (after.start.to_numpy()[1:] == (after.start + after.n_tokens).to_numpy()[:-1]).all()


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing names and no rows at all."""
    from pyspark.sql import functions as F

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "x y z v w u", None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, None, None, "t", None), (4, " ".join(f"word{k}" for k in range(900)), "en", None, 3)]
    for docs, alive in ((spark.createDataFrame(rows, kind), True), (spark.createDataFrame([], kind), False)):
        docs = docs.withColumns({"toxic": F.lit(1), "size": F.lit(2), "kept": F.lit(True)})
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{alive}")
            stage(spark, docs, SF).write.parquet(path)
            out = spark.read.parquet(path)
            if name == "token_output":
                assert out.count() == docs.count()
            else:
                assert out.columns == docs.columns and (out.count() > 0) == alive
                if name != "source_mixing" and alive:
                    assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None}
            docs = out
