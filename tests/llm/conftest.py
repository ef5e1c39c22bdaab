import random

import pytest
from pyspark.sql import functions as F

KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of a caller's own whose names clash with those that operators use inside.
CLASH = ("key", "rank", "size", "unit", "shard", "copies", "sha", "kept", "taken", "dup", "score", "line", "w", "h", "epochs", "picked", "text_hash", "toxic")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Nulls, empty and blank texts, one very long text, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(3)
    shared, passage = words(rng, 60), " ".join(words(rng, 12)) + "\nsecond line here\n" + " ".join(words(rng, 9))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "o n e"), (6, None)]
    base = words(rng, 120)
    for i in range(7, 15):
        near = list(base)
        near[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(near)))
    rows += [(15, " ".join(base)), (16, "  ".join(base)), (17, " ".join(base).upper())]
    for i in range(18, 30):
        a = words(rng, rng.randrange(1, 90))
        rows.append((i, " ".join(a + shared[rng.randrange(10) :] + words(rng, 5)) + "\n" + passage))
    rows.append((30, " ".join(words(rng, 30000, 5000))))
    rows += [(31, " ".join(shared[:35])), (32, " ".join(shared[:34])), (33, "a " * 80), (34, "ééé ñandú the MIT-license; Apache\nlicense, mit license mit license")]
    rows += [(35, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (35, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (36, "same id first"), (36, "same id other text " + " ".join(shared))]
    return [(i, t, "en" if i % 2 else "fr", None if i % 11 == 5 else f"src{i % 3}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    d = spark.createDataFrame(rows, KIND).repartition(3)
    return d.withColumns({c: F.lit(1) for c in CLASH}).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture
def scratch(spark):
    from squadron.llm.common import Scratch

    return Scratch(spark, "test")
