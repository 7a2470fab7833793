import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string, lang_pred string, c0 string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def make_texts():
    """Texts with copies, near copies, hard cases and one very long text."""
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        own = words(rng, rng.randrange(20, 200))
        texts.append(" ".join(own))
        near = list(own)
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
    texts += [texts[0]] * 5 + [None, "", "   ", "\n\n", "one", "two words", "a b c d", "A B C D", "é ü ñ", "123 456", "Σας ΑΣ", "x" * 5000]
    texts.append(" ".join(words(rng, 30_000)))
    texts += ["All rights reserved. CC BY here. General Public License", "Released under the MIT License.\nother line", "cc\tby cc-by CC BY"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with extra columns whose names clash with results."""
    rows = [(i, t, "en" if i % 3 else None, ["s1", "s2", None][i % 3] if i % 5 else "big", len(t or ""), "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def twice(spark, docs):
    """Every row repeated, and rows of null ids."""
    null_id = spark.createDataFrame([(None, "a text without an id", None, None, None, None, None, None, None, None)] * 2, SCHEMA)
    return docs.unionByName(docs).unionByName(null_id)
