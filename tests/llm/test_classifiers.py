import random
import zlib

import numpy as np
import pytest

from tarn.llm import language_id, quality

LETTERS = {"aa": "abcde", "bb": "klmno", "cc": "vwxyz"}


def sample(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(LETTERS)[i % 3]
        text = " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 120)))
        rows.append((i, text, lang))
    return rows


@pytest.fixture(scope="module")
def net(spark):
    return language_id.fit(spark.createDataFrame(sample(), "doc_id long, text string, lang string"))


def test_languages_of_held_out_rows(spark, net):
    rows = [r for r in sample() if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net).collect()}
    assert np.mean([found[i]["lang_pred"] == lang for i, _, lang in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_fit_is_repeatable_and_bounded(spark, net):
    again = language_id.fit(spark.createDataFrame(sample(), "doc_id long, text string, lang string"))
    assert np.array_equal(net.dense, again.dense)
    assert language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


def test_identify_edges(spark, net, docs, no_docs, twice, texts):
    found = {r["doc_id"]: r for r in language_id.identify(docs.select("doc_id", "text"), net).collect()}
    for i, t in enumerate(texts):
        if t is None or not any(c.isalpha() for c in t):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
        else:
            assert found[i]["lang_pred"] in LETTERS
    clashing = language_id.identify(docs, net)
    assert clashing.columns == [*[c for c in docs.columns if c not in ("lang_pred", "score")], "lang_pred", "score"] and clashing.count() == len(texts)
    assert language_id.identify(no_docs, net).count() == 0
    assert language_id.identify(twice, net).count() == 2 * len(texts) + 2
    assert {r["lang_pred"] for r in language_id.identify(docs.select("text"), None).collect()} == {"und"}


def test_windows_cover_the_whole_text(net):
    head = "abcde " * 50
    tail = "vwxyz " * 5000
    assert net.predict([head + tail])[0] == ["cc"]


def plain_responses(net, window):
    """Largest response of each filter, place by place."""
    out = []
    for w, table in zip(language_id.WIDTHS, net.tables, strict=True):
        for f in range(language_id.FILTERS):
            out.append(max(sum(float(table[j, window[i + j], f]) for j in range(w)) for i in range(len(window) - w + 1)))
    return np.array(out)


def plain_probabilities(net, window):
    z = np.maximum(plain_responses(net, window), 0) @ net.dense + net.bias
    z = np.exp(z - z.max())
    return z / z.sum()


def test_prediction_equals_the_plain_network(net):
    rng = random.Random(4)
    for text in ["".join(rng.choice("abcklmvwx éж") for _ in range(n)) for n in (3, 90, 256, 700)]:
        raw = text.encode()
        total = np.zeros(len(net.languages))
        for lo in range(0, len(raw), language_id.WINDOW):
            own = raw[lo : lo + language_id.WINDOW]
            total += len(own) * plain_probabilities(net, own.ljust(language_id.WINDOW, b"\0"))
        (lang,), (score,) = net.predict([text])
        assert score == pytest.approx(total.max() / len(raw), abs=1e-4) and lang == net.languages[int(total.argmax())]


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = language_id.ByteNet(["a", "b", "c"])
    net.tables, net.dense = [t.astype(float) for t in net.tables], net.dense.astype(float)
    net.bias = net.bias.astype(float)
    x, y = rng.integers(1, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        return -np.mean([np.log(plain_probabilities(net, row.tolist())[k]) for row, k in zip(x, y, strict=True)])

    grads = net._gradients(x, y)
    for weights, grad in zip([*net.tables, net.dense, net.bias], grads, strict=True):
        for at in [np.unravel_index(k, grad.shape) for k in np.argsort(-np.abs(grad), axis=None)[:3]]:
            weights[at] += 1e-5
            up = loss()
            weights[at] -= 2e-5
            down = loss()
            weights[at] += 1e-5
            assert grad[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_all_bytes_of_a_stretch_are_learned():
    for text in ["", "a", "日本語" * 170, "abc " * 128, "x" * 300, "é" * 500]:
        raw, own = text.encode(), language_id.windows_of(text)
        assert all(len(w) == language_id.WINDOW for w in own)
        assert all(any(raw[i : i + 8] in w for w in own) for i in range(0, len(raw) - 264, 7))
        assert b"".join(own).count(b"\0") < language_id.WINDOW or len(raw) < language_id.WINDOW


def test_many_languages_are_learned_within_the_sample(spark):
    rows = [(i, f"text of language {i % 300}", f"l{i % 300:03}") for i in range(3600)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(net.languages) == 300
    few = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50)
    assert 0 < len(few.languages) <= 50


def plain_scores(forest, x):
    out = []
    for row in x:
        margin = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            margin += leaf[node - (2**forest.depth - 1)]
        out.append(1 / (1 + np.exp(-margin)))
    return np.array(out)


def test_forest_walk_equals_plain_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    forest = quality.Forest(trees=20, depth=3).fit(x, y)
    assert np.allclose(forest.scores(x), plain_scores(forest, x))
    assert np.mean((forest.scores(x) > 0.5) == y) > 0.95


def test_quality_of_held_out_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(10, 80))]
        rows.append((i, " ".join(words) if good else " ".join(w + "$$$" for w in words)))
        labels.append((i, int(good)))
    labels += [(1, None), (None, 1), (2, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = [r for r in quality.score(docs, forest).collect() if r["held_out"]]
    assert found and np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in found]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


def test_repeated_documents_are_learned_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, 30))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample=40)
    often = quality.fit(spark.createDataFrame(rows + [rows[3]] * 500, "doc_id long, text string"), labels.unionByName(labels), sample=40)
    assert np.array_equal(once.leaf, often.leaf) and once.base == often.base


def test_quality_edges(spark, docs, no_docs, twice, texts):
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one_kind = quality.fit(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int"))
    assert all(r["score"] > 0.5 for r in quality.score(docs, one_kind).collect())
    assert quality.score(no_docs, none).count() == 0
    assert quality.score(twice, none).count() == 2 * len(texts) + 2
    assert len(quality.statistics(None)) == len(quality.FEATURES) == len(quality.statistics("a\nb"))
