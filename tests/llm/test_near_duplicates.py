import random
import re
from collections import Counter

import numpy as np

from tarn.llm import near_duplicates as nd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected(texts_by_id, percent=85):
    sets = {i: shingles(t) for i, t in texts_by_id.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(df, texts_by_id):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}
    assert found == {i: (n, c, i == c) for i, (n, c) in expected(texts_by_id).items()}


def test_equals_brute_force(docs, texts):
    check(nd.near_duplicates(docs), dict(enumerate(texts)))


def test_crowded_family(spark):
    """Copies of one text with changes of their own: linked through the original, and not to each other."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = {0: " ".join(base)}
    for i in range(1, 90):
        own = list(base)
        for place in rng.sample(range(120), 2 if i % 2 else 4):
            own[place] = f"x{i}_{place}"
        rows[i] = " ".join(own)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    check(nd.near_duplicates(df), rows)


def test_edges(no_docs, twice, texts):
    assert nd.near_duplicates(no_docs).count() == 0
    found = nd.near_duplicates(twice).collect()
    assert len(found) == 2 * len(texts) + 2
    plain = expected(dict(enumerate(texts)))
    assert all(r["component_id"] == plain[r["doc_id"]][1] for r in found if r["doc_id"] is not None)
    assert all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)


def test_shingle_sets_and_sketch(texts):
    sets = nd.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    rows = nd.sketch(sets)
    for s, row in zip(sets, rows, strict=True):
        assert (len(s) == 0) == (not row.any())
        assert len(s) == 0 or (row != 0).all()
    rng = np.random.default_rng(2)
    pool = rng.integers(1, 2**63, 1500, np.uint64)
    a, b = nd.sketch([np.unique(pool[:1000]), np.unique(pool[250:1250])], 2000)
    assert abs((a == b).mean() - 750 / 1250) < 0.05


def test_components_are_stars(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in nd.components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}
    assert Counter(found.values()) == {0: 40, 90: 2}
