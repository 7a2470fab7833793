import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_counts_and_packing import check_packed

import corpus_pipeline
from tarn.llm import mixing, neighbours


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_stop_at_the_limit():
    got = mixing.targets({"a": 100, "b": 1000, "c": 10, None: 10}, [5, 2, 1])
    assert got["c"] == pytest.approx(min(30, 1120 / 13)) and got[None] == 30
    assert sum(got.values()) == pytest.approx(1120)
    assert all(got[s] <= 3 * n + 1e-9 for s, n in {"a": 100, "b": 1000, "c": 10, None: 10}.items())
    assert mixing.targets({}, [1]) == {} and mixing.targets({"a": 0}, [1]) == {"a": 0}


def test_fill_gap():
    assert mixing.fill_gap([5, 3, 9, 1], 9) == [True, True, False, True]
    assert mixing.fill_gap([10], 6) == [True] and mixing.fill_gap([13], 6) == [False]
    assert mixing.fill_gap([], 5) == []


@pytest.fixture(scope="module")
def mixed_docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), ["hot"] * 6 + ["b", "c", "d", None], "x") for i in range(3000)]
    return spark.createDataFrame([(i, t, s[i % 10], x) for i, t, s, x in rows], "doc_id long, text string, source string, target string")


def check_mix(rows, docs):
    by_source = defaultdict(list)
    info = {r["doc_id"]: r for r in docs.collect()}
    for r in rows:
        by_source[info[r["doc_id"]]["source"]].append(r)
        assert r["size"] == size_of(info[r["doc_id"]]["text"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    sizes = {s: sum(r["size"] for r in own) for s, own in by_source.items()}
    goal = mixing.targets(sizes, [5, 2, 1])
    for s, own in by_source.items():
        assert {(r["source_size"], r["target"]) for r in own} == {(sizes[s], goal[s])}
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= max(3, 0.01 * goal[s])


def test_mix_meets_targets_and_repeats(mixed_docs):
    rows = mixing.mix(mixed_docs, [5, 2, 1]).collect()
    assert len(rows) == 3000
    check_mix(rows, mixed_docs)
    assert sorted(rows) == sorted(mixing.mix(mixed_docs.repartition(7), [5, 2, 1]).collect())


def test_mix_refines_bins(mixed_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 16)
    monkeypatch.setattr(mixing, "POOL", 8)
    check_mix(mixing.mix(mixed_docs, [5, 2, 1]).collect(), mixed_docs)


def test_mix_edges(docs, no_docs, twice, texts):
    assert mixing.mix(no_docs, [5, 2, 1]).count() == 0
    assert mixing.mix(docs, [5, 2, 1]).count() == len(texts)
    assert mixing.mix(twice, [5, 2, 1]).count() == 2 * len(texts) + 2


def test_carried_columns_stay_with_their_rows(docs, no_docs, twice, texts):
    carry = ["doc_id", "text", "lang", "size", "lang_pred"]  # ``size`` gives way to the result
    rows = mixing.mix(twice, [5, 2, 1], carry=carry).collect()
    assert list(rows[0].asDict()) == ["doc_id", "size", "source_size", "target", "taken", "text", "lang", "lang_pred"]
    assert len(rows) == 2 * len(texts) + 2 and all(r["size"] == size_of(r["text"]) for r in rows)
    assert sorted(((r["doc_id"], r["text"], r["lang"]) for r in rows), key=repr) == sorted(((r["doc_id"], r["text"], r["lang"]) for r in twice.collect()), key=repr)
    goal = {(r["doc_id"], r["source_size"]): r["target"] for r in mixing.mix(twice, [5, 2, 1]).collect()}
    assert all(goal[r["doc_id"], r["source_size"]] == r["target"] for r in rows)
    assert mixing.mix(no_docs, [5, 2, 1], carry=carry).count() == 0


def test_larger_importance_is_taken_more_often(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a", 8.0 if i % 2 else 1.0) for i in range(2000)] + [(5000 + i, "w " * 10, "b", 1.0) for i in range(8000)], "doc_id long, text string, source string, factor double")
    rows = mixing.mix(df, [1, 9], importance="factor").where("doc_id < 2000").collect()
    odd, even = (np.mean([r["taken"] / r["size"] for r in rows if r["doc_id"] % 2 == k]) for k in (1, 0))
    assert odd > 1.5 * even


def test_the_sample_is_the_sorted_pareto_order(spark, mixed_docs):
    """Against sorting: ranks of all documents, whole copies, and all that ranks before the words are reached."""
    rows = mixing.mix(mixed_docs, [5, 2, 1], seed=17).collect()
    taken = {r["doc_id"]: r["taken"] for r in rows}
    draws = {r["doc_id"]: (r["draw"] % (1 << 64) >> 12) for r in mixed_docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("draw")).collect()}
    by_source = defaultdict(list)
    for r in mixed_docs.collect():
        by_source[r["source"]].append((r["doc_id"], size_of(r["text"])))
    goal = mixing.targets({s: sum(n for _, n in own) for s, own in by_source.items()}, [5, 2, 1])
    for s, own in by_source.items():
        total = sum(n for _, n in own)
        want = min(round(goal[s]), 3 * total)
        whole = min(want // total, 3)
        part, factor = (want - whole * total) / total, {i: np.log1p(n) + 1 for i, n in own}
        mean = sum(n * factor[i] for i, n in own) / total
        ranks = []
        for i, n in own:
            u, p = (draws[i] + 0.5) / 2**52, min(max(part * factor[i] / mean, 1e-12), 1 - 1e-12)
            ranks.append(((u / (1 - u)) / (p / (1 - p)), i, n))
        ranks.sort()
        upto, sure, never = 0, [], []
        for _, i, n in ranks:
            (sure if upto + n <= want - whole * total else never).append((i, n))
            upto += n
        extra = lambda i, n: taken[i] - whole * n
        off = [i for i, n in sure if extra(i, n) != n] + [i for i, n in never if extra(i, n) != 0 and n]
        # only the pool around the end is chosen by fit
        assert len(off) <= 12 and set(off) <= {i for _, i, _ in ranks[len(sure) - 1 : len(sure) + 2 * mixing.POOL]}


def test_repeated_rows_make_no_long_pool(spark, tmp_path, monkeypatch):
    """All rows alike, by null id: the pool of a source stays short, and the result is the same however they are dealt."""
    plain, folder = mixing.fill_gap, str(tmp_path)

    def noted(sizes, gap):
        with open(f"{folder}/pools", "a") as f:
            f.write(f"{len(sizes)}\n")
        return plain(sizes, gap)

    monkeypatch.setattr(mixing, "fill_gap", noted)
    rows = spark.range(20_000).selectExpr("cast(null as long) doc_id", "'some words here' text", "if(id % 3 = 0, 'a', 'b') source")
    out = [sorted(map(tuple, mixing.mix(rows.repartition(k), [5, 2]).groupBy("source_size", "taken").count().collect())) for k in (2, 5)]
    pools = [int(n) for n in open(f"{folder}/pools")]
    assert out[0] == out[1] and 0 < max(pools) <= 4 * mixing.POOL


def exact(vectors, k, every):
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(w) - v) ** 2).sum())), i) for i, w in vectors.items() if i != q)
            out[q] = near[:k]
    return out


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 1500)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=32) for i in range(4000)}
    df = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in vectors.items()], "vec_id long, embedding array<double>, score double")
    want, got = exact(vectors, 10, 100), defaultdict(dict)
    for r in neighbours.nearest(df).collect():
        got[r["query_id"]][r["rank"]] = (r["score"], r["vec_id"])
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    recall = np.mean([len({i for _, i in want[q]} & {i for _, i in got[q].values()}) / 10 for q in want])
    assert recall >= 0.95
    for q, own in got.items():
        assert all(s == float(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum())) for s, i in own.values())
        assert [own[k] for k in sorted(own)] == sorted(own.values())


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.nearest(df).where("query_id = 0").collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 100, 0.0), (0, 3, 1, 1.0), (0, 4, 2, 1.0)]
    assert neighbours.nearest(spark.createDataFrame([], df.schema)).count() == 0


def test_repeated_queries_are_asked_once(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 300)]
    more = rows + [rows[99]] * 3 + [rows[199]]  # ids 100 and 200 in several rows
    asked = [tuple(r) for r in neighbours.nearest(spark.createDataFrame(more, "vec_id long, embedding array<double>")).collect()]
    assert sorted((q, k) for q, k, _, _ in asked) == [(q, k) for q in (100, 200) for k in range(1, 11)]
    plain = {q: sorted((float(np.sqrt(((np.array(w) - rows[q - 1][1]) ** 2).sum())), i) for i, w in more if i != q)[:10] for q in (100, 200)}
    assert all([(s, i) for q2, _, i, s in sorted(asked) if q2 == q] == plain[q] for q in (100, 200))


def test_few_vectors_are_verified():
    """Of uniform directions in 64 dimensions, where the tenth nearest is hardly nearer than the rest."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 64))
    vectors /= np.sqrt((vectors**2).sum(1))[:, None]
    index = neighbours.CollisionIndex(vectors, neighbours.random_lines(64))
    found = index.search(vectors[:40], 10, [np.array([q]) for q in range(40)])
    share = np.mean([len(rows) for rows, _ in found]) / 3000
    hits = 0
    for q, (rows, dists) in enumerate(found):
        exact = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        exact[q] = np.inf
        hits += len(set(np.argsort(exact)[:10]) & set(rows[np.argsort(dists)[:10]]))
    assert share < 0.2 and hits / 400 >= 0.95


@pytest.mark.parametrize("n", [1, 5, 50])
def test_shards_of_any_size_are_searched_alike(n):
    vectors = np.repeat([[1.0, 2.0], [1.0, 2.0]], n, axis=0)
    rows, dists = neighbours.CollisionIndex(vectors, neighbours.random_lines(2)).search(np.array([[3.0, 2.0]]), 10, [np.zeros(0, int)])[0]
    assert len(rows) == 2 * n and set(dists) == {2.0}


def test_pipeline_stages(spark, docs, no_docs, twice, texts):
    plain = docs.select(corpus_pipeline.COLUMNS)
    found = plain
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, found = found, spark.createDataFrame(stage(spark, found, "").collect(), plain.schema)
        assert found.columns == corpus_pipeline.COLUMNS
        if name == "language":
            assert {r["doc_id"] for r in found.collect()} == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
        if name == "near_dedup":
            kept = {r["doc_id"] for r in found.collect()}
            assert 0 in kept and not kept & {80, 81, 82, 83, 84} and len(kept) < before.count()
        if name == "mix":
            assert set(found.collect()) <= set(before.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, found.dropDuplicates(["doc_id"]), "").collect()
    check_packed(last, {r["doc_id"]: r["text"] for r in found.collect()})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, docs, no_docs, twice, name, stage):
    assert stage(spark, no_docs, "").count() == 0
    out = stage(spark, twice, "").collect()
    assert out
    if name == "near_dedup":
        ids = [r["doc_id"] for r in out if r["doc_id"] is not None]
        assert len(ids) == len(set(ids))


def test_pipeline_run(spark, docs, tmp_path):
    docs.select(corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_near_dedup_takes_similarity_of_0_8(spark):
    own = [f"w{i}" for i in range(104)]  # 100 shingles, of which two changes leave 90: 90 of 110
    near = ["changed" if i in (30, 60) else w for i, w in enumerate(own)]
    far = ["other" if i in (20, 40, 60) else w for i, w in enumerate(own)]  # 85 of 115
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate([own, near, far])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 2]


def test_language_keeps_unlabelled_documents(spark, docs, texts):
    plain = docs.select(corpus_pipeline.COLUMNS).withColumn("lang", F.lit(None).cast("string"))
    found = corpus_pipeline.language(spark, plain, "").collect()
    assert {r["doc_id"] for r in found} == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    assert {r["lang"] for r in found} == {"und"}


def test_mix_stage_takes_what_the_operator_takes(spark):
    """Also of null ids, which are told apart by their texts, and of rows that repeat."""
    rng = random.Random(9)
    rows = [(i if i % 3 else None, " ".join(["w"] * rng.randrange(1, 6)) + f" {i % 400}", "en", "ab"[i % 5 == 0], i % 2) for i in range(1500)]
    df = spark.createDataFrame(rows + rows[:300], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix(spark, df, "").collect()
    sizes = defaultdict(int)
    for r in df.collect():
        sizes[r["source"]] += size_of(r["text"])
    goal, got = mixing.targets(dict(sizes), [5, 2, 1]), defaultdict(int)
    for r in out:
        got[r["source"]] += size_of(r["text"])
    assert all(abs(got[s] - goal[s]) <= 6 for s in goal)
    assert sorted(map(repr, out)) == sorted(map(repr, corpus_pipeline.mix(spark, df.repartition(3), "").collect()))
