import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm import packing, token_counts

WORD_PATH, BYTE_PATH = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["'s don't I'LL", "<|startoftext|>a<|endoftext|>", "İſΣς ΑΣ", "é é ́x", "aaaa hahaha", "\x85 　 x\x1cy", "日本 😀", "a,b. c!! ..", " two  blanks ", "tab\tand\r\nline", "", None]


def test_token_counts_equal_the_library(texts):
    library = Tokenizer.from_file(WORD_PATH)
    all_texts = HARD + texts
    expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in all_texts]
    assert token_counts.RankMerger(WORD_PATH).counts(all_texts) == expected
    assert token_counts.RankMerger(WORD_PATH, cache_words=3).counts(all_texts) == expected


def test_long_words_equal_the_library_and_take_little_time():
    rng = np.random.default_rng(5)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(list(of), n))
    hard = ["a" * 777, "ab" * 500 + "a", "the" * 400, "aaab" * 300, "é" * 300, "日本" * 200, letters(2000), letters(2000, "aab"), letters(999, "eéтß"), "x" * 64, "x" * 65]
    library = Tokenizer.from_file(WORD_PATH)
    counts = lambda texts: [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    merger = token_counts.RankMerger(WORD_PATH)
    assert merger.counts(hard) == counts(hard)
    big = [letters(1_000_000), letters(300_000, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"), "a" * 200_000]
    began = time.perf_counter()
    found = merger.counts(big)
    assert time.perf_counter() - began < 60
    assert found == counts(big)


def test_count_tokens_rows(docs, no_docs, twice, texts):
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs, WORD_PATH, 2048).collect()}
    assert len(rows) == len(texts)
    assert all(rows[i]["n_bytes"] == len((t or "").encode()) for i, t in enumerate(texts))
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows.values())
    assert token_counts.count_tokens(no_docs, WORD_PATH, 2048).count() == 0
    assert token_counts.count_tokens(twice, WORD_PATH, 2048).count() == 2 * len(texts) + 2


def test_word_encoder_equals_the_library(texts):
    library = Tokenizer.from_file(BYTE_PATH)
    all_texts = HARD + texts
    found = packing.WordEncoder(BYTE_PATH).ids(all_texts)
    assert [f.tolist() for f in found] == [library.encode(t or "", add_special_tokens=False).ids for t in all_texts]


def check_packed(pieces, texts_by_id, capacity=1024):
    library = Tokenizer.from_file(BYTE_PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts_by_id)
    for i, text in texts_by_id.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        upto = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == upto and p["doc_tokens"] == len(ids) and p["length"] > 0
            piece = np.array(ids[upto : upto + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(piece.tobytes())
            upto += p["length"]
        assert upto == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    total = sum(p["length"] for p in pieces)
    return total / (capacity * len(by_sequence))


def test_pack_holds_every_id_once(docs, texts):
    pieces = packing.pack(docs, BYTE_PATH).collect()
    assert check_packed(pieces, dict(enumerate(texts))) > 0.97


def test_pack_edges(no_docs, twice, texts):
    assert packing.pack(no_docs, BYTE_PATH).count() == 0
    pieces = packing.pack(twice, BYTE_PATH).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 3) == 2 * next(p["doc_tokens"] for p in pieces if p["doc_id"] == 3)


@pytest.mark.parametrize("lengths", [[5], [1024, 1024], [600, 600, 600], [1] * 3000, [1000] * 10 + [100] * 3, []])
def test_pack_shard(lengths):
    sequences = packing.pack_shard(lengths, 1024, 1.0, 1 / 1024)
    seen = defaultdict(int)
    for s in sequences:
        assert sum(b - a for _, a, b in s) <= 1024
        for piece, a, b in s:
            seen[piece] += b - a
    assert [seen[i] for i in range(len(lengths))] == lengths
    assert len(sequences) == -(-sum(lengths) // 1024)


def test_pack_shard_looks_past_all_full_sequences():
    lengths = [800] + [300] * 300 + [200]
    sequences = packing.pack_shard(lengths, 1024, 1.0, 1 / 1024)
    assert [p for s in sequences for p in s if p[0] == 301] == [(301, 0, 200)]
    assert any({p[0] for p in s} >= {0, 301} for s in sequences)


def plain_packing(lengths, capacity):
    """Whole pieces by sequence: descending, each to the cheapest sequence with room, the first of equals."""
    room = [capacity] * -(-sum(lengths) // capacity)
    cost, out = [0.0] * len(room), {}
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        n = lengths[piece]
        able = [s for s in range(len(room)) if room[s] >= n]
        if able:
            s = min(able, key=lambda s: (cost[s], s))
            room[s] -= n
            cost[s] += n + n * n / 1024
            out[piece] = s
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pieces_go_to_the_lowest_cost_with_room(seed):
    rng = np.random.default_rng(seed)
    draw = [lambda: rng.integers(1, 1024, 300), lambda: np.minimum(rng.lognormal(5, 1.2, 300).astype(int) + 1, 1023), lambda: rng.choice([1, 300, 700, 1023], 300)]
    lengths = draw[seed % 3]().tolist()
    whole = {p: s for s, own in enumerate(packing.pack_shard(lengths, 1024, 1.0, 1 / 1024)) for p, lo, hi in own if hi - lo == lengths[p]}
    wanted = plain_packing(lengths, 1024)
    assert {p: whole[p] for p in wanted} == wanted


def test_repeated_rows_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 64)
    rows = spark.range(6000).selectExpr("cast(if(id % 2 = 0, null, 7) as long) doc_id", "'the same words again' text").repartition(3)
    pieces = packing.pack(rows, BYTE_PATH)
    n = [r["count"] for r in pieces.groupBy((F.col("sequence_id") / (1 << 33)).cast("long")).count().collect()]
    assert sum(n) >= 6000 and max(n) < 64 * 3
