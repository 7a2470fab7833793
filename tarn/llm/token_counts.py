"""Token counts by rank-synchronous merging of ragged numpy arrays.

``count_tokens`` gives, for each text, the number of tokens of a word-level
byte pair vocabulary (a ``.json`` of the tokenizers library with NFC, white
space, lower case, split and byte level steps).  Pre-tokens of a batch are held
as one ragged array of symbols.  In each round every sequence finds the lowest
rank among its adjacent pairs and merges all places of that pair at once; the
symbols that are left when no pair has a rank are its tokens.  Long pre-tokens
(above ``LONG_BYTES``) are held as one linked array instead, whose ranks are kept
from round to round: each round takes the lowest rank of all of them, which is
then the lowest of each sequence that has it, and ranks anew only the neighbours
of merged places.  So a word of any length costs rounds by the ranks it meets
and work by its merges.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings
inside a text count as one token each, as is the library's default; equal rows
give equal counts; an empty table gives an empty table; further columns of the
input are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_slices, worker_cache

#: A worker forgets its counts of words beyond so many entries.
CACHE_WORDS = 800_000
#: Pre-tokens of more bytes keep their ranks between rounds.
LONG_BYTES = 64

#: Marks that are a pre-token and a token of their own behind letters.
PLAIN_ENDS = {",", ".", ";", ":", "!", "?"}


class RankMerger:
    """Counts tokens of a vocabulary file; words seen before are looked up."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.none = len(pairs)
        char_of = byte_characters()
        self.inner = np.array([vocab.get(char_of[b], -1) for b in range(256)], np.int64)
        self.final = np.array([vocab.get(char_of[b] + suffix, -1) for b in range(256)], np.int64)
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.cache_words = cache_words

    def counts(self, texts: list) -> list[int]:
        """Tokens of each text."""
        if len(self.known) > self.cache_words:
            self.known.clear()
            self.pieces.clear()
        # No pre-token crosses a blank or a line feed, so words between them stand alone.
        words = [t.replace("\n", " ").split(" ") if t else () for t in texts]
        fresh = [w for w in set().union(*words) if w not in self.known]
        self._learn(fresh)
        get = self.known.__getitem__
        return [sum(map(get, w)) for w in words]

    def _learn(self, words: list[str]) -> None:
        """Adds words to ``known``; each is a sum over its pre-tokens, which are shared between words."""
        totals, parts_of = [0] * len(words), []
        for i, word in enumerate(words):
            low = lowered(word)
            if low.isalpha():
                parts_of.append((low,))
            elif low[-1:] in PLAIN_ENDS and low[:-1].isalpha():
                totals[i] = 1
                parts_of.append((low[:-1],))
            else:
                pieces = (word,)
                if self.special and "<" in word:
                    totals[i] = len(self.special.findall(word))
                    pieces = self.special.split(word)
                parts_of.append([token for piece in pieces for token in self.split(lowered(piece))])
        tokens = [t for t in set().union(*parts_of) if t not in self.pieces]
        self.pieces.update(zip(tokens, self.merged_lengths([t.encode() for t in tokens]).tolist(), strict=True))
        get = self.pieces.__getitem__
        self.known.update((word, n + sum(map(get, parts))) for word, n, parts in zip(words, totals, parts_of, strict=True))

    def merged_lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols that each pre-token is merged to."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        if lengths.max(initial=0) > LONG_BYTES:
            out = np.zeros(len(tokens), np.int64)
            for long in (False, True):
                at = np.flatnonzero((lengths > LONG_BYTES) == long)
                own = [tokens[i] for i in at.tolist()]
                out[at] = self._long_lengths(own) if long else self.merged_lengths(own)
            return out
        symbols, owner = self._symbols(tokens, lengths)
        out = np.zeros(len(tokens), np.int64)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(owner)])
            rank = np.full(len(symbols), self.none)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
            best = np.minimum.reduceat(rank, first)
            going = best < self.none
            np.add.at(out, owner[first[~going]], count[~going])
            stay = np.repeat(going, count)
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            if not len(symbols):
                break
            chosen = rank == np.repeat(best[going], count[going])
            # Of overlapping places (a a a) every other one is merged, from the left.
            at = np.flatnonzero(chosen)
            run = np.r_[True, np.diff(at) != 1]
            since = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[since % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def _symbols(self, tokens: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of all pre-tokens, and the pre-token of each."""
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends[lengths > 0]] = self.final[raw[ends[lengths > 0]]]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        known = symbols >= 0  # symbols outside the vocabulary vanish, as in the library without an unknown token
        symbols, owner = symbols[known], owner[known]
        return symbols, owner

    def _long_lengths(self, tokens: list[bytes]) -> np.ndarray:
        """As ``merged_lengths``, by linked places: ``after`` and ``prior`` skip what is merged away."""
        symbols, owner = self._symbols(tokens, np.fromiter(map(len, tokens), np.int64, len(tokens)))
        n = len(symbols)
        after, prior = np.arange(1, n + 1), np.arange(-1, n - 1)
        breaks = np.flatnonzero(owner[1:] != owner[:-1])
        after[breaks], prior[breaks + 1] = -1, -1
        after[n - 1 :], alive = -1, np.ones(n, bool)
        rank = np.full(n, self.none)
        waiting: dict[int, list[np.ndarray]] = {}
        turns: list[int] = []

        def note(places: np.ndarray) -> None:
            """Ranks the pairs that begin at ``places``; ranked ones wait for their turn."""
            pair = after[places] >= 0
            rank[places[~pair]] = self.none
            places = places[pair]
            found = self._rank(symbols[places], symbols[after[places]])
            rank[places] = found
            places, found = places[found < self.none], found[found < self.none]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for own, r in zip(np.split(places, cuts), found[np.r_[0, cuts]].tolist() if len(found) else (), strict=False):
                if r not in waiting:
                    heapq.heappush(turns, r)
                waiting.setdefault(r, []).append(own)

        note(np.arange(n))
        while turns:
            r = heapq.heappop(turns)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # of overlapping places (a a a) every other one is merged, from the left
            run = np.r_[True, after[at[:-1]] != at[1:]]
            since = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[since % 2 == 0]
            gone = after[at]
            symbols[at], alive[gone] = self.made[r], False
            behind = after[gone]
            after[at] = behind
            prior[behind[behind >= 0]] = at[behind >= 0]
            before = prior[at]
            note(np.unique(np.concatenate([at, before[before >= 0]])))
        return np.bincount(owner[alive], minlength=len(tokens))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], self.none)


def lowered(text: str) -> str:
    """NFC and lower case, taken for each character alone (no final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row; no shuffle."""

    def run(batches):
        import pyarrow as pa

        merger = worker_cache("merger_" + path, lambda: RankMerger(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [c for lo, hi in text_slices(texts) for c in merger.counts(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
