"""Cost-balanced packing of tokenized documents into sequences of fixed length.

Each document becomes its token ids and an end id, cut into pieces of at most
one sequence.  A piece costs ``linear * n + quadratic * n * n`` (attention is
kept inside a piece).  Full pieces are sequences of their own.  The rest are
dealt into shards; within a shard, in descending order, each goes to the
sequence of lowest cost that has room.  What fits nowhere whole is cut over the
gaps, cheapest sequences first, so a shard leaves at most one sequence's worth
of padding.

The pieces are written to the shared folder with a number each, and that number
decides the shard: shards hold about ``SHARD_DOCS`` pieces whatever the size of
the corpus and however often a row or id repeats, and a lost executor changes
nothing.  Full pieces are a checksum and are not shuffled; only the ids of last
pieces travel, as two bytes each.

Defined cases: null and empty texts are one piece holding the end id alone;
repeated rows are packed as often as they occur; no input gives no pieces;
further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back_memory, stash, text_slices, worker_cache
from .token_counts import byte_characters

SHARD_DOCS = 1024  # pieces that are not full, one a document at most
#: A worker forgets the ids of words beyond so many entries.
CACHE_WORDS = 200_000

#: Fixed value: where byte-level vocabularies split text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids that the tokenizers library gives for a byte-level vocabulary, with the ids of words kept.

    Pre-tokens begin at a blank that stands between other characters, so the
    stretches between such blanks can be encoded alone, once each.  New
    stretches are encoded together by a faster implementation of the same
    merges; the library itself takes texts in which a blank touches white space
    or a special token's string occurs, and everything if the vocabulary's ids
    do not follow its merges.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes | None] = {}
        self.cache_words = cache_words
        self.fast = self._fast(path)
        if self.fast:
            self.ends = {c: self._array(self.fast.encode_ordinary(c)).tobytes() for c in ",.;:!?"}

    def _fast(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        vocab, step = spec["model"]["vocab"], spec["pre_tokenizer"]
        made = [vocab[a + b] for a, b in merges]
        plain = spec["normalizer"] is None and step == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not plain or made != sorted(made) or made[:1] < [256]:
            return None
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        return tiktoken.Encoding("words", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _array(self, ids: list[int]) -> np.ndarray:
        return np.array(ids, self.type)

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [self._array(e.ids).tobytes() for e in encoded]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Of words that all begin with their only blank: encoded as one text, then told apart by their bytes."""
        ids = self._array(self.fast.encode_ordinary("".join(words)))
        upto = np.cumsum(self.size[ids])
        ends = np.searchsorted(upto, np.cumsum([len(w.encode()) for w in words]), "right") * ids.itemsize
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        slow, fast, ended = [], [], []
        for w in words:
            if w == " " or w[1:2].isspace() or w[-1:].isspace() or w[0] != " " and w[0].isspace():
                self.known[w] = None
            elif not self.fast or w[0] != " " or any(s in w for s in self.special):
                slow.append(w)
            elif w[-1] in self.ends and w[1:-1].isalpha():
                ended.append(w)
                if w[:-1] not in self.known:
                    fast.append(w[:-1])
            else:
                fast.append(w)
        fast = list(dict.fromkeys(fast))
        self.known.update(zip(slow, self._encode(slow), strict=True))
        if fast:
            self.known.update(zip(fast, self._encode_words(fast), strict=True))
        self.known.update((w, self.known[w[:-1]] + self.ends[w[-1]]) for w in ended)

    def ids(self, texts: list) -> list[np.ndarray]:
        if len(self.known) > self.cache_words:
            self.known.clear()
        words = []
        for text in texts:
            first, *rest = (text or "").split(" ")
            words.append([first, *[" " + w for w in rest]] if text else [])
            if text and not first:
                words[-1][0] = " "  # a blank in front: the text is encoded whole
        self._learn([w for w in set().union(*words) if w not in self.known])
        out, get = [], self.known.__getitem__
        for text, own in zip(texts, words, strict=True):
            parts = list(map(get, own))
            joined = self._encode([text])[0] if None in parts else b"".join(parts)
            out.append(np.frombuffer(joined, self.type))
        return out


def pack_shard(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of ``(piece, from, to)``; every id of every piece in exactly one."""
    n_seq = -(-sum(lengths) // capacity)
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(n_seq)]
    room = [capacity] * n_seq
    # sequences by cost for each amount of room, and the least cost of each
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    heaps[capacity] = [(0.0, s) for s in range(n_seq)]
    least = np.full(capacity + 1, np.inf)
    least[capacity] = 0.0 if n_seq else np.inf
    left_over = []
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        n = lengths[piece]
        best = least[n:].min()
        if best == np.inf:
            left_over.append(piece)
            continue
        r = min((n + int(k) for k in np.flatnonzero(least[n:] == best)), key=lambda k: heaps[k][0][1])
        cost, s = heapq.heappop(heaps[r])
        least[r] = heaps[r][0][0] if heaps[r] else np.inf
        sequences[s].append((piece, 0, n))
        room[s] -= n
        if room[s]:
            heapq.heappush(heaps[room[s]], (cost + linear * n + quadratic * n * n, s))
            least[room[s]] = heaps[room[s]][0][0]
    gaps = [s for _, s in sorted(entry for heap in heaps for entry in heap)]
    at = 0
    for piece in left_over:
        done = 0
        while done < lengths[piece]:
            s = gaps[at]
            take = min(room[s], lengths[piece] - done)
            sequences[s].append((piece, done, done + take))
            room[s] -= take
            done += take
            at += room[s] == 0
    return sequences


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1.0 / 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``id_col`` and the columns of ``PIECES``.

    ``start`` counts the document's ids before the piece, ``offset`` the ids
    before it in its sequence; ``ids_crc32`` is over unsigned little-endian
    32-bit ids.  Sequences of one full piece have odd numbers, others even ones.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa

        encoder = worker_cache("encoder_" + path, lambda: WordEncoder(path))
        crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
        for batch in batches:
            names, texts = (batch.column(i).to_pylist() for i in range(2))
            for lo, hi in text_slices(texts):
                rows = []
                for name, ids in zip(names[lo:hi], encoder.ids(texts[lo:hi]), strict=True):
                    ids = np.append(ids, encoder.type(end_id))
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        full = len(piece) == capacity
                        rows.append((name, start, len(piece), len(ids), crc(piece) if full else None, None if full else piece.astype(encoder.type).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "start", "length", "doc_tokens", "crc", "ids"])
        give_back_memory()

    def place(table):
        import pyarrow as pa

        table = table.sort_by("row")
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        base, rows = col["shard"][0] << 32, []
        for sequence in pack_shard(col["length"], capacity, linear, quadratic):
            offset = 0
            for i, lo, hi in sequence:
                size = len(col["ids"][i]) // col["length"][i]
                ids = np.frombuffer(col["ids"][i], "<u2" if size == 2 else "<u4")[lo:hi]
                rows.append((col["id"][i], col["start"][i] + lo, hi - lo, zlib.crc32(ids.astype("<u4").tobytes()), col["doc_tokens"][i], 2 * base, offset))
                offset += hi - lo
            base += 1
        kinds = [table.schema.field("id").type, *[pa.int64()] * 6]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(cut, f"id {kind}, start long, length long, doc_tokens long, crc long, ids binary")
    pieces = stash(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full, part = pieces.where("crc IS NOT NULL"), pieces.where("crc IS NULL")
    shards = max(1, part.count() // SHARD_DOCS)
    whole = full.select("id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = part.drop("crc").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long"))
    packed = dealt.groupBy("shard").applyInArrow(place, f"id {kind}, {PIECES}")
    return packed.unionByName(whole).withColumnRenamed("id", id_col)
