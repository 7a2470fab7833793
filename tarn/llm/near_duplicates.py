"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles of five words, as 64-bit hashes.
``sketch`` fills ``COORDINATES`` coordinates in rounds: in each round every
element is placed in one hashed bin, and bins that were empty take the least
hash placed there; after as many rounds as there are coordinates, one bin a
round takes the least hash of all elements, so every coordinate fills whatever
the set's size.  Two sets agree in a coordinate with the probability of their
similarity, with concentration as for independent hashes.

``BANDS`` bands of ``ROWS`` coordinates make a pair of similarity 0.85 share a
band but with probability 2.4e-7.  Equal sets are one node from the start.  In
each bucket (nodes that share a band) all are first compared with one pivot;
where nodes of different components remain, further pivots are tried in large
buckets, and at last the pairs that are still in different components are
compared: all of small buckets, and of large ones those that pass an exact
prefix, length and positional filter on their full sets.  Pairs inside a component need no comparison, so groups
of copies cost rows in proportion to their size, and no link is dropped by a
cap.  Comparisons are on the full sets.  Components come from alternating large
and small stars over tables in the shared folder.

Defined cases: null texts and texts without words have an empty set and are
linked with nothing, not even each other; fewer words than a shingle are one
shingle; equal texts are linked; ids are expected to be unique (repeated rows
are linked with each other, and each is ``kept`` if its id is the least); a null
id is its own component; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back_memory, stash, text_slices

SHINGLE = 5
ROWS, BANDS = 5, 26
COORDINATES = ROWS * BANDS
#: Buckets of more nodes than this try further pivots before the remaining pairs are compared.
LARGE_BUCKET = 32
PIVOT_ROUNDS = 2
#: Texts of at most so many candidate nodes are found by a broadcast of their ids.
BROADCAST_NODES = 2_000_000
#: Pairs of one node that meet one copy of its set.
PAIRS_A_COPY = 4096
#: Tables of one row a bucket are broadcast up to so many rows; the members of a larger number of buckets meet them by a
#: join that the engine splits where a bucket holds much.
BROADCAST_BUCKETS = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64, 256, _U, endpoint=False)
_PLACE = _rng.integers(1, 2**63, SHINGLE, _U) * _U(2) + _U(1)
_SEEDS = _rng.integers(1, 2**63, 2 * COORDINATES + 2, _U)
_ROW = _rng.integers(1, 2**63, ROWS, _U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    """``base ** 0 .. n - 1`` modulo 2**64."""
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
    return out[:n]


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Of each text the ascending distinct hashes of its shingles."""
    raw = [(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[buf]
    before = np.r_[True, space[:-1]]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    # a word's hash is a polynomial of its bytes, taken from running sums
    running = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[buf] * _powers(len(buf), _BASE), dtype=_U)])
    words = (running[end] - running[start]) * _powers(len(buf), pow(_BASE, -1, 1 << 64))[start]
    words = _mix(words + (end - start).astype(_U))
    stops = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(start, stops)
    n = len(words) - SHINGLE + 1
    rolled = np.zeros(max(n, 0), _U)
    for j in range(SHINGLE):
        rolled += words[j : j + len(rolled)] * _PLACE[j]
    rolled = _mix(rolled)
    out, lo = [], 0
    for hi in upto.tolist():
        if hi - lo >= SHINGLE:
            out.append(np.unique(rolled[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            short = (words[lo:hi] * _PLACE[: hi - lo]).sum(dtype=_U) + _U(hi - lo)
            out.append(_mix(np.array([short], _U)))
        else:
            out.append(np.zeros(0, _U))
        lo = hi
    return out


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of ``t`` coordinates for each set; rows of empty sets stay 0."""
    out = np.zeros((len(sets), t), _U)
    empty = np.ones((len(sets), t), bool)
    size = np.array([len(s) for s in sets], np.int64)
    empty[size == 0] = False
    elements = np.concatenate(sets) if sets else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(sets)), size)
    for turn in range(2 * t):
        open_ = empty.any(1)
        if not open_.any():
            break
        stay = open_[owner]
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
        x = _mix(elements ^ _SEEDS[turn])
        bins = ((x >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if turn < t else np.full(len(x), turn - t)
        least = np.full(len(sets) * t, 2**64 - 1, _U)
        placed = np.zeros(len(sets) * t, bool)
        at = owner * t + bins
        np.minimum.at(least, at, x)
        placed[at] = True
        fill = placed.reshape(out.shape) & empty
        out[fill] = least.reshape(out.shape)[fill]
        empty &= ~fill
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    rows = sketches.reshape(len(sketches), BANDS, ROWS)
    key = np.zeros((len(sketches), BANDS), _U)
    for j in range(ROWS):
        key += rows[:, :, j] * _ROW[j]
    return _mix(key + np.arange(1, BANDS + 1, dtype=_U) * _U(_BASE)).view(np.int64)


def _set_key(own: np.ndarray) -> bytes:
    return np.array([_mix(own ^ s).sum(dtype=_U) for s in _SEEDS[-2:]], _U).tobytes()


def _sketched(docs: DataFrame) -> DataFrame:
    """``id, n_shingles, key, bands`` of each row of ``id, text``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in text_slices(texts, 500_000):
                sets = shingle_sets(texts[lo:hi])
                bands = band_keys(sketch(sets)).tolist()
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([b if len(s) else None for b, s in zip(bands, sets, strict=True)], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "key", "bands"])
        give_back_memory()

    return docs.mapInArrow(run, "id long, n_shingles long, key binary, bands array<long>")


def _full_sets(docs: DataFrame) -> DataFrame:
    """``node, hashes`` (the set's hashes, eight bytes each)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in text_slices(texts, 500_000):
                hashes = pa.array([s.tobytes() for s in shingle_sets(texts[lo:hi])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), hashes], ["node", "hashes"])
        give_back_memory()

    return docs.mapInArrow(run, "node long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` with ``100 * common >= percent * union`` on their full sets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(p, _U), np.frombuffer(q, _U)
                ok = 100 * min(len(x), len(y)) >= percent * max(len(x), len(y))
                if ok:
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    ok = 100 * common >= percent * (len(both) - common)
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back_memory()

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    # a node with many partners (the pivot of a large family) has a copy of its set for each PAIRS_A_COPY of them
    fans = pairs.groupBy("a").agg(F.expr(f"count(*) div {PAIRS_A_COPY} + 1").alias("fan"))
    left = left.join(fans, "a").withColumn("copy", F.explode(F.expr("sequence(0L, fan - 1)"))).drop("fan")
    pairs = pairs.join(fans, "a").withColumn("copy", F.expr("pmod(xxhash64(b), fan)")).drop("fan")
    # only lengths that can reach the threshold meet
    long_enough = (F.length("of_a") * 100 >= F.length("of_b") * percent) & (F.length("of_b") * 100 >= F.length("of_a") * percent)
    met = pairs.join(right, "b").join(left, ["a", "copy"]).where(long_enough).select("a", "b", "of_a", "of_b")
    return met.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``a, b`` links that is not its component's least (which is ``root``)."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    told = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stash(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == told or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told = now


def _cross_pairs(active: DataFrame) -> DataFrame:
    """Pairs of a bucket's nodes that are in different components."""
    a = active.select("band", F.col("node").alias("a"), F.col("root").alias("root_a"))
    b = active.select("band", F.col("node").alias("b"), F.col("root").alias("root_b"))
    return a.join(b, "band").where("a < b AND root_a <> root_b").select("a", "b").distinct()


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_BUCKETS else table


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``nodes`` (``node, root``) of different components that can reach the threshold.

    Shingles are ordered by how many of the nodes hold them, rare ones first.
    If a pair reaches the threshold, then one of the first ``n - need + 1``
    shingles of the smaller set, ``need`` being the overlap that two sets of its
    size need, is among the first of the larger, and the rest behind it suffices
    for the overlap.  So no pair is lost, and texts of one origin that each have
    changes enough of their own do not meet.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = [np.frombuffer(h, np.int64) for h in batch.column(2).to_pylist()]
            size = np.array([len(h) for h in own], np.int64)
            for lo in range(0, len(own), 256):
                part = size[lo : lo + 256]
                node, root = (np.repeat(batch.column(k).to_numpy()[lo : lo + 256], part) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(np.repeat(part, part)), pa.array(np.concatenate(own[lo : lo + 256]))], ["node", "root", "n", "hash"])

    held = stash(sets.join(nodes, "node").select("node", "root", "hashes").mapInArrow(run, "node long, root long, n long, hash long"), "held")
    common = held.groupBy("hash").agg(F.count("*").alias("holders"))
    order = Window.partitionBy("node").orderBy("holders", "hash")
    placed = held.join(common, "hash").withColumn("place", F.row_number().over(order))
    placed = stash(placed.where(f"place <= n - ({percent} * n + 99) div 100 + 1").drop("holders"), "placed")
    few = placed.where(f"place <= n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1").alias("x")
    need = f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}"
    able = f"""x.hash = y.hash AND x.root <> y.root AND (x.n < y.n OR x.n = y.n AND x.node < y.node) AND 100 * x.n >= {percent} * y.n
        AND 1 + least(x.n - x.place, y.n - y.place) >= {need}"""
    met = few.join(placed.alias("y"), F.expr(able))
    return met.select(F.expr("least(x.node, y.node) AS a"), F.expr("greatest(x.node, y.node) AS b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for each row."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = stash(_sketched(texts), "sketched")
    known = rows.where("key IS NOT NULL AND id IS NOT NULL")
    classes = stash(known.groupBy("key").agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
    members = stash(banded.join(_few(stash(buckets, "buckets")), "band"), "members")

    candidates = members.select(F.col("node").alias("id")).distinct()
    if candidates.count() <= BROADCAST_NODES:
        candidates = F.broadcast(candidates)
    sets = stash(_full_sets(texts.join(candidates, "id", "left_semi")).dropDuplicates(["node", "hashes"]), "sets")

    pairs = stash(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stash(_verified(pairs, sets, percent), "links")
    tested = pairs
    roots = components(links)
    for turn in range(PIVOT_ROUNDS + 1):
        rooted = members.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min(F.struct(F.xxhash64(F.lit(turn), "node"), "node", "root")).alias("p")).where("least <> most")
        mixed = stash(mixed.select("band", F.col("p.node").alias("pivot"), F.col("p.root").alias("pivot_root")), "mixed")
        active = rooted.join(_few(mixed), "band")
        if turn < PIVOT_ROUNDS:
            ahead = active.where(f"size > {LARGE_BUCKET} AND root <> pivot_root").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        else:
            crowded = active.where(f"size > {LARGE_BUCKET}").select("node", "root").distinct()
            ahead = _cross_pairs(active.where(f"size <= {LARGE_BUCKET}")).unionByName(_prefix_pairs(crowded, sets, percent)).distinct()
        pairs = stash(ahead.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        found = stash(_verified(pairs, sets, percent), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
    linked = known.join(classes.select("key", "node"), "key").join(roots, "node", "left").select("id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    # rows without a set or an id join nothing, so that they gather in no task
    alone = rows.where("key IS NULL OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linked.unionByName(alone).withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
