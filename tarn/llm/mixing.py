"""Mixing sources to target weights by Pareto order sampling.

Sizes are words.  Each source has a target in words.  ``rate = target / size of
the source`` says how often its documents are taken: ``floor(rate)`` whole
copies of each are certain, and a sample takes the rest.  The sample is in
Pareto order: documents are ranked by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a hash of id and text, and taken from
the lowest rank until the words are reached.  Inclusion probabilities ``p`` are
unequal: in proportion to ``importance``, by default the logarithm of the size
(``log_size``), so that longer documents are likelier to have a further copy.
Behind the point where the words are reached, documents that still fit the gap
are taken from a short pool, so that the taken words end close to the target.

Nothing is sorted or gathered by source: the rank where the words are reached
is found by histograms of at most ``BINS`` bins a source, refined until the bin
holds few documents, so a source may hold any part of the rows.  Only the plan
of the mix (a few numbers a source) is held by the driver.  Rows that are alike in
id and text follow each other in rank, told apart by their number in the table
written first, so a pool is short however often a row repeats; which of them
are taken changes nothing in the result.  Columns to carry stand in that table
beside the sizes, so that decisions meet their rows without a join of all rows:
only those of the pools are joined, by their number, and no text is shuffled but theirs.

Defined cases: null text has size 0 and is never taken; a null source is a
source of its own, ordered last; repeated rows are counted each, and null ids
are told apart by their texts and carried columns; an importance that is null, NaN, infinite or not positive counts as 1; an empty
table gives an empty table; further columns are ignored unless they are carried,
and carried columns named like a result give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Fixed value: what is a word.
WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
#: Bins of all sources together in one pass; more sources have coarser bins and more passes.
MOST_BINS = 1_000_000
#: Bits of a rank that come from the random odds, and below them those that tell equal rows apart.
ODDS_BITS, ROW_BITS = 40, 22
RANK_BITS = ODDS_BITS + ROW_BITS
#: A bin is refined while it holds more documents; the pool behind it is as large.
POOL = 256
MAX_COPIES = 3.0
#: Plans of more sources than this are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def targets(sizes: dict, weights: list[float], max_copies: float = MAX_COPIES) -> dict:
    """Words to take of each source.

    Sources, null last, weigh ``weights`` in turn and share the sum of all
    sizes.  A share above ``max_copies`` times its source's size stops there;
    the excess is shared again by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        per = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * per > max_copies * sizes[s]]
        if not above:
            out.update((s, weight[s] * per) for s in open_)
            break
        for s in above:
            out[s] = max_copies * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fill_gap(sizes: list[int], gap: int) -> list[bool]:
    """Which of the ranked sizes to take: each that still fits, then the one that ends nearest."""
    taken = [False] * len(sizes)
    for i, size in enumerate(sizes):
        if 0 < size <= gap:
            taken[i], gap = True, gap - size
    rest = [(abs(gap - size), i) for i, size in enumerate(sizes) if size and not taken[i]]
    if rest and min(rest)[0] < gap:
        taken[min(rest)[1]] = True
    return taken


def log_size(size: Column) -> Column:
    """The importance of a document by its words: 1 for none, 7 for a thousand."""
    return F.log1p(size.cast("double")) + 1


def mix(docs: DataFrame, weights: list[float], seed: int = 17, importance: str | Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``id_col, size, source_size, target, taken`` and the columns of ``carry`` for each row.

    ``importance`` is a column of positive factors on the inclusion
    probabilities within a source; without it ``log_size`` of the size is taken.
    """
    spark = docs.sparkSession
    results = {id_col.lower(), "size", "source_size", "target", "taken"}
    kept = [c for c in carry or [] if c.lower() not in results]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    factor = log_size(F.col("size")) if importance is None else F.col("factor").cast("double")
    given = F.lit(None) if importance is None else F.col(importance) if isinstance(importance, str) else importance
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), id_col, text_col, *[c for c in kept if c != text_col]).alias("draw"), given.alias("factor"), *([F.struct(*kept).alias("carried")] if kept else []))
    rows = rows.withColumn("factor", F.when((factor > 0) & (factor < float("inf")), factor).otherwise(1.0))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "mix")
    named = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    found = named.groupBy("source_key", "source").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("factor")).alias("mass")).collect()
    sizes = {r.source: r.size for r in found}
    target = targets(sizes, weights)
    plan, gaps = {}, {}
    for r in found:
        want = min(round(target[r.source]), int(MAX_COPIES) * r.size)
        whole = min(int(want // r.size), int(MAX_COPIES)) if r.size else 0
        key = "" if r.source is None else "s" + r.source
        plan[key] = (key, r.size, float(target[r.source]), whole, (want - whole * r.size) / r.size if r.size else 0.0, r.mass / r.size if r.size else 1.0)
        gaps[key] = want - whole * r.size

    def joined(df, entries, columns):
        small = spark.createDataFrame(entries, columns)
        return df.join(F.broadcast(small) if len(entries) <= BROADCAST_SOURCES else small, "source_key")

    planned = joined(named, list(plan.values()), "source_key string, source_size long, target double, whole long, part double, mean double") if plan else named.selectExpr("*", "0L source_size", "0D target", "0L whole", "0D part", "1D mean")
    u = (F.shiftrightunsigned("draw", 12).cast("double") + 0.5) / float(1 << 52)
    p = F.least(F.greatest(F.col("part") * F.col("factor") / F.col("mean"), F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = (u / (1 - u)) / (p / (1 - p))
    # odds / (1 + odds) keeps the order and lies between 0 and 1
    drawn = F.least(F.floor(odds / (1 + odds) * float(1 << ODDS_BITS)).cast("long"), F.lit((1 << ODDS_BITS) - 1))
    ranked = planned.withColumn("rank", F.shiftleft(drawn, ROW_BITS) + F.shiftrightunsigned(F.xxhash64("row"), 64 - ROW_BITS))

    # [lo, hi) is where the words are reached; gap is what is missing at lo
    state = {k: [0, 1 << RANK_BITS, g] for k, g in gaps.items() if g > 0}
    pool_end, open_ = {}, dict(state)
    while open_:
        n_bins = max(16, min(BINS, MOST_BINS // len(open_)))
        entries = [(k, lo, hi, -(-(hi - lo) // n_bins)) for k, (lo, hi, _) in open_.items()]
        inside = joined(ranked.select("source_key", "rank", "size"), entries, "source_key string, lo long, hi long, width long").where("rank >= lo and rank < hi")
        bins = {}
        for b in inside.groupBy("source_key", F.expr("(rank - lo) div width").alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).toLocalIterator():
            bins.setdefault(b.source_key, []).append((b.bin, b.size, b.n))
        for key, lo, hi, width in entries:
            gap, own = open_[key][2], sorted(bins.get(key, []))
            at = next((i for i, total in enumerate(_running(own)) if total >= gap), None)
            if at is None:
                # rounding: all of them are taken
                state[key] = [hi, hi, 0]
                pool_end[key] = hi
                del open_[key]
                continue
            before = sum(x[1] for x in own[:at])
            b, _, n = own[at]
            start = lo + b * width
            if n > POOL and width > 1:
                state[key] = open_[key] = [start, min(hi, start + width), gap - before]
                continue
            state[key] = [start, hi, gap - before]
            held, end = 0, start + width
            for b2, _, n2 in own[at:]:
                held += n2
                end = lo + (b2 + 1) * width
                if held >= POOL:
                    break
            pool_end[key] = end
            del open_[key]
    cut = [(k, *((state[k][0], pool_end[k], state[k][2]) if k in state else (0, 0, 0))) for k in plan]
    marked = joined(ranked, cut, "source_key string, lo long, pool_end long, gap long") if cut else ranked.selectExpr("*", "0L lo", "0L pool_end", "0L gap")

    def choose(pdf):
        pdf = pdf.sort_values(["rank", "id", "size"], kind="stable")
        taken = fill_gap(pdf["size"].tolist(), int(pdf["gap"].iloc[0]))
        return pdf[["row"]].assign(extra=[int(t) for t in taken])

    columns = ["id", "size", "source_size", "target", "whole", "extra", *(["carried"] if kept else [])]
    pool = marked.where("rank >= lo and rank < pool_end")
    chosen = pool.select("source_key", "row", "id", "size", "rank", "gap").groupBy("source_key").applyInPandas(choose, "row long, extra long")
    sure = marked.where("not (rank >= lo and rank < pool_end)").withColumn("extra", (F.col("rank") < F.col("lo")).cast("long"))
    both = sure.select(columns).unionByName(pool.join(chosen, "row").select(columns))
    taken = (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken")
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", taken, *[F.col("carried")[c].alias(c) for c in kept])


def _running(bins):
    total = 0
    for _, size, _ in bins:
        total += size
        yield total
