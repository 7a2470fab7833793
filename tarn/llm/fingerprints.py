"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Each shingle (five words; a shorter text is one shingle) is hashed once.  The
upper bits of the hash name one of ``BINS`` bins, and each bin keeps its least
hash.  An empty bin probes the others in a hashed order of its own, which visits
every bin once, until it meets a filled one, and takes its value, so that equal
sets always borrow alike.  Of each value the lowest ``BITS`` bits are kept and
written as hexadecimal digits.

``likeness`` corrects the share of agreeing bins for chance agreement of
``BITS`` bits.  All of it is SQL expressions over the row itself.

Defined cases: null counts as empty; a text without words has the empty
fingerprint, likeness 1 to another such and 0 to all others; equal texts have
equal fingerprints; rows of one id are ordered by a hash of the text; null ids
stand where numbers below ``LEAST_ID`` would, at one that is hashed from the
text, so they spread; rows that repeat more than ``HOT_ROWS`` times are worked
off once and written as often as they occur; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .native import WORDS_SQL, let

SHINGLE = 5
BINS = 128
BITS = 8
#: Probes that are looked at first; the rest only where all of them are empty.
FIRST_PROBES = 8
#: Ids are dealt into buckets of so many consecutive values, and these into tasks by about so many.
BUCKET, BUCKETS_A_TASK = 512, 8
#: Rows of one id above this number are counted by text.
HOT_ROWS = 1000
LEAST_ID = -(2**62)
#: A chain of at most so many buckets is ordered in one task.
CHAIN_ROWS = 10_000

_BIN = f"cast(shiftright({{x}}, {64 - BINS.bit_length() + 1}) + {BINS // 2} as int)"


def shingles_sql(text: str) -> str:
    """Hashes of the distinct and repeated shingles of a text, in ascending order."""
    own = f"CASE WHEN size(h) = 0 THEN cast(array() as array<bigint>) WHEN size(h) < {SHINGLE} THEN array(xxhash64(h)) ELSE transform(sequence(1, size(h) - {SHINGLE - 1}), i -> xxhash64(slice(h, i, {SHINGLE}))) END"
    words = f"transform({WORDS_SQL.format(text=text)}, w -> xxhash64(w))"
    return f"sort_array({let('h', words, own)})"


def fingerprint_sql(text: str) -> str:
    """The fingerprint of a text as ``array<tinyint>``; empty for a text without words."""
    low = f"cast(cast({{x}} & {2**BITS - 1} as int) - 128 as tinyint)"
    minima = f"filter(s, (x, i) -> i = 0 OR {_BIN.format(x='x')} <> {_BIN.format(x='s[i - 1]')})"
    lookup = f"map_from_arrays(transform(m, x -> {_BIN.format(x='x')}), transform(m, x -> {low.format(x='x')}))"
    slots = let("filled", lookup, f"transform(sequence(0, {BINS - 1}), b -> try_element_at(filled, b))")
    # an odd step visits all bins, whose number is a power of two
    probe = f"get(slots, cast(pmod(at + t * step, {BINS}) as int))"
    met = lambda lo, hi: f"get(filter(transform(sequence({lo}, {hi}), t -> {probe}), y -> y IS NOT NULL), 0)"
    walk = let("at", f"pmod(h, {BINS})", let("step", f"2 * pmod(shiftright(h, 32), {BINS // 2}) + 1", f"coalesce({met(0, FIRST_PROBES - 1)}, {met(FIRST_PROBES, BINS - 1)})"))
    dense = let("slots", slots, f"transform(slots, (v, b) -> IF(v IS NULL, {let('h', 'xxhash64(b)', walk)}, v))")
    out = f"CASE WHEN size(m) = 0 THEN cast(array() as array<tinyint>) WHEN size(m) = {BINS} THEN transform(m, x -> {low.format(x='x')}) ELSE {dense} END"
    return let("s", shingles_sql(text), let("m", minima, out))


def packed_sql(fingerprint: str) -> str:
    """Two lower-case hexadecimal digits for each bin."""
    return f"lower(array_join(transform({fingerprint}, v -> lpad(hex(v + 128), 2, '0')), ''))"


def likeness_sql(a: str, b: str) -> str:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints."""
    chance = 1 / 2**BITS
    agree = f"size(filter(zip_with({a}, {b}, (p, q) -> p = q), z -> z)) / {BINS}D"
    return f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN IF(size({a}) = size({b}), 1D, 0D) ELSE greatest(({agree} - {chance}D) / {1 - chance}D, 0D) END"


def _next_below(groups: DataFrame) -> DataFrame:
    """``bucket, next_bucket``: the nearest smaller one that occurs; of the least, the largest."""
    n, top = groups.agg(F.count("*"), F.max("bucket")).first()
    if n <= CHAIN_ROWS:
        below = F.lead("bucket").over(Window.orderBy(F.desc("bucket")))
        return groups.select("bucket", F.coalesce(below, F.lit(top).cast("long")).alias("next_bucket"))
    own = groups.withColumn("over", F.expr(f"bucket div {BUCKET} - IF(bucket < 0, 1, 0)"))
    tops = own.groupBy("over").agg(F.max("bucket").alias("top"))
    chain = _next_below(stash(tops.select(F.col("over").alias("bucket")), "chain"))
    entry = chain.join(tops.select(F.col("over").alias("next_bucket"), "top"), "next_bucket").select(F.col("bucket").alias("over"), "top")
    w = Window.partitionBy("over").orderBy(F.desc("bucket"))
    return own.withColumn("below", F.lead("bucket").over(w)).join(entry, "over").select("bucket", F.coalesce("below", "top").alias("next_bucket"))


def with_next(rows: DataFrame, columns: list[str], derived: dict[str, str] | None = None, nulls: bool = True, repeats: bool = True) -> DataFrame:
    """``rows`` (with ``id`` and ``text``) and ``next``, a struct of ``columns`` of the next row by descending id.

    ``derived`` columns (SQL by name) are added to the rows where they are dealt
    out, so that the added rows alone are computed twice.  Without null ids
    (``nulls``) and ids in several rows (``repeats``), texts are read only once.

    Rows are dealt by buckets of ids, so every task gets a bounded number of
    ids; the row that follows a bucket's last one is added to the bucket.
    """
    place = f"coalesce(cast(id as long), {LEAST_ID}L - shiftrightunsigned(xxhash64(text), 3))" if nulls else "cast(id as long)"
    rows = rows.withColumn("at", F.expr(place)).withColumn("bucket", F.expr(f"CASE WHEN at >= 0 THEN at div {BUCKET} ELSE -1 - (-1 - at) div {BUCKET} END"))
    heads = stash(rows.groupBy("bucket").agg(F.max("at").alias("head")), "heads")
    follow = _next_below(heads.select("bucket")).join(heads.withColumnRenamed("bucket", "next_bucket"), "next_bucket")
    follow = stash(follow.select(F.col("bucket").alias("into"), F.col("head").alias("at")), "follow")
    # Spark broadcasts ``follow`` (one row a bucket) if its written size allows, and sorts and merges else.
    # Of rows with the same place the one of least hash comes first, so only that is added.
    order = "struct(xxhash64(text), text)"
    heads_only = rows.join(follow, "at")
    if repeats:
        kept = heads_only.groupBy("at", "into").agg(F.expr(f"min_by(struct({', '.join('`' + c + '`' for c in rows.columns if c not in ('at', 'bucket'))}), {order})").alias("r"))
        heads_only = kept.select("at", "into", "r.*").withColumn("bucket", F.col("into"))
    guests = heads_only.withColumn("bucket", F.col("into")).drop("into").withColumn("guest", F.lit(True))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    both = both.withColumns({name: F.expr(text) for name, text in (derived or {}).items()})
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), heads.count() // BUCKETS_A_TASK)
    w = Window.partitionBy("bucket").orderBy("guest", F.desc("at"), F.expr("xxhash64(text)"), "text")
    dealt = both.repartition(tasks, "bucket")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(w)).where(~F.col("guest")).drop("guest", "at", "bucket")


def _several(rows: DataFrame) -> DataFrame:
    """``id, n`` of null ids and of ids in several rows."""
    return stash(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL"), "several")


def _once(rows: DataFrame, several: DataFrame) -> DataFrame:
    """``rows`` with ``copies``: rows that repeat more than ``HOT_ROWS`` times stand once."""
    often = several.where(f"n > {HOT_ROWS}").select("id")
    if often.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long"))
    # ids of more than HOT_ROWS rows are few, and so are the texts of more than HOT_ROWS of those; joins of few rows are broadcast
    often = often.withColumnRenamed("id", "often")
    held = rows.withColumn("sha", F.sha2("text", 256))
    hot = held.join(often, F.col("id").eqNullSafe(F.col("often")), "left_semi").groupBy("id", "sha").agg(F.count("*").alias("copies")).where(f"copies > {HOT_ROWS}")
    hot = stash(hot.select(F.col("id").alias("hot_id"), F.col("sha").alias("hot_sha"), "copies"), "hot")
    same = F.col("id").eqNullSafe(F.col("hot_id")) & (F.col("sha") == F.col("hot_sha"))
    first = held.join(hot, same).groupBy("id", "sha", "copies").agg(F.first("text").alias("text"))
    rest = held.join(hot, same, "left_anti").select("id", "text", F.lit(1).cast("long").alias("copies"))
    return rest.unionByName(first.select("id", "text", "copies"))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to that and to the next document."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    several = _several(rows)
    nulls, repeats = not several.where("id IS NULL").isEmpty(), not several.where("n > 1").isEmpty()
    rows = with_next(_once(rows, several), ["text", "fp"], {"fp": fingerprint_sql("text")}, nulls, repeats).withColumn("n_chars", F.length("text").cast("long"))
    # of a row that stands for several, all but the last are followed by a row like themselves
    follows = F.expr("IF(copies = 1, array(struct(1L AS times, next AS next)), array(struct(1L AS times, next AS next), struct(copies - 1 AS times, named_struct('text', text, 'fp', fp) AS next)))")
    rows = rows.withColumn("f", F.explode(follows)).select("id", "text", "fp", "n_chars", F.col("f.times").alias("times"), F.col("f.next").alias("next"))
    half = "cast(n_chars div 2 as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(next.text, 1, {half}))"))
    rows = rows.select("id", "n_chars", "times", F.sha2("edited", 256).alias("edited_sha256"), "fp", F.expr(fingerprint_sql("edited")).alias("edited_fp"), F.col("next.fp").alias("next_fp"))
    out = rows.select(
        "times",
        F.col("id").alias("result_id"),
        "n_chars",
        "edited_sha256",
        F.expr(packed_sql("fp")).alias("fingerprint"),
        F.expr(packed_sql("edited_fp")).alias("edited_fingerprint"),
        F.expr(likeness_sql("fp", "edited_fp")).alias("near_edited"),
        F.expr(likeness_sql("fp", "next_fp")).alias("near_next"),
    )
    return out.withColumn("times", F.explode(F.expr("sequence(1L, times)"))).drop("times").withColumnRenamed("result_id", id_col)
