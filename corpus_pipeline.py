"""A corpus pipeline over ``documents``: language, near-duplicates, personal data, mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``; further columns of their input are
left out.  No stage looks at anything but its own input.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from tarn.llm import language_id, mixing, near_duplicates, packing, pii
from tarn.llm.common import shared_dir, stash
from tarn.llm.queries import PSEUDONYM_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents are near-duplicates from this similarity of their shingles (in percent); op6_near_duplicates has a value of its own.
NEAR_PERCENT = 80
#: Decisions on more rows than this are joined by a shuffle, not a broadcast.
BROADCAST_ROWS = 2_000_000


def _small(df):
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def language(spark, docs, sf_dir):
    """Rejects documents in no language (null, empty, or without a letter); fills missing languages (``und`` if there is nothing to learn from)."""
    docs = docs.select(COLUMNS)
    found = language_id.identify(docs, language_id.fit(docs)).where(F.col("text").rlike(r"\p{L}"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """Keeps the document of least id of each near-duplicate group; rows of one id count as one document."""
    docs = docs.select(COLUMNS)
    groups = stash(near_duplicates.near_duplicates(docs, percent=NEAR_PERCENT).select("doc_id", "kept"), "groups")
    dropped = groups.where("NOT kept").select("doc_id").distinct()
    left = docs.join(_small(dropped), "doc_id", "left_anti")
    if not groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        left = left.where("doc_id IS NULL").unionByName(left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    return left.select(COLUMNS)


def pseudonyms(spark, docs, sf_dir):
    """Replaces personal data in texts; keeps all documents."""
    found = pii.pseudonymize(docs.select(COLUMNS), PSEUDONYM_KEY)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark, docs, sf_dir):
    """Leaves each row as often as the mix takes it."""
    taken = mixing.mix(docs.select(COLUMNS), weights=[5, 2, 1], carry=COLUMNS).where("size > 0 AND taken > 0")
    return taken.withColumn("copy", F.explode(F.expr("sequence(1L, taken div size)"))).select(COLUMNS)


def pack(spark, docs, sf_dir):
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES = [("language", language), ("near_dedup", near_dedup), ("pii", pseudonyms), ("mix", mix), ("packing", pack)]

#: A trained network and a tokenizer cannot be said in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
