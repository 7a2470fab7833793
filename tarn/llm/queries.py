"""The operators with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers

from . import fingerprints, language_id, licenses, mixing, near_duplicates, neighbours, oracles, packing, pii, quality, token_counts
from .common import table


#: Key of the pseudonyms; real corpora pass their own.
PSEUDONYM_KEY = "tarn-example-key"


def op1_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PSEUDONYM_KEY)


def op2_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", language_id.held_out("doc_id").alias("held_out"))
    found = language_id.identify(rows, language_id.fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op9_fingerprints(spark, sf_dir):
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1])


QUERIES = {f.__name__: f for f in (op1_pii, op2_licenses, op3_packing, op4_quality, op5_language_id, op6_near_duplicates, op7_token_counts, op8_neighbours, op9_fingerprints, op10_mixing)}

SQL: dict[str, str] = {"op2_licenses": oracles.licenses_sql(), "op6_near_duplicates": oracles.NEAR_DUPLICATES}
