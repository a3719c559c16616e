"""A corpus pipeline of five stages: toxic documents go, one document of each near-duplicate group stays, secrets are masked, sources
are mixed to their target weights, and the texts are encoded.

A stage takes (spark, docs, sf_dir) and returns a table; each but the last returns the columns of documents. ``run`` writes each
stage's table and reads it again.

Defined cases, for each stage and for ``run``: null and empty texts stay (as one of each group of near duplicates) and have no
tokens but the end; null ids, labels and sources are values like any other; rows that repeat each other are near duplicates; ties go
to the least doc_id, then to a hash; an empty table gives an empty table; further columns of any name go through unchanged, up to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.llm import mixing, secrets, sentencepieces, simhash, toxicity
from loamworks.llm.common import batches_of, free_names, stash, table

#: Toxicity learns from labels and two stages from hashes: SQL cannot express the rows.
ORACLE_SQL = None


#: Texts that go to Python at once.
BATCH = 1000


def _named(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches_of(spark, BATCH)
    (score,) = free_names(docs, "score")
    scored = toxicity.score(docs, docs, table(spark, sf_dir, "labels"), out=score)
    return scored.filter(F.col(score) < 0.5).select(*_named(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches_of(spark, BATCH)
    return simhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0)))
    return masked.select(*_named(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    own = free_names(docs, *docs.columns)
    kept = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)])
    at = dict(zip(docs.columns, own))
    mixed = mixing.mix(kept, text=at["text"], source=at["source"], key=(at["doc_id"], at["source"], at["text"])).filter("copies > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select(*[F.col(f"`{o}`").alias(c) for c, o in at.items()])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches_of(spark, BATCH)
    coded = sentencepieces.encode_decode(docs.select("doc_id", "text"), sentencepieces.model_bytes())
    return sentencepieces.digests(coded)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
