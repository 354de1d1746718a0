"""Corpus pipeline: five stages over ``documents``, each written and read again before the next.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark
passages go, secrets are masked, and what is left is packed into training sequences. Every stage but
the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import decontaminate, packing, secret_scan, simhash, toxicity
from roadweave.llm.common import cut, release, table
from roadweave.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, fitted on the labelled rows of these documents."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with any hit word go. The key is the id with a hash of the text, so rows without an id are told apart."""
    keyed = docs.withColumn("__key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text"))))
    found = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="__key")
    gone = found.where("contaminated").select("__key").distinct()
    return keyed.join(gone.hint("shuffle_hash"), "__key", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every span is masked; n_chars follows the text."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6."""
    return packing.pack_documents(docs, **vocabulary())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack)]

#: The learned scores, the fingerprints and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        if i:
            release(before)  # what a stage kept goes once the next one has read it
    return STAGES[-1][1](spark, docs, sf_dir)
