"""The corpus pipeline: reject toxic documents, drop near-duplicates, mask secrets, mix sources to target weights, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``. Rows with null or repeated doc_ids are documents of their own.
``run`` applies the stages to ``documents``, which has the columns doc_id, text, source and n_chars, and perhaps others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, minhash_dedup, mixing, secrets, toxicity
from palimpsest.llm._common import free_names, read_table, stored

#: Stages on word shingles link at this share; the 85 % of ``op2_minhash_dedup`` bind that query only.
NEAR_PERCENT = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; it is fitted on labelled rows of docs outside the held-out ones. Without any, none is rejected."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    if not toxicity.fitted(model):
        return docs
    score, predicted = free_names(docs.columns, "score", "predicted")
    return toxicity.scored(docs, model, *docs.columns, score=score, predicted=predicted).where(F.col(predicted) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (``NEAR_PERCENT`` or more of their shingles shared) the document with the smallest doc_id.

    Where doc_ids are null or repeat, rows are told apart by a number in the order of doc_id (nulls last) and text, so each row
    is a document of its own and goes only if its text is near another's.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not odd.limit(1).count():
        kept = minhash_dedup.near_duplicates(docs, NEAR_PERCENT).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    order = [F.asc_nulls_last("row.doc_id"), F.xxhash64("text"), F.xxhash64("row")]
    # Ranges follow each other as their partitions do, so the numbers rise with the order; once stored they stay.
    numbered = stored(row.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc_id", F.monotonically_increasing_id()))
    kept = minhash_dedup.near_duplicates(numbered, NEAR_PERCENT).where("kept").select("doc_id")
    return numbered.join(kept, "doc_id", "left_semi").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mask; n_chars follows where there is such a column."""
    scanner = secrets.Scanner(spark, secrets.default_samples(docs))
    out = scanner.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and round that takes words of it, with those words."""
    return mixing.Mix(docs).mixed_documents()


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of each row, and whether decoding gives the text again."""
    return bpe.Tokenizer(spark, bpe.default_vocabulary(), docs).encode_checked(docs, "doc_id", "source")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the permutations; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
