"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents_view, drop_stored, held_out, stored


def labelled_sample(documents: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """spot, label, text: at most ``rows`` labelled documents that aren't held out, in a fixed pseudorandom order.

    The rows are those with the smallest hashes of doc_id, so the sample is the same in every run. Labels that are null or
    neither 0 nor 1, and doc_ids that are null, are left out; where rows repeat a doc_id, its largest label and text count.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out())
    known = known.withColumn("spot", F.xxhash64("doc_id"))

    def first(df: DataFrame) -> DataFrame:
        return df.groupBy("doc_id", "spot").agg(F.max("label").alias("label")).orderBy("spot", "doc_id").limit(rows)

    # Where there are many labels, hashes above a bound that leaves some twice as many as needed are passed over at the scan.
    # Should that leave too few, as where most labels repeat or are held out, all are looked through.
    share = 4 * rows / max(1, labels.count())
    picked = stored(first(known.where(F.col("spot") <= int(share * 2.0**64) - (1 << 63)) if share < 0.5 else known))
    if share < 0.5 and picked.count() < rows:
        drop_stored(picked)
        picked = stored(first(known))
    # At most ``rows`` small rows, whatever the corpus: safe to broadcast.
    found = documents_view(documents).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.max("spot").alias("spot"), F.max("label").alias("label"), F.max("text").alias("text"))


def fit_in_one_task(sample: DataFrame, fit, schema: str) -> DataFrame:
    """Runs ``fit`` (an iterator of Arrow batches to an iterator of them) over the bounded sample in one task, in its fixed order."""
    return sample.coalesce(1).sortWithinPartitions("spot", "doc_id").select("spot", "label", "text").mapInArrow(fit, schema)
