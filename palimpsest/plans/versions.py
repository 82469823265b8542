"""A table at a log sequence number, from the log of its rows' versions.

The log has one row per version: its key columns, a place (lsn, or lsn and position), a type (DELETE ends the row), and data.
Only conditions on the key or on the lsn may go below the choice of versions; on anything else they would bring back old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], order: list[str], upto: Column | None = None, columns: list[str] | None = None, type_column: str = "_type", below: Column | None = None) -> DataFrame:
    """The newest version of each key at ``upto`` (a condition on the order columns), deleted ones left out.

    One shuffle by key, with partial maxima before it; only ``columns`` travel. below: a condition on key columns alone.
    """
    columns = [c for c in (columns or log.columns) if c not in key]
    if below is not None:
        log = log.where(below)
    if upto is not None:
        log = log.where(upto)
    carried = F.struct(*dict.fromkeys([*columns, type_column]))
    newest = log.groupBy(*key).agg(F.max_by(carried, F.struct(*order)).alias("_row"))
    return newest.where(F.col("_row")[type_column] != "DELETE").select(*key, *(F.col("_row")[c].alias(c) for c in columns))


def intervals(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The log with valid_from and valid_to of each version: visible from the one, included, to the other; null: still valid."""
    own = Window.partitionBy(*key).orderBy(*order)
    return log.withColumn("valid_from", F.col(order[0])).withColumn("valid_to", F.lead(order[0]).over(own))


def visible(spans: DataFrame, lsn: int, type_column: str = "_type") -> DataFrame:
    """Of ``intervals``, what a snapshot at lsn sees."""
    return spans.where((F.col("valid_from") <= lsn) & (F.col("valid_to").isNull() | (F.col("valid_to") > lsn)) & (F.col(type_column) != "DELETE"))


def last_writers(rows: DataFrame, index: str, order: list[str]) -> DataFrame:
    """Of rows that agree in an index's key, the last written: what an index that maps each key to one row shows."""
    carried = [c for c in rows.columns if c != index]
    best = rows.groupBy(index).agg(F.max_by(F.struct(*carried), F.struct(*order)).alias("_row"))
    return best.select(index, *(F.col("_row")[c].alias(c) for c in carried))


def overlay(rows: DataFrame, pending: DataFrame, key: list[str], type_column: str = "_type") -> DataFrame:
    """A transaction's view: a snapshot's rows, replaced or removed by its own pending writes (one per key)."""
    written = pending.where(F.col(type_column) != "DELETE").select(*rows.columns)
    return rows.join(pending.select(*key), key, "left_anti").unionByName(written)


def reclaimable(log: DataFrame, key: list[str], order: list[str], bound: int, type_column: str = "_type") -> DataFrame:
    """Versions that no snapshot at ``bound`` or later sees, because a newer one was there by then. Deletes are no versions."""
    return intervals(log, key, order).where((F.col(type_column) != "DELETE") & (F.col("valid_to") <= bound))


def survivors(log: DataFrame, key: list[str], order: list[str], bound: int, type_column: str = "_type") -> DataFrame:
    """What vacuum keeps: versions still seen, and of each key its last delete, so that the key stays known."""
    spans = intervals(log, key, order)
    gone = F.col("valid_to").isNotNull() & (F.col("valid_to") <= bound)
    return spans.where(~gone).drop("valid_from", "valid_to")
