"""What a log says after a crash: transactions and their fate, what to redo, what to undo, and the state that results.

The log has lsn, tx_id (null: autocommit), type (BEGIN, COMMIT, ABORT, CHECKPOINT, CLR or a change: INSERT, UPDATE, UPSERT,
DELETE, MULTI), table, key columns and data. A CLR names the lsn that it compensates in ``undone_lsn``. Logs whose commits
hold many changes under one lsn have a column seq, the change's place in its commit, and ``undone_seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKERS = ("BEGIN", "COMMIT", "ABORT", "CHECKPOINT")


def max_lsn(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("max_lsn"))


def checkpoint_lsn(log: DataFrame) -> DataFrame:
    """The last checkpoint's lsn, 0 if there is none."""
    return log.where("type = 'CHECKPOINT'").agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("checkpoint_lsn"))


def transactions(log: DataFrame) -> DataFrame:
    """tx_id, first_lsn, last_lsn, status: COMMITTED or ABORTED by its marker, else ACTIVE."""
    ended = F.max_by(F.col("type"), F.when(F.col("type").isin("COMMIT", "ABORT"), F.col("lsn")))
    status = F.when(ended == "COMMIT", "COMMITTED").when(ended == "ABORT", "ABORTED").otherwise("ACTIVE")
    return log.where("tx_id is not null").groupBy("tx_id").agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), status.alias("status"))


def winners(log: DataFrame) -> DataFrame:
    return transactions(log).where("status = 'COMMITTED'").select("tx_id")


def losers(log: DataFrame) -> DataFrame:
    """Transactions without an end. Aborted ones have ended."""
    return transactions(log).where("status = 'ACTIVE'").select("tx_id")


def dirty_indexes(log: DataFrame, indexes: Column) -> DataFrame:
    """The first lsn that touched each table's each index. indexes: the array of index names that an entry touches."""
    touched = log.where(~F.col("type").isin(*MARKERS)).select("table", "lsn", F.explode(indexes).alias("index"))
    return touched.groupBy("table", "index").agg(F.min("lsn").alias("first_lsn"))


def place(log: DataFrame) -> list[str]:
    """What tells changes apart: the lsn, and the place in the commit where the log has it."""
    return ["lsn", "seq"] if "seq" in log.columns else ["lsn"]


def newest_first():
    """Changes in the order in which undo takes them, for numbering compensations."""
    return Window.partitionBy("undone_lsn").orderBy(F.desc("undone_seq"))


def undone(log: DataFrame) -> DataFrame:
    return log.where("type = 'CLR'").select("tx_id", *(F.col(f"undone_{c}").alias(c) for c in place(log))).distinct()


def redo_set(log: DataFrame, checkpoint: int = 0) -> DataFrame:
    """Changes to apply again, each once: from the checkpoint on, of winners, of autocommit, and all compensations."""
    return _redone(log, checkpoint).dropDuplicates(place(log))


def _redone(log: DataFrame, checkpoint: int = 0) -> DataFrame:
    """``redo_set`` with entries that the log repeats: enough where only each key's newest change matters, and without a shuffle of autocommitted ones."""
    changes = log.where((F.col("lsn") >= checkpoint) & ~F.col("type").isin(*MARKERS))
    own = changes.where("tx_id is null or type = 'CLR'")
    return own.unionByName(changes.where("tx_id is not null and type <> 'CLR'").join(winners(log), "tx_id", "left_semi").select(*changes.columns))


def final_state(log: DataFrame, key: list[str], columns: list[str], checkpoint: int = 0, tables: list[str] | None = None) -> DataFrame:
    """Rows after recovery: the newest redone change of each key; unknown tables are passed over."""
    from .versions import latest

    redo = _redone(log, checkpoint).where("type <> 'CLR'")
    if tables is not None:
        redo = redo.where(F.col("table").isin(tables))
    return latest(redo, key, place(log), columns=columns, type_column="type")


def undo_tasks(log: DataFrame) -> DataFrame:
    """Losers' changes that no CLR has compensated, with undo_next_lsn: that of the transaction's next lower one, 0 at its end. Undo goes downwards by lsn, and by seq inside a commit."""
    lost = log.where(~F.col("type").isin(*MARKERS, "CLR")).join(losers(log), "tx_id", "left_semi")
    left = lost.join(undone(log), ["tx_id", *place(log)], "left_anti")
    return left.withColumn("undo_next_lsn", F.coalesce(F.lag("lsn").over(Window.partitionBy("tx_id").orderBy(*place(log))), F.lit(0)))


def compensations(log: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Undo of each task: the key goes back to the version before it among committed and compensated changes, or away if none.

    One pass over each key's changes in their order, which carries the last good one along.
    """
    kept = list(dict.fromkeys([*log.columns, "undo_next_lsn"]))
    tasks = undo_tasks(log).select(*kept, F.lit(None).cast("string").alias("prior_type"), *(F.lit(None).cast(log.schema[c].dataType).alias(f"prior_{c}") for c in columns), F.lit(True).alias("_task"))
    good = _redone(log).where("type <> 'CLR'")
    good = good.select(*(F.col(c) if c in log.columns and c != "undo_next_lsn" else F.lit(None).cast(dict(tasks.dtypes)[c]).alias(c) for c in kept), F.col("type").alias("prior_type"), *(F.col(c).alias(f"prior_{c}") for c in columns), F.lit(False).alias("_task"))
    before = Window.partitionBy(*key).orderBy(*place(log)).rowsBetween(Window.unboundedPreceding, -1)
    version = F.when(~F.col("_task"), F.struct("prior_type", *(f"prior_{c}" for c in columns)))
    best = tasks.unionByName(good).withColumn("prior", F.last(version, ignorenulls=True).over(before)).where("_task")
    restored = F.coalesce(F.col("prior.prior_type") != "DELETE", F.lit(False))
    return best.select(*kept, restored.alias("restored"), *(F.when(restored, F.col(f"prior.prior_{c}")).alias(f"prior_{c}") for c in columns))


def applied_lsns(log: DataFrame, indexes: Column) -> DataFrame:
    """The last lsn applied to each table's each index."""
    touched = log.where(~F.col("type").isin(*MARKERS)).select("table", "lsn", F.explode(indexes).alias("index"))
    return touched.groupBy("table", "index").agg(F.max("lsn").alias("applied_lsn"))


def retained_segments(log: DataFrame, segment_lsns: int, checkpoint: int, keep: int) -> DataFrame:
    """segment, max_lsn, archived: segments wholly before the checkpoint may go, but for the newest ``keep`` of them."""
    segments = log.groupBy(F.floor(F.col("lsn") / segment_lsns).cast("long").alias("segment")).agg(F.max("lsn").alias("max_lsn"))
    # There is one row per segment here, a bounded share of the log.
    before = F.col("max_lsn") < checkpoint
    order = Window.partitionBy(before).orderBy(F.desc("segment"))
    return segments.withColumn("archived", before & (F.row_number().over(order) > keep))
