from pyspark.sql import functions as F

from palimpsest.plans import recovery as R

WAL = "lsn long, tx_id long, type string, table string, id long, doc string, undone_lsn long"


def test_winners_losers_and_final_state(spark):
    log = spark.createDataFrame([(1, 1001, "BEGIN", None, None, None, None), (2, 1001, "INSERT", "users", 1, "one", None), (3, 1001, "COMMIT", None, None, None, None), (4, 2002, "BEGIN", None, None, None, None), (5, 2002, "INSERT", "users", 2, "two", None)], WAL)
    assert [r.tx_id for r in R.winners(log).collect()] == [1001] and [r.tx_id for r in R.losers(log).collect()] == [2002]
    assert [tuple(r) for r in R.final_state(log, ["id"], ["doc"]).collect()] == [(1, "one")]
    assert R.final_state(log, ["id"], ["doc"], tables=["other"]).count() == 0
    assert R.max_lsn(log).first()[0] == 5 and R.checkpoint_lsn(log).first()[0] == 0


def test_undo_of_a_loser(spark):
    rows = [(1, None, "INSERT", "t", 1, "before-update", None), (2, None, "INSERT", "t", 2, "before-delete", None), (10, 7, "INSERT", "t", 100, "x", None), (11, 7, "UPDATE", "t", 1, "after", None), (12, 7, "DELETE", "t", 2, None, None), (13, 7, "INSERT", "t", 101, "y", None)]
    log = spark.createDataFrame(rows, WAL)
    tasks = {r.lsn: r.undo_next_lsn for r in R.undo_tasks(log).collect()}
    assert tasks == {10: 0, 11: 10, 12: 11, 13: 12}
    back = {r.id: (r.restored, r.prior_doc) for r in R.compensations(log, ["id"], ["doc"]).collect()}
    assert back == {100: (False, None), 1: (True, "before-update"), 2: (True, "before-delete"), 101: (False, None)}
    done = log.unionByName(spark.createDataFrame([(14, 7, "CLR", "t", 101, None, 13)], WAL))
    assert {r.lsn for r in R.undo_tasks(done).collect()} == {10, 11, 12}
    assert {(r.id, r.doc) for r in R.final_state(done, ["id"], ["doc"]).collect()} == {(1, "before-update"), (2, "before-delete")}


def test_redo_is_idempotent_and_starts_at_the_checkpoint(spark):
    log = spark.createDataFrame([(1, None, "INSERT", "t", 1, "a", None), (1, None, "INSERT", "t", 1, "a", None), (4, None, "UPDATE", "t", 1, "b", None)], WAL)
    assert [r.lsn for r in R.redo_set(log, 2).collect()] == [4] and R.redo_set(log).count() == 2


def test_segments_and_indexes(spark):
    log = spark.range(0, 100).select(F.col("id").alias("lsn"), F.lit(None).cast("long").alias("tx_id"), F.lit("INSERT").alias("type"), F.lit("t").alias("table"))
    kept = {r.segment: r.archived for r in R.retained_segments(log, 10, 55, 2).collect()}
    assert [k for k, gone in sorted(kept.items()) if gone] == [0, 1, 2]
    assert [tuple(r) for r in R.dirty_indexes(log, F.array(F.lit("id"))).collect()] == [("t", "id", 0)]
    assert [tuple(r) for r in R.applied_lsns(log, F.array(F.lit("id"))).collect()] == [("t", "id", 99)]
