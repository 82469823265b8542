import datetime as dt
import json
import threading

import pytest

from palimpsest import errors as X
from palimpsest.catalog import Catalog, Index
from palimpsest.functions import predicates as P
from palimpsest.operators import backup, maintenance
from palimpsest.operators.engine import READ_COMMITTED, Engine, generate_key
from palimpsest.operators.locks import LockManager
from palimpsest.streaming import tail
from palimpsest.types import DataType

ID = Index("id", DataType.INT, primary=True)
EMAIL = Index("email", DataType.VARCHAR)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.create_table("users", [ID, EMAIL])
    e.create_table("notes", [ID])
    return e


def doc(**fields):
    return json.dumps(fields)


def batch(engine, *docs):
    return engine.spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "_seq long, _doc string").coalesce(1)


def docs(df):
    return [r["_doc"] for r in df.collect()]


def test_catalog_errors():
    c = Catalog()
    c.create("t", [ID], "t")
    for indexes, error in (([ID], X.TableAlreadyExists),):
        with pytest.raises(error):
            c.create("t", indexes, "t")
    with pytest.raises(X.PrimaryKeyNotDefined):
        c.create("u", [EMAIL], "u")
    with pytest.raises(X.TwoPrimaryKeys):
        c.create("u", [ID, Index("x", DataType.INT, primary=True)], "u")
    with pytest.raises(X.LogDirectoryRequired):
        c.create("u", [ID], "")
    with pytest.raises(X.TableNotFound):
        c.table("nope")
    with pytest.raises(X.IndexNotFound):
        c.index("t", "nope")
    assert c.list_tables() == ["t"] and c.list_indexes("t") == [ID] and Catalog.from_json(c.to_json()).tables == c.tables


def test_rows_are_written_read_and_kept_as_they_came(engine):
    engine.upsert("users", batch(engine, '{"id": 2, "email": "b@x", "z": 1.50, "a": null}', '{"email": "a@x", "id": 1}', '{"id": 3, "email": "b@x"}'))
    assert engine.get("users", "id", 2) == '{"id": 2, "email": "b@x", "z": 1.50, "a": null}'
    assert engine.get("users", "id", 9) is None
    assert [r["id"] for r in engine.scan("users", "id").collect()] == [1, 2, 3]
    assert [r["id"] for r in engine.scan("users", "email", P.equal("b@x")).orderBy("id").collect()] == [2, 3]
    assert [r["id"] for r in engine.range_scan("users", "id", 2, 3).collect()] == [2, 3]
    with pytest.raises(X.InvalidKeyType):
        engine.scan("users", "id", P.equal("2"))
    engine.register_views()
    assert engine.spark.sql("SELECT count(*) AS n FROM users WHERE id > 1").first().n == 2
    again = Engine(engine.spark, engine.log.store.root)
    assert again.get("users", "id", 1) == '{"email": "a@x", "id": 1}'


def test_dates_floats_booleans_and_opaque_documents(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.create_table("events", [Index("date", DataType.DATE, primary=True)])
    for day in (1, 15, 31):
        e.put("events", "date", dt.datetime(2024, 1, day), f"event_{day}")
    assert docs(e.range_scan("events", "date", dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 31))) == ["event_15", "event_31"]
    e.create_table("prices", [Index("price", DataType.FLOAT, primary=True), Index("sold", DataType.BOOL)])
    e.upsert_row("prices", '{"price": 10.00, "sold": true}')
    for bad in ('{"price": 10, "sold": true}', '{"price": 1.5}', '{"price": 1.5, "sold": null}', '{"price": "1.5", "sold": false}'):
        with pytest.raises(X.InvalidKeyType):
            e.upsert_row("prices", bad)
    assert docs(e.scan("prices", "sold", P.equal(True))) == ['{"price": 10.00, "sold": true}']


def test_inserts_refuse_keys_that_ever_were(engine):
    engine.insert_row("users", doc(id=1, email="a"))
    with pytest.raises(X.DuplicateKey):
        engine.insert_row("users", doc(id=1, email="b"))
    with pytest.raises(X.DuplicateKey):
        engine.insert("users", batch(engine, doc(id=5, email="x"), doc(id=5, email="y")))
    assert engine.delete("users", "id", 1) is True and engine.delete("users", "id", 1) is False and engine.delete("users", "id", 99) is False
    with pytest.raises(X.DuplicateKey):
        engine.insert_row("users", doc(id=1, email="c"))
    engine.upsert_row("users", doc(id=1, email="d"))
    assert engine.get("users", "id", 1) == doc(id=1, email="d")
    with pytest.raises(X.KeyMismatch):
        engine.upsert_row("users", doc(id=1, email="d"), {"id": 2})
    with pytest.raises(X.InvalidKeyType):
        engine.insert_row("users", '{"email":"no-id"}', {"id": 1})


def test_a_changed_secondary_key_moves_the_row(engine):
    engine.insert_row("users", doc(id=1, email="old"))
    with engine.begin_read() as old:
        engine.upsert_row("users", doc(id=1, email="new"))
        assert engine.get("users", "email", "old") is None and engine.get("users", "email", "new") == doc(id=1, email="new")
        assert old.get("users", "email", "old") == doc(id=1, email="old") and old.get("users", "email", "new") is None
    engine.put("users", "email", "new", doc(email="new", note=1))
    assert engine.get("users", "id", 1) == doc(email="new", note=1)


def test_unique_indexes_show_the_last_writer(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.create_table("staff", [ID, Index("dept", DataType.VARCHAR, unique=True)])
    e.upsert("staff", batch(e, doc(id=1, dept="a"), doc(id=2, dept="a"), doc(id=3, dept="b")))
    assert [r["id"] for r in e.scan("staff", "dept").collect()] == [2, 3]
    assert docs(e.scan("staff", "dept", P.equal("a"))) == [doc(id=2, dept="a")]


def test_snapshots_and_isolation(engine):
    engine.put("notes", "id", 1, doc(id=1, v="initial"))
    rr = engine.begin_read()
    engine.put("notes", "id", 1, doc(id=1, v="updated"))
    rc = engine.begin_read(READ_COMMITTED)
    assert rr.get("notes", "id", 1) == doc(id=1, v="initial") and rc.get("notes", "id", 1) == doc(id=1, v="updated")
    engine.put("notes", "id", 1, doc(id=1, v="again"))
    engine.put("notes", "id", 2, doc(id=2, v="new"))
    assert rr.get("notes", "id", 1) == doc(id=1, v="initial") and rc.get("notes", "id", 1) == doc(id=1, v="again")
    assert rr.scan("notes", "id").count() == 1 and rc.scan("notes", "id").count() == 2
    engine.delete("notes", "id", 1)
    assert rr.get("notes", "id", 1) == doc(id=1, v="initial") and rc.get("notes", "id", 1) is None
    assert rr.is_visible(1) and not rr.is_visible(engine.log.snapshot().lsn)
    assert engine.min_active_lsn() == rr.begin_lsn
    rr.close(), rc.close()
    assert engine.table("notes", engine.log.snapshot().upto(1)).count() == 1


def test_transactions(engine):
    engine.put("notes", "id", 1, doc(id=1, balance=100))
    tx = engine.begin_write()
    tx.put("notes", "id", 2, doc(id=2))
    assert tx.get("notes", "id", 2) == doc(id=2) and engine.get("notes", "id", 2) is None
    tx.delete("notes", "id", 2)
    assert tx.get("notes", "id", 2) is None
    tx.put("notes", "id", 3, doc(id=3, v=1))
    tx.put("notes", "id", 3, doc(id=3, v=2))
    tx.put("users", "id", 1, doc(id=1, email="a"))
    tx.commit()
    assert engine.get("notes", "id", 3) == doc(id=3, v=2) and engine.get("users", "email", "a") == doc(id=1, email="a")
    with pytest.raises(X.TransactionFinished):
        tx.put("notes", "id", 4, doc(id=4))
    gone = engine.begin_write()
    gone.put("notes", "id", 5, doc(id=5))
    gone.rollback(), gone.rollback()
    assert engine.get("notes", "id", 5) is None
    with pytest.raises(X.TransactionFinished):
        gone.commit()
    one, two = engine.begin_write(), engine.begin_write()
    assert one.get("notes", "id", 1) == two.get("notes", "id", 1)
    one.put("notes", "id", 1, doc(id=1, balance=150))
    one.commit()
    with pytest.raises(X.SerializationConflict):
        two.put("notes", "id", 1, doc(id=1, balance=120))
    assert two.state == "ABORTED" and engine.get("notes", "id", 1) == doc(id=1, balance=150)
    empty = engine.begin_write()
    assert empty.commit().files == ()


def test_write_skew_is_possible(engine):
    engine.upsert("notes", batch(engine, doc(id=1, on=True), doc(id=2, on=True)))
    one, two = engine.begin_write(), engine.begin_write()
    for tx, own in ((one, 1), (two, 2)):
        assert all('"on": true' in tx.get("notes", "id", k) for k in (1, 2))
        tx.put("notes", "id", own, doc(id=own, on=False))
    one.commit(), two.commit()
    assert docs(engine.scan("notes", "id")) == [doc(id=1, on=False), doc(id=2, on=False)]


def test_one_of_many_racing_inserts_wins(engine):
    won, lost = [], []

    def insert(k):
        try:
            engine.insert_row("notes", doc(id=7, by=k))
            won.append(k)
        except (X.DuplicateKey, X.LockWaitTimeout):
            lost.append(k)

    engine.locks.timeout = 60
    threads = [threading.Thread(target=insert, args=(k,)) for k in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 5 and engine.get("notes", "id", 7) == doc(id=7, by=won[0])


def test_locks_time_out_and_the_largest_of_a_cycle_gives_way():
    locks = LockManager(timeout=5)
    locks.acquire(1, ("t", "i", "A")), locks.acquire(2, ("t", "i", "B")), locks.acquire(1, ("t", "i", "A"))
    with pytest.raises(X.LockWaitTimeout):
        locks.acquire(3, ("t", "i", "A"), 0.05)
    got = []
    t = threading.Thread(target=lambda: (locks.acquire(1, ("t", "i", "B")), got.append(1)))
    t.start()
    while not locks._waits_for:
        pass
    with pytest.raises(X.DeadlockVictim):
        locks.acquire(2, ("t", "i", "A"))
    assert locks.is_aborted(2)
    locks.release_all(2)
    t.join()
    assert got == [1] and not locks.is_aborted(2)


def test_vacuum_keeps_what_readers_see_and_that_keys_were(engine):
    engine.upsert("notes", batch(engine, *(doc(id=k) for k in range(5))))
    reader = engine.begin_read()
    engine.delete("notes", "id", 1)
    engine.put("notes", "id", 2, doc(id=2, v=2))
    assert maintenance.vacuum(engine, "notes") == 0
    assert reader.get("notes", "id", 1) == doc(id=1)
    reader.close()
    assert maintenance.vacuum(engine, "notes") == 2 and maintenance.vacuum(engine, "notes") == 0
    assert docs(engine.scan("notes", "id")) == [doc(id=0), doc(id=2, v=2), doc(id=3), doc(id=4)]
    assert engine.delete("notes", "id", 1) is False
    with pytest.raises(X.DuplicateKey):
        engine.insert_row("notes", doc(id=1))


def test_checkpoint_archive_and_recovery(engine):
    for k in range(3):
        engine.put("notes", "id", k, doc(id=k))
    assert maintenance.last_checkpoint(engine) == 0
    lsn = maintenance.checkpoint(engine)
    assert maintenance.last_checkpoint(engine) == lsn == 3 and maintenance.checkpointed(engine, "notes").count() == 3
    engine.put("notes", "id", 3, doc(id=3))
    assert maintenance.segments(engine, 2).count() == 3
    moved = maintenance.archive(engine)
    assert len(moved) == 3 and docs(engine.scan("notes", "id")) == [doc(id=k) for k in range(4)]
    assert maintenance.restore_archived(engine) == sorted(moved) and maintenance.restore_archived(engine) == []
    lost = engine.log.claim()  # a writer that died before it published
    engine.spark.range(1).write.parquet(engine.log.store.url(f"log/notes/{lost:020d}-dead"))
    again = Engine(engine.spark, engine.log.store.root)
    assert again.recover() == [lost] and again.recover() == []
    assert docs(again.scan("notes", "id")) == [doc(id=k) for k in range(4)]
    wal = again.log.as_wal([again.catalog.table("notes")], again.log.snapshot())
    assert wal.where("type = 'ABORT'").count() == 1


def test_missing_files_are_noticed(engine):
    commit = engine.put("notes", "id", 1, doc(id=1))
    engine.log.store.delete(commit.files[0][1])
    with pytest.raises(X.CorruptLog):
        engine.scan("notes", "id")


def test_backup_round_trip(engine, tmp_path):
    engine.upsert("users", batch(engine, *(doc(id=k, email=f"user-{k}") for k in range(5))))
    place, restored = str(tmp_path / "backup"), str(tmp_path / "restored")
    n = backup.backup(engine, place)
    engine.upsert_row("users", doc(id=5, email="late"))
    assert backup.verify(engine.spark, place) == n
    with pytest.raises(X.BackupError):
        backup.backup(engine, place)
    assert backup.restore(engine.spark, place, restored) == n
    other = Engine(engine.spark, restored)
    assert [r["id"] for r in other.scan("users", "id").collect()] == [0, 1, 2, 3, 4]
    victim = next(f for f, _ in engine.log.store.files("commits"))
    (tmp_path / "backup" / "commits" / victim).write_text("{}")
    with pytest.raises(X.BackupError):
        backup.verify(engine.spark, place)


def test_encryption_at_rest(spark, tmp_path):
    root, key = str(tmp_path / "db"), bytes(range(32))
    e = Engine(spark, root, key)
    e.create_table("users", [ID, EMAIL])
    e.upsert_row("users", doc(id=1, email="secret@x"))
    assert e.get("users", "id", 1) == doc(id=1, email="secret@x")
    assert "secret" not in e.versions("users").select("_doc").first()["_doc"]
    e.rotate_master_key(bytes(32))
    assert Engine(spark, root, bytes(32)).get("users", "id", 1) == doc(id=1, email="secret@x")
    with pytest.raises(X.DecryptionError):
        Engine(spark, root, key)


def test_the_log_as_a_stream(engine, tmp_path):
    engine.put("notes", "id", 1, doc(id=1))
    engine.put("notes", "id", 2, doc(id=2))
    seen = []
    q = tail.follow(engine, "notes", lambda df, n: seen.extend(r["k_id"] for r in df.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(seen) == [1, 2]
    engine.spark.createDataFrame([(doc(id=8),), (doc(id=9),)], "_doc string").write.parquet(str(tmp_path / "in"))
    stream = engine.spark.readStream.schema("_doc string").parquet(str(tmp_path / "in"))
    q = tail.upserting(engine, "notes", stream, str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["id"] for r in engine.scan("notes", "id").collect()] == [1, 2, 8, 9]


def test_keys_sort_by_time():
    a = [generate_key() for _ in range(3)]
    assert len(set(a)) == 3 and all(k[14] == "7" and k[19] in "89ab" for k in a)


def late_commit(engine, between, table="notes", key=50):
    """Another driver claims a number; ``between`` runs before it publishes."""
    other = Engine(engine.spark, engine.log.store.root)
    return other.commit({table: other.rows(table, [("UPSERT", {"id": key}, doc(id=key))])}, check=lambda staged: between())


@pytest.mark.parametrize("rewrite", [lambda e: maintenance.vacuum(e, "notes"), lambda e: maintenance.compact(e, "notes"), lambda e: (maintenance.checkpoint(e), maintenance.archive(e))])
def test_commits_that_are_published_late_stay(engine, rewrite):
    engine.put("notes", "id", 1, doc(id=1, v=1))
    late = late_commit(engine, lambda: (engine.put("notes", "id", 1, doc(id=1, v=2)), rewrite(engine), maintenance.truncate(engine)))
    again = Engine(engine.spark, engine.log.store.root)
    assert late.lsn < again.log.snapshot().lsn
    for e in (engine, again):
        assert docs(e.scan("notes", "id")) == [doc(id=1, v=2), doc(id=50)]
    maintenance.vacuum(again, "notes"), maintenance.compact(again, "notes"), maintenance.truncate(again)
    assert docs(Engine(engine.spark, engine.log.store.root).scan("notes", "id")) == [doc(id=1, v=2), doc(id=50)]


def test_checkpoints_name_what_they_hold(engine):
    engine.put("notes", "id", 1, doc(id=1))
    late_commit(engine, lambda: (engine.put("notes", "id", 2, doc(id=2)), maintenance.checkpoint(engine)))
    rows = maintenance.replayed(engine, "notes").collect()
    assert sorted(r["k_id"] for r in rows) == [1, 2, 50] and maintenance.last_checkpoint(engine) == 3
    assert sorted(r["k_id"] for r in maintenance.checkpointed(engine, "notes").collect()) == [1, 2]


def test_numbers_go_on_after_truncation(engine):
    for k in range(4):
        engine.put("notes", "id", k, doc(id=k))
    other = Engine(engine.spark, engine.log.store.root)
    assert other.log.last_lsn() == 4 and maintenance.truncate(engine) == 4 and engine.log.store.names("claims") == []
    assert other.put("notes", "id", 9, doc(id=9)).lsn == 5 and engine.put("notes", "id", 10, doc(id=10)).lsn == 6
    assert len(docs(other.scan("notes", "id"))) == len(docs(engine.scan("notes", "id"))) == 6
    assert maintenance.truncate(other) == 6 and engine.log.store.names("summary") == [f"{6:020d}.json"]


def test_two_drivers_share_catalog_and_keys(spark, tmp_path):
    root, key = str(tmp_path / "db"), bytes(range(32))
    one, two = Engine(spark, root, key), Engine(spark, root, key)
    one.create_table("a", [ID]), two.create_table("b", [ID])
    with pytest.raises(X.TableAlreadyExists):
        two.create_table("a", [ID])
    one.put("b", "id", 1, doc(id=1))
    assert Engine(spark, root, key).catalog.list_tables() == ["a", "b"] and two.get("b", "id", 1) == doc(id=1)


def test_readers_of_other_drivers_hold_files_back(engine):
    engine.put("notes", "id", 1, doc(id=1, v=1))
    other = Engine(engine.spark, engine.log.store.root)
    reader = other.begin_read()
    engine.put("notes", "id", 1, doc(id=1, v=2))
    assert engine.min_active_lsn() == 1 and maintenance.vacuum(engine, "notes") == 0
    maintenance.compact(engine, "notes")
    assert reader.get("notes", "id", 1) == doc(id=1, v=1) and maintenance.drop_replaced(engine, "notes") == []
    reader.close()
    assert len(maintenance.drop_replaced(engine, "notes")) == 2 and engine.get("notes", "id", 1) == doc(id=1, v=2)


def test_recovery_undoes_once_and_shuts_lost_writers_out(engine):
    engine.upsert("users", batch(engine, doc(id=1, email="a"), doc(id=2, email="b")))
    other = Engine(engine.spark, engine.log.store.root)
    seen = []

    def die(staged):
        seen.append(engine.recover())
        assert engine.recover(3600) == []

    rows = other.rows("users", [("UPSERT", {"id": k, "email": "x"}, doc(id=k, email="x")) for k in (1, 2, 3)])
    with pytest.raises(X.CommitAborted):
        other.commit({"users": rows}, check=die)
    assert seen == [[2]] and engine.recover() == []
    undone = {(r.key, r.doc) for r in engine.wal().where("type = 'CLR'").collect()}
    assert undone == {('{"id":1}', doc(id=1, email="a")), ('{"id":2}', doc(id=2, email="b")), ('{"id":3}', None)}
    assert docs(engine.scan("users", "id")) == [doc(id=1, email="a"), doc(id=2, email="b")]


def test_replaced_versions_dont_decrypt_as_newer_ones(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), bytes(range(32)))
    e.create_table("users", [ID])
    e.put("users", "id", 1, doc(id=1, v="old")), e.put("users", "id", 1, doc(id=1, v="new"))
    old = e.versions("users").where("_lsn = 1").first()["_doc"]
    t = e.table_of("users")
    lsn = e.log.claim()
    from pyspark.sql import functions as F

    forged = e.versions("users").where("_lsn = 2").withColumns({"_doc": F.lit(old), "_lsn": F.lit(lsn)})
    forged.withColumn("_sum", t.checksum()).write.parquet(e.log.store.url(f"log/users/{lsn:020d}-f"))
    e.log.publish(e.log.snapshot().commits[0].__class__(lsn, "DATA", None, (("users", f"log/users/{lsn:020d}-f"),)))
    with pytest.raises(Exception, match="(?i)tag|decrypt|AES"):
        e.get("users", "id", 1)


def test_closed_engines_and_stores_without_exclusive_creation(spark, engine):
    reader = engine.begin_read()
    engine.close(), engine.close()
    assert not engine.log.leased() and reader not in engine.active
    for action in (lambda: engine.scan("notes", "id"), engine.begin_read, lambda: engine.put("notes", "id", 1, doc(id=1))):
        with pytest.raises(X.EngineClosed):
            action()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.blob.impl", "org.apache.hadoop.fs.http.HttpsFileSystem")
    with pytest.raises(Exception, match="exclusive|alone|UnsupportedStore"):
        Engine(spark, "blob://host/db")


def test_filters_over_several_keys(engine):
    engine.upsert("users", batch(engine, *(doc(id=k, email=f"{'ab'[k % 2]}@{k}") for k in range(10))))
    keep = P.like("email", "a@%") & ~P.one_of("id", 2, 4) | P.where("id", P.equal(9))
    assert [r["id"] for r in engine.where("users", keep).collect()] == [0, 6, 8, 9]
    narrow = engine.where("users", P.where("id", P.between(3, 5)) & ~P.is_null("email"), columns=["email"])
    assert narrow.columns == ["email"] and narrow.count() == 3
    assert "_doc" not in narrow._jdf.queryExecution().executedPlan().toString()
    for bad, error in ((P.where("id", P.equal("1")), X.InvalidKeyType), (P.where("nope", P.equal(1)), X.IndexNotFound), (P.like("id", "1%"), X.InvalidKeyType)):
        with pytest.raises(error):
            engine.where("users", bad)


def test_many_puts_of_a_transaction_are_one_commit(engine):
    tx = engine.begin_write()
    for k in range(300):
        tx.put("notes", "id", k, doc(id=k, v=0))
        tx.put("notes", "id", k, doc(id=k, v=1))
    assert tx.get("notes", "id", 7) == doc(id=7, v=1)
    commit = tx.commit()
    assert engine.versions("notes").count() == 300 and commit.lsn == 1


def test_rows_written_one_by_one_are_checked_as_batches_are(spark, tmp_path):
    """The driver's reading of a document agrees with the executors', for every key type."""
    e = Engine(spark, str(tmp_path / "db"))
    e.create_table("t", [ID, Index("f", DataType.FLOAT), Index("b", DataType.BOOL), Index("d", DataType.DATE), Index("s", DataType.VARCHAR)])
    values = {"id": ["1", "-5", "1.0", '"1"', "null", "true", "9223372036854775807", "9223372036854775808"], "f": ["1.5", "1", "-0.0", "1e3", '"x"', "99999999999999999999"], "b": ["true", "false", "0", "null"], "d": ['"2024-01-02"', '"2024-01-02T03:04:05"', '"2024-01-02T03:04:05Z"', '"nope"', "5"], "s": ['"a"', '""', "1"]}
    good = {"id": "1", "f": "1.5", "b": "true", "d": '"2024-01-02"', "s": '"a"'}
    given = ["{" + ", ".join(f'"{k}": {v if k == name else good[k]}' for k in good) + "}" for name, own in values.items() for v in own] + ['{"id": 1, "id": 2}', "[1]", "", "{", '{"id": 1}']
    rows = e.prepared("t", spark.createDataFrame([(k, d) for k, d in enumerate(given)], "_seq long, _doc string")).orderBy("_seq").collect()
    for text, r in zip(given, rows, strict=True):
        try:
            keys = e.row("t", text)
        except X.InvalidKeyType:
            assert r["_problem"], text
        else:
            assert r["_problem"] is None and {k: r[f"k_{k}"] for k in good} == keys, text
