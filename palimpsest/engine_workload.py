"""Queries that go through the engine itself: each makes a store, writes commits into it and returns what the engine then says.

Customers are documents of a table with a primary key (id), a secondary one (segment) and a float (balance). The SQL beside
each query says over the plain tables what must come out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Index
from .errors import BackupError, CommitAborted, EngineError
from .functions import predicates as P
from .operators import backup, maintenance
from .operators.engine import READ_COMMITTED, Engine
from .plans import recovery as R
from .plans.stages import shared_dir, stored
from .sources.changelog import Commit
from .sources.store import Store
from .streaming import tail
from .types import DataType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ID = Index("id", DataType.INT, primary=True)
SEGMENT = Index("segment", DataType.VARCHAR)
BALANCE = Index("balance", DataType.FLOAT)


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def customers(spark: SparkSession, sf_dir: str, segment: Column | None = None) -> DataFrame:
    """A batch: _seq and _doc of each customer."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    fields = F.struct(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") if segment is None else segment).alias("segment"), F.col("c_acctbal").alias("balance"))
    return rows.select(F.col("c_custkey").alias("_seq"), F.to_json(fields).alias("_doc"))


def opened(spark: SparkSession, sf_dir: str, *indexes: Index, key: bytes | None = None) -> Engine:
    """A new store whose first commit holds all customers."""
    engine = Engine(spark, shared_dir(spark), key)
    engine.create_table("customers", [ID, *(indexes or (SEGMENT, BALANCE))])
    engine.upsert("customers", customers(spark, sf_dir))
    return engine


def first(spark: SparkSession, sf_dir: str, condition: str, segment: Column | None = None) -> DataFrame:
    return customers(spark, sf_dir, segment).where(condition)


def one_row(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


def refused(action: Callable[[], object]) -> str:
    try:
        action()
    except EngineError as e:
        return type(e).__name__
    return "accepted"


_PLAIN = "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer"
_COLUMNS = ["id", "segment", "balance"]


@query("eng_scan_all", _PLAIN)
def _(spark, d):
    return opened(spark, d).scan("customers", "id", columns=_COLUMNS)


@query("eng_get", f"{_PLAIN} WHERE c_custkey = 77")
def _(spark, d):
    doc = opened(spark, d).get("customers", "id", 77)
    return one_row(spark, "doc string", doc).select(F.from_json("doc", "id long, segment string, balance double").alias("x")).select("x.*")


@query("eng_scan_secondary", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return opened(spark, d).scan("customers", "segment", P.equal("BUILDING"), columns=["id"])


@query("eng_range_scan", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal BETWEEN 100.0 AND 2000.0")
def _(spark, d):
    return opened(spark, d).range_scan("customers", "balance", 100.0, 2000.0).select("id", "balance")


@query("eng_where", """SELECT c_custkey AS id FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT (c_acctbal < 0) AND c_custkey >= 20)
OR (c_mktsegment LIKE 'AUTO%' AND c_custkey < 300)""")
def _(spark, d):
    keep = P.one_of("segment", "BUILDING", "MACHINERY") & ~P.where("balance", P.less_than(0.0)) & P.where("id", P.greater_or_equal(20))
    keep |= P.like("segment", "AUTO%") & P.where("id", P.less_than(300)) & ~P.is_null("segment")
    return opened(spark, d).where("customers", keep, columns=["id"])


@query("eng_unique_index", "SELECT c_mktsegment AS segment, max(c_custkey) AS id FROM customer GROUP BY 1")
def _(spark, d):
    return opened(spark, d, Index("segment", DataType.VARCHAR, unique=True)).scan("customers", "segment", columns=["segment", "id"])


@query("eng_views", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    opened(spark, d).register_views()
    return spark.sql("SELECT segment, count(*) AS n FROM customers GROUP BY segment")


@query("eng_catalog", "SELECT * FROM (VALUES ('customers', 'balance', 'FLOAT', false), ('customers', 'id', 'INT', true), ('customers', 'segment', 'VARCHAR', false), ('days', 'day', 'DATE', true)) AS t(\"table\", index, kind, is_primary)")
def _(spark, d):
    engine = opened(spark, d)
    engine.create_table("days", [Index("day", DataType.DATE, primary=True)])
    engine.close()
    again = Engine.open(spark, engine.log.store.root)
    rows = [(t, i.name, str(i.type), i.primary) for t in again.catalog.list_tables() for i in again.catalog.list_indexes(t)]
    return spark.createDataFrame(rows, "table string, index string, kind string, is_primary boolean")


# Writes.

@query("eng_insert", "SELECT c_custkey AS id, 'DuplicateKey' AS again, 'DuplicateKey' AS twice FROM customer WHERE c_custkey < 100")
def _(spark, d):
    engine = Engine(spark, shared_dir(spark))
    engine.create_table("customers", [ID, SEGMENT, BALANCE])
    engine.insert("customers", first(spark, d, "_seq < 100"))
    again = refused(lambda: engine.insert("customers", first(spark, d, "_seq between 99 and 120")))
    new = first(spark, d, "_seq between 130 and 140")
    twice = refused(lambda: engine.insert("customers", new.unionByName(new)))
    return engine.scan("customers", "id", columns=["id"]).select("id", F.lit(again).alias("again"), F.lit(twice).alias("twice"))


@query("eng_rejects", "SELECT 'InvalidKeyType' AS type, 'InvalidKeyType' AS missing, 'KeyMismatch' AS mismatch, 'InvalidKeyType' AS opaque, 0 AS n")
def _(spark, d):
    engine = Engine(spark, shared_dir(spark))
    engine.create_table("customers", [ID, SEGMENT])
    batch = lambda doc: spark.range(3).select(F.lit(doc).alias("_doc"), F.col("id").alias("k_id"))
    found = [refused(lambda doc=doc: engine.upsert("customers", batch(doc))) for doc in ('{"id":"1","segment":"a"}', '{"segment":"a"}', '{"id":7,"segment":"a"}', "no document")]
    return one_row(spark, "type string, missing string, mismatch string, opaque string, n int", *found, engine.versions("customers").count())


@query("eng_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer")
def _(spark, d):
    engine = opened(spark, d)
    engine.upsert("customers", first(spark, d, "_seq % 3 = 0", F.lit("NEW")))
    return engine.scan("customers", "id", columns=["id", "segment"])


@query("eng_put", "SELECT c_custkey AS id, CASE c_custkey WHEN 3 THEN 'PUT' WHEN 4 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey < 10")
def _(spark, d):
    engine = opened(spark, d)
    engine.put("customers", "id", 3, '{"id":3,"segment":"PUT","balance":1.5}')
    engine.upsert_row("customers", '{"id":4,"segment":"KEPT","balance":2.5}')
    engine.put("customers", "segment", "KEPT", '{"segment":"KEPT","balance":3.5}')
    engine.put("customers", "id", 4, '{"id":4,"segment":"MOVED","balance":3.5}')
    engine.put("customers", "id", 1_000_000, "an opaque document")
    engine.delete("customers", "id", 1_000_000)
    return engine.scan("customers", "id", P.less_than(10), columns=["id", "segment"]).union(engine.scan("customers", "segment", P.equal("KEPT"), columns=["id", "segment"]))


@query("eng_delete_where", "SELECT c_custkey AS id FROM customer WHERE NOT c_acctbal < 0")
def _(spark, d):
    engine = opened(spark, d)
    engine.delete_where("customers", "balance", P.less_than(0.0))
    return engine.scan("customers", "id", columns=["id"])


@query("eng_tombstones", "SELECT true AS deleted, false AS again, 'DuplicateKey' AS inserted, 'accepted' AS upserted, count(*) AS n FROM customer")
def _(spark, d):
    engine = opened(spark, d)
    deleted, again = engine.delete("customers", "id", 5), engine.delete("customers", "id", 5)
    row = '{"id":5,"segment":"a","balance":0.5}'
    return one_row(spark, "deleted boolean, again boolean, inserted string, upserted string, n long", deleted, again, refused(lambda: engine.insert_row("customers", row)), refused(lambda: engine.upsert_row("customers", row)), engine.table("customers").count())


# Snapshots.

@query("eng_asof", "SELECT c_custkey AS id, c_mktsegment AS before, CASE WHEN c_custkey % 2 = 0 THEN 'LATER' ELSE c_mktsegment END AS now FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 2 = 0")
def _(spark, d):
    engine = opened(spark, d)
    old = engine.log.snapshot()
    engine.upsert("customers", first(spark, d, "_seq % 2 = 0", F.lit("LATER")))
    rows = engine.where("customers", ~P.where("id", P.less_than(0)))
    gone = rows.where("id % 5 = 0 and id % 2 = 1").select(F.lit(0).cast("long").alias("_seq"), *(F.col(c).alias(f"k_{c}") for c in _COLUMNS), F.lit(None).cast("string").alias("_doc"), F.lit("DELETE").alias("_type"))
    engine.commit({"customers": gone})
    then = engine.scan("customers", "id", snapshot=old, columns=["id", "segment"]).withColumnRenamed("segment", "before")
    return then.join(engine.scan("customers", "id", columns=["id", "segment"]).withColumnRenamed("segment", "now"), "id")


@query("eng_isolation", "SELECT count(*) AS repeatable, count(*) + 1 AS committed, count(*) + 1 AS now FROM customer")
def _(spark, d):
    engine = opened(spark, d)
    with engine.begin_read() as one, engine.begin_read(READ_COMMITTED) as two:
        engine.upsert_row("customers", '{"id":-1,"segment":"a","balance":0.5}')
        return one_row(spark, "repeatable long, committed long, now long", one.scan("customers", "id").count(), two.scan("customers", "id").count(), engine.table("customers").count())


@query("eng_moved_key", "SELECT c_custkey AS id, 'old' AS seen FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1")
def _(spark, d):
    engine = opened(spark, d)
    with engine.begin_read() as reader:
        engine.upsert("customers", first(spark, d, "_seq % 2 = 0", F.lit("MOVED")))
        old = reader.scan("customers", "segment", P.equal("BUILDING"), columns=["id"])
        return old.withColumn("seen", F.lit("old")).union(engine.scan("customers", "segment", P.equal("BUILDING"), columns=["id"]).withColumn("seen", F.lit("new")))


@query("eng_versions_by_lsn", "SELECT c_custkey AS id, 'ended' AS version FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'created' FROM customer WHERE c_custkey % 4 = 0")
def _(spark, d):
    engine = opened(spark, d)
    lsn = engine.upsert("customers", first(spark, d, "_seq % 4 = 0", F.lit("LATER"))).lsn
    rows = lambda df, name: df.select(F.col("k_id").alias("id"), F.lit(name).alias("version"))
    return rows(engine.versions_ended_at("customers", lsn), "ended").union(rows(engine.versions_created_at("customers", lsn), "created"))


# Transactions.

@query("eng_tx_commit", "SELECT c_custkey AS id, CASE WHEN c_custkey < 100 THEN 'TX' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey <> 200")
def _(spark, d):
    engine = opened(spark, d)
    tx = engine.begin_write()
    for k in range(100):
        tx.put("customers", "id", k, f'{{"id":{k},"segment":"TX","balance":0.5}}')
    tx.delete("customers", "id", 200)
    tx.put("customers", "id", -5, '{"id":-5,"segment":"TX","balance":0.5}')
    tx.delete("customers", "id", -5)
    tx.commit()
    return engine.scan("customers", "id", columns=["id", "segment"])


@query("eng_tx_own_writes", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey >= 20 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey < 20")
def _(spark, d):
    engine = opened(spark, d)
    tx = engine.begin_write()
    for k in range(20):
        tx.put("customers", "id", k, f'{{"id":{k},"segment":"BUILDING","balance":0.5}}')
    return tx.scan("customers", "segment", P.equal("BUILDING")).select("id")


@query("eng_tx_rollback", f"{_PLAIN}")
def _(spark, d):
    engine = opened(spark, d)
    tx = engine.begin_write()
    tx.put("customers", "id", 1, '{"id":1,"segment":"GONE","balance":0.5}')
    tx.rollback()
    return engine.scan("customers", "id", columns=_COLUMNS)


@query("eng_tx_conflict", "SELECT 'SerializationConflict' AS late, 'ABORTED' AS state, 'SerializationConflict' AS other_driver, 'B' AS segment")
def _(spark, d):
    engine = opened(spark, d)
    other = Engine(spark, engine.log.store.root)
    doc = lambda s: f'{{"id":1,"segment":"{s}","balance":0.5}}'
    one, two, three = engine.begin_write(), engine.begin_write(), other.begin_write()
    for tx in (one, two, three):
        tx.get("customers", "id", 1)
    three.put("customers", "id", 1, doc("C"))
    one.put("customers", "id", 1, doc("B"))
    one.commit()
    late, state = refused(lambda: two.put("customers", "id", 1, doc("D"))), two.state
    return one_row(spark, "late string, state string, other_driver string, segment string", late, state, refused(three.commit), engine.scan("customers", "id", P.equal(1)).first()["segment"])


# Recovery.

def _lost(engine: Engine, sf_dir: str, condition: str) -> int:
    """What a writer leaves that dies after writing its rows and before publishing them; gives its number."""
    lsn = engine.log.claim()
    t = engine.table_of("customers")
    rows = engine.prepared("customers", first(engine.spark, sf_dir, condition, F.lit("LOST"))).drop("_problem").withColumns({"_type": F.lit("UPSERT"), "_lsn": F.lit(lsn), "_tx_id": F.lit(None).cast("long")})
    rows.withColumn("_sum", t.checksum()).select(*t.schema().names).write.parquet(engine.log.store.url(f"log/customers/{lsn:020d}-lost"))
    return lsn


@query("rec_engine_undo", "SELECT c_custkey AS id, c_custkey < 100 AS restored, CASE WHEN c_custkey < 100 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 3 = 0")
def _(spark, d):
    engine = Engine(spark, shared_dir(spark))
    engine.create_table("customers", [ID, SEGMENT, BALANCE])
    engine.upsert("customers", first(spark, d, "_seq < 100"))
    _lost(engine, d, "_seq % 3 = 0")
    engine.recover()
    clrs = engine.wal().where("type = 'CLR'")
    return clrs.select(F.get_json_object("key", "$.id").cast("long").alias("id"), F.col("doc").isNotNull().alias("restored"), F.get_json_object("doc", "$.segment").alias("segment"))


@query("rec_engine_state", f"SELECT *, true AS aborted, 0 AS left_over FROM ({_PLAIN})")
def _(spark, d):
    engine = opened(spark, d)
    lost = _lost(engine, d, "_seq % 3 = 0")
    again = Engine(spark, engine.log.store.root)
    aborted, late = again.recover(), refused(lambda: engine.log.publish(Commit(lost, "DATA")))
    ok = aborted == [lost] and late == CommitAborted.__name__ and again.recover() == []
    tasks = R.undo_tasks(again.wal()).count()
    state = R.final_state(again.wal(), ["table", "key"], ["doc"], tables=["customers"])
    fields = F.from_json("doc", "id long, segment string, balance double")
    return state.select(fields.alias("x")).select("x.*", F.lit(ok).alias("aborted"), F.lit(tasks).alias("left_over"))


@query("rec_engine_redo", "SELECT c_custkey AS id, 1 AS lsn FROM customer UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 2 = 0")
def _(spark, d):
    engine = opened(spark, d)
    engine.upsert("customers", first(spark, d, "_seq % 2 = 0"))
    _lost(engine, d, "_seq < 50")
    wal = engine.wal(engine.log.pending())
    return R.redo_set(wal.unionByName(wal)).select(F.get_json_object("key", "$.id").cast("long").alias("id"), F.col("lsn").cast("int").alias("lsn"))


@query("rec_engine_analysis", "SELECT 'COMMITTED' AS status, 7 AS changes UNION ALL SELECT 'ACTIVE', (SELECT count(*) FROM customer WHERE c_custkey < 50)")
def _(spark, d):
    engine = opened(spark, d)
    tx = engine.begin_write()
    for k in range(7):
        tx.put("customers", "id", k, f'{{"id":{k},"segment":"TX","balance":0.5}}')
    tx.commit()
    _lost(engine, d, "_seq < 50")
    wal = engine.wal(engine.log.pending())
    return wal.where("table is not null").join(R.transactions(wal), "tx_id").groupBy("status").agg(F.count("*").alias("changes"))


@query("rec_engine_log", "SELECT 'UPSERT' AS type, count(*) AS n FROM customer UNION ALL SELECT 'COMMIT', 2 UNION ALL SELECT 'DELETE', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'CHECKPOINT', 1")
def _(spark, d):
    engine = opened(spark, d)
    engine.delete_where("customers", "balance", P.less_than(0.0))
    maintenance.checkpoint(engine)
    return engine.wal().groupBy("type").agg(F.count("*").alias("n"))


# Maintenance.

@query("maint_vacuum_engine", "SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'LATE' ELSE 'V2' END AS segment, (SELECT count(*) FROM customer) AS gone, 0 AS again FROM customer UNION ALL SELECT -3, 'LATE', (SELECT count(*) FROM customer), 0")
def _(spark, d):
    """A driver claims a number, another commits and vacuums, and the first publishes: its commit stays, below newer versions."""
    engine = opened(spark, d)
    late = Engine(spark, engine.log.store.root)
    made = []

    def between(staged):
        if not made:
            made.append(engine.upsert("customers", customers(spark, d, F.lit("V2"))).lsn)
            made.append(maintenance.vacuum(engine, "customers"))

    late.commit({"customers": late.rows("customers", [("UPSERT", {"id": -3, "segment": "LATE", "balance": 0.5}, '{"id":-3,"segment":"LATE","balance":0.5}')])}, check=between)
    late.upsert_row("customers", '{"id":7,"segment":"LATE","balance":0.5}')
    more = maintenance.vacuum(late, "customers") - 1  # the row that has just been replaced
    again = Engine(spark, engine.log.store.root)
    out = again.scan("customers", "id", columns=["id", "segment"])
    return out.select("id", "segment", F.lit(made[1]).cast("long").alias("gone"), F.lit(more).alias("again"))


@query("maint_vacuum_readers", "SELECT c_custkey AS id, c_mktsegment AS seen FROM customer")
def _(spark, d):
    """A reader of another driver goes on seeing what it saw."""
    engine = opened(spark, d)
    with Engine(spark, engine.log.store.root).begin_read() as reader:
        engine.upsert("customers", customers(spark, d, F.lit("V2")))
        maintenance.vacuum(engine, "customers")
        return stored(reader.scan("customers", "id", columns=["id", "segment"]).withColumnRenamed("segment", "seen"))


@query("maint_checkpoint", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'LATER' ELSE c_mktsegment END AS segment, 1 AS held FROM customer WHERE c_custkey <> 11")
def _(spark, d):
    engine = opened(spark, d)
    held = maintenance.checkpoint(engine)
    engine.upsert("customers", first(spark, d, "_seq % 2 = 0", F.lit("LATER")))
    engine.delete("customers", "id", 11)
    return maintenance.replayed(engine, "customers").select(F.col("k_id").alias("id"), F.col("k_segment").alias("segment"), F.lit(held).alias("held"))


@query("maint_archive", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'LATER' ELSE c_mktsegment END AS segment, 1 AS moved, 1 AS back FROM customer")
def _(spark, d):
    engine = opened(spark, d)
    maintenance.checkpoint(engine)
    engine.upsert("customers", first(spark, d, "_seq % 2 = 0", F.lit("LATER")))
    moved, back = len(maintenance.archive(engine)), len(maintenance.restore_archived(engine))
    return engine.scan("customers", "id", columns=["id", "segment"]).select("id", "segment", F.lit(moved).alias("moved"), F.lit(back).alias("back"))


@query("maint_truncate", "SELECT c_custkey AS id, CASE WHEN c_custkey < 12 THEN 'V' || c_custkey ELSE c_mktsegment END AS segment, 13 AS upto, 0 AS commit_files, 14 AS next_lsn FROM customer")
def _(spark, d):
    engine = opened(spark, d)
    for k in range(12):
        engine.put("customers", "id", k, f'{{"id":{k},"segment":"V{k}","balance":0.5}}')
    upto = maintenance.truncate(engine)
    files = len(engine.log.store.names("commits"))
    again = Engine(spark, engine.log.store.root)
    lsn = again.log.claim()
    again.recover()
    return again.scan("customers", "id", columns=["id", "segment"]).select("id", "segment", F.lit(upto).alias("upto"), F.lit(files).alias("commit_files"), F.lit(lsn).alias("next_lsn"))


@query("maint_compact", "SELECT c_custkey AS id, CASE WHEN c_custkey < 5 THEN 'V' || c_custkey ELSE c_mktsegment END AS segment, 6 AS folders, (SELECT count(*) FROM customer) + 5 AS versions FROM customer")
def _(spark, d):
    engine = opened(spark, d)
    for k in range(5):
        engine.put("customers", "id", k, f'{{"id":{k},"segment":"V{k}","balance":0.5}}')
    folders = maintenance.compact(engine, "customers")
    return engine.scan("customers", "id", columns=["id", "segment"]).select("id", "segment", F.lit(folders).alias("folders"), F.lit(engine.versions("customers").count()).cast("long").alias("versions"))


@query("maint_log_checksums", "SELECT count(*) AS verified, 'CorruptLog' AS damaged FROM customer")
def _(spark, d):
    engine = opened(spark, d)
    t = engine.table_of("customers")
    n = engine.log.verify(t)
    lsn = engine.log.claim()
    rows = engine.versions("customers").limit(5).withColumns({"_doc": F.concat("_doc", F.lit(" ")), "_lsn": F.lit(lsn)})
    rows.write.parquet(engine.log.store.url(f"log/customers/{lsn:020d}-bad"))
    engine.log.publish(Commit(lsn, "DATA", None, (("customers", f"log/customers/{lsn:020d}-bad"),)))
    return one_row(spark, "verified long, damaged string", n, refused(lambda: engine.log.verify(t)))


@query("maint_backup_engine", f"SELECT *, true AS verified FROM ({_PLAIN})")
def _(spark, d):
    engine = opened(spark, d)
    place, root = shared_dir(spark), shared_dir(spark)
    n = backup.backup(engine, place)
    engine.put("customers", "id", 1, '{"id":1,"segment":"LATER","balance":0.5}')
    ok = backup.verify(spark, place) == n == backup.restore(spark, place, root)
    return Engine(spark, root).scan("customers", "id", columns=_COLUMNS).withColumn("verified", F.lit(ok))


@query("maint_backup_damage", "SELECT 'commits' AS path, true AS listed, true AS there, 'BackupError' AS verified UNION ALL SELECT 'extra', false, true, 'BackupError' UNION ALL SELECT 'catalog', true, false, 'BackupError'")
def _(spark, d):
    engine, place = opened(spark, d), shared_dir(spark)
    backup.backup(engine, place)
    store = Store(spark, place)
    store.write(f"commits/{1:020d}.json", "{}")
    store.write("extra/file", "x")
    for name in store.names("catalog"):
        store.delete(f"catalog/{name}")
    found = backup.differences(spark, place)
    verified = refused(lambda: backup.verify(spark, place))
    assert verified == BackupError.__name__
    return found.select(F.substring_index("path", "/", 1).alias("path"), F.col("listed").isNotNull().alias("listed"), F.col("there").isNotNull().alias("there"), F.lit(verified).alias("verified")).distinct()


@query("crypto_engine", "SELECT c_custkey AS id, CASE WHEN c_custkey = 1 THEN 'PUT' ELSE c_mktsegment END AS segment, 0 AS in_clear, 'DecryptionError' AS old_key FROM customer")
def _(spark, d):
    key = bytes(range(32))
    engine = opened(spark, d, SEGMENT, key=key)
    engine.rotate_master_key(bytes(32))
    engine.put("customers", "id", 1, '{"id":1,"segment":"PUT"}')
    old = refused(lambda: Engine(spark, engine.log.store.root, key))
    clear = engine.versions("customers").where("_doc like '%segment%'").count()
    again = Engine(spark, engine.log.store.root, bytes(32))
    return again.scan("customers", "id").select("id", F.get_json_object("_doc", "$.segment").alias("segment"), F.lit(clear).alias("in_clear"), F.lit(old).alias("old_key"))


@query("stream_engine", "SELECT c_custkey AS id, 1 AS lsn FROM customer UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 10 = 0")
def _(spark, d):
    """A stream of documents goes into a table in commits, and the table's log is followed into another table."""
    source, copy = opened(spark, d), Engine(spark, shared_dir(spark))
    copy.create_table("seen", [Index("lsn", DataType.INT), Index("key", DataType.VARCHAR, primary=True), Index("id", DataType.INT)])
    incoming = shared_dir(spark)
    first(spark, d, "_seq % 10 = 0").select("_doc").write.parquet(incoming)
    stream = spark.readStream.schema("_doc string").parquet(incoming)
    tail.upserting(source, "customers", stream, shared_dir(spark)).trigger(availableNow=True).start().awaitTermination(120)

    def keep(rows: DataFrame, n: int) -> None:
        doc = F.to_json(F.struct(F.concat_ws("-", "_lsn", "k_id").alias("key"), F.col("_lsn").alias("lsn"), F.col("k_id").alias("id")))
        copy.upsert("seen", rows.select(doc.alias("_doc")), f"batch {n}")

    tail.follow(source, "customers", keep, shared_dir(spark), 1).trigger(availableNow=True).start().awaitTermination(120)
    return copy.scan("seen", "key", columns=["id", "lsn"]).select("id", F.col("lsn").cast("int").alias("lsn"))


@query("eng_dates", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-12-31'")
def _(spark, d):
    engine = Engine(spark, shared_dir(spark))
    engine.create_table("orders", [ID, Index("day", DataType.DATE), Index("done", DataType.BOOL)])
    rows = spark.read.parquet(f"{d}/orders.parquet")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    engine.insert("orders", rows.select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), day.alias("day"), (F.col("o_orderstatus") == "F").alias("done"))).alias("_doc")))
    return engine.scan("orders", "day", P.between(dt.datetime(1996, 3, 1), dt.datetime(1996, 12, 31)), columns=["id"])
