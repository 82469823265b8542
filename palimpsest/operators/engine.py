"""The engine: tables of documents over a change log, read at snapshots and written in atomic commits.

Batch operators take DataFrames and stay distributed: a batch is evaluated once, as it is written; what was written is checked
and then published. Rows written one by one are checked at the driver. Secondary indexes hold all rows of a key; an index
declared ``unique`` shows the last written row of each key alone.

Several drivers may use a root: commits, the catalog and the keys change by exclusive creation of the next version, and
readers' leases tell all of them which files are still read. Key locks are of one driver.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Index, Table
from ..errors import DuplicateKey, EngineClosed, InvalidKeyType, KeyMismatch
from ..functions import documents as D
from ..functions.crypto import KeyStore, NoCipher
from ..functions.predicates import Condition, Filter, between, equal
from ..plans import recovery as R
from ..plans import versions as V
from ..sources.changelog import ChangeLog, Commit, Snapshot
from .locks import LockManager

READ_COMMITTED, REPEATABLE_READ = "READ COMMITTED", "REPEATABLE READ"
#: Seconds without being published after which ``Engine.open`` takes a claimed commit's writer for lost.
LOST_AFTER = 3600


def generate_key() -> str:
    """A version 7 UUID: 48 bits of milliseconds, then random bits, so that later keys sort after earlier ones."""
    ms, rest = int(time.time() * 1000), uuid.uuid4().int & ((1 << 74) - 1)
    return str(uuid.UUID(int=(ms << 80) | (7 << 76) | ((rest >> 62) << 64) | (2 << 62) | (rest & ((1 << 62) - 1))))


class Reader:
    """A read transaction. Repeatable read keeps its snapshot; read committed takes a new one for each operation."""

    def __init__(self, engine: Engine, isolation: str = REPEATABLE_READ):
        engine.check_open()
        self.engine, self.isolation = engine, isolation
        # A lease at what is newest before the snapshot is taken holds back whatever the snapshot will need.
        self._lease = engine.log.lease(engine.log.snapshot().lsn)
        self._snapshot = engine.log.snapshot()
        engine.active.add(self)

    @property
    def begin_lsn(self) -> int:
        return self._snapshot.lsn

    def snapshot(self) -> Snapshot:
        return self.engine.log.snapshot() if self.isolation == READ_COMMITTED else self._snapshot

    def get(self, table: str, index: str, key: object) -> str | None:
        return self.engine.get(table, index, key, self.snapshot())

    def scan(self, table: str, index: str, condition: Condition | None = None, columns: list[str] | None = None) -> DataFrame:
        return self.engine.scan(table, index, condition, self.snapshot(), columns)

    def is_visible(self, lsn: int) -> bool:
        """Whether the commit of that number is among those that the snapshot sees."""
        snapshot = self.snapshot()
        return lsn <= snapshot.floor or any(c.lsn == lsn for c in snapshot.commits)

    def close(self) -> None:
        if self in self.engine.active:
            self.engine.active.discard(self)
            self.engine.log.store.delete(self._lease)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Engine:
    def __init__(self, spark: SparkSession, root: str, master_key: bytes | None = None):
        """Opens the store at ``root``, or makes one; what was committed is there at once. With a master key new tables are encrypted."""
        self.spark = spark
        self.log = ChangeLog(spark, root)
        self.cipher = KeyStore(spark, master_key, json.loads(self.log.store.newest("keys")[1] or "{}")) if master_key is not None else NoCipher()
        self.catalog = Catalog(master_key is not None)
        self._catalog_version = 0
        self._reload()
        self.locks = LockManager()
        self.active: set[Reader] = set()
        self.write_lock = threading.RLock()
        self.closed = False

    @classmethod
    def open(cls, spark: SparkSession, root: str, master_key: bytes | None = None) -> Engine:
        """Opens a store and undoes what writers left that have been lost for ``LOST_AFTER`` seconds."""
        engine = cls(spark, root, master_key)
        engine.recover(LOST_AFTER)
        return engine

    def check_open(self) -> None:
        if self.closed:
            raise EngineClosed(self.log.store.root)

    def close(self) -> None:
        """Ends all readers; harmless if closed already. What was committed stays."""
        for reader in list(self.active):
            reader.close()
        self.closed = True

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # Catalog

    def _reload(self) -> None:
        version, text = self.log.store.newest("catalog")
        if version > self._catalog_version:
            self.catalog, self._catalog_version = Catalog.from_json(text, self.catalog.encrypt), version
            if isinstance(self.cipher, KeyStore):
                self.cipher.merge(json.loads(self.log.store.newest("keys")[1] or "{}"))

    def create_table(self, name: str, indexes: list[Index], log: str | None = None) -> Table:
        """Declares a table; ``log``: its folder in the log, which tables may share a name prefix of but not use together."""
        self.check_open()
        while True:
            self._reload()
            version, tables = self._catalog_version, dict(self.catalog.tables)
            try:
                table = self.catalog.create(name, indexes, name if log is None else log)
                if table.encrypted:
                    self._keep_keys(name)
                if self.log.store.succeed("catalog", version, self.catalog.to_dict()):
                    self._catalog_version = version + 1
                    return table
            except BaseException:
                self.catalog.tables = tables
                raise
            self.catalog.tables = tables  # another driver has changed the catalog meanwhile

    def _keep_keys(self, *new: str) -> None:
        """Writes the wrapped keys' next version, with those that other drivers have added."""
        while True:
            version, text = self.log.store.newest("keys")
            self.cipher.merge(json.loads(text or "{}"))
            for table in new:
                self.cipher.make(table)
            if self.log.store.succeed("keys", version, self.cipher.wrapped):
                return

    def set_encryption(self, encrypt: bool) -> None:
        """Whether tables made from now on are encrypted, which takes a master key."""
        if encrypt and not isinstance(self.cipher, KeyStore):
            raise ValueError("the engine was opened without a master key")
        self.catalog.encrypt = encrypt

    def rotate_master_key(self, master: bytes) -> None:
        version, text = self.log.store.newest("keys")
        self.cipher.merge(json.loads(text or "{}"))
        self.cipher.rotate(master)
        if not self.log.store.succeed("keys", version, self.cipher.wrapped):
            raise RuntimeError("another driver has changed the keys meanwhile; rotate again")

    def register_views(self, snapshot: Snapshot | None = None) -> None:
        """Temporary views of all tables at a snapshot, for SQL."""
        for name in self.catalog.list_tables():
            self.table(name, snapshot).createOrReplaceTempView(name)

    def table_of(self, name: str) -> Table:
        self.check_open()
        if name not in self.catalog.tables:
            self._reload()
        return self.catalog.table(name)

    # Reads

    def begin_read(self, isolation: str = REPEATABLE_READ) -> Reader:
        return Reader(self, isolation)

    def _aad(self, t: Table) -> Column:
        """What binds a document to its row and version."""
        return F.concat_ws("|", F.lit(t.name), F.col(t.primary.column).cast("string"), F.col("_lsn").cast("string"), F.col("_seq").cast("string"))

    def versions(self, table: str, snapshot: Snapshot | None = None) -> DataFrame:
        """The table's log: every version that the snapshot's commits hold."""
        return self.log.rows(self.table_of(table), snapshot or self.log.snapshot())

    def versions_created_at(self, table: str, lsn: int) -> DataFrame:
        """Versions that the commit of this number wrote, with valid_from and valid_to."""
        return self._spans(table).where((F.col("valid_from") == lsn) & (F.col("_type") != "DELETE"))

    def versions_ended_at(self, table: str, lsn: int) -> DataFrame:
        """Versions that the commit of this number replaced or deleted."""
        return self._spans(table).where((F.col("valid_to") == lsn) & (F.col("_type") != "DELETE"))

    def _spans(self, table: str) -> DataFrame:
        t = self.table_of(table)
        return V.intervals(self.versions(table), [t.primary.column], ["_lsn", "_seq"])

    def table(self, table: str, snapshot: Snapshot | None = None, below: Column | None = None, columns: list[str] | None = None) -> DataFrame:
        """The rows that a snapshot sees: key columns by their names, _doc, and the _lsn and _seq that wrote each.

        below: a condition on the primary key. columns: the index names and ``_doc`` that are wanted; others aren't read.
        """
        t = self.table_of(table)
        wanted = [i for i in t.indexes if columns is None or i.name in columns]
        with_doc = columns is None or "_doc" in columns
        carried = ["_lsn", "_seq", *(i.column for i in wanted), *(["_doc"] if with_doc else [])]
        rows = V.latest(self.versions(table, snapshot), [t.primary.column], ["_lsn", "_seq"], columns=carried, below=below)
        doc = [self.cipher.decrypted(F.col("_doc"), t.name, self._aad(t)).alias("_doc") if t.encrypted else F.col("_doc")] if with_doc else []
        return rows.select(*(F.col(i.column).alias(i.name) for i in wanted), *doc, "_lsn", "_seq")

    def scan(self, table: str, index: str, condition: Condition | None = None, snapshot: Snapshot | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows whose key meets the condition (all without one), ascending by key. Conditions on the primary key reach the Parquet scan.

        columns: the index names and ``_doc`` that are wanted; others aren't read.
        """
        i = self.table_of(table).index(index)
        below = None
        if condition is not None:
            condition.check(i.type)
            below = condition.column(F.col(i.column)) if i.primary else None
        rows = self.table(table, snapshot, below, None if columns is None else [*columns, index])
        if i.unique and not i.primary:
            rows = V.last_writers(rows, i.name, ["_lsn", "_seq"])
        rows = rows.where(F.col(i.name).isNotNull())
        if condition is not None and not i.primary:
            rows = rows.where(condition.column(F.col(i.name)))
        rows = rows.orderBy(i.name)
        return rows if columns is None else rows.select(*columns)

    def where(self, table: str, keep: Filter, snapshot: Snapshot | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows that meet a condition over any of the table's indexes, ascending by primary key. Parts on the primary key alone reach the Parquet scan."""
        t = self.table_of(table)
        keep.check({i.name: i.type for i in t.indexes})
        below = keep.only({t.primary.name})
        rows = self.table(table, snapshot, None if below is None else below.column(lambda n: F.col(t.index(n).column)), None if columns is None else [*columns, t.primary.name, *keep.names()])
        rows = rows.where(keep.column(F.col)).orderBy(t.primary.name)
        return rows if columns is None else rows.select(*columns)

    def range_scan(self, table: str, index: str, low: object, high: object, snapshot: Snapshot | None = None) -> DataFrame:
        return self.scan(table, index, between(low, high), snapshot)

    def get(self, table: str, index: str, key: object, snapshot: Snapshot | None = None) -> str | None:
        """One document with the key (the last written, if several have it), or None."""
        row = self.scan(table, index, equal(key), snapshot).orderBy(F.desc("_lsn"), F.desc("_seq")).select("_doc").first()
        return None if row is None else row["_doc"]

    # Writes

    def row(self, table: str, doc: str | None, keys: dict[str, object] | None = None, all_keys: bool = True) -> dict[str, object]:
        """One document's keys by index, from its fields and as given, under the rules of ``prepared``."""
        t, keys = self.table_of(table), keys or {}
        for name, value in keys.items():
            t.index(name).type.check(value)
        fields, out = D.fields_of(doc), {}
        zone = self.spark.conf.get("spark.sql.session.timeZone") if fields is not None and any(i.type.value == "DATE" for i in t.indexes) else "UTC"
        for i in t.indexes:
            given, own = keys.get(i.name), D.MISSING if fields is None else D.key_in(fields, i, zone)
            if own is None:
                raise InvalidKeyType(f"{table}.{i.name}")
            if own is not D.MISSING and given is not None and own != given:
                raise KeyMismatch(f"{table}.{i.name}")
            out[i.name] = own if own is not D.MISSING else given if fields is None or not all_keys else None
            if out[i.name] is None and (all_keys or i.primary):
                raise InvalidKeyType(f"{table}.{i.name}")
        return out

    def rows(self, table: str, made: list[tuple[str, dict[str, object], str | None]]) -> DataFrame:
        """Log rows (type, keys by index, document) held by the driver, in their order."""
        t = self.table_of(table)
        schema = ", ".join(["_seq long", "_type string", *(f"`{i.column}` {i.type.spark.simpleString()}" for i in t.indexes), "_doc string"])
        return self.spark.createDataFrame([(k, kind, *(keys.get(i.name) for i in t.indexes), doc) for k, (kind, keys, doc) in enumerate(made)], schema).coalesce(1)

    def prepared(self, table: str, rows: DataFrame, all_keys: bool = True) -> DataFrame:
        """A batch (_doc, optionally _seq and key columns ``k_<index>``) with every key derived from the document, and ``_problem``, null where a row is good.

        JSON documents must hold each indexed field with the index's type, and given keys must equal the fields; for opaque
        documents all keys must be given. all_keys=False asks for the primary key alone.
        """
        t = self.table_of(table)
        have = set(rows.columns)
        if "_seq" not in have:
            rows = rows.withColumn("_seq", F.monotonically_increasing_id())
        json_doc = D.is_json(F.col("_doc"))
        problem = F.lit(None).cast("string")
        out = []
        for i in t.indexes:
            given = F.col(i.column).cast(i.type.spark) if i.column in have else F.lit(None).cast(i.type.spark)
            derived = D.key_of(F.col("_doc"), i)
            needed = F.lit(all_keys or i.primary)
            key = F.when(json_doc, derived).otherwise(given)
            if not all_keys:
                key = F.coalesce(key, given)
            problem = F.coalesce(problem, F.when(json_doc & given.isNotNull() & derived.isNotNull() & ~given.eqNullSafe(derived), F.lit(f"mismatch:{i.name}")), F.when(json_doc & derived.isNull() & D.has_field(F.col("_doc"), i.name), F.lit(f"type:{i.name}")), F.when(needed & key.isNull(), F.lit(f"type:{i.name}")))
            out.append(key.alias(i.column))
        return rows.select("_seq", *out, "_doc", problem.alias("_problem"))

    @staticmethod
    def _refuse(table: str, staged: DataFrame) -> None:
        """Fails on the first bad row of a batch as it was written."""
        if "_problem" in staged.columns:
            bad = staged.where("_problem is not null").select("_problem").first()
            if bad is not None:
                kind, _, name = bad["_problem"].partition(":")
                raise (KeyMismatch if kind == "mismatch" else InvalidKeyType)(f"{table}.{name}")

    def _sealed(self, t: Table, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_doc", self.cipher.encrypted(F.col("_doc"), t.name, self._aad(t))) if t.encrypted else rows

    def commit(self, changes: dict[str, DataFrame], tx_id: int | None = None, check: Callable[[dict[str, DataFrame]], None] | None = None, source: str | None = None) -> Commit:
        """Publishes rows with ``_type``, of any number of tables, at once. check: a last look at the written rows, by table."""

        def checked(staged: dict[str, DataFrame]) -> None:
            for name, df in staged.items():
                self._refuse(name, df)
            if check:
                check(staged)

        return self.log.append({self.table_of(name): rows for name, rows in changes.items()}, tx_id, seal=self._sealed, check=checked, source=source)

    def insert(self, table: str, rows: DataFrame) -> Commit:
        """Inserts new rows; fails as a whole if a primary key repeats in the batch or ever was in the table, deleted ones included."""
        return self._insert(table, self.prepared(table, rows))

    def _insert(self, table: str, rows: DataFrame) -> Commit:
        t = self.table_of(table)
        key = t.primary.column

        def new(staged: dict[str, DataFrame]) -> None:
            own = staged[table].select(key)
            twice = own.groupBy(key).count().where("count > 1").select(key)
            known = own.join(self.versions(table).select(key), key, "left_semi")
            clash = twice.unionByName(known).first()
            if clash is not None:
                raise DuplicateKey(f"{table}.{t.primary.name} = {clash[0]!r}")

        with self.write_lock:
            return self.commit({table: rows.withColumn("_type", F.lit("INSERT"))}, check=new)

    def upsert(self, table: str, rows: DataFrame, source: str | None = None) -> Commit:
        """Inserts or replaces whole rows; of rows of one key in the batch the last (by ``_seq``) counts. source: names the batch in its commit."""
        rows = self.prepared(table, rows)
        with self.write_lock:
            return self.commit({table: rows.withColumn("_type", F.lit("UPSERT"))}, source=source)

    def insert_row(self, table: str, doc: str, keys: dict[str, object] | None = None) -> Commit:
        with self._locked(table, keys):
            return self._insert(table, self.rows(table, [("INSERT", self.row(table, doc, keys), doc)]))

    def upsert_row(self, table: str, doc: str, keys: dict[str, object] | None = None) -> Commit:
        with self._locked(table, keys):
            return self.commit({table: self.rows(table, [("UPSERT", self.row(table, doc, keys), doc)])})

    def put(self, table: str, index: str, key: object, doc: str) -> Commit:
        """Upsert by one index: a JSON document must hold that field, equal to the key; other keys come from the document as far as it has them.

        By a secondary index the row is the one that has the key, unless the document names its primary key itself.
        """
        with self._locked(table, {index: key}):
            return self.commit({table: self.rows(table, [("UPSERT", self.put_keys(table, index, key, doc), doc)])})

    def put_keys(self, table: str, index: str, key: object, doc: str, find: Callable[[], object] | None = None) -> dict[str, object]:
        """The keys of a row that ``put`` writes. find: gives the primary key of the row that has a secondary key, None if none has."""
        t = self.table_of(table)
        i = t.index(index)
        i.type.check(key)
        fields = D.fields_of(doc)
        if fields is not None and i.name not in fields:
            raise InvalidKeyType(f"{table}.{index}")
        given = {index: key}
        if not i.primary and (fields is None or t.primary.name not in fields):
            row = None if find else self.scan(table, index, equal(key), columns=[t.primary.name]).first()
            own = find() if find else None if row is None else row[0]
            if own is None:
                raise InvalidKeyType(f"{table}.{t.primary.name}")
            given[t.primary.name] = own
        return self.row(table, doc, given, all_keys=False)

    def delete(self, table: str, index: str, key: object) -> bool:
        """Deletes the rows with the key; False, and nothing is written, if there are none."""
        with self._locked(table, {index: key}):
            rows = self.delete_rows(table, index, equal(key))
            if rows.first() is None:
                return False
            self.commit({table: rows})
            return True

    def delete_where(self, table: str, index: str, condition: Condition) -> Commit:
        """Deletes all rows that meet a condition."""
        with self.write_lock:
            return self.commit({table: self.delete_rows(table, index, condition)})

    def delete_rows(self, table: str, index: str, condition: Condition) -> DataFrame:
        t = self.table_of(table)
        found = self.scan(table, index, condition, columns=[i.name for i in t.indexes])
        return found.select(F.lit(0).cast("long").alias("_seq"), *(F.col(i.name).alias(i.column) for i in t.indexes), F.lit(None).cast("string").alias("_doc"), F.lit("DELETE").alias("_type"))

    def _locked(self, table: str, keys: dict[str, object] | None):
        return self.locks.held(-threading.get_ident(), [(table, index, key) for index, key in sorted((keys or {}).items())], self.write_lock)

    def begin_write(self, isolation: str = REPEATABLE_READ):
        from .transactions import WriteTransaction

        return WriteTransaction(self, isolation)

    # Recovery

    def wal(self, lost: list[int] | None = None) -> DataFrame:
        """The log of all tables as the recovery plans take it; lost: numbers whose unpublished rows are shown too."""
        self._reload()
        return self.log.as_wal(list(self.catalog.tables.values()), self.log.snapshot(), lost)

    def recover(self, older_than: float = 0) -> list[int]:
        """Undoes what lost writers left; gives the numbers that it aborted. Undoing again finds nothing to do.

        Analysis: rows of claimed numbers that nobody published are changes of transactions without an end. Redo: readers
        derive rows from published commits, so there is nothing to apply again. Undo: for each change, newest first, a
        compensation says what the row goes back to; an ABORT publishes a number's compensations and takes its place in the
        log, so its writer can't publish any more; its files go. older_than: seconds that a claim must be old.
        """
        self._reload()
        lost = self.log.pending(older_than)
        if not lost:
            return []
        tables = list(self.catalog.tables.values())
        left = {lsn: [f for t in tables for f in self.log.unpublished(t, [lsn])] for lsn in lost}
        readable = [lsn for lsn in lost if left[lsn] and all(self._whole(f) for f in left[lsn])]
        undone = None
        if readable:
            undone = R.compensations(self.wal(readable), ["table", "key"], ["doc"])
            undone = undone.select("tx_id", F.col("lsn").alias("undone_lsn"), F.col("seq").alias("undone_seq"), "undo_next_lsn", "table", "key", "restored", F.col("prior_doc").alias("doc"))
        aborted = []
        for lsn in lost:
            folder = None
            if lsn in readable:
                rows = undone.where(F.col("undone_lsn") == lsn)
                folder = self.log.write_compensations(lsn, rows.withColumn("lsn", F.lit(lsn)).withColumn("seq", F.row_number().over(R.newest_first())))
            if self.log.give_up(lsn, compensated=folder):
                aborted.append(lsn)
                for f in left[lsn]:
                    self.log.store.delete(f)
        return aborted

    def _whole(self, folder: str) -> bool:
        """Whether a writer finished a folder: Spark marks those that it did."""
        return self.log.store.exists(f"{folder}/_SUCCESS")

    def min_active_lsn(self) -> int:
        """The oldest begin of an open reader, of any driver, or what is newest now."""
        return min(self.log.leased(), default=self.log.snapshot().lsn)
