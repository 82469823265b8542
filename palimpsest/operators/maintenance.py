"""Vacuum, compaction, checkpoints, and archiving and truncation of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import versions as V
from ..sources.changelog import Commit, Snapshot
from .engine import Engine

ORDER = ["_lsn", "_seq"]


def vacuum(engine: Engine, table: str) -> int:
    """Rewrites the table's log without versions that no open or later snapshot sees; gives their number.

    The last delete of each key stays, so that inserting it again is still refused. The rewrite names the commits that it
    replaces: one that another driver publishes meanwhile isn't among them and stays. Files that it replaces go once no reader
    of any driver is open; a reader that is keeps its list of commits and so its files.
    """
    t = engine.table_of(table)
    with engine.write_lock:
        snapshot = engine.log.snapshot()
        bound = min(engine.min_active_lsn(), snapshot.lsn)
        log = engine.log.rows(t, snapshot)
        gone = V.reclaimable(log, [t.primary.column], ORDER, bound).count()
        if gone:
            _rewrite(engine, table, snapshot, V.survivors(log, [t.primary.column], ORDER, bound))
        return gone


def compact(engine: Engine, table: str) -> int:
    """Puts all versions of a table into one folder, so that reads open few files; gives the number of folders that there were."""
    t = engine.table_of(table)
    with engine.write_lock:
        snapshot = engine.log.snapshot()
        folders = len([c for c in snapshot.commits if c.folder(table)])
        if folders > 1:
            _rewrite(engine, table, snapshot, engine.log.rows(t, snapshot))
        return folders


def _rewrite(engine: Engine, table: str, snapshot: Snapshot, rows: DataFrame) -> None:
    t = engine.table_of(table)
    # Rows of a base are laid out by key, so that reads by key skip row groups.
    engine.log.append({t: rows.repartitionByRange(t.primary.column).sortWithinPartitions(t.primary.column)}, kind="BASE", named=snapshot.named())
    drop_replaced(engine, table)


def drop_replaced(engine: Engine, table: str) -> list[str]:
    """Deletes folders that the table's last base replaces, if no reader is open; gives them."""
    commits = engine.log.snapshot().commits
    base = max((c for c in commits if c.kind == "BASE" and c.folder(table)), key=lambda c: c.lsn, default=None)
    if base is None or engine.log.leased():
        return []
    gone = [c.folder(table) for c in commits if c.folder(table) and c.kind in ("DATA", "BASE") and c.lsn != base.lsn and base.replaces(c.lsn)]
    gone = [f for f in gone if engine.log.store.exists(f)]
    for folder in gone:
        engine.log.store.delete(folder)
    return gone


def checkpoint(engine: Engine) -> int:
    """Writes every table's rows as they are now, and a CHECKPOINT commit that names the commits in them; gives the largest number among these. Writers needn't stop."""
    snapshot = engine.log.snapshot()
    lsn, files = engine.log.claim(), []
    for name in engine.catalog.list_tables():
        t = engine.table_of(name)
        folder = f"checkpoints/{lsn:020d}/{name}"
        V.latest(engine.log.rows(t, snapshot), [t.primary.column], ORDER).write.parquet(engine.log.store.url(folder))
        files.append((name, folder))
    upto, folded = snapshot.named()
    engine.log.publish(Commit(lsn, "CHECKPOINT", None, tuple(files), upto, folded))
    return snapshot.lsn


def _newest(commits) -> Commit | None:
    return max((c for c in commits if c.kind == "CHECKPOINT"), key=lambda c: c.lsn, default=None)


def last_checkpoint(engine: Engine) -> int:
    """The largest number that the last checkpoint holds, 0 without one."""
    last = _newest(engine.log.snapshot().commits)
    return 0 if last is None else max([last.upto, *last.folded])


def checkpointed(engine: Engine, table: str) -> DataFrame:
    """The table as the last checkpoint holds it: log rows, without deleted ones."""
    last = _newest(engine.log.snapshot().commits)
    return engine.spark.read.schema(engine.table_of(table).schema()).parquet(engine.log.store.url(last.folder(table)))


def replayed(engine: Engine, table: str) -> DataFrame:
    """The table's rows now, from the last checkpoint and only the commits that it doesn't name: what a restart has to read."""
    t = engine.table_of(table)
    snapshot = engine.log.snapshot()
    last = _newest(snapshot.commits)
    if last is None or last.folder(table) is None:
        return V.latest(engine.log.rows(t, snapshot), [t.primary.column], ORDER)
    later = engine.log.read(t, [c.folder(table) for c in snapshot.commits if c.kind == "DATA" and c.folder(table) and not last.replaces(c.lsn)])
    return V.latest(checkpointed(engine, table).unionByName(later), [t.primary.column], ORDER)


def segments(engine: Engine, segment_lsns: int) -> DataFrame:
    """segment, max_lsn, commits: the log in runs of ``segment_lsns`` numbers."""
    rows = engine.spark.createDataFrame([(c.lsn,) for c in engine.log.snapshot().commits], "lsn long")
    return rows.groupBy(F.floor(F.col("lsn") / segment_lsns).cast("long").alias("segment")).agg(F.max("lsn").alias("max_lsn"), F.count("*").alias("commits"))


def archive(engine: Engine, keep: int = 0) -> list[str]:
    """Moves data commits that the last checkpoint names to ``archive``, but for the newest ``keep``; reads go on from a base of all versions. Nothing happens while a reader is open."""
    with engine.write_lock:
        snapshot = engine.log.snapshot()
        last = _newest(snapshot.commits)
        if last is None or engine.log.leased():
            return []
        there = {f"log/{t.log}/{n}" for t in engine.catalog.tables.values() for n in engine.log.store.names(f"log/{t.log}")}
        covered = [c for c in snapshot.commits if c.kind in ("DATA", "BASE") and last.replaces(c.lsn) and any(f in there for _, f in c.files)]
        covered = covered[: len(covered) - keep] if keep else covered
        moved = [f for c in covered for _, f in c.files if f in there]
        for name in sorted({name for c in covered for name, _ in c.files}):
            t = engine.table_of(name)
            engine.log.append({t: engine.log.rows(t, snapshot)}, kind="BASE", named=snapshot.named())
        for folder in moved:
            engine.log.store.move(folder, f"archive/{folder}")
        return moved


def restore_archived(engine: Engine) -> list[str]:
    """Copies archived commits back; never over files that are there."""
    back = []
    for table in engine.log.store.names("archive/log"):
        for name in engine.log.store.names(f"archive/log/{table}"):
            folder = f"log/{table}/{name}"
            if not engine.log.store.exists(folder):
                engine.log.store.copy(f"archive/{folder}", folder)
                back.append(folder)
    return back


def truncate(engine: Engine) -> int:
    """Shortens the lists of commits and claims to one summary and what came after it; gives the last number in the summary."""
    with engine.write_lock:
        return engine.log.truncate()
