"""Backups: a copy of a snapshot's commits and rows, with a manifest of the files' roles, sizes and SHA-256 sums, made and checked by Spark.

Tables' rows are copied by Spark jobs, whatever their size; the driver copies only the small files: commits, catalog, keys.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BackupError
from ..sources.store import Store
from .engine import Engine

VERSION = 2
_SCHEMA = "path string, role string, size long, sha256 string"
#: Small files that a backup takes along whole: of these folders the newest version.
_VERSIONED = ("catalog", "keys")


def hashed(spark: SparkSession, store: Store, listed: list[tuple[str, int]]) -> DataFrame:
    """path, size, sha256 of files (name, bytes), read on the executors. Spark passes over empty files, whose sum is known."""
    schema = "path string, size long, sha256 string"
    out = spark.createDataFrame([(n, 0, hashlib.sha256().hexdigest()) for n, size in listed if not size], schema)
    full = [store.url(n) for n, size in listed if size]
    if not full:
        return out
    top = _tail(store._fs.makeQualified(store._path("")).toString().rstrip("/"))
    below = F.expr(f"substring(path, locate('{top}/', path) + {len(top) + 1})")
    files = spark.read.format("binaryFile").load(full)
    return out.unionByName(files.select(below.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")))


def _tail(url: str) -> str:
    return "/" + url.split(":", 1)[-1].lstrip("/")


def _role(path: str) -> str:
    top = path.split("/")[0]
    return {"commits": "commit", "log": "log", "checkpoints": "checkpoint", "compensated": "log"}.get(top, "catalog")


def backup(engine: Engine, target: str) -> int:
    """Copies what a snapshot sees to an empty place; gives the number of files. Writers go on meanwhile; a reader's lease holds the snapshot's files."""
    spark, store, other = engine.spark, engine.log.store, Store(engine.spark, target)
    if other.files(""):
        raise BackupError(f"{target} isn't empty")
    with engine.begin_read() as reader:
        snapshot = reader.snapshot()
        there = {}
        for c in snapshot.commits:
            for folder in [*(f for _, f in c.files), *([c.compensated] if c.compensated else [])]:
                above, _, name = folder.rpartition("/")
                if above not in there:
                    there[above] = set(store.names(above))
                if name in there[above]:  # else a later base has replaced it
                    spark.read.parquet(store.url(folder)).write.parquet(other.url(folder))
            if c.lsn > snapshot.floor:
                other.write(f"commits/{c.lsn:020d}.json", c.to_json())
        if snapshot.floor:
            other.write(f"summary/{snapshot.floor:020d}.json", json.dumps([asdict(c) for c in snapshot.commits if c.lsn <= snapshot.floor]))
    for folder in _VERSIONED:
        version, text = store.newest(folder)
        if version:
            other.write(f"{folder}/{version:020d}.json", text)
    listed = other.files("")
    sums = hashed(spark, other, listed).collect()  # one short row for each file, as the manifest has
    entries = [{"path": r["path"], "role": _role(r["path"]), "size": r["size"], "sha256": r["sha256"]} for r in sorted(sums, key=lambda r: r["path"])]
    other.write("manifest.json", json.dumps({"version": VERSION, "files": entries}))
    return len(listed)


def manifest(spark: SparkSession, place: str) -> DataFrame:
    x = json.loads(Store(spark, place).read("manifest.json"))
    if x.get("version") != VERSION or not x.get("files"):
        raise BackupError("the manifest has another version or no files")
    paths = [f["path"] for f in x["files"]]
    if len(set(paths)) < len(paths):
        raise BackupError("the manifest lists a file twice")
    if any(p.startswith("/") or ".." in p.split("/") for p in paths):
        raise BackupError("the manifest leads outside the backup")
    return spark.createDataFrame([(f["path"], f["role"], f["size"], f["sha256"]) for f in x["files"]], _SCHEMA)


def differences(spark: SparkSession, place: str) -> DataFrame:
    """path, listed, there: files that are missing, new, or other than the manifest says, with both sums."""
    store = Store(spark, place)
    found = hashed(spark, store, [f for f in store.files("") if f[0] != "manifest.json"])
    both = manifest(spark, place).alias("m").join(found.alias("t"), "path", "full_outer")
    differs = ~(F.col("m.size").eqNullSafe(F.col("t.size")) & F.col("m.sha256").eqNullSafe(F.col("t.sha256")))
    return both.where(differs).select("path", F.col("m.sha256").alias("listed"), F.col("t.sha256").alias("there"))


def verify(spark: SparkSession, place: str) -> int:
    """Holds all files against the manifest; gives their number, or fails with the first difference."""
    listed = manifest(spark, place)
    try:
        bad = differences(spark, place).first()
    except BackupError:
        raise
    except Exception as e:  # the file system keeps checksums of its own
        raise BackupError(f"a file of {place} can't be read") from e
    if bad is not None:
        raise BackupError(f"{bad['path']} differs from the manifest")
    return listed.count()


def restore(spark: SparkSession, place: str, root: str) -> int:
    """Brings a verified backup to an empty place: rows by Spark jobs, small files by the driver; gives the number of files listed."""
    n = verify(spark, place)
    source, target = Store(spark, place), Store(spark, root)
    if target.files(""):
        raise BackupError(f"{root} isn't empty")
    folders = set()
    for name, _ in source.files(""):
        above = name.rpartition("/")[0]
        if name.endswith(".parquet"):
            folders.add(above)
        elif name != "manifest.json":
            target.write(name, source.read(name))
    for folder in sorted(folders):
        spark.read.parquet(source.url(folder)).write.parquet(target.url(folder))
    return n
