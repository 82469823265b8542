"""Tails a table's log with Structured Streaming, and feeds streams of documents into tables.

The stream is of commit markers: a commit's rows are read once its marker is there, so rows that are written but not yet
published are neither shown too early nor passed over. Truncating the log takes markers away; a stream must have passed them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.engine import Engine
from ..sources.changelog import Commit

#: Commits in one batch of a stream, at most.
COMMITS_A_BATCH = 1000


def commits(engine: Engine, most: int = COMMITS_A_BATCH) -> DataFrame:
    """A stream of commit markers as they are published, one JSON text each."""
    return engine.spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", most).option("pathGlobFilter", "*.json").text(engine.log.store.url("commits"))


def changes(engine: Engine, table: str, batch: DataFrame) -> DataFrame | None:
    """The table's rows of a batch of markers, in the order of the log; None if there are none."""
    t = engine.table_of(table)
    found = sorted((Commit.from_dict(json.loads(r["value"])) for r in batch.collect()), key=lambda c: c.lsn)  # markers, not rows
    folders = [c.folder(table) for c in found if c.kind == "DATA" and c.folder(table)]
    return engine.log.read(t, folders).orderBy("_lsn", "_seq") if folders else None


def follow(engine: Engine, table: str, handle: Callable[[DataFrame, int], None], checkpoint: str, most: int = COMMITS_A_BATCH) -> DataStreamWriter:
    """Calls ``handle`` with each batch's changes, whole commits in the order of their numbers. After a failure the same batch comes again under its number."""

    def batch(markers: DataFrame, n: int) -> None:
        rows = changes(engine, table, markers)
        if rows is not None:
            handle(rows, n)

    return commits(engine, most).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)


def upserting(engine: Engine, table: str, documents: DataFrame, checkpoint: str) -> DataStreamWriter:
    """Upserts a stream of documents (_doc, and keys as far as documents don't hold them), one commit for each batch; a batch that comes again is written once."""

    def write(batch: DataFrame, n: int) -> None:
        source = f"{checkpoint}#{n}"
        if not any(c.source == source for c in engine.log.snapshot().commits) and batch.limit(1).count():
            engine.upsert(table, batch, source)

    return documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts per tumbling window; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
