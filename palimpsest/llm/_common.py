"""What the operators share: Arrow batching with bounded memory, byte-level words, hashing, and durable intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import drop_stored, shared_dir, stored

__all__ = ["drop_stored", "shared_dir", "stored"]

#: Rows in one Arrow batch between the JVM and Python. Texts can be long, so it is far below Spark's default.
ARROW_ROWS = 256
#: Text bytes that one numpy pass works on, unless a single document is longer.
CHUNK_BYTES = 1 << 18

_U = np.uint64
#: Word separators: space and the ASCII controls 09 to 0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches small, for tables with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives memory back to the system at a task's end: Python workers outlive their tasks, and idle ones add up."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL(None).malloc_trim(0)


def _table(base: int, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, _U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=_U)
        _powers[key] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (Stafford's variant 13), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers drawn by a seed."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003 % (1 << 63))) * _U(0x9E3779B97F4A7C15))


BYTE_VALUE = seeded(256, 7)


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Sums P with which ``span_hashes`` gives the hash of any span; symbols: 64-bit values of bytes or code points."""
    out = np.zeros(len(symbols) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(symbols * _table(_BASE, len(symbols), "p"), out=out[1:], dtype=_U)
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end), the same wherever the span stands."""
    with np.errstate(over="ignore"):
        return mixed((prefix[ends] - prefix[starts]) * _table(_BASE_INVERSE, len(prefix), "i")[starts] + (ends - starts).astype(_U))


class Texts:
    """UTF-8 texts of some rows as one byte array; text i is ``data[at[i]:at[i + 1]]``. Null texts are empty."""

    def __init__(self, column: pa.Array):
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        column = column.fill_null("") if column.null_count else column
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]

    def __len__(self) -> int:
        return len(self.at) - 1

    def lengths(self) -> np.ndarray:
        """Code points of each text."""
        heads = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=heads[1:])
        return heads[self.at[1:]] - heads[self.at[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of all texts, and where each text's words begin among them (one more than texts)."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        inside = ~SEPARATOR[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = self.at[:-1][self.at[:-1] < self.at[1:]]
        first[edge] = inside[edge]
        edge = self.at[1:][self.at[:-1] < self.at[1:]] - 1
        last[edge] = inside[edge]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return span_hashes(prefix_hashes(BYTE_VALUE[data]), starts, ends)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` anew, in pieces whose texts in ``column`` have at most ``most`` bytes, or of one row. Small batches are joined."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0

    def flush() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 16)
            begin = 0
            while begin < batch.num_rows:
                before = int(sizes[begin - 1]) if begin else 0
                end = int(np.searchsorted(sizes, before + most - held_bytes, "right"))
                if end <= begin:
                    if held:
                        yield flush()
                        held, held_bytes = [], 0
                        continue
                    end = begin + 1
                held.append(batch.slice(begin, end - begin))
                held_bytes += int(sizes[end - 1]) - before
                begin = end
        if held:
            yield flush()
    finally:
        held.clear()
        release()


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", setup: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` over bounded pieces. work: from a piece to its output; with ``setup``, work(piece, what setup made in this task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (setup(),) if setup else ()
        for piece in chunks(batches, column):
            out = work(piece, *made)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def documents_view(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns that an operator reads, so that others, and clashing names among them, don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def unlike(columns: tuple[str, ...], *added: str) -> None:
    """Fails if a column that an operator adds has the name of one that it keeps (names differ in more than case)."""
    clash = {c.lower() for c in columns} & {c.lower() for c in added}
    if clash or len({c.lower() for c in added}) < len(added):
        raise ValueError(f"columns that are kept and added share a name: {sorted(clash) or added}; give the added ones other names")


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores after those that columns have."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def held_out(column: str = "doc_id"):
    """Rows that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))

