"""Exact top-k by inner product with a bit-sliced index.

Vectors become whole numbers, floor(1024 * x). The index holds blocks of vectors; each attribute of a block is
quantised to ``LEVEL_BITS`` bits and kept as bit slices: bitmaps over the block's rows. A query's quantised coefficients
multiply slices by adding shifted bitmaps, ripple carry by ripple carry, into the slices of an approximate score. From its
most significant slice downward the rows are narrowed to those that can be among the block's top k: the k-th largest
approximate score is found bit by bit, and all rows stay whose score is at most twice the quantisation's error bound below it.
These boundary rows are scored exactly, in whole numbers, and the blocks' winners are merged. The result is exact.

Each block's index is built once, by the task that holds the block, and all queries stream past it: a query goes once to each
block, and no task holds more than a block and a batch of queries; nothing is broadcast or gathered. Blocks are as large as
they can be while every core has one, from ``LEAST_ROWS`` up to ``BLOCK_ROWS`` vectors or ``BLOCK_BYTES``.

Ties go to the smaller vec_id, and a query's own row is no candidate. Vectors that are null, or hold null, NaN or infinite
components, take no part, nor do rows whose vec_id is null. Vectors of another length than the query's are no candidates of
it. Of rows that repeat a vec_id one counts (the least vector). Components so large that a score could exceed a long are
refused with an error. With fewer than k candidates all are returned; without queries or candidates, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import prepare, read_table, stored

K = 10
SCALE = 1024
LEVEL_BITS = 8
QUERY_BITS = 8
LEAST_ROWS, BLOCK_ROWS, BLOCK_BYTES = 8192, 65_536, 64 << 20
#: Scaled components and vector lengths up to here cannot make a score that exceeds a long.
MOST_SCORE = 1 << 62


def sliced(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit slices, least significant first, of whole numbers from 0 to 2**bits - 1: an array of ``bits`` packed bitmaps."""
    rows = -(-len(values) // 64) * 64
    padded = np.zeros(rows, np.int64)
    padded[: len(values)] = values
    return np.stack([np.packbits(((padded >> b) & 1).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(bits)])


def add_shifted(total: np.ndarray, part: np.ndarray, shift: int) -> None:
    """total += part << shift, slice by slice with a ripple carry; total has room for the sum."""
    carry = None
    for b in range(shift, len(total)):
        k = b - shift
        if k < len(part):
            one, two = total[b], part[k]
            half = one ^ two
            if carry is None:
                carry = one & two
                total[b] = half
            else:
                more = (one & two) | (half & carry)
                total[b] = half ^ carry
                carry = more
        else:
            if carry is None or not carry.any():
                break
            one = total[b].copy()
            total[b] = one ^ carry
            carry = one & carry


def at_least(slices: np.ndarray, bound: int, among: np.ndarray) -> np.ndarray:
    """The bitmap of rows of ``among`` whose value is at least ``bound``, from the most significant slice downward."""
    if bound <= 0:
        return among
    if bound >> len(slices):
        return np.zeros_like(among)
    above, equal = np.zeros_like(among), among.copy()
    for b in reversed(range(len(slices))):
        if bound >> b & 1:
            equal &= slices[b]
        else:
            above |= equal & slices[b]
            equal &= ~slices[b]
    return above | equal


def kth_largest(slices: np.ndarray, among: np.ndarray, k: int) -> int:
    """The k-th largest value among the rows (at least k), bit by bit from the most significant slice downward."""
    value, above, equal = 0, 0, among.copy()
    for b in reversed(range(len(slices))):
        ones = equal & slices[b]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            value |= 1 << b
            equal = ones
        else:
            above += n
            equal &= ~slices[b]
    return value


class Block:
    """The index of some rows: exact whole vectors, and slices of their quantised attributes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.low = vectors.min(axis=0)
        spread = int((vectors.max(axis=0) - self.low).max(initial=0))
        # One step for all attributes, so that their slices can be added up.
        self.step = max(1, -(-(spread + 1) >> LEVEL_BITS) if spread else 1)
        while spread // self.step >= 1 << LEVEL_BITS:
            self.step += 1
        levels = (vectors - self.low) // self.step
        self.slices = [sliced(levels[:, d], LEVEL_BITS) for d in range(vectors.shape[1])]
        self.complement = [~s for s in self.slices]
        rows = np.zeros(self.slices[0].shape[1] * 64 if self.slices else 0, np.uint8)
        rows[: len(ids)] = 1
        self.all_rows = np.packbits(rows, bitorder="little").view(np.uint64)

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best for the query: surely all that are."""
        if len(self.ids) <= k:
            return np.arange(len(self.ids))
        largest = int(np.abs(query).max(initial=0))
        unit = max(1, -(-largest // ((1 << QUERY_BITS) - 1)))
        weight = np.sign(query) * ((np.abs(query) + unit // 2) // unit)
        # A negative weight counts the levels from the top, so that only additions are needed.
        width = LEVEL_BITS + int(np.abs(weight).sum()).bit_length() + 1
        total = np.zeros((width, len(self.all_rows)), np.uint64)
        for d in np.flatnonzero(weight):
            part = self.slices[d] if weight[d] > 0 else self.complement[d]
            for b in range(int(abs(weight[d])).bit_length()):
                if int(abs(weight[d])) >> b & 1:
                    add_shifted(total, part, b)
        # score = sum(q * (low + step * level + rest)): the approximation has unit * step * total but for a constant.
        # Errors: 0 <= rest < step for each |q|, and |q - unit * weight| for each whole step * level.
        top = (1 << LEVEL_BITS) - 1
        error = int(np.abs(query).sum()) * (self.step - 1) + int(np.abs(query - unit * weight).sum()) * self.step * top
        kth = kth_largest(total, self.all_rows, k)
        bound = kth - -(-2 * error // (unit * self.step))
        chosen = at_least(total, bound, self.all_rows)
        return np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, vec_id), the query's own row left out."""
        rows = self.candidates(query, k + 1)  # one more, as the query's own row may be among them
        rows = rows[self.ids[rows] != query_id]
        scores = self.vectors[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return list(zip(scores[best].tolist(), self.ids[rows[best]].tolist(), strict=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<long>), dim: of the vectors that take part."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    x = x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(finite)
    refused = F.raise_error(F.lit("a component is too large for scores that are longs"))
    whole = F.transform("x", lambda c: F.when(F.abs(c) < float(1 << 18), F.floor(c * SCALE)).otherwise(refused.cast("long")))
    return x.select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of ``queries``; both as ``whole_vectors`` gives them."""
    spark = vectors.sparkSession
    prepare(spark)
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    schema = "query_id long, vec_id long, score long"
    found = None
    for dim in sorted(sizes):
        rows = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * dim)), max(LEAST_ROWS, -(-sizes[dim] // spark.sparkContext.defaultParallelism)))
        best = _best(vectors.where(F.col("dim") == dim), queries.where(F.col("dim") == dim), dim, -(-sizes[dim] // rows), k, schema)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(vectors: DataFrame, queries: DataFrame, dim: int, blocks: int, k: int, schema: str) -> DataFrame:
    """Each block's k best rows for each query: a partition holds one block's vectors, and after them all queries."""
    own = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("role"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), "vec_id", "v")
    dealt = own.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "role", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, block = None, [], [], None
        for batch in batches:
            of, role = batch.column("block").to_numpy(), batch.column("role").to_numpy()
            vec_id, v = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dim)
            out: list[tuple[int, int, int]] = []
            for own in np.unique(of):
                if own != number:
                    number, ids, parts, block = own, [], [], None
                rows = np.flatnonzero((of == own) & (role == 0))  # these come before any query
                if len(rows):
                    ids.append(vec_id[rows])
                    parts.append(v[rows])
                asked = np.flatnonzero((of == own) & (role == 1))
                if len(asked) and block is None and ids:
                    block, ids, parts = Block(np.concatenate(ids), np.concatenate(parts)), [], []
                if block is not None:
                    out += [(int(vec_id[i]), found, score) for i in asked for score, found in block.top(int(vec_id[i]), v[i], k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = stored(whole_vectors(read_table(spark, sf_dir, "embeddings")))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH whole AS (
  SELECT vec_id, min([CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
