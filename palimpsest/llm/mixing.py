"""Mixing sources to target weights: fixed-length blocks of words, multinomial counts per shard, permuted block indexes.

A document's size is its number of words (runs of other bytes than 20 and 09-0D; null texts have none). Sources in code
point order, null last, weigh ``WEIGHTS``, repeating, and share the corpus's size; no target exceeds ``MOST_TIMES`` times
its source's size, and what is above is shared anew by weight until none is above.

1. A source's documents, ordered by hash buckets and rows, form one stream of words, cut into blocks of ``BLOCK_WORDS``; the
   last one may be shorter. Positions are two-level prefix sums; no task holds a source.
2. A source gets as many slots as it takes to come to its target, to the word: the last slot takes just the words that are
   left. Each output shard draws the numbers of its slots by source from a multinomial whose weights are the slots that
   remain, so that all are used up at the end. Beyond ``MOST_GROUPS`` shards, or ``MOST_DRAWS`` counts, the driver draws for groups
   of shards, and executors for the shards of each group.
3. Slot k of a source takes block ``permutation(k mod blocks)`` of round ``k div blocks``: in each round a keyed Feistel
   network permutes the indexes, so a block comes once a round and never more than ``MOST_TIMES`` times.
4. Slots join blocks by source and index, and blocks are parts of documents by position.

Reruns give the same mix. Documents without words are never taken. Rows with null or repeated doc_ids are documents of their
own: they are told apart by a number in the order of doc_id (nulls last) and text. Empty tables give no rows. The driver holds
one row for each source, so more than ``MOST_SOURCES`` are refused with an error (a mix has a weight for each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Texts, chunks, drop_stored, free_names, mixed, prepare, read_table, stored

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 1024
#: Words of an output shard; groups of shards that the driver draws for, and counts (groups by sources) that it draws, at most.
SHARD_WORDS, MOST_GROUPS, MOST_DRAWS = 1 << 20, 4096, 1 << 20
#: Rows of a bucket on average.
BUCKET_ROWS = 1000
MOST_SOURCES = 10_000
SEED = 20_240_501

_U = np.uint64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> list[float]:
    """The target of each source, in their order."""
    left, open_ = float(sum(sizes)), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        share = {i: left * weights[i % len(weights)] / total for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _halves(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each half of a number below n, and their mask."""
    half = (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(_U)
    half = np.where((_U(1) << (half * _U(2))) < n.astype(_U), half + _U(1), half)
    return half, (_U(1) << half) - _U(1)


def _turned(x: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(x + mixed(key + _U(turn)))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each index below n in the permutation of 0..n-1 that key names: a Feistel network, walked until it is below n."""
    half, mask = _halves(n)
    out, todo = index.astype(_U), np.arange(len(index))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (_turned(right, key[todo], turn) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(_U)]
    return out.astype(np.int64)


def index_of(place: int, n: int, key: int) -> int:
    """The index that ``permuted`` puts at a place."""
    half, mask = _halves(np.array([n]))
    out, own = np.array([place], _U), np.array([key], _U)
    while True:
        left, right = out >> half, out & mask
        for turn in reversed(range(4)):
            left, right = right ^ (_turned(left, own, turn) & mask), left
        out = (left << half) | right
        if out[0] < n:
            return int(out[0])


def round_key(number: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The key of each source's permutation in each round."""
    return mixed(mixed(number.astype(_U) + _U(SEED)) + turn.astype(_U)) if len(number) else number.astype(_U)


def slots_for(number: int, words: int, size: int) -> tuple[int, int]:
    """How many slots a source of ``size`` words needs to take so many words, and how many words the last one takes of its block."""
    if not words:
        return 0, 0
    blocks = -(-size // BLOCK_WORDS)
    rounds, rest = divmod(words, size)
    if not rest:  # the last slot takes its whole block
        return rounds * blocks, BLOCK_WORDS
    # The short block comes at this place in the round that ends early.
    place = index_of(blocks - 1, blocks, int(round_key(np.array([number]), np.array([rounds]))[0]))
    short = size - (blocks - 1) * BLOCK_WORDS
    if rest > place * BLOCK_WORDS + short:
        rest += BLOCK_WORDS - short  # as if the short block were whole
    return rounds * blocks + -(-rest // BLOCK_WORDS), rest - (-(-rest // BLOCK_WORDS) - 1) * BLOCK_WORDS


def drawn(slots: np.ndarray, shards: int, seed) -> list[np.ndarray]:
    """Each shard's numbers of slots by source: a multinomial draw for each shard over what remains; the last takes the rest."""
    draw, left, out = np.random.default_rng(seed), slots.astype(np.int64), []
    for shard in range(shards):
        remaining = int(left.sum())
        if shard == shards - 1 or not remaining:
            out.append(left)
            break
        taken = np.minimum(draw.multinomial(-(-remaining // (shards - shard)), left / remaining), left)
        out.append(taken)
        left = left - taken
    return out


class Mix:
    """A plan for mixing ``documents`` (doc_id, text, source, and any other columns) and its parts as DataFrames."""

    def __init__(self, documents: DataFrame, weights: tuple[int, ...] = WEIGHTS):
        spark = documents.sparkSession
        prepare(spark)
        self.columns, self.kinds = documents.columns, dict(documents.dtypes)
        self.keyed = self._keyed(documents)
        size = F.coalesce(F.regexp_count(F.col("row.text"), F.lit(WORD)), F.lit(0)).cast("long")
        self.rows = stored(self.keyed.select("key", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), size.alias("size")))
        grouped = stored(self.rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
        if grouped.count() > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources; make them coarser")
        # UTF-8 bytes sort as code points do.
        summary = sorted(grouped.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        drop_stored(grouped)
        sizes = [int(r["size"]) for r in summary]
        goals = targets(sizes, weights)
        plan = [slots_for(k, min(MOST_TIMES * size, round(goal)), size) for k, (goal, size) in enumerate(zip(goals, sizes, strict=True))]
        schema = "number int, source string, source_size long, target double, blocks long, slots long, last_words long"
        self.sources = spark.createDataFrame([(k, r["source"], size, goal, -(-size // BLOCK_WORDS), *own) for k, (r, size, goal, own) in enumerate(zip(summary, sizes, goals, plan, strict=True))], schema)
        self.shards = max(1, -(-sum(sizes) // SHARD_WORDS))
        self.groups = min(self.shards, MOST_GROUPS, max(1, MOST_DRAWS // max(1, len(sizes))))
        self.draws = self._drawn(np.array([n for n, _ in plan], np.int64), self.groups)
        self.placed = stored(self._placed(max(1, sum(r["n"] for r in summary) // BUCKET_ROWS)))

    @staticmethod
    def _keyed(documents: DataFrame) -> DataFrame:
        """row (all columns) and key, a number of its own for each row: the doc_id where that is one."""
        rows = documents.select(F.struct(*documents.columns).alias("row"))
        own = F.col("row.doc_id").cast("long").alias("key")
        if not rows.select(own).groupBy("key").count().where("count > 1 or key is null").limit(1).count():
            return rows.select("row", own)
        order = [F.asc_nulls_last(F.col("row.doc_id").cast("long")), F.xxhash64("row.text"), F.xxhash64("row")]
        # Ranges follow each other as their partitions do, so the numbers rise with the order; once stored they stay.
        return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()))

    def _numbered(self, df: DataFrame) -> DataFrame:
        own = self.sources.select("number", F.col("source").alias("own_source"))
        return df.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")

    @staticmethod
    def _drawn(slots: np.ndarray, groups: int) -> list[tuple[int, int, int, int]]:
        """(group, source's number, its first slot, its slots there)."""
        out, first = [], np.zeros(len(slots), np.int64)
        for group, taken in enumerate(drawn(slots, groups, SEED)):
            out += [(group, int(k), int(first[k]), int(taken[k])) for k in np.flatnonzero(taken)]
            first = first + taken
        return out

    def _placed(self, buckets: int) -> DataFrame:
        """number, key, size, begin: where in its source's stream each document with words begins."""
        numbered = self._numbered(self.rows.where("size > 0")).select("number", "key", "size")
        numbered = numbered.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        sums = numbered.groupBy("number", "bucket").agg(F.sum("size").alias("in_bucket"))
        before = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("number").orderBy("bucket")) - F.col("in_bucket")).select("number", "bucket", "before")
        order = Window.partitionBy("number", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        inside = numbered.withColumn("until", F.sum("size").over(order))
        return inside.join(before, ["number", "bucket"]).select("number", "key", "size", (F.col("before") + F.col("until") - F.col("size")).alias("begin"))

    def slots(self) -> DataFrame:
        """shard, number, slot, round, block, most: which block of its source each output slot takes, and how many words of it at most."""
        spark = self.rows.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        by_group = spark.createDataFrame(self.draws, "shard int, number int, first long, taken long")
        if self.shards > self.groups:
            each = -(-self.shards // self.groups)

            def split(batch: pa.Table) -> pa.Table:
                batch = batch.sort_by("number")
                group, number, first = batch.column("shard")[0].as_py(), batch.column("number").to_numpy(), batch.column("first").to_numpy().copy()
                out = []
                for k, taken in enumerate(drawn(batch.column("taken").to_numpy(), each, [SEED, group])):
                    out += [(group * each + k, int(number[i]), int(first[i]), int(taken[i])) for i in np.flatnonzero(taken)]
                    first = first + taken
                return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["shard", "number", "first", "taken"])

            by_group = by_group.groupBy("shard").applyInArrow(split, "shard int, number int, first long, taken long")
        slots = by_group.repartition(parts, "shard", "number").select("shard", "number", F.explode(F.sequence("first", F.col("first") + F.col("taken") - 1)).alias("slot"))
        slots = slots.join(F.broadcast(self.sources.select("number", "blocks", F.col("slots").alias("all_slots"), "last_words")), "number")
        most = F.when(F.col("slot") == F.col("all_slots") - 1, F.col("last_words")).otherwise(BLOCK_WORDS)
        slots = slots.select("shard", "number", "slot", "blocks", most.cast("long").alias("most"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number, slot, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "slot", "blocks"))
                turn = slot // np.maximum(blocks, 1)
                block = permuted(slot % np.maximum(blocks, 1), blocks, round_key(number, turn))
                yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("number"), batch.column("slot"), pa.array(turn.astype(np.int32)), pa.array(block), batch.column("most")], ["shard", "number", "slot", "round", "block", "most"])

        return slots.mapInArrow(run, "shard int, number int, slot long, round int, block long, most long")

    def parts(self) -> DataFrame:
        """number, key, size, block, low, high, place: the words [low, high) of each document that each block holds, the first at that place of the block."""
        spread = F.sequence(F.floor(F.col("begin") / BLOCK_WORDS), F.floor((F.col("begin") + F.col("size") - 1) / BLOCK_WORDS))
        cut = self.placed.select("*", F.explode(spread).alias("block"))
        low, high = F.greatest(F.col("block") * BLOCK_WORDS - F.col("begin"), F.lit(0)), F.least((F.col("block") + 1) * BLOCK_WORDS - F.col("begin"), F.col("size"))
        return cut.select("number", "key", "size", "block", low.alias("low"), high.alias("high"), (F.col("begin") + low - F.col("block") * BLOCK_WORDS).alias("place"))

    def uses(self) -> DataFrame:
        """key, round, low, high: the words that each round takes of each document, by block."""
        joined = self.parts().join(self.slots().select("number", "block", "round", "most"), ["number", "block"])
        high = F.least("high", F.col("low") + F.col("most") - F.col("place"))
        return joined.select("key", "round", "low", high.alias("high")).where("high > low")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of each document."""
        used = self.uses().groupBy("key").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
        found = self._numbered(self.rows).join(used, "key", "left").join(F.broadcast(self.sources.select("number", "source_size", "target")), "number")
        return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def mixed_documents(self) -> DataFrame:
        """The mix with the documents' columns: a row for each document and round, whose text is the words that the round takes (n_chars follows).

        A round that takes a whole document keeps its text as it is. Of others the words of neighbouring blocks keep what
        stands between them; those of blocks apart are joined by a space.
        """
        uses = self.uses().groupBy("key", "round").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ranges"))
        each = self.keyed.join(uses, "key").select("row", "ranges")
        columns, kinds = self.columns, self.kinds
        (ranges_name,) = free_names(columns, "ranges")
        each = each.select("row.*", F.col("ranges").alias(ranges_name))
        has_count = "n_chars" in columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in chunks(batches, "text"):
                texts = Texts(piece.column("text"))
                starts, ends, first = texts.words()
                raw, out = texts.data.tobytes(), []
                for i, ranges in enumerate(piece.column(ranges_name).to_pylist()):
                    joined: list[list[int]] = []
                    for r in ranges:
                        if joined and joined[-1][1] == r["low"]:
                            joined[-1][1] = r["high"]
                        else:
                            joined.append([r["low"], r["high"]])
                    if len(joined) == 1 and joined[0][1] - joined[0][0] == first[i + 1] - first[i]:
                        out.append(raw[texts.at[i] : texts.at[i + 1]])
                    else:
                        out.append(b" ".join(raw[starts[first[i] + a] : ends[first[i] + b - 1]] for a, b in joined))
                made = {"text": pa.array([x.decode("utf-8") for x in out], pa.string())}
                if has_count:
                    made["n_chars"] = pa.array(Texts(made["text"]).lengths()).cast(piece.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([made.get(c, piece.column(c)) for c in columns], columns)

        return each.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def query(spark, sf_dir: str) -> DataFrame:
    return Mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).taken()
