"""Near-duplicate documents: universal-hash minima, banding, signature and set verification, connected components.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; words are runs of other bytes than 20 and 09-0D).
With fewer words the whole sequence is the one shingle; null, empty and blank texts have the empty set and no link.
Two documents are linked if 100 * intersection >= percent * union of their full sets; ``PERCENT``, unless a caller asks for another.

1. One pass over the texts gives each document its set size, a 128-bit sum over its set, minima under multiply-add hashes
   modulo 2**64, a hash of each band of ``ROWS`` minima, and a signature to verify pairs with before their sets are read.
   Bands are as many as it takes for a pair at the threshold to share none with a chance below ``MISSED``: 36 for 85 %.
2. Documents with equal sets form a class; only its smallest doc_id goes on. This, and the smallest member of each
   band bucket, are aggregates that combine before they shuffle, so no group meets in one task.
3. Each bucket's members are paired with its leader. A pair is dropped if its set sizes or its signatures rule out a link;
   the rest is confirmed or refused on the full sets. Components follow by alternating large-star and small-star.
4. Lastly, members outside the component of their bucket's leader are compared with the members in other components,
   under the same two conditions, inside the join. After that every pair that shares a bucket is linked, refused, or
   already in one component. No bucket is capped.

Signatures. Sets of up to ``SMALL`` shingles have a map of ``64 * WORDS`` cells, set where a shingle falls: cells of one set
that the other lacks are at most the shingles that it lacks, so such a pair is refused by bounds that are never wrong. Larger
sets fill too many cells; theirs is one bit of a mixed hash of each of ``64 * WORDS`` minima (a bit of the minimum itself won't
do: the lowest one is the shingle's parity under every hash), and a pair is refused if more bits differ than a pair at the
threshold has with a chance below ``MISSED``. Two sets of different sorts are always held against each other in full.

Repeated doc_ids: rows of equal id are one document whose set is the union of theirs. Rows whose doc_id is null have no
place in the result. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Texts, documents_view, drop_stored, map_texts, mixed, prepare, read_table, seeded, stored

SHINGLE = 5
PERCENT = 85
#: Minima of a band.
ROWS = 6
#: 64-bit words of a signature, and shingles of the largest set whose signature is a map.
WORDS, SMALL = 16, 512
#: The chance that bands, and for large sets as much that signatures, miss a pair at the threshold.
MISSED = 5e-8
#: Members that share one copy of their leader's set when sets are compared.
SALTED = 256
#: Edges, fingerprints, and sets of one partition where tables are stored between steps.
EDGES_A_TASK, PRINTS_A_TASK, SETS_A_TASK = 100_000, 20_000, 20_000

_U = np.uint64
_PLACE = seeded(max(SHINGLE, ROWS), 17) | _U(1)
_SHORT = seeded(SHINGLE, 19)
_SIGNS = [f"sign_{k}" for k in range(WORDS)]
_PRINTS = "doc_id long, n_shingles long, sum_a long, sum_b long, " + ", ".join(f"{c} long" for c in _SIGNS) + ", bands array<long>"


def shingles(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and where each text's begin."""
    starts, ends, first = texts.words()
    words = texts.word_hashes(starts, ends)
    n = np.diff(first)
    rolled = np.zeros(max(0, len(words) - size + 1), _U)
    with np.errstate(over="ignore"):
        for k in range(size):
            rolled += words[k : k + len(rolled)] * _PLACE[k]
    rolled = mixed(rolled)
    sets = []
    for i in range(len(n)):
        if n[i] >= size:
            s = np.sort(rolled[first[i] : first[i] + n[i] - size + 1])
            sets.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif n[i]:
            with np.errstate(over="ignore"):
                sets.append(mixed((words[first[i] : first[i + 1]] * _PLACE[: n[i]]).sum(keepdims=True) + _SHORT[n[i] : n[i] + 1]))
        else:
            sets.append(words[:0])
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else words[:0]), at


def band_count(percent: int) -> int:
    """The fewest bands that miss a pair at the threshold with a chance below ``MISSED``."""
    return math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS))) if percent < 100 else 1


def most_differing(percent: int) -> int:
    """The fewest bits that two large sets' signatures at the threshold exceed in difference with a chance below ``MISSED``: a binomial tail."""
    n, p = 64 * WORDS, (1 - percent / 100) / 2
    above, k = 0.0, n
    while k and p and (above := above + math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))) < MISSED:
        k -= 1
    return k if p else 0


def minima(values: np.ndarray, at: np.ndarray, hashes: int) -> np.ndarray:
    """The smallest value of each set under each of so many hashes; sets: ``values[at[i]:at[i + 1]]``, none empty."""
    multiply, add = seeded(hashes, 11) | _U(1), seeded(hashes, 13)
    out = np.empty((len(at) - 1, hashes), _U)
    step = 1 << 16
    begin = 0
    while begin < len(at) - 1:  # a block of sets that stays in cache
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + step, "right")) - 1)
        block, where = values[at[begin] : at[end]], at[begin:end] - at[begin]
        scratch = np.empty_like(block)
        with np.errstate(over="ignore"):
            for k in range(hashes):
                np.multiply(block, multiply[k], out=scratch)
                np.add(scratch, add[k], out=scratch)
                out[begin:end, k] = np.minimum.reduceat(scratch, where)
        begin = end
    return out


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = (signature[:, : bands * ROWS].reshape(len(signature), bands, ROWS) * _PLACE[:ROWS]).sum(axis=2, dtype=_U)
        return mixed(rows + seeded(bands, 23))


def sketches(signature: np.ndarray) -> np.ndarray:
    """``WORDS`` words of each large set: a bit of a mixed hash of each minimum, so that each hash draws anew whether a shingle has it set."""
    out = np.empty((len(signature), WORDS), np.int64)
    for begin in range(0, len(signature), 256):  # a block that stays in cache
        block = mixed(signature[begin : begin + 256, : 64 * WORDS])
        out[begin : begin + 256] = np.packbits((block & _U(1)).astype(np.uint8), axis=1).view(np.int64).reshape(-1, WORDS)
    return out


def maps(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``WORDS`` words of each small set, given the sets one after another and their sizes: the cells that its shingles fall into."""
    cells = np.zeros((len(n), 64 * WORDS), np.uint8)
    cells[np.repeat(np.arange(len(n)), n), (mixed(values ^ _SHORT[1]) % _U(64 * WORDS)).astype(np.int64)] = 1
    return np.packbits(cells, axis=1).view(np.int64).reshape(-1, WORDS)


def _some(values: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sets ``values[at[i]:at[i + 1]]``, and where they begin."""
    n = np.diff(at)
    mask = np.zeros(len(n), bool)
    mask[chosen] = True
    return values[np.repeat(mask, n)], np.append(0, np.cumsum(n[chosen]))


def _list_column(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _fingerprint(piece: pa.RecordBatch, bands: int) -> pa.RecordBatch:
    return _summed(piece.column("doc_id"), *shingles(Texts(piece.column("text"))), bands)


def _summed(doc_ids: pa.Array, values: np.ndarray, at: np.ndarray, n_bands: int) -> pa.RecordBatch:
    n = np.diff(at)
    full, small, large = np.flatnonzero(n), np.flatnonzero(n <= SMALL), np.flatnonzero(n > SMALL)
    bands, spot = band_hashes(minima(values, np.append(at[:-1][full], at[-1]), n_bands * ROWS), n_bands), np.zeros(len(n) + 1, np.int64)
    spot[1:] = np.cumsum(np.where(n > 0, n_bands, 0))
    signs = np.zeros((len(n), WORDS), np.int64)
    signs[small] = maps(_some(values, at, small)[0], n[small])
    if len(large):
        signs[large] = sketches(minima(*_some(values, at, large), 64 * WORDS))
    sums = [np.zeros(len(n), _U) for _ in range(2)]
    with np.errstate(over="ignore"):
        for s, v in zip(sums, (values, mixed(values ^ _SHORT[0])), strict=True):
            if len(full):
                s[full] = np.add.reduceat(v, at[:-1][full])
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(WORDS)), _list_column(bands.reshape(-1), spot)], ["doc_id", "n_shingles", "sum_a", "sum_b", *_SIGNS, "bands"])


def _sets(piece: pa.RecordBatch) -> pa.RecordBatch:
    values, at = shingles(Texts(piece.column("text")))
    return pa.RecordBatch.from_arrays([piece.column("doc_id"), _list_column(values, at)], ["doc_id", "set"])


def _may_link(a: str, b: str, percent: int):
    """Whether set sizes and signatures of two sides, columns with the suffixes a and b, allow a link."""

    def bits(of):
        total = None
        for c in _SIGNS:
            more = F.bit_count(of(F.col(f"{c}_{a}"), F.col(f"{c}_{b}")))
            total = more if total is None else total + more
        return total

    n_a, n_b, small = F.col(f"n_{a}"), F.col(f"n_{b}"), F.greatest(f"n_{a}", f"n_{b}") <= SMALL
    # 100 * shared >= percent * union, and each side lacks at least the cells that only the other fills.
    room_a, room_b = n_a * 100 - n_b * percent, n_b * 100 - n_a * percent
    fits = lambda only, room: only * (100 + percent) <= room
    by_map = fits(bits(lambda x, y: x.bitwiseAND(F.bitwise_not(y))), room_a) & fits(bits(lambda x, y: y.bitwiseAND(F.bitwise_not(x))), room_b)
    by_bits = bits(lambda x, y: x.bitwiseXOR(y)) <= most_differing(percent)
    both_large = F.least(f"n_{a}", f"n_{b}") > SMALL
    return (room_a >= 0) & (room_b >= 0) & F.when(small, by_map).when(both_large, by_bits).otherwise(F.lit(True))


def _side(df: DataFrame, x: str, *keep) -> DataFrame:
    """doc_id as x, n_shingles and signature with the suffix x."""
    return df.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in _SIGNS), *keep)


def _few(edges: DataFrame, n: int) -> DataFrame:
    """``edges``, some n rows, stored in as few partitions as they need."""
    return stored(edges.coalesce(2 + n // EDGES_A_TASK))


def _packed(df: DataFrame, rows: int, a_task: int = EDGES_A_TASK) -> DataFrame:
    """``df``, of at most so many rows, stored in a file for each core, or for every ``a_task`` rows: not in a small one for each shuffle partition."""
    return stored(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // a_task))))


def star_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, by alternating large-star and small-star until no edge changes.

    Every step is a minimum by node that combines before its shuffle, and a join of edges with those minima; a node of
    many edges is never gathered. Nodes without an edge don't occur.
    """
    n = edges.count()
    pairs = _few(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), n)
    last = None
    while True:
        summary = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if summary == last or not summary[0]:
            break
        last, before = summary, pairs
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are stored, so that both sides of a join with them are plain shuffles, which Spark can split at hot nodes.
        least_of_all = _few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
        # Large-star: each larger neighbour of u goes to the least of u and its neighbours.
        large = _few(both.where("v > u").join(least_of_all, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), n)
        # Small-star: u and its smaller neighbours go to the least of these.
        least = _few(large.groupBy("u").agg(F.min("v").alias("m")), n)
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = _few(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), n)
        drop_stored(before, least_of_all, large, least)
    roots = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    out = _few(roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct()), n)
    drop_stored(pairs)
    return out


def _confirmed(likely: DataFrame, docs: DataFrame, percent: int, most: int) -> DataFrame:
    """Of the distinct pairs (a, b, n_a, n_b), about ``most`` or less, those whose full sets are linked."""
    likely = _packed(likely, most, PRINTS_A_TASK)
    n = likely.count()
    wanted = likely.select(F.col("a").alias("doc_id")).distinct().unionByName(likely.select(F.col("b").alias("doc_id")).distinct()).distinct()
    sets = map_texts(docs.join(wanted, "doc_id", "left_semi"), _sets, "doc_id long, set array<long>")
    sets = _packed(sets.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("set"))).alias("set")), 2 * n, SETS_A_TASK)
    # The side with more partners is b; its set goes to as many salts as its partners fill.
    salts = _few(likely.groupBy("b").agg(F.floor(F.count("*") / SALTED).cast("int").alias("salts")), n)
    left = likely.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts") + 1).cast("int"))
    left = left.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    right = salts.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").select("b", "set_b", F.explode(F.sequence(F.lit(0), "salts")).alias("salt"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    linked = left.join(right, ["b", "salt"]).withColumn("shared", shared).where(f"100L * shared >= {percent}L * (n_a + n_b - shared)")
    out = _packed(linked.select("a", "b"), 2 * n, SETS_A_TASK)
    drop_stored(likely, sets, salts)
    return out


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, of links at ``percent`` or more: see the module's text."""
    prepare(documents.sparkSession)
    docs = documents_view(documents).where("doc_id is not null")
    bands = band_count(percent)
    prints = stored(map_texts(docs, lambda piece: _fingerprint(piece, bands), _PRINTS))
    if prints.groupBy("doc_id").count().where("count > 1").limit(1).count():
        once, prints = prints, stored(_united(docs, bands))
        drop_stored(once)
    full = prints.where("n_shingles > 0")
    n = prints.count()
    classes = _packed(full.groupBy("sum_a", "sum_b", "n_shingles").agg(F.min("doc_id").alias("rep")), n)
    classed = _packed(full.join(classes, ["sum_a", "sum_b", "n_shingles"]).withColumn("bands", F.when(F.col("doc_id") == F.col("rep"), F.col("bands"))).drop("sum_a", "sum_b"), n, PRINTS_A_TASK)
    reps = classed.where("doc_id = rep")
    members = reps.select(F.posexplode("bands").alias("k", "band"), F.col("doc_id").alias("a"))
    leaders = members.groupBy("band").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b")
    buckets = _packed(members.join(leaders, "band"), n * bands, 2 * EDGES_A_TASK)
    in_buckets = buckets.count()
    pairs = _packed(buckets.where("a > b").select("a", "b").distinct(), in_buckets, 2 * EDGES_A_TASK)
    likely = pairs.join(_side(reps, "a"), "a").join(_side(reps, "b"), "b").where(_may_link("a", "b", percent)).select("a", "b", "n_a", "n_b")
    edges = _confirmed(likely, docs, percent, in_buckets)
    components = star_components(edges)
    own = components.select(F.col("node").alias("a"), F.col("component").alias("own_a"))
    of_leader = components.select(F.col("node").alias("b"), F.col("component").alias("own_b"))
    known = buckets.join(own, "a", "left").join(of_leader, "b", "left").withColumn("own", F.coalesce("own_a", "a"))
    met = _packed(known.select("k", "band", "a", "b", "own", (F.col("own") != F.coalesce("own_b", "b")).alias("odd")), in_buckets, 2 * EDGES_A_TASK)
    # An odd member and its leader have met already; a bucket that has no third member is done with.
    open_bands = met.groupBy("band").agg(F.count("*").alias("n"), F.max("odd").alias("any_odd")).where("n > 2 and any_odd").select("band")
    short = F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("bands")
    known = _packed(met.join(open_bands, "band", "left_semi").join(_side(reps, "a", short), "a"), in_buckets, PRINTS_A_TASK)
    drop_stored(met)
    others = known.select("band", *(F.col(c).alias(c[:-1] + "b" if c == "a" or c.endswith("_a") else c + "_2") for c in known.columns if c not in ("band", "k", "b")))
    # Of two odd members each pair comes once, an odd and another member meet once as well; of all buckets that a pair
    # shares only the first gives it.
    once = F.col("own") != F.col("own_2")
    once &= ~F.col("odd_2") | (F.col("a") > F.col("b"))
    once &= _may_link("a", "b", percent)
    once &= ~F.exists(F.zip_with(F.slice("bands", 1, F.col("k")), F.slice("bands_2", 1, F.col("k")), lambda x, y: x == y), lambda same: same)
    rest = known.where("odd").drop("b").join(others, "band").where(once)
    swap = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    rest = rest.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b")).distinct()
    found = _confirmed(rest.join(pairs, ["a", "b"], "left_anti"), docs, percent, in_buckets)
    drop_stored(buckets, pairs, known)
    if found.limit(1).count():
        first, components = components, star_components(edges.unionByName(found))
        drop_stored(first)
    drop_stored(edges, found, classes)
    linked = classed.select("doc_id", "rep").join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    out = prints.select("doc_id", "n_shingles").join(linked, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _united(docs: DataFrame, bands: int) -> DataFrame:
    """Fingerprints where doc_ids repeat: of the union of the sets of each id's rows."""
    sets = map_texts(docs, _sets, "doc_id long, set array<long>").groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("set")))).alias("set"))

    def run(batches):
        for batch in batches:
            lists = [np.unique(np.asarray(x, np.int64).view(_U)) for x in batch.column("set").to_pylist()]
            if lists:
                at = np.zeros(len(lists) + 1, np.int64)
                np.cumsum([len(x) for x in lists], out=at[1:])
                yield _summed(batch.column("doc_id"), np.concatenate(lists), at, bands)

    return sets.mapInArrow(run, _PRINTS)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
