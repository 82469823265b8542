"""Lempel-Ziv phrase fingerprints: LZ78 phrases of each text, hashed, and the least hash of each of ``BINS`` bins.

A text's bytes are parsed into phrases, each the shortest that its dictionary lacks; the phrases' hashes are the text's set.
The set's minima, one for each bin of the hash range (one-permutation minwise hashing), are the fingerprint. A bin that no
hash falls into stays empty. The likeness of two fingerprints is the share of bins with equal minima among bins that either
fills: an estimate of the sets' Jaccard similarity, from 0 to 1, and 1 for equal texts, empty ones included.

``compare_neighbours`` also fingerprints an edited text, in which the last quarter of the code points gives way to the head
of the next document. Both texts parse alike up to there, so the shared part is parsed once.

The next document is the one with the next larger doc_id, after the last one the first. Rows that repeat a doc_id follow
each other in the order of their texts' first 32 characters, then of a hash; null doc_ids come first. A lone document is its own next. Null texts are
empty. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents_view, mixed, prepare, read_table, seeded
from ._ranges import RANGE_ROWS, in_ranges

BINS = 128
_U = np.uint64
_STEP = int(seeded(1, 41)[0]) | 1
_BYTE_SALT = [int(x) >> 1 for x in seeded(256, 43)]
_MASK = (1 << 61) - 1


def parse(data: bytes, nodes: dict[int, int], hashes: list[int], node: int = 0, fresh: list[int] | None = None) -> int:
    """Goes on with an LZ78 parse at ``node``; adds phrases to ``nodes`` (parent and byte to child) and ``hashes``. Returns the last node.

    fresh: collects the keys that are added, so that a parse can be taken back.
    """
    get, add = nodes.get, hashes.append
    for byte in data:
        key = node << 8 | byte
        child = get(key)
        if child is None:
            nodes[key] = len(hashes)
            if fresh is not None:
                fresh.append(key)
            # A phrase's hash is made from its prefix's.
            add((hashes[node] * 0x1000193 + _BYTE_SALT[byte]) & _MASK)
            node = 0
        else:
            node = child
    return node


def signature(hashes: list[int], last: int) -> np.ndarray:
    """The least hash of each bin, 0 where it is empty; ``last``: the node of a phrase that the text's end cut short."""
    phrases = hashes[1:]
    if last:
        phrases = [*phrases, (hashes[last] ^ 0x5555555555) & _MASK]
    out = np.zeros(BINS, np.uint32)
    if phrases:
        h = mixed(np.array(phrases, _U) + _U(_STEP & _MASK))
        place, value = (h & _U(BINS - 1)).astype(np.int64), (h >> _U(32)).astype(np.uint32) | np.uint32(1)
        least = np.full(BINS, np.iinfo(np.uint32).max, np.uint32)
        np.minimum.at(least, place, value)
        out[place] = least[place]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != 0) | (b != 0)
    return float((a == b)[used].mean()) if used.any() else 1.0


def fingerprint_of(text: str) -> np.ndarray:
    hashes = [0]
    last = parse(text.encode(), {}, hashes)
    return signature(hashes, last)


def both_fingerprints(text: str, edited_tail: str, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``text`` and of ``text[:cut] + edited_tail``."""
    nodes: dict[int, int] = {}
    hashes = [0]
    node = parse(text[:cut].encode(), nodes, hashes)
    size, fresh = len(hashes), []
    one = signature(hashes, parse(text[cut:].encode(), nodes, hashes, node, fresh))
    for key in fresh:
        del nodes[key]
    del hashes[size:]
    return one, signature(hashes, parse(edited_tail.encode(), nodes, hashes, node))


def fingerprint(df: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and fingerprint, as hexadecimal text, of the column text."""
    prepare(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint_of(t or "").tobytes().hex() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(made, pa.string())], [*keep, "fingerprint"])

    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "fingerprint string"]))


def compare_neighbours(documents: DataFrame) -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next; see the module's text."""
    spark = documents.sparkSession
    prepare(spark)
    docs = documents_view(documents).withColumn("text", F.coalesce("text", F.lit("")))
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("hash"))
    ordered = in_ranges(docs, key, (1,), RANGE_ROWS, around=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("range_", "role_", "doc_id", "text")), strict=True)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None  # (range, doc_id, text), whose next row is awaited
        waiting = None  # the result of the row before it, all but near_next
        for where, ahead, doc_id, text in rows(batches):
            if held is not None:
                if held[0] != where:
                    raise ValueError("a range has no row ahead")
                _, held_id, held_text = held
                cut = len(held_text) - len(held_text) // 4
                tail = text[: len(held_text) // 4]
                one, other = both_fingerprints(held_text, tail, cut)
                if waiting is not None:
                    yield (*waiting[:-1], likeness(waiting[-1], one))
                waiting = (held_id, len(held_text), hashlib.sha256((held_text[:cut] + tail).encode()).hexdigest(), one.tobytes().hex(), other.tobytes().hex(), likeness(one, other), one)
                if ahead:
                    yield (*waiting[:-1], likeness(one, fingerprint_of(text)))
                    waiting = None
            held = None if ahead else (where, doc_id, text)
        if held is not None:
            raise ValueError("a range has no row ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compared(batches)
        while some := list(itertools.islice(made, 256)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(read_table(spark, sf_dir, "documents"))
