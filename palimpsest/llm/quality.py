"""Quality by nearest-neighbour voting: labelled latent-semantic vectors are broadcast, every document meets them all.

Terms are words (lower-cased, hashed to ``WORD_TERMS``), and the shapes of words and of neighbouring words: which kinds of
characters a word has, how it begins and ends, how long it is, and whether it repeats the word before (``SHAPE_TERMS``). Their
counts per text, weighted by log frequency and inverse document frequency, are projected to ``RANK`` dimensions by a singular
value decomposition of the labelled sample (latent semantic analysis) and scaled to length one. Every document's cosines with
all labelled vectors are computed in blocks, exactly; its ``NEIGHBOURS`` nearest vote with their labels, weighted by a power of
the similarity. Of neighbours at the same cosine (to nine decimals) those earlier in the sample's fixed order vote first, so
equal texts score alike in whatever block they stand.

The sample is at most ``TRAIN_ROWS`` labelled documents (whole texts) outside the held-out rows; its vectors take at most
``TRAIN_ROWS * RANK * 8`` bytes, which is what the broadcast is bounded by. Scoring takes nothing but the whole text.

Null, empty and blank texts have no term; they, and texts like no labelled one, score the sample's share of label 1. Without
usable labels every score is 0.5. Repeated rows each give a row; empty tables give none.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Texts, chunks, documents_view, held_out, mixed, prepare, read_table, unlike
from ._labelled import fit_in_one_task, labelled_sample

SHAPE_TERMS = WORD_TERMS = 1024
TERMS = SHAPE_TERMS + WORD_TERMS
RANK = 48
TRAIN_ROWS = 6_144
NEIGHBOURS = 15
POWER = 4
THRESHOLD = 0.7
#: Documents whose cosines are held at once.
BLOCK = 256
DECIMALS = 9

_U = np.uint64
_KIND = np.full(256, 32, np.uint8)  # other marks
_KIND[:33] = 0
_KIND[list(b".,;:!?")] = 16
_KIND[0x80:] = 8
_KIND[0x30:0x3A] = 4
_KIND[0x41:0x5B] = 2
_KIND[0x61:0x7B] = 1


def term_counts(texts: Texts) -> np.ndarray:
    """How often each text has each term: shapes first, then words."""
    starts, ends, first = texts.words()
    n = np.diff(first)
    out = np.zeros((len(n), TERMS), np.float32)
    if not len(starts):
        return out
    kind = _KIND[texts.data]
    words = texts.word_hashes(starts, ends)
    row = np.repeat(np.arange(len(n)), n)
    follows = np.zeros(len(words), bool)
    follows[1:] = row[1:] == row[:-1]
    shape = np.bitwise_or.reduceat(kind, starts).astype(_U)
    shape = shape << _U(6) | kind[starts].astype(_U)
    shape = shape << _U(6) | kind[ends - 1].astype(_U)
    shape = shape << _U(4) | np.minimum(np.log2(ends - starts).astype(_U), _U(7))
    again = np.zeros(len(words), _U)
    again[1:] = (words[1:] == words[:-1]) & follows[1:]
    shape = mixed(shape << _U(1) | again)
    with np.errstate(over="ignore"):
        pair = mixed(shape[:-1] * _U(3) + shape[1:])
    hashed = lambda x, terms: (x & _U(terms - 1)).astype(np.int64)
    spots = np.concatenate([row * TERMS + hashed(shape, SHAPE_TERMS), (row[1:] * TERMS + hashed(pair, SHAPE_TERMS))[follows[1:]], row * TERMS + SHAPE_TERMS + hashed(words, WORD_TERMS)])
    return np.bincount(spots, minlength=out.size).reshape(out.shape).astype(np.float32)


class Model:
    """Projection, labelled vectors and labels."""

    def __init__(self, weight: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.weight, self.axes, self.vectors, self.labels = weight, axes, vectors, labels

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray) -> Model:
        weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
        weight = weight.astype(np.float32)
        # Right singular vectors of the sample, from its small Gram matrix, summed up block by block.
        gram = np.zeros((counts.shape[1],) * 2)
        for begin in range(0, len(counts), BLOCK):
            x = (_frequencies(counts[begin : begin + BLOCK]) * weight).astype(np.float64)
            gram += x.T @ x
        squares, axes = np.linalg.eigh(gram)
        best = np.argsort(-squares, kind="stable")[:RANK]
        axes = np.ascontiguousarray(axes[:, best[squares[best] > 1e-9 * max(1e-30, squares.max(initial=0))]])
        model = cls(weight, axes, np.zeros((0, axes.shape[1])), labels.astype(np.float64))
        model.vectors = np.concatenate([np.zeros((0, axes.shape[1])), *(model.project(counts[i : i + BLOCK]) for i in range(0, len(counts), BLOCK))])
        return model

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = (_frequencies(counts) * self.weight).astype(np.float64) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        share = float(self.labels.mean())
        out = np.full(len(counts), share)
        k = min(NEIGHBOURS, len(self.labels))
        for begin in range(0, len(counts), BLOCK):
            cosine = np.round(self.project(counts[begin : begin + BLOCK]) @ self.vectors.T, DECIMALS)
            last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            chosen = cosine > last
            tied = cosine == last
            chosen |= tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - chosen.sum(axis=1, keepdims=True))
            _, near = np.nonzero(chosen)  # k of each row, in the sample's order
            near = near.reshape(-1, k)
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** POWER
            total = vote.sum(axis=1)
            known = total > 1e-9
            out[begin : begin + BLOCK][known] = (vote * self.labels[near]).sum(axis=1)[known] / total[known]
        return np.clip(out, 0, 1)

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, weight=self.weight, axes=self.axes, vectors=self.vectors, labels=self.labels)
        return f.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as x:
            return cls(x["weight"], x["axes"], x["vectors"], x["labels"])


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts per hundred terms of the text, on a log scale."""
    return np.log1p(counts * (100 / np.maximum(counts.sum(axis=1, keepdims=True), 1)))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros((rows, TERMS), np.float32), []
        for piece in chunks(batches, "text"):
            counts[len(known) : len(known) + piece.num_rows] = term_counts(Texts(piece.column("text")))
            known += piece.column("label").to_pylist()
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([Model.fit(counts[: len(known)], np.array(known)).to_bytes()], pa.binary())], ["model"])

    found = fit_in_one_task(labelled_sample(documents, labels, "quality", rows), run, "model binary").collect()
    return Model.from_bytes(bytes(found[0]["model"])) if found else Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0))


def scored(documents: DataFrame, model: Model, *keep: str, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The columns ``keep`` of each document, score, and predicted, under other names if these are given."""
    prepare(documents.sparkSession)
    unlike(keep, score, predicted)
    shared = documents.sparkSession.sparkContext.broadcast(model.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_bytes(shared.value)
        for piece in chunks(batches, "text"):
            counts = term_counts(Texts(piece.column("text")))
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), pa.array(own.score(counts))], [*keep, score])

    kinds = dict(documents.dtypes)
    out = documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"`{score}` double"]))
    return out.withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    documents = documents_view(read_table(spark, sf_dir, "documents"))
    out = scored(documents, train(documents, read_table(spark, sf_dir, "labels")), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
