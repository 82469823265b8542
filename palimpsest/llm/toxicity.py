"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's words are its runs of bytes other than ASCII marks and white space, A-Z lower-cased. Its features are each word,
each pair of neighbours and each pair with one word between, hashed to ``BUCKETS`` coordinates and counted, over the root of
the text's length. As many languages inflect, words of more than ``STEMS`` bytes also count as their first so many bytes (1-grams only). Learning rates
are per coordinate, and L1 keeps the weights few: they are broadcast as two short arrays.

Weights are fitted on at most ``TRAIN_ROWS`` labelled documents (whole texts) outside the held-out rows, in one task that
holds only those rows' features. Scoring takes whole texts of all documents and nothing but the text.

Null and empty texts, and others without a word, have no feature: they score the sample's share of label 1. Without usable
labels every score is 0.5. Repeated rows each give a row; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BYTE_VALUE, LOWER, Texts, chunks, documents_view, held_out, mixed, prefix_hashes, prepare, read_table, seeded, span_hashes, unlike
from ._labelled import fit_in_one_task, labelled_sample

BUCKETS = 1 << 20
TRAIN_ROWS = 8_192
STEMS = (4, 6)
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1.5, 0.0
#: A feature's value is its count times this over the square root of the text's number of features.
SCALE = 8.0
THRESHOLD = 0.3

_U = np.uint64
_SALT = seeded(3 + len(STEMS), 31) | _U(1)
_MARK = np.zeros(256, bool)
_MARK[:128] = True
_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of each text's features, one after another, and where each text's begin."""
    plain = object.__new__(Texts)
    plain.data, plain.at = np.where(_MARK[texts.data], np.uint8(0x20), texts.data), texts.at
    starts, ends, first = plain.words()
    prefix = prefix_hashes(BYTE_VALUE[LOWER[plain.data]])
    words = span_hashes(prefix, starts, ends)
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    kinds = [(np.arange(len(words)), words)]
    with np.errstate(over="ignore"):
        for k, size in enumerate(STEMS, 3):
            long = np.flatnonzero(ends - starts > size)
            kinds.append((long, mixed(span_hashes(prefix, starts[long], starts[long] + size) * _SALT[k])))
        for k, gap in enumerate((1, 2), 1):
            one = np.arange(max(0, len(words) - gap))
            one = one[one + gap < np.repeat(first[1:], n)[: len(one)]]
            kinds.append((one, mixed(words[one] * _SALT[k] + words[one + gap])))
    spots = np.concatenate([s for s, _ in kinds])
    row = of[spots]
    order = np.argsort(row, kind="stable")
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(n)), out=at[1:])
    return (np.concatenate([h for _, h in kinds])[order] & _U(BUCKETS - 1)).astype(np.int32), at


Model = tuple[np.ndarray, np.ndarray, float, float]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """From (coordinates, counts, label) to the coordinates with a weight, their weights, the bias, and the share of label 1."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    bias = np.array([BUCKETS])
    for _ in range(epochs):
        for where, count, label in rows:
            i, x = np.append(where, bias), np.append(count * (SCALE / np.sqrt(max(1, count.sum()))), 1)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    all_weights = weights(np.arange(BUCKETS + 1))
    used = np.flatnonzero(all_weights[:-1])
    return used.astype(np.int32), all_weights[used].astype(np.float32), float(all_weights[-1]), float(np.mean([label for *_, label in rows]))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The sparse weights: at most ``BUCKETS`` of them, and some thousands in practice."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for piece in chunks(batches, "text"):
            where, at = features(Texts(piece.column("text")))
            for k, label in enumerate(piece.column("label").to_pylist()):
                seen.append((*np.unique(where[at[k] : at[k + 1]], return_counts=True), label))
        used, weights, bias, share = fit(seen) if seen else (np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, 0.5)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2]).astype(np.int32)), pa.array(np.append(weights, [bias, share]).astype(np.float64))], ["feature", "weight"])

    found = fit_in_one_task(labelled_sample(documents, labels, "toxic", rows), run, "feature int, weight double").toPandas()
    bias = float(found.weight[found.feature == -1].sum())
    share = float(found.weight[found.feature == -2].sum()) if len(found) else 0.5
    found = found[found.feature >= 0].sort_values("feature")
    return found.feature.to_numpy(np.int32), found.weight.to_numpy(np.float32), bias, share


def fitted(model: Model) -> bool:
    """Whether there were labels to learn from."""
    used, _, bias, share = model
    return bool(len(used)) or bias != 0 or share != 0.5


def scored(documents: DataFrame, model: Model, *keep: str, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The columns ``keep`` of each document, score (the probability that its text is toxic) and predicted, under other names if these are given."""
    prepare(documents.sparkSession)
    unlike(keep, score, predicted)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def setup():
        used, weights, bias, share = shared.value
        table = np.zeros(BUCKETS, np.float32)
        table[used] = weights
        return table, bias, share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias, share = setup()
        for piece in chunks(batches, "text"):
            where, at = features(Texts(piece.column("text")))
            out = np.full(len(at) - 1, share)
            full = np.flatnonzero(np.diff(at))
            if len(full):
                total = np.add.reduceat(table[where].astype(np.float64), at[:-1][full]) * SCALE / np.sqrt(np.diff(at)[full])
                out[full] = 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), pa.array(out)], [*keep, score])

    kinds = dict(documents.dtypes)
    made = documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"`{score}` double"]))
    return made.withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    documents = documents_view(read_table(spark, sf_dir, "documents"))
    out = scored(documents, train(documents, read_table(spark, sf_dir, "labels")), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
