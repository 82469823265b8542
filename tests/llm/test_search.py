import math

import numpy as np
import pytest
from palimpsest.llm import bitsliced as B

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score long"


def brute(rows, k=B.K, every=3):
    good = {}
    for i, x, *_ in rows:
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v = tuple(math.floor(1024 * float(np.float32(c))) for c in x)
            good[i] = min(good.get(i, v), v)
    out = []
    for q in (i for i in good if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, **sizes):
    vectors = B.whole_vectors(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, B.top_k(vectors, vectors.where("vec_id % 3 = 0")).select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("rows_a_block", [65_536, 16, 1])
def test_exact(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(B, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(B, "prepare", lambda s: (s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false"), s.conf.set("spark.sql.shuffle.partitions", "13")))
    draw = np.random.default_rng(7)
    rows = [(int(i), [float(np.float32(c)) for c in draw.normal(size=6)], 0, 1, 1) for i in draw.permutation(90)]
    rows += [(200 + i, [0.5, -0.5, 0.25, 0.0, 1.0, -1.0], 0, 1, 1) for i in range(30)]  # one vector, thirty times
    rows += [(300, None, 0, 1, 1), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 1, 1), (306, [float("nan")] * 6, 0, 1, 1), (309, [float("inf")] * 6, 0, 1, 1), (312, [], 0, 1, 1), (315, [2.0, 3.0], 0, 1, 1), (316, [2.0, 1.0], 0, 1, 1), (None, [1.0] * 6, 0, 1, 1), (3, [0.1] * 6, 0, 1, 1), (318, [0.0] * 6, 0, 1, 1)]
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.5], 0, 0, 0), (1, [0.5, -1.0], 0, 0, 0)]
    assert found(spark, rows) == brute(rows) and found(spark, []) == [] and found(spark, rows[:1]) == []


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(0, [1e20, 0.0], 0, 0, 0), (3, [1.0, 0.0], 0, 0, 0)])


def test_slices_add_and_compare():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 200, 300), draw.integers(0, 200, 300)
    total = np.zeros((14, 5), np.uint64)
    B.add_shifted(total, B.sliced(a, 8), 0), B.add_shifted(total, B.sliced(b, 8), 3)
    value = np.zeros(320, np.int64)
    for k in range(14):
        value += np.unpackbits(total[k].view(np.uint8), bitorder="little").astype(np.int64) << k
    assert (value[:300] == a + 8 * b).all()
    among = np.packbits(np.arange(320) < 300, bitorder="little").view(np.uint64)
    ordered = np.sort((a + 8 * b))[::-1]
    for k in (1, 7, 150, 300):
        kth = B.kth_largest(total, among, k)
        assert kth == ordered[k - 1]
        rows = np.flatnonzero(np.unpackbits(B.at_least(total, kth, among).view(np.uint8), bitorder="little"))
        assert set(rows) == set(np.flatnonzero(a + 8 * b >= kth))


def test_large_blocks_take_few_exact_scores():
    """The slices leave few boundary rows, all that belong to the best, whatever vectors are common."""
    draw = np.random.default_rng(5)
    vectors = draw.integers(-1024, 1024, (3000, 16))
    vectors[::3] = vectors[0]
    block = B.Block(np.arange(3000), vectors)
    for q in range(1, 3000, 251):
        scores = vectors @ vectors[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores.tolist()) if i != q)[: B.K]
        assert [(-s, i) for s, i in block.top(q, vectors[q], B.K)] == want
    assert np.mean([len(block.candidates(vectors[q], B.K + 1)) for q in range(1, 3000, 251)]) < 1500


def test_oracle_takes_one_row_of_each_id(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(0, [1.0, 0.5]), (0, [0.5, 0.25]), (1, [2.0, 2.0]), (1, [-1.0, 3.0]), (100, [0.0, 1.0]), (None, [1.0, 1.0]), (2, [1.0, None])]
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    want = sorted(c.execute(B.ORACLE).fetchall())
    vectors = B.whole_vectors(spark.createDataFrame([(i, x, 0, 0, 0) for i, x in rows], SCHEMA))
    out = B.top_k(vectors, vectors.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, out)) == want
