import random
import zlib

import numpy as np
import pytest
from palimpsest.llm import quality, toxicity

DOCS = "doc_id long, text string, score double, label int, spot long, source string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=400):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice(["an", "be", "co", "de", "ro", "ti"]) for _ in range(draw.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(draw.randint(5, 60))]
        bad, junk = i % 4 == 1, i % 4 == 3
        if bad:
            for _ in range(max(1, len(words) // 12)):
                words.insert(draw.randrange(len(words)), draw.choice(["scumble,", "vile", "vilest."]))
        if junk:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), 0.5, 3, 9, "s"))
        labels.append((i, int(not junk), int(bad), "other"))
    return docs, labels


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_learns_and_keeps_held_out_rows_out(spark, module, column):
    docs, labels = corpus()
    extra = [(10_000, None, 0.1, 1, 1, "s"), (10_001, "", 0.1, 1, 1, "s"), (10_002, " \n", 0.1, 1, 1, "s"), (None, "vile words", 0.1, 1, 1, "s"), (5, docs[5][1], 0.1, 1, 1, "s"), (10_003, "word " * 20_000, 0.1, 1, 1, "s")]
    # Held-out labels are turned around: a model that saw them would do badly on the rest.
    turned = [(i, q if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - q, t if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - t, x) for i, q, t, x in labels]
    turned += [(None, 1, 1, ""), (7, None, None, ""), (8, 9, 9, ""), (99_999, 1, 1, "")]
    frame, marks = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(turned, LABELS)
    model = module.train(frame, marks)
    out = module.scored(frame, model, "doc_id", "source").collect()
    assert len(out) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in out)
    truth = {i: dict(zip(("quality", "toxic"), (q, t), strict=True))[column] for i, q, t, _ in labels}
    right = np.mean([r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth])
    assert right > 0.97
    again = module.scored(frame, module.train(frame, marks), "doc_id", "source").collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_rows(spark, module):
    docs, _ = corpus(8)
    frame, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    assert {r.score for r in module.scored(frame, module.train(frame, none), "doc_id").collect()} == {0.5}
    empty = spark.createDataFrame([], DOCS)
    assert module.scored(empty, module.train(empty, none), "doc_id").count() == 0


def test_features_of_each_text_stand_alone():
    import pyarrow as pa
    from palimpsest.llm._common import Texts

    given = ["Vile, words here", "", "one", "x y", "Vile, words here", None]
    together, at = toxicity.features(Texts(pa.array(given)))
    for i, t in enumerate(given):
        alone, _ = toxicity.features(Texts(pa.array([t], pa.string())))
        assert sorted(together[at[i] : at[i + 1]]) == sorted(alone)
    assert (quality.term_counts(Texts(pa.array(given)))[0] == quality.term_counts(Texts(pa.array(given[:1])))[0]).all()


def test_neighbours_vote_as_brute_force():
    draw = np.random.default_rng(1)
    counts, labels = draw.poisson(0.05, (60, quality.TERMS)).astype(np.float32), draw.integers(0, 2, 60)
    model = quality.Model.fit(counts, labels)
    asked = draw.poisson(0.05, (700, quality.TERMS)).astype(np.float32)
    x = model.project(asked)
    for i, score in list(enumerate(model.score(asked)))[::50]:
        cosine = [float(np.dot(x[i], v)) for v in model.vectors]
        near = sorted(range(60), key=lambda k: -cosine[k])[: quality.NEIGHBOURS]
        votes = [max(0, cosine[k]) ** quality.POWER for k in near]
        assert score == pytest.approx(sum(v * labels[k] for v, k in zip(votes, near, strict=True)) / sum(votes), abs=1e-5)


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_clashing_names_and_the_query(spark, tmp_path, module, column):
    """Kept columns may not have an added one's name; the query gives held_out by crc32 and a score for every row, whatever columns the table has."""
    docs, labels = corpus(120)
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = module.train(frame, marks)
    with pytest.raises(ValueError, match="share a name"):
        module.scored(frame, model, "doc_id", "Score")
    other = module.scored(frame, model, "doc_id", "score", score="p", predicted="label").collect()
    assert {r.score for r in other} == {0.5} and all(r.label == int(r.p >= module.THRESHOLD) for r in other)
    frame.withColumnRenamed("label", "predicted").write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    out = {r.doc_id: r for r in module.query(spark, str(tmp_path)).collect()}
    assert len(out) == 120 and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert {i: r.score for i, r in out.items()} == {r.doc_id: r.p for r in other}


def test_votes_of_equal_neighbours_go_by_the_samples_order():
    counts = np.zeros((40, quality.TERMS), np.float32)
    counts[:, 3] = 5  # all alike
    counts[30:, 9] = 5
    model = quality.Model.fit(counts, np.array([1] * quality.NEIGHBOURS + [0] * (40 - quality.NEIGHBOURS)))
    asked = np.repeat(counts[:1], quality.BLOCK + 7, axis=0)
    assert set(model.score(asked)) == {1.0} and set(model.score(asked[:1])) == {1.0}


def test_term_counts_by_brute_force():
    """Words are counted by identity: texts with the same shapes and other words differ, in the word terms alone."""
    import pyarrow as pa
    from palimpsest.llm._common import Texts

    one, two = (quality.term_counts(Texts(pa.array([t])))[0] for t in ("abc def abc", "xyz uvw xyz"))
    assert (one[: quality.SHAPE_TERMS] == two[: quality.SHAPE_TERMS]).all() and (one[quality.SHAPE_TERMS :] != two[quality.SHAPE_TERMS :]).any()
    assert one[quality.SHAPE_TERMS :].sum() == 3 and sorted(one[quality.SHAPE_TERMS :][one[quality.SHAPE_TERMS :] > 0]) == [1, 2]


def features_by_hand(text):
    """Words, stems, neighbours and pairs with one word between, as tuples."""
    words = "".join(" " if ord(c) < 128 and not c.isalnum() else c.lower() if ord(c) < 128 else c for c in text or "").split(" ")
    words = [w.encode() for w in words if w]
    out = [("word", w) for w in words] + [("stem", w[:n], n) for n in toxicity.STEMS for w in words if len(w) > n]
    return out + [(gap, words[i], words[i + gap]) for gap in (1, 2) for i in range(len(words) - gap)]


def test_features_by_brute_force():
    """The hashed features stand for the tuples one to one, text by text."""
    import pyarrow as pa
    from palimpsest.llm._common import Texts

    draw = random.Random(12)
    given = [" ".join(draw.choice(["vile", "words", "Étude", "antidisestablishment", "a", "of-it", "x1,y2", "straße"]) for _ in range(draw.randint(0, 30))) for _ in range(60)]
    hashed, at = toxicity.features(Texts(pa.array(given)))
    of = {}
    for i, t in enumerate(given):
        want = features_by_hand(t)
        assert at[i + 1] - at[i] == len(want)
        for k in set(want):
            of.setdefault(k, set()).add(want.count(k))
    spots = {k: None for k in of}
    for k in spots:  # each tuple alone gives its coordinate by the texts that hold it
        holding = [set(hashed[at[i] : at[i + 1]].tolist()) for i, t in enumerate(given) if k in features_by_hand(t)]
        spots[k] = set.intersection(*holding)
        assert spots[k]
    assert all(set(hashed[at[i] : at[i + 1]].tolist()) <= set().union(*(spots[k] for k in features_by_hand(t))) for i, t in enumerate(given) if t)


def test_ftrl_as_written_out():
    """The vectorised fit against a loop over single coordinates."""
    draw = random.Random(14)
    rows = []
    for k in range(60):
        where = sorted(draw.sample(range(50), draw.randint(1, 12)))
        rows.append((np.array(where, np.int32), np.array([draw.randint(1, 3) for _ in where]), int(where[0] < 6)))
    z, n, bias = {}, {}, toxicity.BUCKETS

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for where, count, label in rows:
            x = {int(i): c * toxicity.SCALE / sum(count) ** 0.5 for i, c in zip(where, count, strict=True)} | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    used, weights, intercept, share = toxicity.fit(rows)
    want = {i: weight(i) for i in z if i != bias and weight(i)}
    assert dict(zip(used.tolist(), weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)
    assert intercept == pytest.approx(weight(bias)) and share == pytest.approx(np.mean([r[2] for r in rows]))


def test_the_sample_is_the_smallest_hashes_however_many_labels(spark):
    from palimpsest.llm._labelled import labelled_sample
    from pyspark.sql import functions as F

    ids = list(range(3000))
    docs = spark.createDataFrame([(i, f"text {i}", 0.0, 0, 0, "") for i in ids], DOCS)
    marks = [(i, i % 2, 0, "") for i in ids] + [(i, 0, 0, "") for i in ids[::2]] + [(None, 1, 1, ""), (3, None, 1, "")]
    spots = {r.i: r.h for r in spark.range(3000).select(F.col("id").alias("i"), F.xxhash64("id").alias("h")).collect()}
    free = sorted((spots[i], i) for i in ids if zlib.crc32(str(i).encode()) % 4 != 2)
    for rows, given in ((40, marks), (5000, marks), (40, [m for m in marks if m[0] is not None and m[0] >= 0] + [(2, 1, 1, "")] * 3000), (40, [(i, 1, 1, "") for _, i in free[-200:]])):
        out = labelled_sample(docs, spark.createDataFrame(given, LABELS), "quality", rows).collect()
        wanted = {m[0] for m in given if m[0] is not None and m[1] is not None}
        assert {r.doc_id for r in out} == {i for _, i in [(h, i) for h, i in free if i in wanted][:rows]}
        assert all(r.text == f"text {r.doc_id}" and r.spot == spots[r.doc_id] for r in out)
