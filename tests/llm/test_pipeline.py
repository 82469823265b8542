import os
import random
import re
import tempfile
from types import SimpleNamespace

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_a_small_corpus(spark, tmp_path):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice(["an", "be", "co", "de", "ro", "ti"]) for _ in range(draw.randint(2, 5)))
    docs, toxic = [], {}
    for i in range(240):
        words = [word() for _ in range(40)]
        toxic[i] = i % 5 == 1
        if toxic[i]:
            for k in range(4):
                words[k * 9] = "vile"
        docs.append([i, " ".join(words), "en", f"s{i % 4}"])
    for i in range(20):  # copies, one word changed in some
        text = docs[10 * i][1].split()
        text[-1] = text[-1] if i % 2 else "changed"
        docs.append([500 + i, " ".join(text), "en", "s0"])
    docs.append([600, " ".join(["password=abcdef1234", *reversed(docs[0][1].split())]), "en", "s1"])
    docs += [[700, None, "en", None], [701, "", None, "s2"]]
    docs = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in docs]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(t)) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    now, made = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == now.dtypes
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        made[name] = now.collect()
    text = {i: t for i, t, *_ in docs}
    left = {r.doc_id for r in made["toxicity"]}
    assert left == {i for i in text if not (text[i] and "vile" in text[i])}
    kept = {r.doc_id for r in made["near_duplicates"]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in left if len(w := (text[i] or "").split()) >= 5}
    for i in left:
        twins = [j for j in left if j < i and sets.get(i) and sets.get(j) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert (i in kept) == (not twins)
    masked = {r.doc_id: r for r in made["secrets"]}
    assert masked.keys() == kept
    for i, r in masked.items():
        assert r.text == (text[i] and text[i].replace("password=abcdef1234", "[SECRET]")) and r.n_chars == (None if r.text is None else len(r.text))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(r.text) for r in masked.values())
    assert abs(sum(size(r.text) for r in made["mixing"]) - total) <= 4
    assert all(set(r.text.split()) <= set(masked[r.doc_id].text.split()) for r in made["mixing"])
    assert len(made["bpe"]) == len(made["mixing"]) and all(r.round_trip and r.n_tokens == len(r.ids) for r in made["bpe"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(made["bpe"])


def test_near_duplicates_link_at_80_percent(spark):
    draw = random.Random(6)
    docs = []
    for k in range(60):  # the last words changed: 80 of 100 shingles shared and more, or less
        words = [f"w{draw.randrange(9999)}" for _ in range(94)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[: 94 - k % 20], *(f"x{k}y{i}" for i in range(k % 20))]))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    # 90 shingles each, 90 - d shared.
    assert kept == {i for i, _ in docs if not i % 2 or 100 * (90 - i // 2 % 20) < 80 * (90 + i // 2 % 20)}


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    words = lambda name: " ".join(f"{name}{k}" for k in range(30))
    rows = [(1, words("a")), (1, words("b")), (1, words("a")), (2, words("b") + " end"), (None, words("c")), (None, words("d")), (None, words("a")), (3, words("c") + " end"), (4, None), (None, None), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.dtypes == df.dtypes
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert left == sorted([(1, words("a")), (1, words("b")), (3, words("c") + " end"), (None, words("d")), (4, None), (4, None), (None, None)], key=repr)


CLASHING = "doc_id long, text string, source string, n_chars int, score string, predicted string, label string, spans string, ranges string, size string, number string, key string, row string, _lsn string, component_id string, kept string, ids string, held_out string"


@pytest.mark.parametrize("some", [True, False])
def test_every_stage_with_clashing_columns_odd_rows_and_none(spark, tmp_path, some):
    texts = [(1, "plain words stand here and there in a row"), (2, None), (3, ""), (4, " \t\n"), (None, "no id but words"), (5, "long " * 30_000), (6, "same text for two ids goes once"), (7, "same text for two ids goes once"), (8, "secret=abcdef123"), (8, "secret=abcdef123")]
    rows = [(i, t, None if i == 3 else f"s{(i or 0) % 2}", None if t is None else len(t), *[f"x{i}"] * 14) for i, t in texts] if some else []
    docs = spark.createDataFrame(rows, CLASHING)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if some and name == "toxicity":
            assert now.count() == len(rows)  # nothing to learn from
        if some and name == "near_duplicates":
            left = sorted((r.doc_id for r in now.collect()), key=repr)
            assert left == sorted([1, 2, 3, 4, None, 5, 6, 8], key=repr)
        if some and name == "secrets":
            assert {r.text for r in now.collect() if r.doc_id == 8} == {"[SECRET]"}
    assert now.count() > 0 if some else now.count() == 0


def test_the_last_stage_where_the_executors_folder_has_another_file_system_at_its_absolute_name(spark, tmp_path, monkeypatch):
    if not os.path.isdir("/dev/shm") or os.stat("/dev/shm").st_dev == os.stat(tmp_path).st_dev:
        pytest.skip("one file system alone")
    texts = ["the common words", "", None, "the common words of others, the common words"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    with tempfile.TemporaryDirectory(dir="/dev/shm") as own:
        os.mkdir(f"{own}/below")
        (tmp_path / "link").symlink_to(f"{own}/below")
        folder = f"{tmp_path}/link/.."  # own, but os.path.abspath makes it tmp_path
        monkeypatch.setattr(corpus_pipeline.bpe, "SparkFiles", SimpleNamespace(getRootDirectory=lambda: folder))
        rows = corpus_pipeline.encode(spark, df, "").collect()
        assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3] and all(r.round_trip and r.n_tokens == len(r.ids) and bool(r.ids) == bool(texts[r.doc_id]) for r in rows)
        assert [x.split("-")[0] for x in sorted(os.listdir(own))] == ["below", "lexicon"] and os.listdir(tmp_path) == ["link"]
