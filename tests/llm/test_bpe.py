import errno
import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from palimpsest.llm import bpe as B
from palimpsest.llm._common import Texts

SCHEMA = "doc_id long, text string, ids string, n_tokens int, word string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.default_vocabulary())


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(B.default_vocabulary())


def lexicon(vocabulary, words):
    words = sorted({w.encode() for w in words})
    at = np.cumsum([0, *map(len, words)])
    return B.Transducer.build(words, *vocabulary.merge(np.frombuffer(b"".join(words), np.uint8), at))


def texts():
    draw = random.Random(1)
    parts = ["'s", "'ll", "'", " ", "  ", "\n", "\t", "\r\n", "a", "é", "1", "²", "Ⅷ", "!", "<|endoftext|>", "'re", "don't", "‍", "中", "😀", "é", "xxx", "<|", "|>", "ab'ves", " ", "\x00", " the", "thereou", "　"]
    out = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(1500)]
    out += ["".join(chr(draw.choice([draw.randint(0, 0x2FFF), draw.randint(0xE000, 0x1FFFF)])) for _ in range(50)) for _ in range(500)]
    return [*out, "", "a" * 3000 + "b" * 500, "!?" * 2000, "word " * 30_000]


def test_ids_are_the_librarys(vocabulary, library):
    given = texts()
    encoder = B.Encoder(vocabulary, lexicon(vocabulary, [" the", "the", "thereou", "xxx", "a", "é", " word"]))
    for _ in range(2):  # the second time from what it remembers
        ids, at = encoder.encode(Texts(pa.array(given)))
        want = library.encode_batch(given, add_special_tokens=False)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(given))] == [w.ids for w in want]


def test_the_automaton_is_minimal_and_finds_its_words_alone(vocabulary):
    words = ["tap", "taps", "top", "tops", "stop", "stops"]
    auto = lexicon(vocabulary, words)
    assert len(auto.parts["final"]) == 7  # root, t, s, st, t[ao], and the final ones after p and s
    asked = [w.encode() for w in [*sorted(words), "ta", "tapss", "x", "stopsx"]]
    assert auto.find(np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0, *map(len, asked)])).tolist() == [0, 1, 2, 3, 4, 5, -1, -1, -1, -1]
    again = B.Transducer.mapped(auto.to_bytes(), "test-" + hashlib.sha256(auto.to_bytes()).hexdigest()[:8])
    assert all((again.parts[k] == v).all() for k, v in auto.parts.items())


def test_the_working_folder_may_have_another_mount_at_its_absolute_name(vocabulary, tmp_path, monkeypatch):
    auto = lexicon(vocabulary, ["tap", "taps", "top"])
    own, elsewhere, replace = tmp_path / "own", tmp_path / "elsewhere", os.replace
    own.mkdir(), elsewhere.mkdir()

    def among_mounts(a, b):
        if not os.path.samefile(os.path.dirname(a), os.path.dirname(b)):
            raise OSError(errno.EXDEV, os.strerror(errno.EXDEV), a, None, b)
        replace(a, b)

    monkeypatch.chdir(own)
    monkeypatch.setattr(os, "getcwd", lambda: str(elsewhere))
    monkeypatch.setattr(os, "replace", among_mounts)
    for _ in range(2):  # written, then found
        mapped = B.Transducer.mapped(auto.to_bytes(), "x", ".")
        assert all((mapped.parts[k] == v).all() for k, v in auto.parts.items())
    assert os.listdir(own) == ["lexicon-x"] and not os.listdir(elsewhere)


def test_query_columns_match_the_library(spark, library):
    given = [*texts()[:60], "word " * 2000]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(given)] + [(900, None, "x", 1, "y"), (3, given[3], "x", 1, "y")]
    out = B.digests(spark.createDataFrame(rows, SCHEMA), B.default_vocabulary()).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, out)) == sorted(want)
    assert B.digests(spark.createDataFrame([], SCHEMA), B.default_vocabulary()).count() == 0


def test_frequent_words_are_none_but_the_frequent(spark):
    docs = spark.createDataFrame([(i, "often " * 40 + "qxzj"[i % 4] * (i // 4 + 1), "", 0, "") for i in range(50)], SCHEMA)
    words = B.frequent_words(docs, {}, share=0.01, most=3)
    assert b" often" in words and len(words) <= 3 and all(w.strip() in (b"often", b"q", b"x", b"z", b"j") for w in words)


def test_decode_replaces_broken_bytes(spark):
    tokenizer = B.Tokenizer(spark, B.default_vocabulary(), spark.createDataFrame([("a",)], "text string"))
    ids = spark.createDataFrame([(1, [tokenizer.vocabulary.of_byte[0xE9].item(), 64]), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokenizer.decode(ids, "doc_id").collect()} == {1: "�a", 2: ""}
