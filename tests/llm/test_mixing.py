import re

import numpy as np
import pytest
from palimpsest.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, taken int, number int, block long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, 2, 3) for i, t, s in rows], SCHEMA)


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def corpus():
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 40)), ("big", "éa", "a", None)[0 if i % 3 else i % 4]) for i in range(300)]
    return rows + [(900, None, "a"), (901, "", None), (902, "one", "tiny"), (902, "one", "tiny"), (None, "no id here", "a"), (903, "  x　y\tz", "big"), (904, "w " * 20_000, "a"), (905, " ", "blank")]


def test_targets_stop_at_three_times_and_share_the_rest():
    assert M.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert M.targets([10, 1000, 1000]) == pytest.approx([30, 1980 * 2 / 3, 1980 / 3])
    assert M.targets([]) == [] and M.targets([0, 0]) == [0, 0] and M.targets([5, 0]) == [5, 0]
    draw = np.random.default_rng(1)
    for _ in range(100):
        sizes = [int(x) for x in draw.integers(0, 1000, draw.integers(1, 9))]
        goals = M.targets(sizes)
        assert sum(goals) == pytest.approx(sum(sizes)) and all(g <= 3 * s + 1e-6 for g, s in zip(goals, sizes, strict=True))


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        out = M.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(out.tolist()) == list(range(n))
    assert (M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1, np.uint64)) != M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 2, np.uint64))).any()


def test_taken(spark):
    rows = corpus()
    out = M.Mix(frame(spark, rows)).taken().collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in out) == sorted((i is None, i or 0, size(t)) for i, t, _ in rows)
    of = {}
    for i, t, s in rows:
        of[s] = of.get(s, 0) + size(t)
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    goals = dict(zip(names, M.targets([of[s] for s in names]), strict=True))
    by_goal = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        by_goal.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for s in names:
        # Within a block of the target, and blocks are a 4096th of the source or a word.
        assert abs(sum(by_goal[of[s], round(goals[s], 6)]) - goals[s]) <= max(1.0, of[s] / 2048)
    again = M.Mix(frame(spark, rows[::-1])).taken().collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_mixed_documents_hold_the_words_that_are_taken(spark):
    rows = corpus()
    mix = M.Mix(frame(spark, rows))
    taken = {}
    for r in mix.taken().collect():
        taken.setdefault(r.doc_id, []).append(r.taken)
    words, texts = {}, {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t)
    for r in mix.mixed_documents().collect():
        assert r.n_chars == len(r.text) and r.lang == "en"
        own = [set(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts[r.doc_id]]
        assert any(set(re.findall(r"[^\x20\x09-\x0D]+", r.text)) <= s for s in own)
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
    assert {i: n for i, n in words.items() if n} == {i: sum(n) for i, n in taken.items() if sum(n)}


def test_nothing_to_mix(spark):
    assert M.Mix(frame(spark, [])).taken().count() == 0
    assert [r.taken for r in M.Mix(frame(spark, [(1, None, None), (2, " ", "a")])).taken().collect()] == [0, 0]
    assert M.Mix(frame(spark, [(1, None, None)])).mixed_documents().count() == 0


def test_the_inverse_permutation():
    for n in (1, 2, 5, 64, 1000):
        places = M.permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
        assert all(M.index_of(int(places[i]), n, 9) == i for i in range(0, n, max(1, n // 50)))


def test_slots_come_to_the_target_to_the_word():
    draw = np.random.default_rng(4)
    for number in range(200):
        size = int(draw.integers(1, 12 * M.BLOCK_WORDS))
        words = int(draw.integers(0, 3 * size + 1))
        n, last = M.slots_for(number, words, size)
        blocks = -(-size // M.BLOCK_WORDS)
        turn = np.arange(n) // blocks
        block = M.permuted(np.arange(n) % blocks, np.full(n, blocks), M.round_key(np.full(n, number), turn))
        of = [min(M.BLOCK_WORDS, size - b * M.BLOCK_WORDS) for b in block.tolist()]
        assert sum(of[:-1]) + min([last, *of[-1:]]) * bool(n) == words


def test_draws_use_up_all_slots():
    slots = np.array([500, 0, 3, 1000])
    for shards in (1, 2, 7, 40):
        out = M.drawn(slots, shards, 5)
        assert len(out) <= shards and (sum(out) == slots).all() and max(abs(x.sum() - 1503 / shards) for x in out) <= shards


def test_taken_by_brute_force(spark, monkeypatch):
    """Each document's words against a stream laid out word by word and slots walked one by one, over several groups of shards."""
    monkeypatch.setattr(M, "SHARD_WORDS", 3000)
    monkeypatch.setattr(M, "MOST_GROUPS", 3)
    rows = [(i, " ".join(f"w{k}" for k in range(37 * i % 900)), ("a", "b", "c")[i % 7 % 3]) for i in range(120)]
    mix = M.Mix(frame(spark, rows))
    order = {}
    for r in mix.placed.orderBy("number", "begin").collect():
        order.setdefault(r.number, []).append((r.key, r["size"]))
    want = {i: 0 for i, _, _ in rows}
    names = ["a", "b", "c"]
    goals = M.targets([sum(size(t) for _, t, s in rows if s == name) for name in names])
    assert {n: sorted(k for k, _ in own) for n, own in order.items()} == {n: sorted(i for i, t, s in rows if s == name and size(t)) for n, name in enumerate(names)}
    for number, own in order.items():
        stream = [key for key, n in own for _ in range(n)]
        blocks = [stream[i : i + M.BLOCK_WORDS] for i in range(0, len(stream), M.BLOCK_WORDS)]
        left, k = round(goals[number]), 0
        while left:
            turn = np.array([k // len(blocks)])
            b = int(M.permuted(np.array([k % len(blocks)]), np.array([len(blocks)]), M.round_key(np.array([number]), turn))[0])
            for key in blocks[b][:left]:
                want[key] += 1
            left -= len(blocks[b][:left])
            k += 1
    assert {r.doc_id: r.taken for r in mix.taken().collect()} == want
    slots = mix.slots().collect()
    assert sorted((r.number, r.slot) for r in slots) == sorted((r.number, k) for r in mix.sources.collect() for k in range(r.slots))
    assert len({r.shard for r in slots}) > 3
    monkeypatch.setattr(M, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        M.Mix(frame(spark, rows))
