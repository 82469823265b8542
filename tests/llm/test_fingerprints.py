import hashlib
import random

import pytest
from palimpsest.llm import lz_fingerprint as L

SCHEMA = "doc_id long, text string, range int, ahead int, first boolean"


def phrases(data):
    seen, word = set(), b""
    for byte in data:
        word += bytes([byte])
        if word not in seen:
            seen.add(word)
            word = b""
    return seen, word


def test_parse_is_lz78():
    draw = random.Random(2)
    for _ in range(50):
        data = bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 300)))
        nodes, hashes = {}, [0]
        last = L.parse(data, nodes, hashes)
        seen, rest = phrases(data)
        assert len(hashes) - 1 == len(seen) and bool(last) == bool(rest)


def test_likeness_follows_the_edit():
    draw = random.Random(4)
    text = "".join(draw.choice("abcdefgh ") for _ in range(4000))
    near = [L.likeness(L.fingerprint_of(text), L.fingerprint_of(text[: 4000 - cut] + "".join(draw.choice("stuvwxyz ") for _ in range(cut)))) for cut in (0, 400, 2000, 4000)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[-1] < 0.3
    assert L.likeness(L.fingerprint_of(""), L.fingerprint_of("")) == 1 and L.likeness(L.fingerprint_of(""), L.fingerprint_of("a")) == 0


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        a, b, c = map(L.fingerprint_of, (t, edited, following))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), L.likeness(a, b), L.likeness(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_range", [3, 500])
def test_neighbours(spark, monkeypatch, per_range):
    monkeypatch.setattr(L, "RANGE_ROWS", per_range)
    draw = random.Random(6)
    rows = [(draw.randrange(-50, 10**12), "".join(draw.choice("ab é😀") for _ in range(draw.randint(0, 40)))) for _ in range(60)]
    rows += [(5, None), (6, ""), (7, "same"), (7, "other"), (7, "same"), (None, "null id"), (None, None), (8, "long " * 20_000)]
    frame = spark.createDataFrame([(i, t, 1, 1, True) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, L.compare_neighbours(frame).collect()), key=repr) == want(rows)


def test_one_and_no_document(spark):
    frame = spark.createDataFrame([(3, "abcdefgh", 1, 1, True)], SCHEMA)
    (row,) = L.compare_neighbours(frame).collect()
    assert tuple(row) == want([(3, "abcdefgh")])[0] and row.near_next == 1
    assert L.compare_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    (only,) = L.fingerprint(frame, "doc_id").collect()
    assert only.fingerprint == row.fingerprint


def by_hand(text):
    """The fingerprint from phrases as bytes: each phrase's hash from its prefix's, the least of each bin."""
    made, word, whole = {b"": 0}, b"", (text or "").encode()
    for byte in whole:
        word += bytes([byte])
        if word not in made:
            made[word] = (made[word[:-1]] * 0x1000193 + L._BYTE_SALT[byte]) & L._MASK
            word = b""
    values = [h for w, h in made.items() if w] + ([(made[word] ^ 0x5555555555) & L._MASK] if word else [])
    out = [0] * L.BINS
    for h in values:
        x = (h + (L._STEP & L._MASK)) % 2**64
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % 2**64
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) % 2**64
        x ^= x >> 31
        least = (x >> 32) | 1
        out[x % L.BINS] = min(out[x % L.BINS] or least, least)
    return out


def test_fingerprints_by_brute_force():
    draw = random.Random(8)
    for n in (0, 1, 2, 50, 3000):
        text = "".join(draw.choice("abé ") for _ in range(n))
        assert L.fingerprint_of(text).tolist() == by_hand(text)
        other = "".join(draw.choice("abé ") for _ in range(n))
        a, b = by_hand(text), by_hand(other)
        used = [k for k in range(L.BINS) if a[k] or b[k]]
        assert L.likeness(L.fingerprint_of(text), L.fingerprint_of(other)) == pytest.approx(sum(a[k] == b[k] for k in used) / len(used) if used else 1)


def test_ranges_are_even_and_split_equal_ids(spark):
    """A third of all rows has no id and a third has one: no range holds much more than its share, and every row has one place."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}", 1, 1, True) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    from pyspark.sql import functions as F

    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("hash"))
    dealt = L.in_ranges(docs, key, (1,), 100, around=True).collect()
    own = [r for r in dealt if r.role_ == 0]
    sizes = [sum(r.range_ == k for r in own) for k in {r.range_ for r in own}]
    assert len(own) == 3000 and len(sizes) >= 25 and max(sizes) <= 300
    assert sorted(r.range_ for r in dealt if r.role_ == 1) == sorted({r.range_ for r in own})
