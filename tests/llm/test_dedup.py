import random
import re

import numpy as np
import pytest
from palimpsest.llm import minhash_dedup as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept string, band long"


def table(spark, rows):
    """Rows (doc_id, text) with extra columns whose names the operator also uses."""
    return spark.createDataFrame([(i, t, "en", "s", None, 5, "x", 7) for i, t in rows], SCHEMA)


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets[i] = sets.get(i, set()) | s
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df).collect()}


def prose(draw, n):
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def test_agrees_with_all_pairs(spark):
    draw = random.Random(5)
    rows, base = [], prose(draw, 120)
    for i in range(80):  # one family with links of all strengths: chains, near misses, exact copies
        words = list(base)
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
            words[draw.randrange(len(words))] = f"x{draw.randrange(9999)}"
        rows.append((i, " ".join(words)))
    line = " ".join(prose(draw, 12))
    rows += [(1000 + i, f"{line} {' '.join(prose(draw, draw.randint(0, 30)))} {line}") for i in range(60)]
    rows += [(2000 + i, " ".join(prose(draw, draw.randint(0, 8)))) for i in range(40)]
    rows += [(3000, " ".join(prose(draw, 20_000)))]
    draw.shuffle(rows)
    assert found(table(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    five = "One  two\tTHREE\nfour five"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "b a"), (7, five), (8, five.lower()), (None, five), (9, "É x y z w"), (10, "é x y z w"), (11, "a b c d e"), (12, "a b c d e")]
    assert found(table(spark, rows)) == brute(rows)


def test_repeated_ids_are_one_document(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b), (4, f"{a}"), (4, b)]
    assert found(table(spark, rows)) == brute(rows) == {1: (4, 1, True), 2: (2, 2, True), 3: (2, 3, True), 4: (4, 1, False)}


def test_empty_table(spark):
    out = M.near_duplicates(table(spark, []))
    assert out.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(30)], [(0, k) for k in range(1, 40)], [(3, 9), (9, 4), (4, 8), (20, 21), (21, 22), (20, 22)]])
def test_components(spark, edges):
    out = {r.node: r.component for r in M.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if (root[a], root[b]) != (m, m):
                root[a] = root[b] = m
                changed = True
    assert out == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_links_of_small_sets(spark):
    draw, rows = random.Random(21), []
    for k in range(900):  # a text and the same with a word more, of 6 to 25 shingles
        words = prose(draw, 10 + k % 3 if k % 2 else draw.randint(10, 29))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
    assert found(table(spark, rows)) == brute_by_shingle(rows)


def brute_by_shingle(rows, percent=85):
    """The pairs (2k, 2k + 1) are all that share a shingle."""
    out = {}
    for k in range(0, len(rows), 2):
        (a, s), (b, t) = rows[k : k + 2]
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (s.split(), t.split()))
        linked = 100 * len(s & t) >= percent * len(s | t)
        out |= {a: (len(s), a, True), b: (len(t), a if linked else b, not linked)}
    return out


def test_every_link_of_short_near_copies(spark):
    """2,000 near copies of 10 to 20 words: a word more at an end, so that 6 of 7 shingles and up are shared."""
    draw, rows = random.Random(33), []
    for k in range(2000):
        words = prose(draw, draw.randint(9, 20))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(["more", *words] if k % 2 else [*words, "more"]))]
    assert found(table(spark, rows)) == brute_by_shingle(rows)


def test_sets_around_the_largest_map_and_at_the_threshold(spark):
    """Pairs of both sorts of signature, of a small and a large set, and with just as many changed words as a link allows, and one more."""
    draw, rows = random.Random(34), []
    for k in range(120):
        n = draw.choice([60, 250, 480, M.SMALL - 3, M.SMALL + 6, 700, 1500])
        words = prose(draw, n)
        least = -(-170 * (n - 4) // 185)  # 100 * shared >= 85 * (2 * size - shared)
        changed = n - 4 - least + draw.choice([0, 1])
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[: n - changed], *(f"y{k}z{i}" for i in range(changed))]))]
    want = brute_by_shingle(rows)
    assert found(table(spark, rows)) == want and {kept for i, (_, _, kept) in want.items() if i % 2} == {True, False}


def test_maps_never_refuse_a_link(spark):
    """Signatures refuse no pair that the full sets link, whatever the sizes; most pairs well below the threshold go."""
    draw, sets = random.Random(35), []
    for k in range(300):
        n = draw.randint(1, M.SMALL)
        one = draw.sample(range(10**6), n)
        lacks, more = draw.randint(0, n // 5), draw.randint(0, n // 5)
        sets.append((one, one[lacks:] + [10**6 + k * 1000 + i for i in range(more)]))
    signed = lambda xs: M.maps(np.concatenate([np.array(x, np.uint64) for x in xs]), np.array([len(x) for x in xs]))
    a, b = signed([x for x, _ in sets]), signed([y for _, y in sets])
    rows = [(k, k, len(x), len(y), *a[k].tolist(), *b[k].tolist()) for k, (x, y) in enumerate(sets)]
    columns = ["a long", "b long", "n_a long", "n_b long", *(f"sign_{k}_a long" for k in range(M.WORDS)), *(f"sign_{k}_b long" for k in range(M.WORDS))]
    kept = {r.a for r in spark.createDataFrame(rows, ", ".join(columns)).where(M._may_link("a", "b", 85)).collect()}
    linked = {k for k, (x, y) in enumerate(sets) if 100 * len({*x} & {*y}) >= 85 * len({*x} | {*y})}
    assert linked <= kept and len(kept - linked) < len(sets) - len(linked)


def test_a_templated_group_without_links(spark):
    """Documents that share a template and have words of their own meet in many buckets; none is linked, and none is lost that is."""
    draw = random.Random(36)
    template = prose(draw, 100)
    rows = [(k, " ".join([*template, *prose(draw, 18)])) for k in range(150)]
    rows += [(500 + k, rows[k][1] + " end") for k in range(0, 150, 10)]
    assert found(table(spark, rows)) == brute(rows)
