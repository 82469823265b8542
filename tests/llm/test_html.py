import random

import pytest
from palimpsest.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string, range_ int, n_chars string"


def extract(spark, rows):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], SCHEMA)).collect()}


def one(page, pair=None):
    return H.main_text(H.lines_of(page), None if pair is None else H.lines_of(pair))


def test_marked_articles():
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a>menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div><article><h1>Head</h1><p><b>One  &amp; two.<br><p>Three\n four &lt;5 &copy &amp</p><aside>side</aside><div class="notice cookie">ok?</div><ul><li>item<li>more</ul><form><p>field</form></article><section id="comments"><article><p>reader says</article></section><footer>&copy; foot</footer></body></html>'
    assert one(page) == "Head One & two. Three four <5 © & item more"
    cut = page[: page.index(" four")]
    assert one(cut) == "Head One & two. Three" and one(cut + "<p class=") == "Head One & two. Three" and one(cut + " &am") == "Head One & two. Three &am"


def test_copies_on_other_pages_stay_and_containers_go():
    page = "<article><h1>A</h1><p>same text</p><div><p>Follow us</p></div></article>"
    pair = "<article><h1>B</h1><p>same text</p><div><p>Follow us</p></div></article>"
    assert one(page, pair) == "A same text" and one(page, page) == "A same text"


def test_unmarked_pages_lose_what_their_neighbour_shares(spark):
    page = lambda body: f"<body><div>Site name</div><div><p>{body}</p></div><div>All rights</div></body>"
    rows = [(1, "http://h.org/a/1?x=1", page("first")), (2, "https://H.org/a/2.html", page("second")), (3, "http://h.org/b/9/", page("third")), (4, "http://other.org/a/1", page("alone")), (5, None, page("no url")), (6, "http://h.org/a/2", None), (7, "http://h.org/a/2", "")]
    out = extract(spark, rows)
    assert out == {1: "first", 2: "second", 3: "third", 4: "Site name alone All rights", 5: "Site name no url All rights", 6: "", 7: ""}


@pytest.mark.parametrize("per_range", [2, 500])
def test_pairs_do_not_depend_on_ranges(spark, monkeypatch, per_range):
    real = H.with_neighbours
    monkeypatch.setattr(H, "with_neighbours", lambda df, key: real(df, key, per_range))
    draw = random.Random(3)
    rows = [(i, f"http://host{i % 3}.org/{draw.randrange(20)}/{draw.randrange(50)}", f"<body><p>top {i % 3}<p>own {i}<p>end</body>") for i in range(60)]
    assert extract(spark, rows) == {i: f"own {i}" for i in range(60)}
    assert extract(spark, []) == {}


def test_alignment_is_a_longest_common_subsequence():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.choice("abcde") for _ in range(draw.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(H.shared_lines(a, b))
        assert len(found) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_addresses():
    assert H.address("https://user@Host.org:80/a/b.html?q#f") == ("host.org", "a/b") and H.address("/a/index.html") == ("", "/a")
    assert H.address(None) == ("", "") and H.address("http://h.org?x") == ("h.org", "")


def test_long_and_broken_pages():
    assert one("<p>" * 20_000 + "x") == "x" and one("<" * 20_000) == "<" * 20_000
    assert one("<div class='ad>x</div><p>y") == "x y" and one("</article></div><p>z") == "z"


def test_lines_are_the_same_only_in_the_same_place():
    page = "<body><div>Home</div><p>Home</p><p>own</p></body>"
    assert one(page, "<body><div>Home</div><p>other</p></body>") == "Home own" and one(page, "<body><section>Home</section><p>other</p></body>") == "Home Home own"


def test_copies_are_no_pairs(spark):
    """A page whose nearest neighbour is its copy is held against the other one; without another it is kept as it is."""
    page = lambda body: f"<body><div>Site</div><p>{body}</p></body>"
    rows = [(1, "http://h.org/a/1", page("one")), (2, "http://h.org/a/1", page("one")), (3, "http://h.org/b/2", page("two")), (4, "http://g.org/a/1", page("lone")), (5, "http://g.org/a/2", page("lone"))]
    assert extract(spark, rows) == {1: "Site one", 2: "one", 3: "two", 4: "Site lone", 5: "Site lone"}


def by_hand(pages):
    """Main texts of pages made of <div> and <p> lines: pairs by URL within hosts, shared lines by all common subsequences."""
    out, hosts = {}, {}
    for i, url, lines in pages:
        hosts.setdefault(url.split("/")[2], []).append((url, i, lines))
    for own in hosts.values():
        own.sort()
        for k, (url, i, lines) in enumerate(own):
            near = lambda u: tuple(map(len, (__import__("os").path.commonprefix([u.split("/")[3:], url.split("/")[3:]]), __import__("os").path.commonprefix([u, url]))))  # noqa: B023, E731
            others = [(near(own[j][0]), -j, own[j][2]) for j in (k - 1, k + 1) if 0 <= j < len(own)]
            shared = set()
            for *_, other in sorted(others, reverse=True):
                best = [[set()] * (len(other) + 1) for _ in range(len(lines) + 1)]
                for a, x in enumerate(lines):
                    for b, y in enumerate(other):
                        best[a + 1][b + 1] = best[a][b] | {a} if x == y else max(best[a + 1][b], best[a][b + 1], key=len)
                if len(best[-1][-1]) < len(lines):
                    shared = best[-1][-1]
                    break
            out[i] = " ".join(t for a, (_, t) in enumerate(lines) if a not in shared)
    return out


def test_unmarked_pages_by_brute_force(spark):
    """Whole results for pages without marked articles: each host has lines of its own at the top and the end, and pages have their own."""
    draw, pages = random.Random(9), []
    for i in range(150):
        host, lines = i % 5, [("div", f"top {i % 5}"), ("div", f"menu {i % 5}")]
        lines += [("p", f"own {i} {k}") for k in range(draw.randint(1, 4))] + [("div", f"end {i % 5}")]
        pages.append((i, f"http://host{host}.org/{draw.choice('abc')}/{draw.randrange(1000):04d}{i:03d}", lines))
    rows = [(i, url, "<body>" + "".join(f"<{e}>{t}</{e}>" for e, t in lines) + "</body>") for i, url, lines in pages]
    found = extract(spark, rows)
    assert found == by_hand(pages) == {i: " ".join(t for e, t in lines if e == "p") for i, _, lines in pages}
    unpaired = {r.page_id: r.text for r in H.extract(spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], SCHEMA), paired=False).collect()}
    assert all(unpaired[i] != found[i] for i in found)


def test_the_query_takes_every_page(spark, tmp_path):
    page = "<article><p>Text {}</p></article><footer>foot</footer>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(20)] + [(None, None, None), (5, "http://h.org/5", page.format(5))]
    spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    out = [tuple(r) for r in H.query(spark, str(tmp_path)).select("page_id", "url", "text", "n_chars").collect()]
    want = [(i, u, "" if h is None else f"Text {i}") for i, u, h in rows]
    assert sorted(out, key=repr) == sorted([(i, u, t, len(t)) for i, u, t in want], key=repr)
