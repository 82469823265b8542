"""Main text of web pages: each page is held against the page whose URL is nearest on its host, and shared lines go.

A page's lines are the texts of its blocks. Pages of a host are ordered by path; of the pages before and after, the one with
the longer common path prefix is the pair (the one before if equal), unless it shares every line: a copy says nothing about
what is boilerplate, and the other one is the pair if it is none. The lines of both, each with the elements that it stands in,
are aligned by a longest common subsequence, and shared lines are deleted, with two exceptions that markup decides, since line
differences can't:

* what stands in menus, page headers and footers, sidebars, notices, adverts, forms, comment sections and the like goes
  whether the pair shares it or not (such blocks often differ from page to page);
* where a page marks its article (``article``, else ``main``), lines outside it go as well, and the article's own flow of
  headings, paragraphs, lists, quotes and tables stays though another page shares it: copies and quoted passages are content.

Inside a block white space becomes one space, and blocks are joined by one space. Character references are decoded. Markup
is read as browsers do where it is broken: unclosed elements, stray end tags, pages cut off within a tag or a reference.

Null and blank pages have the empty text and are nobody's pair. Null URLs count as one host without a path; repeated URLs are pages of their own.
Empty tables give no rows.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, read_table
from ._ranges import with_neighbours

# HTML's elements by what they do to text, and names that mark boilerplate.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
FLOW = frozenset("article main body p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hgroup html".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp template noscript svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button select option dialog menu head header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NAMES = frozenset("ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners cookie cookies cookiebar consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay sidebar sidenav aside menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations widget widgets pagination pager login search skip".split())

#: Elements of a line's path that are compared, the innermost ones.
PATH = 8

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z].*\Z""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)


@dataclass(slots=True)
class Line:
    text: str
    #: In the page's article or main element.
    article: bool
    main: bool
    #: In a block that markup names as boilerplate.
    dropped: bool
    #: In the article's own flow, not in a further container.
    flow: bool
    #: The elements around it.
    path: str = ""

    @property
    def aligned(self) -> tuple[str, str]:
        """What must agree for two lines to be the same."""
        return self.path, self.text


def _boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED and not (name == "header" and in_article):
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key in ("class", "id") and name != "main" and any(w in NAMES for w in re.split(r"[\s_-]+", value)):
            return True
    return False


def lines_of(page: str) -> list[Line]:
    """The page's blocks of text, in order."""
    out: list[Line] = []
    # Open elements: (name, dropped, in article, in main, flow, header inside an article).
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = [("", False, False, False, True, False)]
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                name, dropped, article, main, flow, header = stack[-1]
                out.append(Line(text, article, main, dropped or (header and not any(e[0] in HEADINGS for e in stack)), flow, "/".join(e[0] for e in stack[-PATH:])))

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        closing, name, attributes = m[1] or m[4], name.lower(), m[3] if m[2] else m[6]
        if name in RAW and not closing:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        block = name in BLOCKS
        if block:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if not block:
                        flush() if stack[k][1] != stack[k - 1][1] else None
                    del stack[k:]
                    break
                if not block and stack[k][0] in BLOCKS:
                    break
        elif name not in VOID:
            if block and stack[-1][0] != "" and name not in ("html", "body", "head"):
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item the item before
                    if stack[k][0] == "p" or (stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS and stack[k][0] not in HEADINGS:
                        break
            _, dropped, article, main, flow, header = stack[-1]
            here = not dropped and _boilerplate(name, attributes, article)
            if block or here:
                if here and not block:
                    flush()
                inside = article or (name == "article" and not dropped and not here)
                stack.append((name, dropped or here, inside, main or name == "main", True if name in ("article", "main") else flow and name in FLOW, header or (name == "header" and article)))
    flush()
    return out


def shared_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b, by increasing runs over matching places."""
    begin = 0
    while begin < len(a) and begin < len(b) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    found = {*range(begin), *range(len(a) - end, len(a))}
    places = defaultdict(list)
    for j in range(begin, len(b) - end):
        places[b[j]].append(j)
    ends: list[int] = []  # the least place in b at which a run of each length ends
    links: list[tuple | None] = []
    for i in range(begin, len(a) - end):
        for j in reversed(places.get(a[i], ())):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def shared_with(lines: list[Line], other: list[Line]) -> set[int]:
    """Places of the lines that an alignment with another page's lines shares."""
    return shared_lines([x.aligned for x in lines], [x.aligned for x in other])


def main_text(lines: list[Line], pair: list[Line] | None) -> str:
    """The page's main text, given the lines of its pair if it has one."""
    return text_without(lines, shared_with(lines, pair) if pair else set())


def text_without(lines: list[Line], shared: set[int]) -> str:
    """The page's main text, given the places of the lines that its pair shares."""
    if any(x.article for x in lines):
        rooted, inside = True, [x.article for x in lines]
    elif any(x.main and not x.dropped for x in lines):
        rooted, inside = True, [x.main for x in lines]
    else:
        rooted, inside = False, [True] * len(lines)
    kept = [x.text for i, x in enumerate(lines) if inside[i] and not x.dropped and (i not in shared or (rooted and x.flow))]
    return " ".join(kept)


def address(url: str | None) -> tuple[str, str]:
    """Host, and path without query, fragment, index name and ending."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", url or "")
    host, _, path = rest.removeprefix("//").partition("/") if rest.startswith("//") else ("", "", rest)
    host = re.split(r"[?#]", host)[0].rpartition("@")[2].lower().partition(":")[0]
    path = re.split(r"[?#]", path)[0].rstrip("/")
    return host, re.sub(r"(?:/?index)?\.(?:html?|php|aspx?)$", "", path)


def _nearness(a: str, b: str) -> tuple[int, int]:
    """Common leading parts of two paths, then common leading characters."""
    x, y = a.split("/"), b.split("/")
    n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    m = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return n, m


def extract(pages: DataFrame, paired: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each page. paired=False leaves the pairs out, to see what they change."""
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # Host, then path, as a key that sorts pages of a host together; close to what address() gives, and only the order depends on it.
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    bare = F.regexp_replace(F.split(bare, r"[?#]", 2)[0], r"(\.html?)?/*$", "")
    address_key = F.concat_ws("\t", F.lower(F.substring_index(bare, "/", 1)), bare)
    key = F.struct(address_key.alias("address"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("html").alias("hash"))
    blank = F.trim("html") == ""
    dealt = with_neighbours(rows.where(~blank), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None  # (range, role, page_id, url, host, path, lines)
        made: list[tuple] = []

        def finish(after) -> None:
            pairs = [(p, x) for p, x in ((1, before), (0, after)) if paired and x is not None and x[0] == now[0] and x[4] == now[4]]
            pairs.sort(key=lambda x: (_nearness(now[5], x[1][5]), x[0]), reverse=True)
            shared = next((places for _, x in pairs if len(places := shared_with(now[6], x[6])) < len(now[6])), set())
            text = text_without(now[6], shared)
            made.append((now[2], now[3], text, len(text)))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])
            made.clear()
            return out

        for batch in batches:
            for where, role, page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("range_", "role_", "page_id", "url", "html")), strict=True):
                row = (where, role, page_id, url, *address(url), lines_of(page))
                if now is not None and now[1] == 0:
                    finish(row)
                before, now = now, row
            if len(made) >= 128:
                yield flush()
        if now is not None and now[1] == 0:
            finish(None)
        if made:
            yield flush()

    found = dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")
    return found.unionByName(rows.where(blank).select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
