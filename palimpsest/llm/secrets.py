"""Secret scans: three base patterns, and character Markov models of random strings against ordinary identifiers.

``scan`` gives all spans of each whole text, in code points with the end exclusive:

* assign, access, hex: leftmost non-overlapping matches of ``ASSIGN``, ``ACCESS`` and ``HEX``, without those too short;
* random: stretches of runs of ``TOKEN`` bytes, base spans cut out, of at least ``LEAST`` bytes, whose log-likelihood ratio of
  random strings to ordinary identifiers exceeds a margin per character, and ``EVIDENCE`` beyond that in all. A stretch is the
  whole run, or what stands between two ``_JOINS`` of it (a path, a query, a name), the most telling one first, then those to
  its left and right.

The ratio decides alone. Ordinary identifiers are a second-order Markov chain of characters, random strings a first-order
chain for each alphabet that the samples show (a string's alphabet is told by the classes of its characters); the alphabet
counts that tells most. All chains are trained from labelled samples (string, 1 for random and 0 for ordinary). A context's
steps are counted once for each character before it, so that a few frequent words don't pass for knowledge of all words, and
each alphabet's margin is what ordinary strings of words reach that were kept from training, and more if words are few
(``MARGIN`` at least).
``default_samples`` gives samples: seeded random strings over the usual alphabets, and identifiers made from ``COMMON``
words and the frequent words of the whole corpus. Strings of digits alone have no chain: numbers, dates and accounts look the same.

Null and empty texts have no span. Repeated rows each give a row. Empty tables give no rows.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Texts, chunks, documents_view, drop_stored, prepare, read_table, stored, unlike

# The base patterns, their least lengths, and the kinds in their order.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
MARGIN, EVIDENCE = 0.25, 12.0
#: Strings of each label in the default samples, and the share of the corpus's words that a word must have for identifiers to be made from it.
SAMPLE_STRINGS, WORD_SHARE = 20_000, 2e-5
#: Random strings of one alphabet that it takes for a chain of its own.
LEAST_STRINGS = 50
#: How many steps of a context weigh as much as what is known without it: ordinary pairs, single characters, none; random strings' single characters.
_PAIR, _ONE, _NONE, _RANDOM = 4.0, 10.0, 30.0, 300.0
#: Of ordinary strings whose words training lacks, so many in a hundred may exceed a margin; strings shorter than that don't count.
_EXCEED, _JUDGED = 1.0, 12
#: Parts of the words that are kept from training in turn; what is added to margins that a single word was judged by, less by the root of their number.
FOLDS, _DOUBT = 4, 3.0

#: Words that names in programs and files often have, whatever the corpus says; ordinary samples are made from these as well.
COMMON = """account action active address after alert amount array attribute author average back base before begin body
border bottom branch buffer build button cache call category center change channel check child class client close code color
column comment commit config connect content context copy count create current customer data date default delete depth detail
device display document domain double driver edge element email empty enable encode entry error event example expect export
factor false feature field file filter final first flag folder font format frame from function global graph group handler hash
header height hidden history host icon image import index input insert instance integer internal item join key label language
last layer layout left length level library limit line link list local login manager mark master match matrix maximum media
member memory menu message method minimum model module month mouse name network next node normal notice number object offset
option order origin output owner package page panel parent parse path pattern payment percent period person phone picture place
player point policy position prefix previous price private process product profile project property public query question queue
random range rate reader record reference region remote remove render report request reset resource response result return right
role root route rule sample scale schema scope score screen script search second section select send server service session
setting shape share signal simple size sort source space start state static status step stop storage store stream string
structure style subject submit suffix support switch symbol system table target task template test text thread time title token
tool total track transfer tree trigger type unit update upload user valid value variable vector version video view visible
volume width window word worker write year zone""".split()

_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
#: What joins a secret to the text beside it: paths, queries, names.
_JOINS = np.zeros(256, bool)
_JOINS[list(b"/.=_-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
#: What may stand right before an assignment's value, or hint at its name; only texts with such bytes are matched.
_STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def runs(chosen: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` chosen bytes; no run crosses from one text to the next."""
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(chosen) + 1, bool)
    edge[at] = True
    begin, stop = chosen.copy(), chosen.copy()
    begin[1:] &= ~chosen[:-1] | edge[1:-1]
    stop[:-1] &= ~chosen[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


_SYMBOLS = int(_TOKEN.sum())
#: Each token byte's number; the begin of a string has the number after the last.
_CODE = np.full(256, _SYMBOLS, np.int64)
_CODE[_TOKEN] = np.arange(_SYMBOLS)


def _alphabet(raw: np.ndarray) -> int:
    """Which classes of characters a string has: digits, a-f, g-z, A-F, G-Z, marks."""
    low, high = raw | 0x20, (raw >= 0x41) & (raw < 0x5B)
    letter = (low >= 0x61) & (low < 0x7B)
    early = letter & (low < 0x67)
    digit = (raw >= 0x30) & (raw < 0x3A)
    return sum(int(x.any()) << k for k, x in enumerate((digit, early & ~high, letter & ~early & ~high, early & high, letter & ~early & high, ~letter & ~digit)))


def _codes(text: str, before: int) -> np.ndarray:
    return np.r_[np.full(before, _SYMBOLS), _CODE[np.frombuffer(text.encode(), np.uint8)]]


def _words(strings: list[str]) -> list[set[str]]:
    """The words of each string: what capitals and marks set apart, and of words that are two or more known ones in a row these."""
    found = [{w.lower() for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", t)} for t in strings]
    known = set().union(*found)
    parts: dict[str, set[str]] = {}
    for w in sorted(known, key=len):
        i = next((i for i in range(2, len(w) - 1) if w[:i] in parts and w[i:] in parts), None)
        parts[w] = {w} if i is None else parts[w[:i]] | parts[w[i:]]
    return [set().union(*(parts[w] for w in own)) for own in found]


def _ordinary(strings: list[str]) -> np.ndarray:
    """Log-likelihoods [before last, last, this] of a second-order chain. Counted are the characters that stood before each step, not how often it came."""
    n, seen = _SYMBOLS + 1, set()
    for text in strings:
        c = _codes(text, 3)
        seen.update((((c[:-3] * n + c[1:-2]) * n + c[2:-1]) * n + c[3:]).tolist())
    triples = np.bincount(np.fromiter(seen, np.int64, len(seen)) % n**3, minlength=n**3).reshape(n, n, n).astype(np.float64)
    pairs = (triples > 0).sum(axis=0).astype(np.float64)
    single = (pairs > 0).sum(axis=0).astype(np.float64)
    single = (single + _NONE / n) / (single.sum() + _NONE)
    after_one = (pairs + _ONE * single) / (pairs.sum(axis=1, keepdims=True) + _ONE)
    return np.log((triples + _PAIR * after_one) / (triples.sum(axis=2, keepdims=True) + _PAIR)).astype(np.float32)


def _chains(strings: list[str]) -> np.ndarray:
    """Log-likelihoods [alphabet, last, this] of a first-order chain for each alphabet."""
    n, alphabets = _SYMBOLS + 1, {}
    for text in strings:
        kind = _alphabet(np.frombuffer(text.encode(), np.uint8))
        if kind != 1:
            counts, of = alphabets.setdefault(kind, (np.zeros((n, n)), [0]))
            c = _codes(text, 1)
            np.add.at(counts, (c[:-1], c[1:]), 1)
            of[0] += 1
    chosen = [c for c, of in alphabets.values() if of[0] >= LEAST_STRINGS] or [c for c, _ in alphabets.values()] or [np.zeros((n, n))]
    out = []
    for counts in chosen:
        single = (counts.sum(axis=0) + 0.01) / (counts.sum() + 0.01 * n)
        out.append(np.log((counts + _RANDOM * single) / (counts.sum(axis=1, keepdims=True) + _RANDOM)))
    return np.stack(out).astype(np.float32)


class Models:
    """Log-likelihoods of each step, ``ordinary[before last, last, this]`` and ``random[alphabet, last, this]``, and the margin of each alphabet."""

    def __init__(self, ordinary: np.ndarray, random: np.ndarray, margins: np.ndarray | None = None):
        self.ordinary, self.random = ordinary, random
        self.margins = np.full(len(random), MARGIN) if margins is None else margins

    @classmethod
    def fit(cls, samples: list[tuple[str, int]]) -> Models:
        plain, chains = [t for t, label in samples if not label], _chains([t for t, label in samples if label])
        words = _words(plain)
        judged, known = [], set().union(*words)
        for fold in range(FOLDS):
            out = {w for w in known if zlib.crc32(w.encode()) % FOLDS == fold}
            part = cls(_ordinary([t for t, own in zip(plain, words, strict=True) if not own & out]), chains)
            judged += [part.steps(np.frombuffer(t.encode(), np.uint8)).mean(axis=1) for t, own in zip(plain, words, strict=True) if own and own <= out and len(t) >= _JUDGED]
        doubt = _DOUBT / np.sqrt(max(1, len(known)))
        margins = np.maximum(MARGIN, np.percentile(np.stack(judged), 100 - _EXCEED, axis=0) + doubt) if judged else None
        return cls(_ordinary(plain), chains, margins)

    def steps(self, token: np.ndarray) -> np.ndarray:
        """The ratio of each character of a run, for each alphabet."""
        code = np.r_[_SYMBOLS, _SYMBOLS, _CODE[token]]
        return (self.random[:, code[1:-1], code[2:]] - self.ordinary[code[:-2], code[1:-1], code[2:]]).astype(np.float64)


def random_strings(n: int, seed: int = 1) -> list[str]:
    draw = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    digits, capitals = "0123456789", letters.upper()
    alphabets = (digits + letters[:6], digits + capitals[:6], letters + capitals + digits, letters + capitals + digits + "+/", letters + capitals + digits + "_-", letters + digits, capitals + digits, capitals + digits[2:8], letters + capitals, letters, capitals)
    return ["".join(draw.choices(alphabets[k % len(alphabets)], k=draw.randint(20, 64))) for k in range(n)]


def identifiers(words: list[str], n: int, seed: int = 2) -> list[str]:
    """Ordinary long strings as code and prose have them: words, given or ``COMMON``, joined in the usual ways, with numbers at times."""
    draw = random.Random(seed)
    words = [*words, *COMMON]
    out = []
    for k in range(n):
        some = [draw.choice(words) for _ in range(draw.randint(2, 6))]
        joined = ("_".join(some), "".join(w.capitalize() for w in some), "-".join(some), ".".join(some), "/".join(some), "_".join(some).upper(), "".join(some), f"{'_'.join(some)}_{draw.randint(0, 2030)}", "=" * draw.randint(2, 30), "-" * draw.randint(2, 30))
        out.append(joined[k % len(joined)])
    return out


def default_samples(documents: DataFrame) -> list[tuple[str, int]]:
    """Labelled strings: ``SAMPLE_STRINGS`` of each label. Words of the ordinary ones are those with ``WORD_SHARE`` of all words of all documents: 50,000 at most."""
    words = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,15})"), F.lit(1)))
    counts = stored(documents.select(words.alias("word")).select(F.lower("word").alias("word")).groupBy("word").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    common = sorted(r.word for r in counts.where(F.col("count") >= WORD_SHARE * total).select("word").collect())
    drop_stored(counts)
    return [(s, 0) for s in identifiers(common, SAMPLE_STRINGS)] + [(s, 1) for s in random_strings(SAMPLE_STRINGS)]


def find_spans(texts: Texts, models: Models) -> list[list[tuple[int, int, int]]]:
    """Of each text the spans (start, kind's place, end) in bytes from the piece's begin, sorted."""
    data, at = texts.data, texts.at
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    if not len(data):
        return out
    raw = data.tobytes()
    low = raw.lower()
    of = lambda i: int(np.searchsorted(at, i, "right")) - 1
    for k in sorted({of(i) for stem in _STEMS for i in _places(low, stem)}):
        for m in ASSIGN.finditer(raw, int(at[k]), int(at[k + 1])):
            if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
                out[k].append((m.start(), 0, m.end()))
    for k in sorted({of(i) for i in _places(raw, b"AKIA")}):
        for m in ACCESS.finditer(raw, int(at[k]), int(at[k + 1])):
            if m.end() - m.start() >= LEAST_ACCESS:
                out[k].append((m.start(), 1, m.end()))
    for s, e in zip(*runs(_HEX[data], at, LEAST_HEX), strict=True):
        out[of(s)].append((int(s), 2, int(e)))
    free = _TOKEN[data]
    for spans in out:
        for a, _, b in spans:
            free[a:b] = False
    for s, e in zip(*runs(free, at, LEAST), strict=True):
        out[of(s)] += [(int(s) + a, 3, int(s) + b) for a, b in stretches(data[s:e], models)]
    for spans in out:
        spans.sort()
    return out


def stretches(token: np.ndarray, models: Models) -> list[tuple[int, int]]:
    """Starts and ends of the parts of a run that are random: the whole, or stretches between joins."""
    steps = models.steps(token) - models.margins[:, None]
    above = np.concatenate([np.zeros((len(steps), 1)), np.cumsum(steps, axis=1)], axis=1)
    whole = float(above[:, -1].max())
    joins = np.flatnonzero(_JOINS[token])
    starts, ends = np.r_[0, joins + 1], np.r_[joins, len(token)]
    starts, ends = starts[starts < ends], ends[starts < ends]
    out, todo = [], [(0, len(starts))]
    while todo:
        i, j = todo.pop()
        # For each end, how many starts are far enough before it, and the one among them with the least sum before it.
        fits = np.searchsorted(starts[i:j], ends[i:j] - LEAST, "right")
        if i >= j or not fits[-1]:
            continue
        low = np.minimum.accumulate(above[:, starts[i:j]], axis=1)
        gains = np.where(fits > 0, above[:, ends[i:j]] - low[:, np.maximum(fits, 1) - 1], -np.inf)
        alphabet, last = np.unravel_index(int(gains.argmax()), gains.shape)
        if gains[alphabet, last] <= EVIDENCE:
            continue
        if j - i == len(starts) and whole >= gains[alphabet, last] - EVIDENCE / 2:
            return [(0, len(token))]
        first = int(above[alphabet, starts[i : i + fits[last]]].argmin())
        out.append((int(starts[i + first]), int(ends[i + last])))
        todo += [(i, i + first), (i + int(last) + 1, j)]
    return sorted(out)


def _places(raw: bytes, word: bytes) -> Iterator[int]:
    i = raw.find(word)
    while i >= 0:
        yield i
        i = raw.find(word, i + 1)


class Scanner:
    """Scans texts with one set of trained models (some 300,000 numbers, broadcast)."""

    def __init__(self, spark, samples: list[tuple[str, int]]):
        prepare(spark)
        self._shared = spark.sparkContext.broadcast(Models.fit(samples))

    def scan(self, df: DataFrame, *keep: str, spans: str = "spans") -> DataFrame:
        """The columns ``keep`` and spans (under another name if one is given): array of (kind, start, end) by start, then kind as listed."""
        unlike(keep, spans)
        return self._map(df, keep, f", `{spans}` array<struct<kind: string, start: int, end: int>>", self._spans, spans)

    def redact(self, df: DataFrame, mask: str = "[SECRET]") -> DataFrame:
        """All columns, with every span in text replaced by ``mask`` (overlapping spans by one)."""
        others = [c for c in df.columns if c != "text"]

        def work(piece, texts, found):
            raw, out = texts.data.tobytes(), []
            for k, spans in enumerate(found):
                parts, end = [], int(texts.at[k])
                for a, _, b in spans:
                    if a >= end:
                        parts += [raw[end:a], mask.encode()]
                    end = max(end, b)
                out.append(b"".join([*parts, raw[end : texts.at[k + 1]]]).decode("utf-8") if parts else None)
            old = piece.column("text")
            return pa.array([new if new is not None else same for new, same in zip(out, old.to_pylist(), strict=True)], pa.string())

        return self._map(df, others, ", text string", lambda texts, found, piece: work(piece, texts, found), "text").select(*df.columns)

    @staticmethod
    def _spans(texts: Texts, found, piece) -> pa.Array:
        points = np.flatnonzero((texts.data & 0xC0) != 0x80) if any(found) else np.zeros(0, np.int64)
        place = lambda i: int(np.searchsorted(points, i))
        rows = [[{"kind": KINDS[kind], "start": place(a) - place(texts.at[k]), "end": place(b) - place(texts.at[k])} for a, kind, b in spans] for k, spans in enumerate(found)]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    def _map(self, df: DataFrame, keep, added: str, work, name: str = "spans") -> DataFrame:
        shared = self._shared
        kinds = dict(df.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in chunks(batches, "text"):
                texts = Texts(piece.column("text"))
                found = find_spans(texts, shared.value)
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), work(texts, found, piece)], [*keep, name])

        return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + added)


def query(spark, sf_dir: str) -> DataFrame:
    documents = documents_view(read_table(spark, sf_dir, "documents"))
    found = Scanner(spark, default_samples(documents)).scan(documents, "doc_id")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(of, KINDS[:3]), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
