"""Byte-level BPE over whole texts: a minimal acyclic transducer for frequent words, exact merges for all others.

``encode`` splits each text as the vocabulary's pattern does, looks its distinct words up in a memory-mapped automaton and
merges those it lacks by the vocabulary's merge ranks; ids are the same whatever the automaton holds. ``decode`` turns ids
into text. All steps work on whole arrays of words (numpy), not word by word.

The automaton's words are those that hold at least ``LEXICON_SHARE`` of all tokens of the corpus, counted in the pieces in
which they have that share of the piece's tokens: 25,000 words at most, whatever the corpus.

Null texts count as empty and have no ids. Empty tables give no rows. Repeated rows each give a row. Strings of the
vocabulary's added tokens inside a text become that token, as the tokenizers library has it.
"""

from __future__ import annotations

import contextlib
import glob
import hashlib
import heapq
import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Texts, chunks, documents_view, drop_stored, mixed, prefix_hashes, prepare, read_table, release, span_hashes, stored

LEXICON_SHARE = 4e-5
#: Text bytes of a piece; distinct words are handled once in each.
PIECE_BYTES = 1 << 19
#: Longer words are merged one by one with a heap.
LONG_WORD = 256
#: Words whose ids a task keeps at most, and ids of all of them.
REMEMBERED, REMEMBERED_IDS = 1 << 17, 1 << 20

_U = np.uint64
_NONE = np.iinfo(np.int64).max


class HashMap:
    """From unsigned keys to row numbers by open addressing, for whole arrays of keys at once; the largest key can't be held."""

    def __init__(self, keys: np.ndarray, slots: np.ndarray | None = None, table: np.ndarray | None = None):
        if table is not None:
            self.table, self.slots, self.free = table, slots, np.iinfo(table.dtype).max
        else:
            self.free = np.iinfo(keys.dtype).max
            self._room(len(keys), keys.dtype)
            self._place(keys, np.arange(len(keys)))

    def _room(self, keys: int, kind) -> None:
        size = 1 << max(4, int(keys * 2).bit_length())
        self.table, self.slots, self.used = np.full(size, self.free, kind), np.zeros(size, np.int32), 0

    def _place(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.used += len(keys)
        spot = self._home(keys, len(self.table))
        while len(keys):
            free = self.table[spot] == self.free
            self.slots[spot[free]] = rows[free]  # of several that want a slot the last one written gets it
            won = free & (self.slots[spot] == rows)
            self.table[spot[won]] = keys[won]
            keys, rows, spot = keys[~won], rows[~won], (spot[~won] + 1) & (len(self.table) - 1)

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Puts in distinct keys that aren't there yet; the table doubles when it is half full."""
        if 2 * (self.used + len(keys)) > len(self.table):
            held = np.flatnonzero(self.table != self.free)
            old, old_rows = self.table[held], self.slots[held]
            self._room(2 * (len(old) + len(keys)), old.dtype)
            self._place(old, old_rows)
        self._place(keys, rows)

    @staticmethod
    def _home(keys: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(65 - int(size).bit_length())).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is missing."""
        spot = self._home(keys, len(self.table))
        seen = self.table[spot]
        out = np.where(seen == keys, self.slots[spot], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen != self.free))
        while len(left):
            spot_left = (spot[left] + 1) & (len(self.table) - 1)
            spot[left] = spot_left
            seen = self.table[spot_left]
            same = seen == keys[left]
            out[left[same]] = self.slots[spot_left[same]]
            left = left[~same & (seen != self.free)]
        return out


class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form, read by the driver."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a prefix space is supported")
        to_byte = {c: b for b, c in byte_characters().items()}
        self.tokens: list[bytes] = [b""] * (max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for text, i in model["vocab"].items():
            self.tokens[i] = bytes(to_byte[c] for c in text)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.tokens[i] = text.encode()
        self.of_byte = np.array([model["vocab"][c] for _, c in sorted(byte_characters().items())], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([model["vocab"][x] for x in column], np.int64) for column in (*zip(*merges, strict=True), ["".join(m) for m in merges]))
        self.pairs, self.made = HashMap(self.key(left, right)), made

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(_U) << _U(32)) | right.astype(_U)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.pairs.get(self.key(left, right)).astype(np.int64)
        rank[rank < 0] = _NONE
        return rank

    def merge(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, ``data[at[i]:at[i + 1]]``, none empty: all words do their lowest-ranked merge, again and again."""
        n = np.diff(at)
        ids, sizes = [None] * len(n), np.zeros(len(n), np.int64)
        for i in np.flatnonzero(n > LONG_WORD):
            ids[i] = self.merge_long(data[at[i] : at[i + 1]])
            sizes[i] = len(ids[i])
        short = np.flatnonzero(n <= LONG_WORD)
        word = np.repeat(np.arange(len(short)), n[short])
        token = self.of_byte[data[np.repeat(n <= LONG_WORD, n)]]
        last = np.zeros(len(token), bool)
        last[np.cumsum(n[short]) - 1] = True
        rank = np.full(len(token), _NONE)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(token[inner], token[inner + 1])
        begin_at = np.cumsum(n[short]) - n[short]
        room = np.full(len(token), -1)  # a word's ids go to the first places of its bytes
        while len(token):
            begin = np.flatnonzero(np.r_[True, last[:-1]])
            least = np.minimum.reduceat(rank, begin)
            over = least == _NONE
            if over.any():
                out = np.repeat(over, np.diff(np.append(begin, len(token))))
                ended, sizes_over = word[out], np.diff(np.append(begin, len(token)))[over]
                room[begin_at[ended] + np.arange(len(ended)) - np.repeat(np.cumsum(sizes_over) - sizes_over, sizes_over)] = token[out]
                sizes[short[word[begin[over]]]] = sizes_over
                word, token, last, rank = word[~out], token[~out], last[~out], rank[~out]
                if not len(token):
                    break
                begin, least = np.flatnonzero(np.r_[True, last[:-1]]), least[~over]
            size = np.diff(np.append(begin, len(token)))
            hit = np.flatnonzero(rank == np.repeat(least, size))
            spot = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]  # the leftmost of each word
            token[spot] = self.made[least]
            last[spot] = last[spot + 1]
            keep = np.ones(len(token), bool)
            keep[spot + 1] = False
            spot = spot - np.arange(len(spot))
            word, token, last, rank = word[keep], token[keep], last[keep], rank[keep]
            rank[spot] = _NONE
            right = spot[~last[spot]]
            rank[right] = self.ranks(token[right], token[right + 1])
            left = spot[(spot > 0)] - 1
            left = left[~last[left]]
            rank[left] = self.ranks(token[left], token[left + 1])
        tokens = room[room >= 0]
        out_at = np.zeros(len(n) + 1, np.int64)
        np.cumsum(sizes, out=out_at[1:])
        out = np.empty(out_at[-1], np.int64)
        out[np.repeat(n <= LONG_WORD, sizes)] = tokens
        for i in np.flatnonzero(n > LONG_WORD):
            out[out_at[i] : out_at[i + 1]] = ids[i]
        return out, out_at

    def merge_long(self, data: np.ndarray) -> np.ndarray:
        """The ids of one long word, with a heap of merges, in time about proportional to its length."""
        token = self.of_byte[data].tolist()
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        made = self.made
        first = self.ranks(np.array(token[:-1]), np.array(token[1:]))
        heap = [(int(r), i, token[i], token[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if token[i] == a else len(token)
            if j >= len(token) or token[j] != b:
                continue
            token[i], token[j] = int(made[rank]), -1
            after[i] = after[j]
            if after[i] < len(token):
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else len(token)
                if y < len(token):
                    r = int(self.ranks(np.array([token[x]]), np.array([token[y]]))[0])
                    if r != _NONE:
                        heapq.heappush(heap, (r, x, token[x], token[y]))
        return np.array([t for t in token if t >= 0], np.int64)


@cache
def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(other)}


LETTER, NUMBER, SPACE, OTHER = range(4)


@cache
def character_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    out = np.full(len(points), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    table = np.full(0x110000, OTHER, np.uint8)
    table[points] = out
    return table


class Split:
    """The words (pre-tokens) of a piece's texts.

    Letters, numbers and other marks form runs; one space right before a run belongs to it; of other white space before a
    run the last character stands alone; an apostrophe with s, t, m, d, re, ve or ll is a word unless it follows a space or a mark.
    """

    def __init__(self, texts: Texts, added: dict[str, int]):
        data = texts.data
        whole = data.tobytes()
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        self.byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(self.byte_at, texts.at)
        forced = []
        for word in added:
            raw, i = word.encode(), whole.find(word.encode())
            while i >= 0:
                k = int(np.searchsorted(self.byte_at, i))
                if int(np.searchsorted(texts.at, i, "right")) == int(np.searchsorted(texts.at, i + len(raw) - 1, "right")):
                    forced.append((k, k + len(word)))
                i = whole.find(raw, i + len(raw))
        kind = character_classes()[points]
        edge = np.zeros(len(points) + 1, bool)  # where texts, or the stretches between added tokens, begin or end
        edge[first] = True
        for a, b in forced:
            edge[[a, b]] = True
        start = edge.copy()
        start[1:-1] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(start)
        spaces = runs[:-1][kind[runs[:-1]] == SPACE] if len(points) else runs[:0]
        ends = runs[np.searchsorted(runs, spaces) + 1]
        ends = ends[~edge[ends]]
        start[ends - 1] = True
        start[ends[points[ends - 1] == 0x20]] = False
        marks = np.flatnonzero(points[:-1] == 0x27) if len(points) else runs[:0]
        marks = marks[start[marks] & (kind[marks + 1] == LETTER) & ~edge[marks + 1]]
        one, two = points[marks + 1], np.where(edge[marks + 2], 0, np.append(points, 0)[marks + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(marks), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        for chosen, size in ((marks[short], 2), (marks[long], 3)):
            start[chosen + 1] = False
            start[chosen + size] = True
        for a, b in forced:
            start[a + 1 : b] = False
        starts = np.flatnonzero(start[:-1])
        self.starts, self.ends = starts, np.append(starts[1:], len(points)).astype(np.int64)
        self.first = np.searchsorted(starts, first)
        hashes = span_hashes(prefix_hashes(mixed(points.astype(_U) + _U(1))), self.starts, self.ends)
        self.hashes, self.example, self.which, self.counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.data = data

    def distinct(self, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the distinct words (or of some of them), one after another, and where each begins."""
        example = self.example if chosen is None else self.example[chosen]
        return gathered(self.data, self.byte_at[self.starts[example]], self.byte_at[self.ends[example]])


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = ends - starts
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return data[np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)], at


class Transducer:
    """A minimal acyclic automaton over sorted words. The outputs on a word's path add up to its place among the words, which has its ids."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.arcs = HashMap(None, parts["slots"], parts["table"])

    @classmethod
    def build(cls, words: list[bytes], ids: np.ndarray, ids_at: np.ndarray) -> Transducer:
        """words: sorted and distinct. Suffixes are shared as the words come in: a state that can't change any more is replaced by an equal one."""
        register: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        path = [0]
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                shape = (final[state], *arcs[state].items())
                arcs[path[-1]][last[len(path) - 1]] = register.setdefault(shape, state)

        for word in words:
            common = len(os.path.commonprefix([word, last]))
            close(common)
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][byte] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            last = word
        close(0)
        below: dict[int, int] = {}

        def count(top: int) -> None:
            stack = [top]
            while stack:
                state = stack[-1]
                todo = [x for x in arcs[state].values() if x not in below]
                if todo:
                    stack.extend(todo)
                else:
                    below[state] = final[state] + sum(below[x] for x in arcs[state].values())
                    stack.pop()

        count(0)
        number = {state: k for k, state in enumerate(sorted(below))}
        keys, to, skip = [], [], []
        for state in below:
            passed = int(final[state])
            for byte, x in sorted(arcs[state].items()):
                keys.append(number[state] << 8 | byte)
                to.append(number[x])
                skip.append(passed)
                passed += below[x]
        held = HashMap(np.array(keys, np.uint32))
        return cls({"table": held.table, "slots": held.slots, "to": np.array(to, np.int32), "skip": np.array(skip, np.int32), "final": np.array([final[s] for s in sorted(below)], np.uint8), "ids": ids.astype(np.int32), "ids_at": ids_at.astype(np.int32), "longest": np.array([max(map(len, words), default=0)], np.int32)})

    def to_bytes(self) -> bytes:
        head, body, offset = {}, [], 0
        for k, x in self.parts.items():
            raw = x.tobytes()
            raw += b"\0" * (-len(raw) % 64)
            head[k] = (str(x.dtype), len(x), offset)
            body.append(raw)
            offset += len(raw)
        text = json.dumps(head).encode().ljust(1024)
        return b"".join([text, *body])

    @classmethod
    def mapped(cls, raw: bytes, name: str, folder: str | None = None) -> Transducer:
        """Puts the file into a folder of this machine's (a temporary one by default) unless it is there, and maps it; workers with the same folder share its pages.

        Files of earlier lexicons are unlinked; whoever still maps one keeps its pages. A lost executor's successor writes its own from the broadcast.
        An executor's folder is its working folder, whose absolute name may lead through another mount, so the file is written and renamed under one name of the folder.
        """
        top = folder or tempfile.gettempdir()
        path = os.path.join(top, f"lexicon-{name}")
        if not os.path.exists(path):
            for old in glob.glob(os.path.join(top, "lexicon-*")):
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(old)
            part = os.path.join(top, f"tmp{uuid.uuid4().hex}")  # tempfile would make the name absolute
            with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
                f.write(raw)
            os.replace(part, path)
        try:
            view = np.memmap(path, np.uint8, "r")
        except FileNotFoundError:  # another lexicon's task has just unlinked it
            view = np.frombuffer(raw, np.uint8)
        head = json.loads(view[:1024].tobytes())
        return cls({k: view[1024 + o : 1024 + o + n * np.dtype(t).itemsize].view(t) for k, (t, n, o) in head.items()})

    def find(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of each word ``data[at[i]:at[i + 1]]``, -1 where the automaton lacks it; all words step together."""
        sizes = np.diff(at)
        out = np.full(len(sizes), -1, np.int64)
        alive = np.flatnonzero(sizes <= self.parts["longest"][0])
        state, place = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
        to, skip, final = self.parts["to"], self.parts["skip"], self.parts["final"]
        step = 0
        while len(alive):
            over = sizes[alive] == step
            if over.any():
                good = over & (final[state] == 1)
                out[alive[good]] = place[good]
                alive, state, place = alive[~over], state[~over], place[~over]
            arc = self.arcs.get((state.astype(np.uint32) << np.uint32(8)) | data[at[alive] + step].astype(np.uint32))
            on = arc >= 0
            alive, arc = alive[on], arc[on]
            state, place = to[arc].astype(np.int64), place[on] + skip[arc]
            step += 1
        return out


def frequent_words(docs: DataFrame, added: dict[str, int], share: float = LEXICON_SHARE, most: int | None = None) -> list[bytes]:
    """The corpus's frequent words, sorted; see the module's text. most: only so many, the most frequent."""

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        split = Split(Texts(piece.column("text")), added)
        chosen = np.flatnonzero(split.counts >= share * len(split.starts))
        data, at = split.distinct(chosen)
        raw = data.tobytes()
        # The empty word counts all tokens.
        return pa.RecordBatch.from_arrays([pa.array([b"", *(raw[at[i] : at[i + 1]] for i in range(len(chosen)))], pa.binary()), pa.array([len(split.starts), *split.counts[chosen].tolist()])], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text", PIECE_BYTES):
            yield count(piece)

    counts = stored(docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where(F.octet_length("word") == 0).agg(F.sum("n")).first()[0] or 0
    found = counts.where((F.octet_length("word") > 0) & (F.col("n") >= share * total)).collect()  # 1 / share rows at most
    drop_stored(counts)
    return sorted(bytes(r.word) for r in sorted(found, key=lambda r: (-r.n, bytes(r.word)))[:most])


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary) -> Transducer:
    words = [w for w in frequent_words(docs, vocabulary.added) if w.decode() not in vocabulary.added]
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    return Transducer.build(words, *vocabulary.merge(np.frombuffer(b"".join(words), np.uint8), at))


class Encoder:
    """Encodes pieces of text in one task; keeps the ids of words of earlier pieces, up to ``REMEMBERED`` words and ``REMEMBERED_IDS`` ids."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._forget()

    def _forget(self) -> None:
        self.known, self.words = HashMap(np.zeros(0, _U)), 0
        self.pool, self.pool_at = np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64)

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        end = int(self.pool_at[self.words])
        self.pool = _grown(self.pool, end + len(ids))
        self.pool_at = _grown(self.pool_at, self.words + len(at))
        self.pool[end : end + len(ids)] = ids
        self.pool_at[self.words + 1 : self.words + len(at)] = end + at[1:]
        self.known.add(hashes, self.words + np.arange(len(hashes)))
        self.words += len(hashes)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin."""
        split = Split(texts, self.vocabulary.added)
        row = self.known.get(split.hashes).astype(np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            if self.words and (self.words + len(new) > REMEMBERED or self.pool_at[self.words] > REMEMBERED_IDS):
                self._forget()
                row, new = np.full(len(row), -1), np.arange(len(row))
            row[new] = self.words + np.arange(len(new))
            self._remember(split.hashes[new], *self._word_ids(*split.distinct(new)))
        word = row[split.which]
        out, word_at = gathered(self.pool, self.pool_at[word], self.pool_at[word + 1])
        return out, word_at[split.first]

    def _word_ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words: from the automaton, of an added token, or merged."""
        place = self.lexicon.find(data, at)
        ids_at, ids = self.lexicon.parts["ids_at"], self.lexicon.parts["ids"]
        added = self.vocabulary.added
        raw = data.tobytes() if added else b""
        if any(w.encode() in raw for w in added):
            special = {int(i): w for i in np.flatnonzero(place < 0) if (w := added.get(raw[at[i] : at[i + 1]].decode("utf-8"))) is not None}
        else:
            special = {}
        source = np.where(place >= 0, 0, 1)
        source[list(special)] = 2
        known, plain = np.flatnonzero(source == 0), np.flatnonzero(source == 1)
        merged, merged_at = self.vocabulary.merge(*gathered(data, at[plain], at[plain + 1])) if len(plain) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        found, found_at = gathered(ids, ids_at[place[known]].astype(np.int64), ids_at[place[known] + 1].astype(np.int64))
        sizes = np.ones(len(place), np.int64)
        sizes[known], sizes[plain] = np.diff(found_at), np.diff(merged_at)
        out_at = np.zeros(len(place) + 1, np.int64)
        np.cumsum(sizes, out=out_at[1:])
        out, spread = np.empty(out_at[-1], np.int32), np.repeat(source, sizes)
        out[spread == 0], out[spread == 1] = found, merged
        for i, token in special.items():
            out[out_at[i]] = token
        return out, out_at


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` values: itself, or a copy of twice the room."""
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class Strings:
    """Many byte strings in one array, gathered by their numbers."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.at = np.zeros(len(strings) + 1, np.int64)
        np.cumsum([len(x) for x in strings], out=self.at[1:])

    def joined(self, numbers: np.ndarray, first: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The strings of all numbers, one after another, and where those of each group begin; ``first``: where the groups begin among the numbers."""
        data, at = gathered(self.data, self.at[numbers], self.at[numbers + 1])
        return memoryview(data), at[first]


class Decoder:
    """From ids to bytes, and to the ids written as decimals, for whole pieces at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = Strings(vocabulary.tokens)
        self.decimals = Strings([b"%d," % i for i in range(len(vocabulary.tokens))])

    def texts(self, ids: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
        """The UTF-8 of each text; bytes that aren't UTF-8 become U+FFFD."""
        data, at = self.tokens.joined(ids, first)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            raw = bytes(data[a:b])
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            yield raw

    def id_digests(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """SHA-256 of each text's ids, as decimals joined by commas."""
        data, at = self.decimals.joined(ids, first)
        return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class Tokenizer:
    """Encodes and decodes columns with one vocabulary and one corpus's lexicon."""

    def __init__(self, spark: SparkSession, path: str, lexicon_from: DataFrame):
        prepare(spark)
        self.vocabulary = Vocabulary(path)
        raw = build_lexicon(lexicon_from, self.vocabulary).to_bytes()
        self._shared = spark.sparkContext.broadcast((self.vocabulary, raw, hashlib.sha256(raw).hexdigest()[:24]))

    def _coded(self, df: DataFrame, keep: tuple[str, ...], columns: dict[str, str], work) -> DataFrame:
        """The columns ``keep`` and what ``work`` makes of each piece, its ids, where each text's begin, and a decoder: one pass through Python."""
        shared = self._shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, raw, name = shared.value
            encoder, decoder = Encoder(vocabulary, Transducer.mapped(raw, name, SparkFiles.getRootDirectory())), None  # the folder goes with the executor
            for piece in chunks(batches, "text", PIECE_BYTES):
                decoder = decoder or Decoder(vocabulary)
                ids, at = encoder.encode(Texts(piece.column("text")))
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), *work(piece, ids, at, decoder)], [*keep, *columns])

        kinds = dict(df.dtypes)
        return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{k} {t}" for k, t in columns.items())]))

    def encode(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep`` and ids, array<int>, of the column text."""
        return self._coded(df, keep, {"ids": "array<int>"}, lambda piece, ids, at, decoder: [_lists(ids, at)])

    def encode_checked(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep``, n_tokens, ids, and round_trip: whether decoding the ids gives the text again (null as empty)."""

        def work(piece, ids, at, decoder):
            texts = Texts(piece.column("text"))
            raw = memoryview(texts.data)
            same = [made == raw[texts.at[i] : texts.at[i + 1]] for i, made in enumerate(decoder.texts(ids, at))]
            return [pa.array(np.diff(at)), _lists(ids, at), pa.array(same, pa.bool_())]

        return self._coded(df, keep, {"n_tokens": "long", "ids": "array<int>", "round_trip": "boolean"}, work)

    def digests(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep``, n_tokens, ids_sha256 (of decimals joined by commas) and decoded_sha256 (of the text that the ids give)."""

        def work(piece, ids, at, decoder):
            decoded = [hashlib.sha256(raw).hexdigest() for raw in decoder.texts(ids, at)]
            return [pa.array(np.diff(at)), pa.array(decoder.id_digests(ids, at), pa.string()), pa.array(decoded, pa.string())]

        return self._coded(df, keep, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, work)

    def decode(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep``, ids, and text; bytes that aren't UTF-8 become U+FFFD."""
        shared = self._shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            decoder = None
            for batch in batches:
                decoder = decoder or Decoder(shared.value[0])
                column = batch.column("ids")
                at = column.offsets.to_numpy().astype(np.int64)
                texts = [x.decode("utf-8") for x in decoder.texts(column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), column, pa.array(texts, pa.string())], [*keep, "ids", "text"])
            release()

        kinds = dict(df.dtypes)
        return df.select(*keep, "ids").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "ids array<int>, text string"]))


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    docs = documents_view(docs)
    return Tokenizer(docs.sparkSession, path, docs).digests(docs, "doc_id")


def default_vocabulary() -> str:
    """The public vocabulary that the query uses; any path can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), default_vocabulary())
