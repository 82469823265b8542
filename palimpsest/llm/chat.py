"""Chat formatting: a finite-state machine over roles, text segments with loss flags, and a template given as data.

``format_turns`` turns each row of a conversation (conv_id, turn, role, text) into segments of the training text: what the
template puts around the text, without loss, and the text, with loss for the template's roles that are learned. The machine
starts in ``START`` and moves by role; a row whose move is missing is kept, and from it on the conversation's rows say that
their order isn't valid. Both need just the rows before, so a conversation streams through its task row by row, however long; it is
the one thing that isn't split, as its turns depend on those before.

Control characters of the template inside texts get an escape before them and so can't be taken for marks; reading back
removes it. ``read_back`` parses the concatenated segments of a conversation by the template alone.

Null texts are empty; a null role is written as the empty role. Rows of one conversation go by turn, nulls first, then by
role and text; repeated rows are turns of their own. Null conv_ids form one conversation. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, read_table

START = "start"


@dataclass(frozen=True)
class Template:
    """Marks around each turn: ``opening`` + role + ``opened``, text, ``closing``. ``escape`` precedes each of ``controls`` in roles and texts.

    ``moves``: role to follow each state; the state after a turn is its role. ``learned``: roles whose texts bear loss.
    """

    opening: str = "### "
    opened: str = ":\n"
    closing: str = "\n</turn>\n"
    escape: str = "\\"
    controls: str = "\\#<:"
    moves: dict[str, frozenset[str]] = field(default_factory=lambda: {START: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    learned: frozenset[str] = frozenset({"assistant"})

    def escaped(self, text: str) -> str:
        return re.sub("[" + re.escape(self.controls) + "]", lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's text segments and whether each bears loss."""
        return [(self.opening + self.escaped(role) + self.opened, False), (self.escaped(text), role in self.learned), (self.closing, False)]

    def pattern(self) -> re.Pattern:
        """Matches one turn. Inside it every control character has its escape, so the marks, which hold some, are found for sure."""
        own = "(?:[^" + re.escape(self.controls) + "]|" + re.escape(self.escape) + ".)*?"
        return re.compile(f"{re.escape(self.opening)}({own}){re.escape(self.opened)}({own}){re.escape(self.closing)}", re.DOTALL)


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, place (of the row, from 0), part (of the segment in its row, from 0), segment, loss, valid (so far), in order within partitions."""
    spark = conversations.sparkSession
    prepare(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, place, valid = (), START, 0, True
        for batch in batches:
            out: list[tuple] = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if (conv_id,) != now:
                    now, state, place, valid = (conv_id,), START, 0, True
                valid &= role in template.moves.get(state, ())
                out += [(conv_id, place, part, segment, loss, valid) for part, (segment, loss) in enumerate(template.segments(role, text))]
                state, place = role, place + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], ["conv_id", "place", "part", "segment", "loss", "valid"])

    return rows.mapInArrow(run, "conv_id long, place long, part int, segment string, loss boolean, valid boolean")


class _Reading:
    """One conversation's digests, read from its formatted text as it comes."""

    def __init__(self, conv_id, template: Template, pattern: re.Pattern):
        self.conv_id, self.template, self.pattern = conv_id, template, pattern
        self.text, self.turns, self.chars, self.loss_chars, self.valid = "", 0, 0, 0, True
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.next = (0, 0)

    def add(self, conv_id, place: int, part: int, segment: str, loss: bool, valid: bool) -> None:
        if conv_id != self.conv_id or (place, part) != self.next:
            raise ValueError(f"conversation {self.conv_id}: segments don't come in their order; read_back(..., ordered=False) sorts them")
        self.next = (place, part + 1) if part < 2 else (place + 1, 0)
        self.valid &= valid
        self.chars += len(segment)
        if loss:
            plain = self.template.unescaped(segment)
            self.loss_chars += len(plain)
            self.loss_hash.update(plain.encode())
        self.text += segment
        # A turn ends with its closing mark; more than one can't be waiting.
        while m := self.pattern.match(self.text):
            self.turns += 1
            self.turns_hash.update("".join((self.template.unescaped(m[1]), "\n", self.template.unescaped(m[2]), "\n")).encode())
            self.text = self.text[m.end() :]

    def result(self) -> tuple:
        if self.text:
            raise ValueError(f"conversation {self.conv_id} doesn't end with a turn")
        return self.conv_id, self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars, self.valid


def read_back(segments: DataFrame, template: Template = Template(), ordered: bool = True) -> DataFrame:
    """Per conversation the digests of its turns and of its text under loss, from its segments.

    ordered: they come straight from ``format_turns``, whose order is checked; otherwise, as after they were stored, they are sorted first.
    """
    if not ordered:
        segments = segments.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, reading, done = template.pattern(), None, []

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        for batch in batches:
            for conv_id, place, part, segment, loss, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "part", "segment", "loss", "valid")), strict=True):
                if place == 0 and part == 0:
                    if reading is not None:
                        done.append(reading.result())
                    reading = _Reading(conv_id, template, pattern)
                elif reading is None:
                    raise ValueError(f"conversation {conv_id} doesn't begin with its first segment; read_back(..., ordered=False) sorts them")
                reading.add(conv_id, place, part, segment, loss, valid)
            if len(done) >= 256:
                yield flush()
                done = []
        if reading is not None:
            done.append(reading.result())
        if done:
            yield flush()

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def query(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_turns(rows.unionByName(own)))


#: DuckDB can hash what was put in, though not format it: the digests must agree. formatted_chars counts the marks and escapes.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
stepped AS (
  SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + length(role) + 15 + length(regexp_replace(role || text, '[^\\#<:]', '', 'g'))) AS BIGINT) AS formatted_chars,
  bool_and((before = 'start' AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user')
    OR (before = 'user' AND role = 'assistant')) AS valid
FROM stepped GROUP BY conv_id
"""
