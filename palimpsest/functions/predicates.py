"""The filter language: seven comparisons of one key, as Catalyst expressions that reach the Parquet scan, and their combinations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IndexNotFound, InvalidKeyType
from ..types import DataType

_OPERATORS = {"=": lambda c, a, b: c == a, "!=": lambda c, a, b: c != a, ">": lambda c, a, b: c > a, ">=": lambda c, a, b: c >= a, "<": lambda c, a, b: c < a, "<=": lambda c, a, b: c <= a, "between": lambda c, a, b: (c >= a) & (c <= b)}


@dataclass(frozen=True)
class Condition:
    """``operator`` applied to a key, ``value`` and, for between (inclusive; empty if reversed), ``end``. Unknown operators match nothing."""

    operator: str
    value: object = None
    end: object = None

    def check(self, kind: DataType) -> Condition:
        """Itself, if its literals have the key's type."""
        if self.operator in _OPERATORS:
            kind.check(self.value)
            if self.operator == "between":
                kind.check(self.end)
        return self

    def column(self, key: Column) -> Column:
        if self.operator not in _OPERATORS:
            return F.lit(False)
        return _OPERATORS[self.operator](key, _literal(self.value), None if self.end is None else _literal(self.end))

    def matches(self, key: object) -> bool:
        """The same for a value at the driver."""
        return bool(_OPERATORS[self.operator](key, self.value, self.end) if self.operator != "between" else self.value <= key <= self.end) if self.operator in _OPERATORS else False

    def start(self) -> object:
        """The least key that can match, None if any can. Catalyst derives it from the pushed filter by itself."""
        return self.value if self.operator in ("=", ">", ">=", "between") else None

    def goes_on(self, key: object) -> bool:
        """Whether, in ascending order, a key after ``key`` can still match."""
        last = {"=": self.value, "<": self.value, "<=": self.value, "between": self.end}.get(self.operator)
        return True if last is None else key < last if self.operator == "<" else key <= last


def _literal(value: object) -> Column:
    kind = DataType.of(value)
    return F.lit(value).cast(kind.spark)


def equal(value) -> Condition:
    return Condition("=", value)


def not_equal(value) -> Condition:
    return Condition("!=", value)


def greater_than(value) -> Condition:
    return Condition(">", value)


def greater_or_equal(value) -> Condition:
    return Condition(">=", value)


def less_than(value) -> Condition:
    return Condition("<", value)


def less_or_equal(value) -> Condition:
    return Condition("<=", value)


def between(low, high) -> Condition:
    return Condition("between", low, high)


def both(*conditions: tuple[Column, Condition]) -> Column:
    """All of several conditions, each on a key of its own."""
    out = F.lit(True)
    for key, condition in conditions:
        out = out & condition.column(key)
    return out


def either(*conditions: tuple[Column, Condition]) -> Column:
    out = F.lit(False)
    for key, condition in conditions:
        out = out | condition.column(key)
    return out


@dataclass(frozen=True)
class Filter:
    """A condition over several keys: comparisons, IN, LIKE and IS NULL of one key each (``index``), put together by &, | and ~.

    Nulls are as in SQL: a comparison with a null key is unknown, and rows whose condition is unknown are left out.
    """

    kind: str
    index: str | None = None
    given: tuple = ()
    parts: tuple[Filter, ...] = ()

    def __and__(self, other: Filter) -> Filter:
        return Filter("and", parts=(self, other))

    def __or__(self, other: Filter) -> Filter:
        return Filter("or", parts=(self, other))

    def __invert__(self) -> Filter:
        return Filter("not", parts=(self,))

    def names(self) -> set[str]:
        return ({self.index} if self.index else set()).union(*(p.names() for p in self.parts))

    def check(self, kinds: dict[str, DataType]) -> None:
        """Fails unless every literal has its key's type, and every key is known."""
        if self.index is not None:
            if self.index not in kinds:
                raise IndexNotFound(self.index)
            kind = kinds[self.index]
            if self.kind == "compare":
                self.given[0].check(kind)
            elif self.kind == "in":
                for value in self.given:
                    kind.check(value)
            elif self.kind == "like" and kind is not DataType.VARCHAR:
                raise InvalidKeyType(f"{self.index} is no text")
        for part in self.parts:
            part.check(kinds)

    def column(self, of: Callable[[str], Column]) -> Column:
        """As a Catalyst expression; of: gives a key's column."""
        if self.kind == "and":
            return self.parts[0].column(of) & self.parts[1].column(of)
        if self.kind == "or":
            return self.parts[0].column(of) | self.parts[1].column(of)
        if self.kind == "not":
            return ~self.parts[0].column(of)
        key = of(self.index)
        if self.kind == "compare":
            return self.given[0].column(key)
        if self.kind == "in":
            return key.isin(*map(_literal, self.given)) if self.given else F.lit(False)
        return key.like(self.given[0]) if self.kind == "like" else key.isNull()

    def only(self, names: set[str]) -> Filter | None:
        """The conjuncts that read no other keys than these; None if there are none."""
        if self.kind == "and":
            kept = [x for p in self.parts if (x := p.only(names)) is not None]
            return kept[0] & kept[1] if len(kept) == 2 else kept[0] if kept else None
        return self if self.names() <= names else None


def where(index: str, condition: Condition) -> Filter:
    return Filter("compare", index, (condition,))


def one_of(index: str, *values) -> Filter:
    return Filter("in", index, values)


def like(index: str, pattern: str) -> Filter:
    return Filter("like", index, (pattern,))


def is_null(index: str) -> Filter:
    return Filter("null", index)
