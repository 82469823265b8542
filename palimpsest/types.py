"""The five key types, strict: no value is coerced from one to another."""

from __future__ import annotations

import datetime as dt
from enum import Enum

from pyspark.sql import types as T

from .errors import InvalidKeyType


class DataType(Enum):
    INT = "INT"
    VARCHAR = "VARCHAR"
    BOOL = "BOOL"
    FLOAT = "FLOAT"
    DATE = "DATE"

    @property
    def spark(self) -> T.DataType:
        """INT is 64 bits; DATE is a zoneless timestamp of microseconds."""
        return {"INT": T.LongType(), "VARCHAR": T.StringType(), "BOOL": T.BooleanType(), "FLOAT": T.DoubleType(), "DATE": T.TimestampNTZType()}[self.value]

    @classmethod
    def of(cls, value: object) -> DataType:
        """The type of a Python value; booleans aren't integers."""
        for kind, own in ((cls.BOOL, bool), (cls.INT, int), (cls.FLOAT, float), (cls.VARCHAR, str), (cls.DATE, dt.datetime)):
            if isinstance(value, own):
                return kind
        raise InvalidKeyType(f"{value!r} is no key")

    def check(self, value: object) -> object:
        """``value`` if it has this type, else an error; null is no key."""
        if value is None or DataType.of(value) is not self:
            raise InvalidKeyType(f"{value!r} is not of type {self.value}")
        if self is DataType.INT and not -(1 << 63) <= value < 1 << 63:
            raise InvalidKeyType(f"{value!r} exceeds 64 bits")
        return value

    def __str__(self) -> str:
        return self.value
