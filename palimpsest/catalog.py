"""Tables and their indexes. The catalog is kept as versions of a small JSON file beside the log."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import IndexNotFound, LogDirectoryRequired, PrimaryKeyNotDefined, TableAlreadyExists, TableNotFound, TwoPrimaryKeys
from .types import DataType

KEY_PREFIX = "k_"


@dataclass(frozen=True)
class Index:
    """An index is a top-level field of the documents; one is primary. ``unique``: of rows with equal keys, the last written stands for all."""

    name: str
    type: DataType
    primary: bool = False
    unique: bool = False

    @property
    def column(self) -> str:
        return KEY_PREFIX + self.name


@dataclass(frozen=True)
class Table:
    name: str
    indexes: tuple[Index, ...]
    log: str
    encrypted: bool = False

    @property
    def primary(self) -> Index:
        return next(i for i in self.indexes if i.primary)

    def index(self, name: str) -> Index:
        for i in self.indexes:
            if i.name == name:
                return i
        raise IndexNotFound(f"{self.name}.{name}")

    def schema(self) -> T.StructType:
        """A row of the table's log."""
        fields = [T.StructField("_lsn", T.LongType(), False), T.StructField("_seq", T.LongType(), False), T.StructField("_tx_id", T.LongType()), T.StructField("_type", T.StringType(), False)]
        return T.StructType([*fields, *(T.StructField(i.column, i.type.spark) for i in self.indexes), T.StructField("_doc", T.StringType()), T.StructField("_sum", T.LongType())])

    def checksum(self) -> Column:
        """What a log row's ``_sum`` must be, from its other columns."""
        return F.xxhash64(*(F.coalesce(F.col(f.name).cast(f.dataType).cast("string"), F.lit("\0")) for f in self.schema().fields if f.name != "_sum"))


@dataclass
class Catalog:
    """Tables by name. ``encrypt``: whether tables made from now on keep their documents encrypted."""

    encrypt: bool = False
    tables: dict[str, Table] = field(default_factory=dict)

    def create(self, name: str, indexes: list[Index], log: str) -> Table:
        if not log:
            raise LogDirectoryRequired(name)
        if name in self.tables:
            raise TableAlreadyExists(name)
        primaries = sum(i.primary for i in indexes)
        if primaries == 0:
            raise PrimaryKeyNotDefined(name)
        if primaries > 1:
            raise TwoPrimaryKeys(name)
        self.tables[name] = Table(name, tuple(indexes), log, self.encrypt)
        return self.tables[name]

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise TableNotFound(name)
        return self.tables[name]

    def index(self, table: str, index: str) -> Index:
        return self.table(table).index(index)

    def list_tables(self) -> list[str]:
        return sorted(self.tables)

    def list_indexes(self, table: str) -> list[Index]:
        return list(self.table(table).indexes)

    def to_dict(self) -> dict:
        return {t.name: {"log": t.log, "encrypted": t.encrypted, "indexes": [[i.name, i.type.value, i.primary, i.unique] for i in t.indexes]} for t in self.tables.values()}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=1)

    @classmethod
    def from_json(cls, text: str, encrypt: bool = False) -> Catalog:
        out = cls(encrypt)
        for name, t in json.loads(text).items():
            out.tables[name] = Table(name, tuple(Index(n, DataType(k), p, u) for n, k, p, u in t["indexes"]), t["log"], t["encrypted"])
        return out
