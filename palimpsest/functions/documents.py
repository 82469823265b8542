"""Documents are kept as the very strings that came in. Their fields are read by way of VARIANT; strings that hold no JSON object are opaque."""

from __future__ import annotations

import datetime as dt
import json
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Index
from ..types import DataType

#: What schema_of_variant says of a field that fits each key type; decimals are how JSON numbers with a point are kept.
_FITTING = {DataType.INT: r"^BIGINT$", DataType.FLOAT: r"^(DOUBLE|FLOAT|DECIMAL.*)$", DataType.VARCHAR: r"^STRING$", DataType.BOOL: r"^BOOLEAN$", DataType.DATE: r"^(STRING|TIMESTAMP.*|DATE)$"}


def parsed(doc: Column) -> Column:
    """The document as VARIANT, null if it is no JSON object."""
    value = F.try_parse_json(doc)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def is_json(doc: Column) -> Column:
    return parsed(doc).isNotNull()


def _path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def has_field(doc: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(parsed(doc), _path(name), "variant").isNotNull(), F.lit(False))


def field_type(doc: Column, name: str) -> Column:
    """What kind of value a top-level field holds, null if it is missing."""
    return F.schema_of_variant(F.try_variant_get(parsed(doc), _path(name), "variant"))


def key_of(doc: Column, index: Index) -> Column:
    """The document's key for an index: null if its field is missing or of another type. Dates are ISO 8601 strings."""
    value = F.try_variant_get(parsed(doc), _path(index.name), index.type.spark.simpleString())
    if index.type is DataType.DATE:
        value = F.try_to_timestamp(F.try_variant_get(parsed(doc), _path(index.name), "string")).cast("timestamp_ntz")
    return F.when(field_type(doc, index.name).rlike(_FITTING[index.type]), value)


MISSING = object()


def fields_of(doc: str | None) -> dict | None:
    """The same reading of one document at the driver: its fields, None if it is opaque. As in VARIANT, names may not repeat."""

    def once(pairs):
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("a name repeats")
        return out

    def refuse(name):
        raise ValueError(name)

    try:
        value = json.loads(doc or "", object_pairs_hook=once, parse_constant=refuse)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def key_in(fields: dict, index: Index, zone: str) -> object:
    """``key_of`` at the driver: the field's value if it fits the index, None if it doesn't, ``MISSING`` if there is none."""
    value = fields.get(index.name, MISSING)
    if value is MISSING:
        return MISSING
    whole = isinstance(value, int) and not isinstance(value, bool)
    small = whole and -(1 << 63) <= value < 1 << 63
    if index.type is DataType.DATE:
        try:
            at = dt.datetime.fromisoformat(value) if isinstance(value, str) else None
        except ValueError:
            return None
        return at.astimezone(ZoneInfo(zone)).replace(tzinfo=None) if at is not None and at.tzinfo else at
    if index.type is DataType.FLOAT:
        return float(value) if isinstance(value, float) or (whole and not small) else None
    fits = {DataType.INT: small, DataType.VARCHAR: isinstance(value, str), DataType.BOOL: isinstance(value, bool)}
    return value if fits[index.type] else None


def key_struct(value: Column, kind: DataType) -> Column:
    """A key for exchange: a struct of five fields, all null but the one of its type; dates as nanoseconds."""
    fields = {"i": DataType.INT, "s": DataType.VARCHAR, "b": DataType.BOOL, "f": DataType.FLOAT, "d": DataType.DATE}
    types = {"i": "bigint", "s": "string", "b": "boolean", "f": "double", "d": "bigint"}
    own = F.unix_micros(value.cast("timestamp")) * 1000 if kind is DataType.DATE else value
    return F.struct(*((own if k is kind else F.lit(None)).cast(types[n]).alias(n) for n, k in fields.items()))


def key_from_struct(key: Column, kind: DataType) -> Column:
    if kind is DataType.DATE:
        return F.timestamp_micros((key["d"] / 1000).cast("bigint")).cast("timestamp_ntz")
    return key[{DataType.INT: "i", DataType.VARCHAR: "s", DataType.BOOL: "b", DataType.FLOAT: "f"}[kind]]


ENTRY_SCHEMA = "table string, index string, keys map<string, struct<i: bigint, s: string, b: boolean, f: double, d: bigint>>, document string"


def entry_to_json(table: Column, index: Column, keys: Column, doc: Column) -> Column:
    """One log entry as a portable string: table, index, keys by index, document."""
    return F.to_json(F.struct(table.alias("table"), index.alias("index"), keys.alias("keys"), doc.alias("document")))


def entry_from_json(text: Column) -> Column:
    return F.from_json(text, ENTRY_SCHEMA)


COMPENSATION_SCHEMA = "tx_id bigint, undone_lsn bigint, undone_seq bigint, undo_next_lsn bigint, table string, key string, restored boolean, doc string"


def compensation_to_json(**fields: Column) -> Column:
    """A compensation as a portable string: what was undone, where undo goes on, and the row as it was before (nulls are left out)."""
    names = [f.split()[0] for f in COMPENSATION_SCHEMA.split(", ")]
    return F.to_json(F.struct(*(fields[n].alias(n) for n in names if n in fields)))


def compensation_from_json(text: Column) -> Column:
    return F.from_json(text, COMPENSATION_SCHEMA)
