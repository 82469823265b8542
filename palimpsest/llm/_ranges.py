"""Rows dealt to ranges of a sort key, each range with the rows next to it, so that neighbours meet without a global sort in one task."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a range, and rows of one where that makes no more than ``FEW`` ranges, on average.
RANGE_BYTES, RANGE_ROWS, FEW = 8 << 20, 500, 4096
#: Until there are as many ranges as may be; beyond, ranges get larger, and tasks sort them with spilling and stream through them.
MOST_RANGES = 50_000
#: Keys that are drawn for each range, so that ranges are quantiles with a spread of about a quarter.
DRAWN = 16


def in_ranges(df: DataFrame, key: Column, roles: tuple[int, ...], rows_a_range: int = RANGE_ROWS, around: bool = False) -> DataFrame:
    """df with key_, range_ and role_, sorted by them in a partition for each range.

    key: a struct of longs and strings, none null, with a hash of the row last, so that rows that agree in all else can be told
    apart and no value gathers in one range; rows that agree even in the key stay together. Each row has role_ 0 in its own range. roles: 1 also gives the range before each range's first row (around: the last range the very
    first row), -1 also gives the range after its last row.

    Ranges begin at quantiles of keys drawn by their hashes: at most ``MOST_RANGES * DRAWN`` or so, of which the begins are
    kept and looked up in a literal by bisection. Only where work is cut depends on them.
    """
    keyed = df.withColumn("key_", key)
    # Keys are computed again from df rather than stored: they are cheap beside the texts.
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0))
    bare = keyed.select("key_", size.cast("long").alias("size"))
    summary = bare.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("key_").alias("least")).first()
    n = summary["n"]
    if not n:
        return keyed.withColumns({"range_": F.lit(0), "role_": F.lit(0)})
    wanted = max(-(-summary["bytes"] // RANGE_BYTES), min(-(-n // rows_a_range), FEW))
    wanted = max(1, min(MOST_RANGES, wanted, n))
    share = min(1.0, wanted * DRAWN / n)
    drawn = F.shiftrightunsigned(F.xxhash64("key_", F.lit(71)), 2) <= int(share * (1 << 62))
    keys = sorted(_plain(r["key_"]) for r in bare.where(drawn).select("key_").collect())
    begins = sorted({_plain(summary["least"]), *(keys[i * len(keys) // wanted] for i in range(wanted) if keys)})
    kind = keyed.schema["key_"].dataType
    bounds = _literal(begins, kind)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(begins).bit_length()))))
    place = F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step <= len(begins)) & (F.get(bounds, lo + step - 1) <= F.col("key_")), lo + step).otherwise(lo)) - 1
    dealt = keyed.withColumn("range_", place)
    spot = lambda at, role: F.struct(at.alias("range_"), F.lit(role).alias("role_"))
    spots = [spot(F.col("range_"), 0)]
    if 1 in roles:
        first = F.col("key_") == F.get(bounds, F.col("range_"))
        before = F.pmod(F.col("range_") - 1, F.lit(len(begins)))
        spots.append(F.when(first if around else first & (F.col("range_") > 0), spot(before, 1)))
    if -1 in roles:
        ends = {r["range_"]: _plain(r["key_"]) for r in bare.select(place.alias("range_"), "key_").groupBy("range_").agg(F.max("key_").alias("key_")).collect()}
        last = F.col("key_") == F.get(_literal([ends[k] for k in range(len(begins))], kind), F.col("range_"))
        spots.append(F.when(last & (F.col("range_") < len(begins) - 1), spot(F.col("range_") + 1, -1)))
    dealt = dealt.withColumn("spot_", F.explode(F.filter(F.array(*spots), lambda s: s.isNotNull()))).select(*df.columns, "key_", "spot_.range_", "spot_.role_")
    return dealt.repartitionById(len(begins), F.col("range_")).sortWithinPartitions("range_", *(["role_"] if around else []), "key_", *([] if around else ["role_"]))


def with_neighbours(df: DataFrame, key: Column, rows_a_range: int = RANGE_ROWS) -> DataFrame:
    """``in_ranges`` with the rows on both sides of each range."""
    return in_ranges(df, key, (1, -1), rows_a_range)


def _plain(key) -> tuple:
    """A key that sorts as Spark sorts it: strings by their bytes."""
    return tuple(x.encode() if isinstance(x, str) else x for x in key)


def _literal(keys: list[tuple], kind: T.StructType) -> Column:
    rows = [{f.name: x.decode() if isinstance(x, bytes) else x for f, x in zip(kind.fields, key, strict=True)} for key in keys]
    return F.from_json(F.lit(json.dumps(rows)), T.ArrayType(kind))
