"""Joins, aggregates, sorting and limits of tables. Plain DataFrame plans: Catalyst chooses join strategy and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HINTS = {"hash": "shuffle_hash", "merge": "merge", "loop": "shuffle_replicate_nl", "auto": None}


def joined(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner", strategy: str = "auto") -> DataFrame:
    """A join; without a strategy, Catalyst takes one by size."""
    hint = HINTS[strategy]
    return left.join(right.hint(hint) if hint else right, on, how)


def combined(operation: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION, INTERSECT and EXCEPT of rows without repeats, ``union all`` with them."""
    return {"union": lambda: left.union(right).distinct(), "union all": lambda: left.union(right), "intersect": lambda: left.intersect(right), "except": lambda: left.subtract(right)}[operation]()


def grouped(df: DataFrame, by: list[str], sets: str = "groupBy", **aggregates: tuple[str, str]) -> DataFrame:
    """GROUP BY with named aggregates: ``total=("sum", "price")``; functions count, sum, avg, min, max, count_distinct. sets: groupBy, rollup or cube."""
    functions = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}
    return getattr(df, sets)(*by).agg(*(functions[f](F.col(c) if c != "*" else F.lit(1)).alias(name) for name, (f, c) in aggregates.items()))


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY ... LIMIT ... OFFSET: a top-k in each partition and one merge, not a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
