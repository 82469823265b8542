import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import InvalidKeyType
from palimpsest.functions import predicates as P
from palimpsest.types import DataType

KEYS = {
    DataType.INT: [-5, 0, 7, 2**40],
    DataType.FLOAT: [-1.5, 0.0, 2.25, 1e300],
    DataType.VARCHAR: ["B", "a", "apple", "é"],
    DataType.BOOL: [False, True],
    DataType.DATE: [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 31, 23, 59, 59, 999999)],
}


@pytest.mark.parametrize("kind", list(DataType))
def test_each_operator_agrees_with_its_driver_side(spark, kind):
    keys = KEYS[kind]
    rows = spark.createDataFrame([(k,) for k in keys], f"k {kind.spark.simpleString()}")
    for a in keys:
        for make in (P.equal, P.not_equal, P.greater_than, P.greater_or_equal, P.less_than, P.less_or_equal):
            found = {r.k for r in rows.where(make(a).column(F.col("k"))).collect()}
            assert found == {k for k in keys if make(a).matches(k)}
    low, high = keys[0], keys[-1]
    assert rows.where(P.between(low, high).column(F.col("k"))).count() == len(keys)
    assert rows.where(P.between(high, low).column(F.col("k"))).count() == 0


def test_unknown_operators_match_nothing(spark):
    assert not P.Condition("like", 1).matches(1)
    assert spark.range(3).where(P.Condition("like", 1).column(F.col("id"))).count() == 0


def test_hints_of_start_and_end():
    assert P.equal(3).start() == P.between(3, 5).start() == P.greater_than(3).start() == 3
    assert P.less_than(3).start() is None and P.not_equal(3).start() is None
    assert P.less_than(3).goes_on(2) and not P.less_than(3).goes_on(3)
    assert P.less_or_equal(3).goes_on(3) and not P.between(1, 3).goes_on(4)
    assert P.greater_than(3).goes_on(10**9)


def test_types_are_strict():
    for kind, value in ((DataType.FLOAT, 10), (DataType.INT, 1.0), (DataType.INT, True), (DataType.BOOL, 1), (DataType.VARCHAR, None), (DataType.INT, 2**63)):
        with pytest.raises(InvalidKeyType):
            P.equal(value).check(kind)


def test_comparisons_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).withColumn("x", F.col("id") * 2).write.parquet(path)
    for condition, shown in ((P.between(3, 5), "GreaterThanOrEqual(id,3)"), (P.not_equal(4), "Not(EqualTo(id,4))"), (P.less_than(4), "LessThan(id,4)")):
        plan = spark.read.parquet(path).where(condition.column(F.col("id"))).select("id")._jdf.queryExecution().toString()
        assert shown in plan.split("PushedFilters")[1] and "x:" not in plan.split("ReadSchema")[1]
