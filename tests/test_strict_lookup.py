"""Lookups that fail on a missing key."""

import pytest

from sessionrec.operators import factorization as fz
from sessionrec.operators.sessions import strict_lookup


def test_values_and_one_join(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "key int, name string")
    table = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "key int, value long")
    found = strict_lookup(rows, table, "key")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "a", 10), (1, "c", 10), (2, "b", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


@pytest.mark.parametrize("key", [4, None])
def test_missing_key_fails(spark, key):
    rows = spark.createDataFrame([(key,)], "key int")
    table = spark.createDataFrame([(1, 10)], "key int, value long")
    with pytest.raises(Exception, match=f"no row for key {'null' if key is None else key}"):
        strict_lookup(rows, table, "key").collect()


def test_lag_pairs_need_every_item(spark, log):
    ids = fz.item_ids(log)
    assert fz.lag_pairs(log, ids).count() > 0
    with pytest.raises(Exception, match="no row for aid 10"):
        fz.lag_pairs(log, ids.filter("aid != 10")).collect()
