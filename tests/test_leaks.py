"""Matches of whole keys between two tables."""

from foldstone.operators import joins
from foldstone.workload import QUERIES
from foldstone.workload import fixtures as X

KEYS = ["age", "gender", "day", "lat", "long"]
SCHEMA = "age double, gender string, day string, lat double, long double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_levels_count_prefixes_and_match_missing_keys(spark):
    a, b = (1.0, "F", "d", 0.5, 1.5), (1.0, "F", None, 0.5, 1.5)
    left = frame(spark, [a, a, b, (2.0, "M", "d", 0.1, 0.2), (None, None, None, None, None)])
    right = frame(spark, [a, b, b, (1.0, "F", "d", 0.5, 9.0), (3.0, "M", "d", 0.1, 0.2),
                          (None, None, None, None, None)])
    full = {(r["age"], r["day"]): (r["left_rows"], r["right_rows"], r["pairs"])
            for r in joins.key_matches(left, right, KEYS).collect()}
    assert full == {(1.0, "d"): (2, 1, 2), (1.0, None): (1, 2, 2), (None, None): (1, 1, 1)}
    levels = {r["keys_used"]: tuple(r)[1:] for r in joins.match_levels(left, right, KEYS).collect()}
    assert levels[5] == (3, 4, 4, 5)
    assert levels[4] == (3, 4, 5, 7) and levels[1] == (2, 4, 5, 13)


def test_levels_without_a_match(spark):
    left, right = frame(spark, [(1.0, "F", "d", 0.5, 1.5)]), frame(spark, [(2.0, "F", "d", 0.5, 1.5)])
    assert [tuple(r) for r in joins.match_levels(left, right, KEYS).orderBy("keys_used").collect()] == [
        (n, 0, 0, 0, 0) for n in range(1, 6)]
    assert joins.match_levels(left.limit(0), right, KEYS).count() == 5


def test_pairs_of_some_keys_and_of_all(spark):
    a, b = (1.0, "F", "d", 0.5, 1.5), (1.0, "F", "d", 0.5, 9.0)
    left = frame(spark, [a, a, b, (2.0, "M", None, 0.1, 0.2)])
    right = frame(spark, [a, b, (1.0, "F", "d", 0.7, 1.5), (2.0, "M", None, 0.3, None)])
    got = {(r["age"], r["day"]): (r["left_rows"], r["right_rows"], r["pairs"], r["exact_pairs"])
           for r in joins.key_matches(left, right, KEYS[:3], KEYS[3:]).collect()}
    assert got == {(1.0, "d"): (3, 3, 9, 3), (2.0, None): (1, 1, 1, 0)}


def test_registered_leak_check_lists_matches(spark, tmp_path):
    """Records that agree in age, gender and date but not in place are listed."""
    spark.sql("select 0 as n_regionkey, 0 as n_nationkey, 'N' as n_name").write.parquet(
        f"{tmp_path}/nation.parquet")
    spark.sql("select 0 as r_regionkey, 'R' as r_name").write.parquet(f"{tmp_path}/region.parquet")
    spark.sql("select id as c_custkey, concat('c', id) as c_name, 'BUILDING' as c_mktsegment, "
              "id * 1000e0 as c_acctbal, 0 as c_nationkey from range(2)").write.parquet(
        f"{tmp_path}/customer.parquet")
    spark.sql("select id as o_orderkey, id % 2 as o_custkey, '1-URGENT' as o_orderpriority, "
              "timestamp_ntz '1995-01-01' as o_orderdate, 5000e0 as o_totalprice, 'F' as o_orderstatus "
              "from range(40)").write.parquet(f"{tmp_path}/orders.parquet")
    sides = X.records(spark, str(tmp_path)).groupBy("latitude").pivot("split", ["train", "test"]).count().collect()
    assert len(sides) == 2 and all(r["train"] and r["test"] for r in sides)
    train, test = sum(r["train"] for r in sides), sum(r["test"] for r in sides)
    found = QUERIES["exact_match_leak"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(1.0, "Female", "1995-01-01", train, test, train * test,
                                          sum(r["train"] * r["test"] for r in sides))]
