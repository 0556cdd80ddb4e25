import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import bars, kernels


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([("a", day(0)), ("a", day(5)), ("a", day(9)), ("b", day(1)), ("c", None)], "code string, day date")
    right = spark.createDataFrame([("a", day(1), 1.0), ("a", day(5), None), ("a", day(7), 3.0), ("b", day(2), 9.0)], "code string, t date, v double")
    return left, right


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_asof_backward_keeps_unmatched_and_null_values(sides):
    got = kernels.asof(*sides, ["code"], "day", "t", ["v"], matched_time="m")
    assert rows(got, "code", "day", "v", "m") == sorted([("a", day(0), None, None), ("a", day(5), None, day(5)), ("a", day(9), 3.0, day(7)), ("b", day(1), None, None), ("c", None, None, None)], key=str)


def test_asof_strict_forward_and_tolerance(sides):
    assert ("a", day(5), 1.0) in rows(kernels.asof(*sides, ["code"], "day", "t", ["v"], allow_exact=False), "code", "day", "v")
    assert ("b", day(1), 9.0) in rows(kernels.asof(*sides, ["code"], "day", "t", ["v"], direction="forward"), "code", "day", "v")
    assert ("a", day(9), None) in rows(kernels.asof(*sides, ["code"], "day", "t", ["v"], tolerance=1), "code", "day", "v")
    with pytest.raises(ValueError):
        kernels.asof(*sides, ["code"], "day", "t", ["v"], direction="sideways")


def test_range_agg_includes_both_ends(sides):
    got = kernels.range_agg(*sides, ["code"], "day", "t", 4, 0, low=("v", F.min), n=("v", F.count))
    assert ("a", day(5), 1.0, 1) in rows(got, "code", "day", "low", "n")
    assert ("a", day(0), None, 0) in rows(got, "code", "day", "low", "n")


def test_islands_and_latest(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, 5), ("a", 4, 5), ("a", 5, None)], "code string, t int, v int")
    assert [r.segment for r in kernels.islands(df, ["code"], ["t"], F.col("v")).orderBy("t").collect()] == [1, 1, 2, 2, 3]
    assert kernels.latest_per_key(df, ["code"], ["t"]).collect()[0].t == 5


def test_percentiles_and_winsorize(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 4.0), (1, None), (2, 3.0)], "d int, v double")
    got = df.withColumn("p", kernels.percent_rank_average(F.col("v"), ["d"])).withColumn("q", kernels.percent_less(F.col("v"), ["d"], 0.5))
    assert rows(got.where("d = 1"), "v", "p", "q") == sorted([(1.0, 0.25, 0.0), (2.0, 0.625, 1 / 3), (2.0, 0.625, 1 / 3), (4.0, 1.0, 1.0), (None, None, 0.5)], key=str)
    assert rows(got.where("d = 2"), "p", "q") == [(1.0, 0.5)]
    big = spark.createDataFrame([(1, float(k)) for k in range(20)], "d int, v double")
    clipped = [r.w for r in kernels.winsorize(big, "v", ["d"], 0.1, "w").collect()]
    assert min(clipped) == 2.0 and max(clipped) == 17.0


def test_empty_tables(spark, sides):
    left, right = sides
    assert kernels.asof(left.limit(0), right, ["code"], "day", "t", ["v"]).count() == 0
    assert kernels.asof(left, right.limit(0), ["code"], "day", "t", ["v"]).where("v is not null").count() == 0


def test_plan_of_asof_has_one_shuffle_per_side_and_no_join(sides):
    plan = kernels.asof(*sides, ["code"], "day", "t", ["v"])._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_routing_and_missing_frequency(spark):
    a = spark.createDataFrame([("x", day(1), 1.0)], "code string, day date, close double")
    b = spark.createDataFrame([("x", day(1), 2.0), ("y", day(1), 3.0)], "code string, day date, close double")
    assert rows(bars.route_by_source([a, b]), "code", "close") == [("x", 1.0), ("y", 3.0)]
    with pytest.raises(LookupError):
        bars.require_frequency(a.withColumn("freq", F.lit("1min")), "5min")


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_in_buckets_nulls_and_clashing_names(spark, direction, exact):
    rnd = random.Random(7)
    code = lambda: rnd.choice(["a", "b", None])
    time = lambda: rnd.choice([None, *range(60)])
    left = [(code(), time(), k) for k in range(200)]
    right = [(code(), time(), rnd.randrange(9)) for _ in range(40)]
    ldf = spark.createDataFrame(left, "code string, t int, _side int").withColumn("_t", F.lit("mine"))
    rdf = spark.createDataFrame(right, "code string, u int, v int").withColumn("_r", F.lit(1))

    def want(c, t):
        found = [(u if direction == "backward" else -u, v) for k, u, v in right if None not in (c, t, k, u) and k == c
                 and (u < t if direction == "backward" else u > t) | (exact and u == t)]
        return max(found)[1] if found else None

    for bucket in (None, lambda t: F.floor(t / 7)):
        got = {r["_side"]: r.v for r in kernels.asof(ldf, rdf, ["code"], "t", "u", ["v"], direction, exact, bucket=bucket).collect()}
        assert got == {k: want(c, t) for c, t, k in left}


def test_range_agg_leaves_null_keys_and_times_apart(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", None, 2), (None, 5, 3)], "code string, t int, _v int")
    right = spark.createDataFrame([("a", 4, 1.0), ("a", None, 99.0), (None, 5, 7.0)], "code string, u int, x double")
    got = {r["_v"]: (r.m, r.n) for r in kernels.range_agg(left, right, ["code"], "t", "u", 2, 0, m=("x", F.max), n=("x", F.count)).collect()}
    assert got == {1: (1.0, 1), 2: (None, 0), 3: (None, 0)}


@pytest.mark.parametrize("most", [0, 100])
def test_lookup_by_either_join(spark, most):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("z", 4)], "code string, _d int")
    names = spark.createDataFrame([("a", "A1"), ("a", "A2"), ("b", "B"), (None, "none")], "code string, name string")
    assert sorted((r["_d"], r.name) for r in kernels.lookup(rows, names, ["code"], ["name"], most).collect()) == [(1, "A2"), (2, "B"), (3, None), (4, None)]
