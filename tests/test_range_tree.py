"""Differences of tables by a tree of digests."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import range_tree as R

ROWS = 50


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tree") / "t")
    spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") * 0.5).alias("x"), F.lit("n").alias("node"), F.when(F.col("id") % 2 == 0, "s").alias("_key")) \
        .coalesce(1).sortWithinPartitions("k").write.parquet(path)
    return spark.read.parquet(path)


def surplus(df):
    return {tuple(r)[:-1]: r["surplus"] for r in df.collect()}


def brute(a, b):
    d = Counter(map(tuple, a.collect()))
    d.subtract(Counter(map(tuple, b.select(*a.columns).collect())))
    return {k: v for k, v in d.items() if v}


def test_equal_tables_differ_nowhere(stored):
    assert R.diff_rows(stored, stored.repartition(5), "k", ROWS).collect() == []


def test_one_row_reads_one_leaf(stored):
    other = stored.withColumn("x", F.when(F.col("k") == 2345, -1.0).otherwise(F.col("x")))
    ranges = R.ranges_of(stored, "k", ROWS)
    trees = R.tree_of(stored, ranges), R.tree_of(other, ranges)
    assert len(trees[0].levels) >= 3
    leaves = R.differing_leaves(*trees)
    assert leaves.count() == 1
    read = R._within(stored, ranges, leaves)
    assert read.count() <= 2 * ROWS
    assert "GreaterThanOrEqual(k" in read._jdf.queryExecution().executedPlan().toString()
    got = R.diff_rows(stored, other, "k", trees=trees)
    assert surplus(got) == brute(stored, other) and len(surplus(got)) == 2
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1, 100])
def test_changes_of_all_kinds(spark, stored, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_RANGES", most)
    base = stored.unionByName(spark.createDataFrame([(None, 1.0, "n", None)] * 3 + [(9, None, None, None)] * 2, stored.schema))
    other = (base.where("k IS NULL OR k % 700 <> 3").withColumn("x", F.when(F.col("k") % 911 == 8, None).otherwise(F.col("x")))
             .unionByName(spark.createDataFrame([(None, 1.0, "n", None), (-50, 2.0, "n", "s"), (99999, 2.0, "n", "s"), (9, None, None, None)], stored.schema)))
    want = brute(base, other)
    assert surplus(R.diff_rows(base, other, "k", ROWS)) == want
    assert surplus(R.diff_rows(other, base, "k", ROWS)) == {k: -v for k, v in want.items()}


def test_a_null_that_moves_is_a_difference(spark):
    a = spark.createDataFrame([(1, None, "u")], "k int, p string, q string")
    b = spark.createDataFrame([(1, "u", None)], "k int, p string, q string")
    assert len(R.diff_rows(a, b, "k").collect()) == 2


def test_empty_tables(stored):
    none = stored.limit(0)
    assert R.diff_rows(none, none, "k").collect() == []
    assert len(R.diff_rows(stored, none, "k", ROWS).collect()) == len(R.diff_rows(none, stored, "k", ROWS).collect()) == 4000


def test_other_columns_or_ranges_are_refused(stored):
    with pytest.raises(ValueError):
        R.diff_rows(stored, stored.drop("x"), "k")
    with pytest.raises(ValueError):
        R.differing_leaves(R.tree_of(stored, R.ranges_of(stored, "k")), R.tree_of(stored, R.ranges_of(stored, "k")))
