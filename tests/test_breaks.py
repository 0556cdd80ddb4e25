"""Segments by pointers to the next break, against the fold over each series."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import adjust, breaks


def fold_of(values, tolerance):
    """The segment numbers of one series, value by value."""
    ref, k, out = None, 0, []
    for x in values:
        if x is None or ref is None or abs(x - ref) > tolerance * abs(ref):
            ref, k = x, k + 1
        out.append(k)
    return out


def check(spark, series, tolerance, **how):
    """``series``: name to values, one a day."""
    rows = [(c, k, x, "x") for c, vs in series.items() for k, x in enumerate(vs)]
    df = spark.createDataFrame(rows, "code string, day int, ratio double, key string").repartition(5)
    got = {}
    for r in sorted(breaks.segments_by_breaks(df, tolerance=tolerance, **how).collect(), key=lambda r: r.day):
        got.setdefault(r.code, []).append(r.segment)
    assert got == {c: fold_of(vs, tolerance) for c, vs in series.items() if vs}


@pytest.mark.parametrize("width", [None, 3])
def test_random_series(spark, width):
    rng = np.random.default_rng(5)
    steps = np.cumsum(rng.random(900) < 0.02) / 100 + 1
    noise = steps * (1 + rng.normal(0, 2e-4, 900))
    holes = [None if rng.random() < 0.03 else float(x) for x in np.round(rng.normal(0, 1, 700), 1)]
    series = {"step": steps.tolist(), "noise": noise.tolist(), "holes": holes, "zero": [0.0] * 400 + [1.0] + [0.0] * 5, "nulls": [None] * 70, "one": [2.0],
              "walk": (100 + np.cumsum(rng.normal(0, 1, 800))).tolist(), "negative": (-steps).tolist()}
    check(spark, series, 5e-4, width=width)
    check(spark, series, 0.2, width=width)


def test_one_break_seen_from_far(spark):
    """All rows of a long quiet series point to one late break, through three levels of the tree."""
    rng = np.random.default_rng(7)
    quiet = (1 + rng.normal(0, 1e-5, 9000)).tolist()
    quiet[8500] = 3.0
    check(spark, {"quiet": quiet, "short": [1.0, 2.0, 2.0]}, 5e-4, width=2)


def test_as_the_fold_on_dates_and_ties(spark):
    rows = [(c, datetime.date(2024, 1, 1) + datetime.timedelta(k // 2), k % 2, float(1 + (k * k) % 7 // 3)) for c in ("a", "b") for k in range(300)]
    df = spark.createDataFrame(rows, "code string, day date, n int, ratio double")
    got = breaks.segments_by_breaks(df, ties=["n"]).orderBy("code", "day", "n").collect()
    for c in ("a", "b"):
        assert [r.segment for r in got if r.code == c] == fold_of([r[3] for r in rows if r[0] == c], 5e-4)


def test_nulls_names_and_empty_tables(spark):
    rows = [(None, 1, 1.0, 9), (None, 2, 1.0, 9), (None, None, 5.0, 9), ("a", 1, float("nan"), 9), ("a", 2, float("inf"), 9), ("a", 3, 1.0, 9), ("a", 3, 1.0, 9)]
    df = spark.createDataFrame(rows, "code string, pos int, v double, segment int").withColumn("b", F.lit(1)).withColumn("items", F.lit("z"))
    got = breaks.segments_by_breaks(df, "v", order="pos")
    assert got.columns == ["code", "pos", "v", "b", "items", "segment"]
    assert sorted((r.code or "", r.pos or 0, r.segment) for r in got.collect()) == [("", 0, 1), ("", 1, 2), ("", 2, 2), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 3, 3)]
    assert breaks.segments_by_breaks(df.where("false"), "v", order="pos").count() == 0


def test_no_python_and_same_summary(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("code"), (F.col("id") / 4).cast("int").alias("day"),
                                  (1 + F.floor(F.col("id") / 130) / 50).alias("ratio"))
    got = breaks.segments_by_breaks(df)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    a = adjust.ratio_segments(df).orderBy("code", "segment").collect()
    assert a == adjust.segment_summary(got).orderBy("code", "segment").collect()
