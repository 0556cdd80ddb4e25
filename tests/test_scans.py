import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import indicators as ind
from tapeloom.functions import scans

DAY = dt.date(2024, 1, 1)


def series(seed, n, holes=0.2):
    rng = random.Random(seed)
    return [None if rng.random() < holes else round(rng.uniform(-5, 50), 3) for _ in range(n)]


def frame(spark, data):
    rows = [(c, DAY + dt.timedelta(days=k), x, None if k % 11 == 3 else (k % 7) / 7, float(k % 9) - 1) for c, xs in data.items() for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, "code string, day date, x double, a double, n double").repartition(3)


def folded(xs, alphas):
    out, y = [], None
    for x, a in zip(xs, alphas):
        if x is not None:
            y = x if y is None else (1 - a) * y + a * x
        out.append(y)
    return out


DATA = {"a": series(1, 150), None: series(4, 20), "b": [None] * 40 + series(2, 60, 0.6), "c": [None] * 30, "d": [1.5], "e": series(3, 97, 0)}


@pytest.mark.parametrize("width", [7, 10_000])
def test_means_with_runs_of_nulls_in_any_buckets(spark, width):
    s = scans.Scans(frame(spark, DATA), F.unix_date("day") - F.unix_date("day") % width)
    got = s.scan(ema=scans.ema_step(F.col("x"), 12), own=scans.mean_step(F.col("x"), F.col("a")), one=scans.mean_step(F.col("x"), 1.0)).last_value("last", F.col("x")).result("ema", "own", "one", "last")
    for code, rows in _by_code(got).items():
        xs = DATA[code]
        own = [1.0 if k % 11 == 3 else (k % 7) / 7 for k in range(len(xs))]
        carried = folded(xs, [1.0] * len(xs))
        for k, want in enumerate((folded(xs, [2 / 13] * len(xs)), folded(xs, own), carried, [None, *carried[:-1]])):
            got_k = [r[2 + k] for r in rows]
            assert [x is None for x in got_k] == [x is None for x in want]
            assert [x for x in got_k if x is not None] == pytest.approx([x for x in want if x is not None], rel=1e-9, abs=1e-9)


def _by_code(df):
    out = {}
    for r in sorted(map(tuple, df.collect()), key=lambda r: (r[0] or "", r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_indicators_equal_their_folds(spark):
    df = frame(spark, {"a": series(5, 200, 0), "b": series(6, 31, 0)})
    s = scans.Scans(df.withColumn("close", F.col("x") + 10), F.trunc("day", "month"))
    got = scans.trix(scans.rsi(scans.macd(s), "close", 6, 24)).result("close", "dif", "dea", "macd", "rsi6", "rsi24", "trix")
    for rows in _by_code(got).values():
        close = np.array([r[2] for r in rows])
        want = [*ind.macd(close), ind.rsi(close, 6), ind.rsi(close, 24), ind.trix(close)[0]]
        for k, w in enumerate(want):
            for g, v in zip((r[3 + k] for r in rows), w):
                assert (g is None and np.isnan(v)) or g == pytest.approx(v, abs=1.01e-3)


def test_no_python_and_one_busy_series_in_several_tasks(spark):
    """Half of all rows are one series': after the deal by (series, bucket) several tasks hold some of them."""
    df = frame(spark, {"busy": series(8, 900, 0.1), **{f"c{k}": series(k, 40) for k in range(20)}})
    s = scans.Scans(df, F.trunc("day", "month"))
    done = scans.macd(s, "x").result("dif", "dea", "macd")
    plan = done._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "SinglePartition" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = done.withColumn("task", F.spark_partition_id()).where("code = 'busy'").groupBy("task").count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert tasks > 3


def test_variable_extreme_against_slices(spark):
    rng = random.Random(9)
    rows = []
    for code, n in (("a", 200), ("b", 17), ("c", 1), (None, 30)):
        for k in range(n):
            look = rng.choice([None, 0.0, -2.0, 0.5, 1.0, 2.9, float("nan"), float(rng.randrange(1, 250)), float(k + 1), float(k + 2)])
            rows.append((code, DAY + dt.timedelta(days=k), None if rng.random() < 0.05 else rng.uniform(0, 9), look))
    df = spark.createDataFrame(rows, "code string, day date, x double, n double")
    got = scans.variable_extreme(scans.variable_extreme(df, "x", "n", "hi"), "x", "n", "lo", low=True)
    seen = {(r.code, r.day): (r.hi, r.lo) for r in got.collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    full = 0
    for own in by.values():
        for k, (code, day, _, n) in enumerate(own):
            want = (None, None)
            if n is not None and n == n and 1 <= int(n) <= k + 1:
                part = [r[2] for r in own[k + 1 - int(n):k + 1]]
                if None not in part:
                    want = max(part), min(part)
                    full += 1
            assert seen[code, day] == want
    assert full > 30 and len(seen) == len(rows)
    assert scans.variable_extreme(df.limit(0), "x", "n", "hi").count() == 0


@pytest.mark.parametrize("width", [7, 10_000])
def test_means_of_means_in_one_scan(spark, width):
    """Chains three deep and of a weighted difference, with the values before: each as a fold of its own over the values of the one before."""
    s = scans.Scans(frame(spark, DATA), F.unix_date("day") - F.unix_date("day") % width)
    steps = {"a": scans.ema_step(F.col("x"), 5), "b": scans.ema_step(F.col("x"), 12), "c": scans.ema_of(3, a=1, b=-2), "d": scans.ema_of(4, c=1), "e": scans.ema_of(6, d=0.5)}
    got = s.scan(before={"e0": "e", "a0": "a"}, **steps).result(*steps, "e0", "a0")
    for code, rows in _by_code(got).items():
        xs = DATA[code]
        n = len(xs)
        a, b = folded(xs, [2 / 6] * n), folded(xs, [2 / 13] * n)
        c = folded([None if v is None else v - 2 * w for v, w in zip(a, b)], [2 / 4] * n)
        d = folded(c, [2 / 5] * n)
        e = folded([None if v is None else v / 2 for v in d], [2 / 7] * n)
        assert len(rows) == n
        for k, want in enumerate((a, b, c, d, e, [None, *e[:-1]], [None, *a[:-1]])):
            got_k = [r[2 + k] for r in rows]
            assert [v is None for v in got_k] == [v is None for v in want]
            assert [v for v in got_k if v is not None] == pytest.approx([v for v in want if v is not None], rel=1e-9, abs=1e-9)


def _exchanges(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return [line for line in plan.splitlines() if "ReusedExchange" not in line and ("Exchange hashpartitioning" in line or "Exchange SinglePartition" in line)]


# besides the one deal of the rows, a scan may deal buckets twice: to their series, and back
@pytest.mark.parametrize("name, most", [("trix", 3), ("macd", 3), ("rsi", 5), ("kdj", 3)])
def test_rows_are_dealt_once(spark, name, most):
    s = scans.Scans(frame(spark, {"a": series(8, 300, 0), "b": series(3, 40, 0)}).select("code", "day", "x"), F.trunc("day", "month"))
    run = {"trix": lambda: scans.trix(s, "x").result("trix"), "macd": lambda: scans.macd(s, "x").result("macd"), "rsi": lambda: scans.rsi(s, "x", 6, 24).result("rsi6", "rsi24"), "kdj": lambda: scans.kdj(s, F.col("x")).result("j")}
    found = _exchanges(run[name]())
    assert len(found) <= most and sum("REPARTITION_BY_COL" in x for x in found) == 1


def test_look_backs_deal_rows_once(spark):
    """No join and no second deal, of one extreme after another or of both at once, which are the same; look-backs without end need no more levels than the series has."""
    df = frame(spark, {"a": series(8, 300, 0), "b": series(3, 40, 0.1), None: series(2, 9, 0)}).select("code", "day", "x", F.when(F.col("n") > 6, float("inf")).otherwise(F.col("n") * F.day("day")).alias("n"))
    one = scans.variable_extreme(scans.variable_extreme(df, "x", "n", "hi"), "x", "n", "lo", low=True)
    both = scans.variable_extremes(df, "x", "n", "hi", "lo")
    assert len(_exchanges(one)) == len(_exchanges(both)) == 1
    want = sorted(map(str, one.collect()))
    assert sorted(map(str, both.select(*one.columns).collect())) == want and len(want) == 349
    assert one.where("hi > lo").count() > 30
