"""Ranks, quantiles and running values by grains, against pandas."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import grains as G

ROWS = 40


@pytest.fixture(scope="module")
def frame():
    """Three groups (one a null key): a large one with a value of a third of its rows and not-a-numbers, a middling one, one of nulls only."""
    r = random.Random(5)
    rows = []
    for i in range(1500):
        x = 7.0 if i % 3 == 0 else float("nan") if i % 50 == 1 else None if i % 41 == 2 else round(r.gauss(0, 10), 1)
        rows.append(("a", i, x, "kept"))
    rows += [(None, 2000 + i, float(r.randrange(9)), "kept") for i in range(100)]
    rows += [("c", 3000 + i, None, None) for i in range(90)]
    rows += [("d", 4000, 1.5, None)]
    return rows


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame, "code string, id int, x double, _grain string").repartition(6)


def groups(frame):
    out = {}
    for code, i, x, _ in frame:
        out.setdefault(code, []).append((i, x))
    return out


@pytest.mark.parametrize("rows", [ROWS, 10_000])
def test_ranks(df, frame, rows):
    got = {r["id"]: (r["below"], r["ties"], r["n"]) for r in G.ranked(df, "x", ["code"], rows=rows).collect()}
    assert len(got) == len(frame)
    for members in groups(frame).values():
        xs = [math.inf if math.isnan(x) else x for _, x in members if x is not None]
        for i, x in members:
            if x is None:
                assert got[i] == (None, None, None)
            else:
                x = math.inf if math.isnan(x) else x
                assert got[i] == (sum(y < x for y in xs), xs.count(x), len(xs))


def test_percent_rank_quantiles_and_clipping(spark, frame):
    numbers = [(c, i, None if x is not None and math.isnan(x) else x) for c, i, x, _ in frame]
    df = spark.createDataFrame(numbers, "code string, id int, x double").repartition(6)
    pd_all = pd.DataFrame(numbers, columns=["code", "id", "x"])
    want = pd_all.groupby("code", dropna=False)["x"].rank(pct=True)
    got = {r["id"]: r["p"] for r in G.percent_rank_average(df, "x", "p", ["code"], ROWS).collect()}
    for i, p in zip(pd_all["id"], want):
        assert got[i] is None if math.isnan(p) else got[i] == pytest.approx(p, abs=1e-12)
    q = {r["code"]: r for r in G.quantiles(df, "x", ["code"], ROWS, low=0.05, mid=0.5, top=1.0).collect()}
    clipped = {r["id"]: r["w"] for r in G.winsorize(df, "x", "w", 0.1, ["code"], ROWS).collect()}
    assert set(q) == {"a", None, "d"} and len(clipped) == len(numbers)
    for code, members in groups([(*m, None) for m in numbers]).items():
        xs = sorted(x for _, x in members if x is not None)
        if xs:
            for name, share in (("low", 0.05), ("mid", 0.5), ("top", 1.0)):
                assert q[code][name] == pytest.approx(pd.Series(xs).quantile(share), abs=1e-9)
        k = int(len(xs) * 0.1)
        for i, x in members:
            assert clipped[i] == (None if x is None else max(min(x, xs[-1 - k]), xs[k]))


@pytest.mark.parametrize("kind", ["bigint", "decimal(12,2)", "date", "timestamp"])
def test_other_types(spark, kind):
    df = spark.range(500).select("id", F.expr({"bigint": "id * id % 97 + 9007199254740992", "decimal(12,2)": "cast(id * 7 % 91 / 4 as decimal(12,2))",
                                               "date": "date_add(date'2020-01-01', cast(id * 7 % 91 as int))", "timestamp": "timestamp_seconds(id * 7 % 91)"}[kind]).alias("x"))
    rows = df.collect()
    xs = [r["x"] for r in rows]
    got = {r["id"]: (r["below"], r["ties"], r["n"]) for r in G.ranked(df, "x", rows=30).collect()}
    assert got == {r["id"]: (sum(x < r["x"] for x in xs), xs.count(r["x"]), len(xs)) for r in rows}


def test_a_group_is_many_tasks_and_a_heavy_value_is_not_sorted(df, frame):
    g = G.Grains(df, "x", ["code"], ROWS)
    placed = g.placed(singles=True).where("code = 'a' AND x IS NOT NULL")
    sizes = {r[g.grain]: r["count"] for r in placed.groupBy(g.grain).count().collect()}
    assert len(sizes) > 15
    assert max(n for grain, n in sizes.items() if grain % 2 == 0) <= 2 * ROWS
    at_seven = placed.where("x = 7").select(g.grain).distinct().collect()
    assert len(at_seven) == 1 and at_seven[0][0] % 2 == 1
    assert sizes[at_seven[0][0]] == sum(code == "a" and x == 7 for code, _, x, _ in frame) >= 500


def test_few_grains_whatever_the_rows(df, monkeypatch):
    monkeypatch.setattr(G, "MOST_GRAINS", 10)
    g = G.Grains(df, "x", ["code"], 2)
    assert g.rows > 100 and g.parts <= 11
    assert G.ranked(df, "x", ["code"], rows=2).where("code = 'a'").agg(F.max(F.col("below") + F.col("ties"))).first()[0] == G.ranked(df, "x", ["code"]).where("code = 'a'").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("rows", [ROWS, 10_000])
def test_running_values(spark, rows):
    r = random.Random(6)
    data = [("s", i // 3 if i % 29 else None, i, None if i % 17 == 0 else r.uniform(-5, 6)) for i in range(900)] + [("t", i, i, float(i)) for i in range(5)]
    df = spark.createDataFrame(data, "code string, t int, id int, x double").repartition(5)
    s = G.LongSeries(df, "t", ["id"], ["code"], rows)
    s.running(sums={"total": F.col("x")}, before={"prev": F.col("x")}).running(peaks={"peak": F.col("total")})
    got = {(x["code"], x["id"]): x for x in s.result("code", "id", "total", "prev", "peak").collect()}
    assert len(got) == len(data)
    for code in "st":
        total = peak = last = None
        for c, t, i, x in sorted((d for d in data if d[0] == code), key=lambda d: (d[1] is not None, d[1] or 0, d[2])):
            total = total if x is None else x + (total or 0)
            peak = total if peak is None else peak if total is None else max(peak, total)
            row = got[c, i]
            assert row["prev"] == last
            assert (row["total"], row["peak"]) == (pytest.approx(total), pytest.approx(peak)) if total is not None else row["total"] is None
            last = x


def test_one_series_needs_no_single_task(spark):
    df = spark.range(3000).select(F.lit(1).alias("p"), F.col("id").alias("t"), (F.sin("id") + 3).alias("v"))
    plan = G.drawdown(df, "v", "t", rows=100)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # windows over rows are by grain; the others run over a row per grain
    rows = [line for line in windows if line.split("windowspecdefinition(")[1].startswith("_grain")]
    assert rows and all("_carry_" in line for line in windows if line not in rows)
    values = df.orderBy("t").toPandas()["v"]
    got = G.drawdown(df, "v", "t", rows=100).first()
    assert got["worst"] == pytest.approx((values / values.cummax() - 1).min())
    assert got["final"] == pytest.approx(values.iloc[-1])
    assert got["deviation"] == pytest.approx(values.pct_change().std())


def test_empty(spark):
    empty = spark.createDataFrame([], "code string, x double, t int")
    assert G.ranked(empty, "x", ["code"]).collect() == []
    assert G.quantiles(empty, "x", ["code"], mid=0.5).collect() == []
    assert G.winsorize(empty, "x", "w", 0.1).collect() == []
    assert G.drawdown(empty, "x", "t", by=["code"]).collect() == []
