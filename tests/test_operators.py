import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import adjust, audit, calendar, ingest, perf, pit, screen, securities, validate


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def test_codes(spark):
    df = spark.createDataFrame([("600000.SH",), ("sz.000001",), ("000300.SH",), ("688001",), (None,)], "c string")
    got = df.select(securities.normalize_code(F.col("c"), "any").alias("n"), securities.classify_security(F.col("c")).alias("k")).collect()
    assert [r.n for r in got] == ["600000", "000001", "000300", "688001", None]
    assert [r.k for r in got][2:4] == ["index", "star_market"]
    with pytest.raises(Exception, match="not a security code"):
        spark.createDataFrame([("510300.XX",)], "c string").select(securities.vendor_code(F.col("c"), "ETF")).collect()


def test_validate_marks_all_rules_and_keeps_every_row(spark):
    df = spark.createDataFrame([("600000", 1, 1.0, 2.0, 0.5, 1.5), ("x", 0, 1.0, 0.5, 2.0, None), (None, 5, None, None, None, None)], "code string, time long, open double, high double, low double, close double")
    spec = validate.TableSpec({"code": validate.ColumnSpec(required=True), "close": validate.ColumnSpec("number", gt=0), "gone": validate.ColumnSpec(required=False)})
    checked = validate.validate(df, validate.rules_for(df, spec))
    by = {r.time: r for r in checked.collect()}
    assert by[1].failed_rules == [] and by[0].failed_rules == ["CodeFormat", "DateValid"] and by[5].failed_rules == ["RequiredValueNull", "CodeFormat"]
    assert by[0].error_values == {"code": "x", "time": "0"}
    assert validate.accepted(checked).count() + validate.rejected(checked, "b", "t", "s").count() == 3
    missing = validate.TableSpec({"gone": validate.ColumnSpec(required=True)})
    assert validate.accepted(validate.validate(df, validate.rules_for(df, missing))).count() == 0


def test_membership_is_ambiguous_or_fails_closed(spark):
    m = spark.createDataFrame([("a", "x", day(0), day(5)), ("a", "y", day(4), None), ("b", "z", day(3), day(9))], "code string, industry string, effective_from date, effective_to date")
    p = spark.createDataFrame([("a", day(1)), ("a", day(5)), ("a", day(7)), ("b", day(0))], "code string, day date")
    got = {(r.code, r.day): (r.industry, r.ambiguous) for r in pit.membership_at(m, p, "day").collect()}
    assert got == {("a", day(1)): ("x", False), ("a", day(5)): (None, True), ("a", day(7)): ("y", False), ("b", day(0)): (None, False)}
    with pytest.raises(Exception, match="several industries"):
        pit.membership_at(m, p, "day", "error").collect()
    assert [r.meets for r in pit.overlaps(m, ["code"]).orderBy("code", "effective_from").collect()] == [None, "overlap", None]


def test_anchor_is_latest_not_greatest(spark):
    f = spark.createDataFrame([("a", day(0), 1.0), ("a", day(5), 3.0), ("a", day(9), 2.0)], "code string, day date, factor double")
    assert adjust.anchors(f).first().latest == 2.0
    bars = spark.createDataFrame([("a", day(k), 10.0, 11.0, 9.0, 10.0) for k in (0, 6, 9)], "code string, day date, open double, high double, low double, close double")
    got = {r.day: (r.close_front, r.close_back) for r in adjust.adjust(bars, f).collect()}
    assert got == {day(0): (5.0, 10.0), day(6): (15.0, 30.0), day(9): (10.0, 20.0)}
    front = adjust.adjust(bars, f).select("code", "day", *[f"{p}_front" for p in adjust.PRICES])
    assert all(r.close == 10.0 and not r.invalid for r in adjust.restore_raw(front, f).collect())


def test_revisions_raise_on_bad_factors(spark):
    f = spark.createDataFrame([("a", day(0), 1.0), ("a", day(0), 2.0)], "code string, day date, factor double")
    with pytest.raises(Exception, match="bad factor"):
        adjust.revisions(f, f.limit(0), day(5)).collect()


def test_change_points_follow_the_segment_start(spark):
    df = spark.createDataFrame([("a", day(k), v) for k, v in enumerate([1.0, 1.0003, 1.0006, 1.0006, 2.0])], "code string, day date, ratio double")
    assert [r.segment for r in adjust.change_points(df).orderBy("day").collect()] == [1, 1, 2, 2, 3]


def test_weekdays(spark):
    days = [(day(a), day(a + b)) for a in range(14) for b in range(30)]
    df = spark.createDataFrame(days, "a date, z date").withColumn("n", perf.weekdays(F.col("a"), F.col("z")))
    for r in df.collect():
        assert r.n == np.busday_count(r.a, r.z + dt.timedelta(1)), (r.a, r.z)


def test_average_cost(spark):
    t = spark.createDataFrame([("a", "buy", 10.0, 100.0, 1), ("a", "buy", 20.0, 100.0, 2), ("a", "sell", 18.0, 150.0, 3), ("a", "sell", 10.0, 100.0, 4)], "code string, side string, price double, volume double, seq int")
    r = perf.realised_pnl(t, ["seq"]).first()
    assert (r.sells, r.wins, r.realised, r.best, r.worst) == (2, 1, 450.0 - 250.0, 450.0, -250.0)


def test_repeated_trades_match_one_to_one(spark):
    a = spark.createDataFrame([("d", "x", "buy", 1.0)] * 3, "day string, code string, side string, volume double")
    r = perf.match_rate(a, a.limit(2)).first()
    assert (r.matches, r.larger) == (2, 3)


def test_min_variance_weights():
    m = np.array([[0.01, -0.01, 0.01, -0.01], [0.1, -0.1, 0.12, -0.1]])
    w = screen.min_variance(m, -1.0)
    assert np.isclose(w.sum(), 1) and (w >= 0).all() and w[0] > w[1]
    assert np.isclose(screen.min_variance(m, 1.0)[1], 1.0)


def test_buffer_band_keeps_holdings(spark):
    rows = [("s", day(0), c, k + 1) for k, c in enumerate("abcdefgh")] + [("s", day(1), c, k + 1) for k, c in enumerate("hgfedcba")]
    got = screen.buffer_band(spark.createDataFrame(rows, "strategy string, day date, code string, rank int"), hold=3, band=8)
    assert sorted(r.code for r in got.where(F.col("day") == day(1)).collect()) == ["a", "b", "c"]


def test_dates_in_any_form(spark):
    df = spark.createDataFrame([("20240102",), ("1704124800000",), ("1704124800",), ("2024-01-02",), ("soon",), (None,)], "v string")
    assert [r[0] for r in df.select(ingest.to_epoch_ms(F.col("v"))).collect()] == [1704124800000] * 4 + [None, None]


def test_mapping_collision(spark):
    with pytest.raises(ValueError):
        ingest.map_columns(spark.createDataFrame([(1, 2)], "a int, b int"), {}, {"a": "b"})


def test_upsert_keeps_the_last_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    once = ingest.upsert(old, new, ["k"], "seq")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, ingest.upsert(once, new, ["k"], "seq").collect())) == sorted(map(tuple, once.collect()))


def test_audit_in_one_pass(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    got = {r.check: r["count"] for r in audit.count_checks(df, "t", {"Null": (F.col("b").isNull(), "error"), "Big": (F.col("a") > 5, "warn")}).collect()}
    assert got == {"Null": 1, "Big": 0}


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).withColumn("v", F.col("id") * 2)
    assert audit.fingerprint(a).first() == audit.fingerprint(a.orderBy(F.desc("id")).repartition(7)).first()


def test_calendar(spark):
    days = spark.createDataFrame([(day(0),), (day(1),), (day(4),)], "day date")
    got = {r.day: r.shifted for r in calendar.shift_days(days, days, 1).collect()}
    assert got == {day(0): day(1), day(1): day(4), day(4): None}
    assert calendar.minute_grid(days).count() == 3 * 241


def test_digest_ignores_order_and_sees_nulls(spark):
    a = spark.createDataFrame([(k, f"v{k}", None if k % 3 else 1.5) for k in range(300)], "id long, v string, x double")
    first = sorted(audit.canonical_digest(a, 1).collect())
    assert first == sorted(audit.canonical_digest(a.orderBy(F.desc("id")).repartition(7), 1).collect()) and sum(r.n for r in first) == 300
    assert first != sorted(audit.canonical_digest(a.na.fill(0.0), 1).collect())


def test_change_points_at_zero(spark):
    rows = spark.createDataFrame([("a", k, x) for k, x in enumerate([0.0, 0.0, 0.0, 1.0, 1.0, None, 1.0])], "code string, day int, ratio double")
    assert [r.segment for r in adjust.change_points(rows).orderBy("day").collect()] == [1, 1, 1, 2, 2, 3, 4]


def test_chosen_weights_against_pandas(spark):
    """X5 on a small table: the chosen codes and their least-variance weights, worked out from the raw closes."""
    rng = np.random.default_rng(3)
    days = pd.date_range("2020-01-01", periods=150)
    closes = pd.DataFrame(50 + np.cumsum(rng.normal(size=(150, 8)), axis=0), index=days, columns=[f"{k:06d}" for k in range(8)])
    rows = [(c, d.date(), float(closes[c][d])) for c in closes for d in days]
    got = screen.four_factor_weights(spark.createDataFrame(rows, "code string, day date, close double"), lookback=60, k=3).toPandas()
    r = closes.pct_change()
    months = pd.Series(days, days).groupby(days.to_period("M")).max()
    want = {}
    for end in months:
        past = r[:end].tail(60)
        if len(past) < 60 or past.isna().any().any():
            continue
        peak = closes.rolling(60).max()
        low = (closes / peak - 1).rolling(60).min().loc[end]
        if low.isna().any():
            continue
        score = sum(x.rank() / x.count() for x in (past.mean() / past.std(ddof=0), (past > 0).mean(), low, past.mean()))
        top = score.round(9).sort_index().sort_values(ascending=False, kind="stable").index[:3]
        top = sorted(top)
        for c, w in zip(top, screen.min_variance(past[top].to_numpy().T, 0.0005)):
            want[(end.replace(day=1).date(), c)] = w
    assert len(want) >= 3 and {(m, c): pytest.approx(w, abs=1e-9) for m, c, w in zip(got.month, got.code, got.weight)} == want


def test_minute_against_daily_with_zero_and_missing_prices(spark):
    """D13 as its SQL has it: any price is an error against a daily close of zero, and the last price is the last one there is."""
    t = [dt.datetime(2020, 1, 1, 9, k) for k in range(3)]
    minutes = spark.createDataFrame([("zero", t[0], 0.0), ("off", t[0], 0.0), ("off", t[1], 5.0), ("gap", t[0], 9.0), ("gap", t[1], 10.0), ("gap", t[2], None), ("none", t[0], None)], "code string, ts timestamp, price double")
    daily = spark.createDataFrame([("zero", t[0].date(), 0.0), ("off", t[0].date(), 0.0), ("gap", t[0].date(), 10.04), ("none", t[0].date(), 0.0)], "code string, day date, close double")
    got = {r.code: (r.last_price, r.level) for r in audit.minute_against_daily(minutes, daily).collect()}
    assert got == {"zero": (0.0, "error"), "off": (5.0, "error"), "gap": (10.0, "warn"), "none": (None, "ok")}
