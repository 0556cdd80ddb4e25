import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import pit
from tapeloom.plans import ORACLE, QUERIES

DAY0 = datetime.date(2020, 1, 1)


def day(k):
    return None if k is None else DAY0 + datetime.timedelta(k)


@pytest.mark.parametrize("span", [60, 400])
def test_membership_against_brute_force(spark, span):
    rnd = random.Random(span)
    rows = []
    for _ in range(150):
        a = rnd.randrange(span)
        b = None if rnd.random() < 0.03 else a + rnd.randrange(-2, 12)
        rows.append((rnd.choice(["a", "b", "c", None]), rnd.choice(["X", "Y", "Z", None]), None if rnd.random() < 0.03 else a, b))
    members = spark.createDataFrame([(c, i, day(a), day(b)) for c, i, a, b in rows], "code string, industry string, effective_from date, effective_to date")
    points = [(c, t, n) for n, (c, t) in enumerate([(c, t) for c in ("a", "b", "c", "d", None) for t in [*range(-1, span + 12), None]] + [("a", 5)])]
    got = pit.membership_at(members, spark.createDataFrame([(c, day(t), n) for c, t, n in points], "code string, day date, n long"), "day").collect()
    assert len(got) == len(points)
    by = {r.n: (r.code, r.industry, r.ambiguous) for r in got}
    for c, t, n in points:
        open_ = {i for code, i, a, b in rows if code == c and c and i and t is not None and a is not None and a <= t and (b is None or t <= b)}
        assert by[n] == (c, open_.pop() if len(open_) == 1 else None, len(open_) > 1)


def test_several_industries_may_be_an_error(spark):
    members = spark.createDataFrame([("a", "X", day(0), day(5)), ("a", "Y", day(5), None)], "code string, industry string, effective_from date, effective_to date")
    points = spark.createDataFrame([("a", day(4))], "code string, day date")
    assert pit.membership_at(members, points, "day", "error").first().industry == "X"
    with pytest.raises(Exception, match="several industries: a"):
        pit.membership_at(members, points.withColumn("day", F.lit(day(5))), "day", "error").collect()


def test_points_and_memberships_are_not_paired(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("code"), F.lit("X").alias("industry"), F.lit(day(0)).alias("effective_from"), F.lit(day(1)).alias("effective_to"))
    plan = pit.membership_at(rows, rows.select("code", F.col("effective_from").alias("day")), "day")._jdf.queryExecution().sparkPlan().toString()
    keys = re.findall(r"Join \[([^\]]*)\]", plan)
    assert keys and all("," in k for k in keys) and "NestedLoop" not in plan and "Cartesian" not in plan


def test_whole_tables_are_read(spark):
    for name in ("a6_membership_quality", "j7_point_in_interval", "j8_interval_overlaps"):
        assert "o_orderkey % 10 = 3" not in ORACLE[name] and "id % 7" not in ORACLE[name]
    assert QUERIES["a6_membership_quality"](spark, "/root/testdata/sf0.001").first().n == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
