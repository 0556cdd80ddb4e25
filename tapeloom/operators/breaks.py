"""Segments of a series by pointers to the next break, for series longer than a task should hold.

A segment's reference is its first value, and the next segment starts at the first later value outside its tolerance. So every
row has one pointer, to its next break, and the starts are the rows met from the first row on. Rows are packed into
buckets of time. Within a bucket pointers are followed in place; a row that meets no break there looks for it in a tree of
least and greatest values over the buckets. The pointers that leave a bucket are then doubled from the first row on: each
round the known starts mark those twice as far, so a chain of n buckets takes about log2(n) rounds.

All of it is JVM expressions and joins on (series, node). A row that equals its predecessor is never a start, so it asks
nothing. Each step is checkpointed in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.shared import pinned

#: Rows that a bucket is to hold in the densest series, children of a node of the tree, and the most parents that are broadcast (64 children of 33 bytes each: under 9 MB).
BUCKET, FAN_OUT, FEW = 64, 64, 4_000


def _moment(df: DataFrame, column: str) -> Column:
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return F.floor(c).cast("long")


def _leaves(rows: DataFrame, value: str, outside, keys: Sequence[str], order: str, ties: Sequence[str], width: int | None) -> tuple[DataFrame, int]:
    """A row per bucket: its rows in order, their values, each one's next break inside (0: none) and the last start reached from it; and the greatest bucket."""
    v = F.col(f"`{value}`").cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    key = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    tied = F.struct(*[F.col(f"`{t}`").alias(f"t{n}") for n, t in enumerate(ties)]) if ties else F.lit(0)
    base = rows.select(key.alias("key"), _moment(rows, order).alias("at"), finite.alias("v"), tied.alias("ties"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    each = base.groupBy("key").agg(F.count("at").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    of = each.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.col("n") / (F.col("hi") - F.col("lo") + 1)).alias("density")).first()
    lo, hi = (of["lo"], of["hi"]) if of["lo"] is not None else (0, 0)
    width = width or max(1, math.ceil(BUCKET / (of["density"] or 1.0)))
    # rows without a time are bucket 0, before all others
    bucket = F.coalesce(F.floor((F.col("at") - lo) / width) + 1, F.lit(0)).cast("long")
    packed = base.groupBy("key", bucket.alias("b")).agg(F.sort_array(F.collect_list(F.struct("at", "ties", "v", "row"))).alias("items"))
    packed = packed.withColumn("v", F.transform("items", lambda x: x["v"])).withColumn("pos", F.sequence(F.lit(1), F.size("items")))
    later = F.transform("pos", lambda i: F.coalesce(F.get(F.filter("pos", lambda j: (j > i) & outside(F.get("v", i - 1), F.get("v", j - 1))), F.lit(0)), F.lit(0)))
    packed = packed.withColumn("next", later)
    last = F.aggregate(F.reverse("pos"), F.array().cast("array<int>"), lambda acc, i: F.concat(
        F.array(F.when(F.get("next", i - 1) == 0, i).otherwise(F.get(acc, F.get("next", i - 1) - i - 1))), acc))
    return pinned(packed.withColumn("last", last)), (hi - lo) // width + 1


def _tree(leaves: DataFrame, top: int) -> list[DataFrame]:
    """Level by level, a row per parent with its children's least and greatest values and whether one is missing."""
    level = leaves.select("key", F.col("b").alias("id"), F.array_min("v").alias("low"), F.array_max("v").alias("high"), F.exists("v", lambda x: x.isNull()).alias("gap"))
    out = []
    while True:
        up = pinned(level.groupBy("key", F.floor(F.col("id") / FAN_OUT).alias("id")).agg(
            F.sort_array(F.collect_list(F.struct("id", "low", "high", "gap"))).alias("kids"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("gap").alias("gap")))
        kids = up.select(F.col("key").alias("_key"), F.col("id").alias("_id"), "kids")
        out.append(F.broadcast(kids) if kids.limit(FEW + 1).count() <= FEW else kids)
        level, top = up.drop("kids"), top // FAN_OUT
        if top == 0:
            return out


def _exits(leaves: DataFrame, tree: list[DataFrame], outside, beyond) -> DataFrame:
    """(key, b, pos) of every possible start whose next break lies in a later bucket, and that break's bucket ``tb``, place ``tpos`` and last start ``tlast``."""
    def may_start(i: Column) -> Column:
        here, before = F.get("v", i - 1), F.get("v", i - 2)
        return (F.get("next", i - 1) == 0) & ((i == 1) | here.isNull() | ~here.eqNullSafe(before))

    asked = leaves.select("key", "b", "v", F.explode(F.filter("pos", may_start)).alias("pos")).select("key", "b", "pos", F.get("v", F.col("pos") - 1).alias("ref"), F.col("b").alias("id"), F.lit(None).cast("int").alias("met"))
    for n, kids in enumerate(tree):  # up, to the first level where a later sibling breaks
        parent = F.floor(F.col("id") / FAN_OUT)
        j = asked.join(kids, (F.col("key") == F.col("_key")) & (parent == F.col("_id")), "left")
        hit = F.get(F.filter("kids", lambda k: (k["id"] > F.col("id")) & beyond(F.col("ref"), k)), F.lit(0))["id"]
        j = j.withColumn("hit", F.when(F.col("met").isNull(), hit))
        asked = j.select("key", "b", "pos", "ref", F.when(F.col("met").isNotNull(), F.col("id")).otherwise(F.coalesce("hit", parent)).alias("id"), F.coalesce("met", F.when(F.col("hit").isNotNull(), F.lit(n))).alias("met"))
    asked = asked.where(F.col("met").isNotNull())
    for n in range(len(tree) - 1, 0, -1):  # down, to the first child that breaks
        j = asked.join(tree[n - 1], (F.col("key") == F.col("_key")) & (F.col("id") == F.col("_id")), "left")
        first = F.get(F.filter("kids", lambda k: beyond(F.col("ref"), k)), F.lit(0))["id"]
        asked = j.select("key", "b", "pos", "ref", F.when(F.col("met") >= n, first).otherwise(F.col("id")).alias("id"), "met")
    ends = leaves.select(F.col("key").alias("_key"), F.col("b").alias("tb"), F.col("v").alias("tv"), F.col("pos").alias("places"), F.col("last").alias("lasts"))
    j = asked.join(ends, (F.col("key") == F.col("_key")) & (F.col("id") == F.col("tb")))
    j = j.withColumn("tpos", F.get(F.filter("places", lambda p: outside(F.col("ref"), F.get("tv", p - 1))), F.lit(0)))
    return pinned(j.select("key", "b", "pos", "tb", "tpos", F.get("lasts", F.col("tpos") - 1).alias("tlast")))


def _entries(leaves: DataFrame, exits: DataFrame) -> DataFrame:
    """(key, b, entry): the first start in each bucket that has one, by pointer doubling from each series' first row."""
    firsts = leaves.groupBy("key").agg(F.min("b").alias("b"), F.min_by(F.get("last", F.lit(0)), "b").alias("pos"))
    aimed = exits.select("key", F.col("tb").alias("b"), F.col("tlast").alias("pos")).distinct()
    begun = firsts.withColumn("hit", F.lit(True))
    state = (exits.join(aimed.withColumn("aimed", F.lit(True)), ["key", "b", "pos"], "left").join(begun, ["key", "b", "pos"], "left")
             .where("aimed or hit").select("key", "b", "pos", F.struct("tb", "tpos").alias("to"), F.col("tb").alias("jb"), F.col("tlast").alias("jpos"), F.coalesce("hit", F.lit(False)).alias("hit")))
    state, known = pinned(state), -1
    while (now := state.where("hit").count()) > known:
        known = now
        far = state.select("key", F.col("b").alias("jb"), F.col("pos").alias("jpos"), F.col("jb").alias("kb"), F.col("jpos").alias("kpos"))
        marked = state.where("hit and jb is not null").select("key", F.col("jb").alias("b"), F.col("jpos").alias("pos"), F.lit(True).alias("more"))
        state = pinned(state.join(far, ["key", "jb", "jpos"], "left").join(marked, ["key", "b", "pos"], "left")
                       .select("key", "b", "pos", "to", F.col("kb").alias("jb"), F.col("kpos").alias("jpos"), (F.col("hit") | F.col("more").isNotNull()).alias("hit")))
    return firsts.select("key", "b", F.lit(1).alias("entry")).unionByName(state.where("hit").select("key", F.col("to.tb").alias("b"), F.col("to.tpos").alias("entry")))


def segments_by_breaks(rows: DataFrame, value: str = "ratio", tolerance: float = 5e-4, keys: Sequence[str] = ("code",), order: str = "day", ties: Sequence[str] = (),
                       into: str = "segment", width: int | None = None) -> DataFrame:
    """``rows`` with the number, from 1, of each one's segment in its series (``keys``), as `adjust.change_points` numbers them.

    A segment starts where the value leaves the segment's first value by over ``tolerance``, relative to it. A value that
    is null, NaN or infinite is a segment of its own, and so is what follows it. Rows are ordered by ``order`` (a date, time or number; rows without one
    first), then ``ties``, value and all columns; repeated rows stay rows. Null keys are one series. Other columns may have any
    names and any type that can be ordered; ``into`` replaces a column of that name. An empty table stays empty.

    ``width`` is a bucket's span in days, microseconds or units; without it, about 64 rows of the densest series. A row costs
    as many comparisons as its bucket has rows, so one instant should not repeat often within a series.
    """
    rows = rows.drop(into)

    def outside(ref: Column, x: Column) -> Column:
        return F.coalesce(F.abs(x - ref) > tolerance * F.abs(ref), F.lit(True))

    def beyond(ref: Column, node: Column) -> Column:
        room = tolerance * F.abs(ref)
        return F.coalesce(node["gap"] | (node["high"] - ref > room) | (ref - node["low"] > room), F.lit(True))

    leaves, top = _leaves(rows, value, outside, keys, order, ties, width)
    entries = _entries(leaves, _exits(leaves, _tree(leaves, top), outside, beyond))
    start = F.struct(F.coalesce("entry", F.lit(0)).alias("at"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("counts"))

    def step(acc: Column, i: Column) -> Column:
        met = acc["at"] == i
        k = acc["k"] + F.when(met, 1).otherwise(0)
        return F.struct(F.when(met, F.get("next", i - 1)).otherwise(acc["at"]).alias("at"), k.alias("k"), F.concat(acc["counts"], F.array(k)).alias("counts"))

    counted = leaves.join(entries, ["key", "b"], "left").withColumn("c", F.aggregate("pos", start, step))
    counted = pinned(counted.select("key", "b", F.floor(F.col("b") / FAN_OUT).alias("up"), F.col("c.k").alias("k"), F.col("c.counts").alias("counts")))
    # starts before a bucket: those before its parent, and those of earlier buckets of that parent
    earlier = (Window.unboundedPreceding, -1)
    ups = counted.groupBy("key", "up").agg(F.sum("k").alias("k")).select("key", "up", F.coalesce(F.sum("k").over(Window.partitionBy("key").orderBy("up").rowsBetween(*earlier)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("k").over(Window.partitionBy("key", "up").orderBy("b").rowsBetween(*earlier)), F.lit(0))
    placed = counted.withColumn("within", within).join(ups, ["key", "up"]).select("key", "b", "counts", (F.col("within") + F.col("before")).alias("before"))
    each = leaves.join(placed, ["key", "b"]).select("before", F.explode(F.arrays_zip("items", "counts")).alias("z"))
    return each.select("z.items.row.*", (F.col("before") + F.col("z.counts")).cast("long").alias(into))
