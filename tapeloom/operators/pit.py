"""Point-in-time lookups: what was known on a day, and who belonged where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.kernels import asof, latest_per_key


def _day(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


def known_reports(reports: DataFrame, as_of, period_from=None, period_to=None, months: Sequence[int] = (3, 6, 9, 12)) -> DataFrame:
    """Report rows announced by ``as_of``, by period and by the period's last month."""
    out = reports.where((F.col("ann_date") <= _day(as_of)) & F.month("end_date").isin(list(months)))
    out = out if period_from is None else out.where(F.col("end_date") >= _day(period_from))
    return out if period_to is None else out.where(F.col("end_date") <= _day(period_to))


def latest_report(reports: DataFrame, as_of, keys: Sequence[str] = ("code",), columns: Sequence[str] | None = None, by_period: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """The newest report known on a day: by announcement, then period (``by_period`` turns them around) (A1)."""
    order = ["end_date", "ann_date"] if by_period else ["ann_date", "end_date"]
    return latest_per_key(known_reports(reports, as_of), keys, [*order, *ties], columns)


def latest_value(reports: DataFrame, as_of, value: str, keys: Sequence[str] = ("code",), ties: Sequence[str] = ()) -> DataFrame:
    """The newest non-null figure by (period, announcement) (A2)."""
    rows = known_reports(reports, as_of).where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct("end_date", "ann_date", *ties)).alias(value))


def valuation(valuations: DataFrame, bars: DataFrame, shares: DataFrame, as_of) -> DataFrame:
    """Per code: latest valuation, latest close and latest known shares; floating shares fall back to value / close."""
    day = _day(as_of)
    v = valuations.where(F.col("day") <= day).groupBy("code").agg(F.max_by("circ_mv", "day").alias("circ_mv"), F.max("day").alias("valuation_day"))
    c = bars.where(F.col("day") <= day).groupBy("code").agg(F.max_by("close", "day").alias("close"))
    s = shares.where(F.col("ann_date") <= day).groupBy("code").agg(F.max_by("free_share", F.struct("ann_date", "end_date", "free_share")).alias("free_share"))
    return v.join(c, "code", "left").join(s, "code", "left").withColumn("a_floats", F.coalesce("free_share", F.col("circ_mv") / F.when(F.col("close") != 0, F.col("close"))))


OPERATORS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__"}


def screen(df: DataFrame, filters: Sequence[tuple[str, str, object]] = (), order_by: Sequence[tuple[str, bool]] = (), limit: int | None = None) -> DataFrame:
    """filter / order / limit of a valuation query; unknown fields are skipped, the first order key is the main one."""
    for name, op, value in filters:
        if name in df.columns:
            df = df.where(getattr(F.col(name), OPERATORS[op])(value))
    keys = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order_by if c in df.columns]
    df = df.orderBy(*keys) if keys else df
    return df if limit is None else df.limit(limit)


def statuses(codes: DataFrame, snapshot: DataFrame, strict: bool = False) -> DataFrame:
    """st, halt and delisted of each code from the day's cross-section."""
    risk = F.col("delisting_source").isin("price", "both") if strict else F.coalesce(F.col("is_delisting_risk"), F.lit(False))
    rows = codes.select("code").distinct().join(snapshot.withColumn("_on", F.lit(True)), "code", "left")
    return rows.select("code", (F.coalesce(F.col("is_st"), F.lit(False)) | F.coalesce(risk, F.lit(False))).alias("st"),
                       F.coalesce((F.col("suspended") == 1) | (F.col("volume") == 0), F.lit(False)).alias("halt"), F.col("_on").isNull().alias("delisted"))


def drop_by_status(codes: DataFrame, snapshot: DataFrame, kinds: Sequence[str] = ("st", "halt", "delisted"), strict: bool = False) -> DataFrame:
    bad = F.lit(False)
    for k in kinds:
        bad = bad | F.col(k)
    return codes.join(statuses(codes, snapshot, strict).where(bad), "code", "left_anti")


def traded_universe(bars: DataFrame, as_of, delisted: DataFrame | None = None, exclude: Sequence[str] = ("920", "4", "8")) -> DataFrame:
    """Codes traded on the last day up to ``as_of``, without excluded prefixes and codes delisted by then."""
    upto = bars.where(F.col("day") <= _day(as_of)).select("code", "day")
    last = upto.agg(F.max("day").alias("day"))
    rows = upto.join(F.broadcast(last), "day").select("code").distinct()  # one row is broadcast
    for p in exclude:
        rows = rows.where(~F.col("code").startswith(p))
    return rows if delisted is None else rows.join(delisted.where(F.col("delist_date") <= _day(as_of)), "code", "left_anti")


def listed_universe(basic: DataFrame, bars: DataFrame, as_of, kind: str | None = None) -> DataFrame:
    """Listed, not delisted, with at least one bar by the day."""
    day = _day(as_of)
    rows = basic.where((F.col("list_date") <= day) & (F.col("delist_date").isNull() | (F.col("delist_date") > day)))
    rows = rows if kind is None else rows.where((F.col("kind") == kind) & ~((F.lit(kind) == "equity") & F.coalesce(F.col("is_cross_border"), F.lit(False))))
    return rows.join(bars.where(F.col("day") <= day), "code", "left_semi")


def listed_for(df: DataFrame, first_days: DataFrame, as_of, days: int) -> DataFrame:
    """Codes listed for at least so many natural days."""
    return df.join(first_days.where(F.datediff(_day(as_of), F.col("list_date")) >= days), "code", "left_semi")


def without_recent_halts(df: DataFrame, bars: DataFrame, as_of, n: int) -> DataFrame:
    """Drop codes halted on any of their last ``n`` rows."""
    w = Window.partitionBy("code").orderBy(F.col("day").desc())
    recent = bars.where(F.col("day") <= _day(as_of)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return df.join(recent.where(F.col("volume") == 0), "code", "left_anti")


def membership_at(members: DataFrame, points: DataFrame, time: str, on_ambiguous: str = "flag") -> DataFrame:
    """Industry at a time: from <= t and (to is null or to >= t).

    Several industries at once give a null industry with ``ambiguous``, or an
    error if ``on_ambiguous`` is "error"; none gives null. Points and the
    starts and ends of memberships go through one union and one window by code;
    only an industry's name is joined, by code and number.
    """
    start, end = F.col("effective_from"), F.col("effective_to")
    spans = members.where(F.col("code").isNotNull() & F.col("industry").isNotNull() & start.isNotNull() & (end.isNull() | (end >= start)))
    spans = spans.select("code", "industry", start.alias("_from"), end.alias("_to"))
    # intervals of one industry that meet become one, so that each open industry counts once
    w = Window.partitionBy("code", "industry").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    apart = ~F.coalesce(F.max(F.col("_to").isNull()).over(w), F.lit(False)) & F.coalesce(F.col("_from") > F.max("_to").over(w), F.lit(True))
    merged = (spans.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_id", F.dense_rank().over(Window.partitionBy("code").orderBy("industry")).cast("long"))
              .groupBy("code", "industry", "_id", "_run").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max(F.col("_to").isNull()).alias("_open")))
    opened = merged.select("code", F.col("_from").alias("_t"), F.lit(0).alias("_side"), F.lit(1).alias("_n"), "_id")
    closed = merged.where(~F.col("_open")).select("code", F.col("_to").alias("_t"), F.lit(2).alias("_side"), F.lit(-1).alias("_n"), (-F.col("_id")).alias("_id"))
    own = points.select("*", F.col(time).alias("_t"), F.lit(1).alias("_side"))
    # the number of open industries, and the sum of their ids, which is the id where one is open
    w = Window.partitionBy("code").orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    state = (own.unionByName(opened.unionByName(closed), allowMissingColumns=True)
             .withColumn("_n", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_id", F.sum("_id").over(w)).where("_side = 1")
             .withColumn("_id", F.when(F.col("_n") == 1, F.col("_id"))))
    names = merged.select("code", "_id", F.col("industry").alias("_low")).distinct()
    out = state.join(names, ["code", "_id"], "left")
    several = F.col("_n") > 1
    if on_ambiguous == "error":
        industry = F.when(several, F.raise_error(F.concat(F.lit("several industries: "), F.col("code"))).cast("string")).otherwise(F.col("_low"))
    else:
        industry = F.when(~several, F.col("_low"))
    return out.select(*points.columns, industry.alias("industry"), several.alias("ambiguous"))


def overlaps(intervals: DataFrame, by: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Per interval, how it meets the earlier ones of its key: ``overlap`` or ``touch``.

    A running maximum of ends finds them in one sort, without pairing intervals.
    """
    w = Window.partitionBy(*by).orderBy(F.col(start), F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))).rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))).over(w)
    return intervals.withColumn("meets", F.when(until > F.col(start), "overlap").when(until == F.col(start), "touch"))


def snapshot_completeness(constituents: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per index and day: counts and complete / partial / invalid / unknown (A3)."""
    stats = constituents.groupBy("index_code", "day").agg(
        F.count_distinct("code").alias("n_codes"), (F.count("*") - F.count_distinct("code")).alias("n_duplicates"), F.count_if(F.col("weight") < 0).alias("n_negative"),
        F.count_if(~F.coalesce(F.col("code").rlike(r"^\d{6}$"), F.lit(False))).alias("n_bad_codes"))
    stats = stats.join(expected, "index_code", "left") if expected is not None else stats.withColumn("expected", F.lit(None).cast("long"))
    wrong = F.col("n_duplicates") + F.col("n_negative") + F.col("n_bad_codes") > 0
    return stats.withColumn("status", F.when(wrong, "invalid").when(F.col("expected").isNull(), "unknown").when(F.col("n_codes") >= F.col("expected"), "complete").otherwise("partial"))


def constituents_at(constituents: DataFrame, meta: DataFrame, as_of) -> DataFrame:
    """Rows of each index's newest complete snapshot by the day (A4)."""
    best = meta.where((F.col("status") == "complete") & (F.col("day") <= _day(as_of))).groupBy("index_code").agg(F.max("day").alias("day"))
    return constituents.join(best, ["index_code", "day"]).dropDuplicates(["index_code", "code"])


def constituent_quality(constituents: DataFrame, meta: DataFrame) -> DataFrame:
    """Completeness with the sum of weights (A5)."""
    return meta.join(constituents.groupBy("index_code", "day").agg(F.sum("weight").alias("weight")), ["index_code", "day"], "left")


def membership_quality(members: DataFrame, classification: DataFrame) -> DataFrame:
    """One row of totals for an interval table."""
    met = overlaps(members, ["code"])
    open_ = members.where(F.col("effective_to").isNull()).groupBy("code").count().where("count > 1")
    orphans = members.join(classification, "industry", "left_anti")
    return (met.agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"), F.count_if(F.col("meets") == "overlap").alias("overlaps"), F.count_if(F.col("meets") == "touch").alias("touching"),
                    F.count_if(F.col("effective_from") > F.col("effective_to")).alias("bad_ranges"))
            .crossJoin(open_.agg(F.count("*").alias("multi_current"))).crossJoin(orphans.agg(F.count("*").alias("orphans"))))  # three one-row tables


def with_valuation(bars: DataFrame, valuations: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fill null fields of bars from the last valuation row."""
    got = asof(bars, valuations.select("code", F.col("day").alias("_vd"), *[F.col(f).alias(f"_{f}") for f in fields]), ["code"], "day", "_vd", [f"_{f}" for f in fields])
    return got.withColumns({f: F.coalesce(F.col(f), F.col(f"_{f}")) if f in bars.columns else F.col(f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields])


def security_metadata(stocks: DataFrame, funds: DataFrame, bars: DataFrame) -> DataFrame:
    """Stocks and funds together; a missing list date falls back to the first bar, with its source."""
    first = bars.groupBy("code").agg(F.min("day").alias("_first"))
    both = stocks.withColumn("asset", F.lit("stock")).unionByName(funds.withColumn("asset", F.lit("etf")), allowMissingColumns=True).join(first, "code", "left")
    source = F.when(F.col("list_date").isNotNull(), "metadata").when(F.col("_first").isNotNull(), "first_bar")
    return both.withColumn("list_date_source", source).withColumn("list_date", F.coalesce("list_date", "_first")).drop("_first")


FUNDAMENTAL_TABLES = ("valuation", "balance_statement", "income_statement", "cashflow_statement", "growth_ability", "profit_ability", "eps", "operating_ability", "debt_paying_ability")
WITHOUT_SOURCE = ("operating_ability", "debt_paying_ability")


def fundamentals(tables: dict[str, DataFrame], name: str, as_of, codes: DataFrame | None = None, fields: Sequence[str] | None = None, empty_schema: str = "code string, end_date date, ann_date date") -> DataFrame:
    """One entry for the fundamental tables (P26): unknown names read the valuation; tables without a source are empty."""
    name = name if name in FUNDAMENTAL_TABLES else "valuation"
    if name in WITHOUT_SOURCE or name not in tables:
        return next(iter(tables.values())).sparkSession.createDataFrame([], empty_schema)
    rows = tables[name]
    rows = latest_per_key(rows.where(F.col("day") <= _day(as_of)), ["code"], ["day"]) if name == "valuation" else known_reports(rows, as_of)
    rows = rows if codes is None else rows.join(codes.select("code"), "code", "left_semi")
    keys = [c for c in ("code", "day", "end_date", "ann_date") if c in rows.columns]
    return rows if fields is None else rows.select(*keys, *[F.col(f) if f in rows.columns else F.lit(None).cast("double").alias(f) for f in fields])


def changed_stable_absent(universe: DataFrame, factors: DataFrame, start, end) -> DataFrame:
    """Each code as changed, stable or without records in a window of factors (U4)."""
    w = Window.partitionBy("code").orderBy("day")
    moved = factors.withColumn("_p", F.lag("factor").over(w)).where(F.col("day").between(_day(start), _day(end)))
    state = moved.groupBy("code").agg(F.max((F.col("_p").isNotNull() & (F.col("_p") != F.col("factor"))).cast("int")).alias("_c"))
    return universe.select("code").distinct().join(state, "code", "left").select("code", F.when(F.col("_c").isNull(), "absent").when(F.col("_c") == 1, "changed").otherwise("stable").alias("state"))


def last_day_codes(bars: DataFrame, condition: Column | None = None, pattern: str | None = None) -> DataFrame:
    """Distinct codes of the table's last day by a predicate or a code pattern."""
    last = bars.agg(F.max("day").alias("day"))
    rows = bars.join(F.broadcast(last), "day")  # one row
    rows = rows if condition is None else rows.where(condition)
    rows = rows if pattern is None else rows.where(F.col("code").rlike(pattern))
    return rows.select("code").distinct()


def events_by_type(events: DataFrame, kind: str, start=None, end=None, codes: DataFrame | None = None) -> DataFrame:
    """Events of a type and span in a full order, missing effective days last."""
    rows = events.where(F.col("event_type") == kind)
    rows = rows if start is None else rows.where(F.col("effective_date") >= _day(start))
    rows = rows if end is None else rows.where(F.col("effective_date") <= _day(end))
    rows = rows if codes is None else rows.join(codes.select("code"), "code", "left_semi")
    return rows.orderBy(F.col("effective_date").asc_nulls_last(), F.col("source_key"))
