"""Price adjustment: anchors, adjusted prices, revisions, segments and corporate actions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.kernels import asof, fold, islands

PRICES = ("open", "high", "low", "close")


def anchors(factors: DataFrame) -> DataFrame:
    """Per code the factor that is latest and earliest in time, not the greatest (Q1)."""
    return factors.groupBy("code").agg(F.max_by("factor", "day").alias("latest"), F.min_by("factor", "day").alias("earliest"))


def normalize_factors(factors: DataFrame) -> DataFrame:
    """Six-digit codes, positive factors, the last one per day (Q4)."""
    bare = factors.withColumn("code", F.regexp_extract("code", r"(\d{6})", 1)).where((F.col("code") != "") & (F.col("factor") > 0))
    return bare.groupBy("code", F.to_date("time").alias("day")).agg(F.max_by("factor", "time").alias("factor"))


def factor_on_day(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """``factor`` in force on each bar's day."""
    return asof(bars, factors, ["code"], "day", "day", ["factor"]) if "factor" not in bars.columns else bars


def adjust(bars: DataFrame, factors: DataFrame, prices: Sequence[str] = PRICES) -> DataFrame:
    """front = raw * f / latest, back = raw * f / earliest; null without an anchor (Q2). Anchors are global, never of the batch."""
    rows = factor_on_day(bars, factors.withColumnRenamed("day", "_fd").select("code", F.col("_fd").alias("day"), "factor")).join(anchors(factors), "code", "left")
    out = {f"{p}_front": F.col(p) * F.col("factor") / F.col("latest") for p in prices} | {f"{p}_back": F.col(p) * F.col("factor") / F.col("earliest") for p in prices}
    return rows.withColumns(out)


def restore_raw(adjusted: DataFrame, factors: DataFrame, prices: Sequence[str] = PRICES) -> DataFrame:
    """raw = front * latest / f; rows whose factor is missing or not positive are marked ``invalid`` (Q3)."""
    rows = factor_on_day(adjusted, factors).join(anchors(factors), "code", "left")
    bad = ~F.coalesce((F.col("factor") > 0) & (F.col("latest") > 0), F.lit(False))
    return rows.withColumns({p: F.when(~bad, F.col(f"{p}_front") * F.col("latest") / F.col("factor")) for p in prices}).withColumn("invalid", bad)


def revisions(incoming: DataFrame, baseline: DataFrame, as_of, epsilon: float = 1e-9) -> DataFrame:
    """Each (code, day) as new, unchanged or revised against a baseline, with absolute and relative change (Q5).

    Rows after ``as_of`` are left out. Keys seen twice or factors that are not
    positive numbers raise when the result is read.
    """
    seen = incoming.where(F.col("day") <= F.lit(as_of).cast("date"))
    checked = seen.groupBy("code", "day").agg(F.count("*").alias("_n"), F.first("factor").alias("factor"))
    bad = (F.col("_n") > 1) | ~F.coalesce(F.col("factor") > 0, F.lit(False)) | F.isnan("factor")
    rows = checked.withColumn("factor", F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("bad factor"), "code", "day")).cast("double")).otherwise(F.col("factor"))).drop("_n")
    joined = rows.join(baseline.select("code", "day", F.col("factor").alias("old")), ["code", "day"], "left")
    delta = F.abs(F.col("factor") - F.col("old"))
    return joined.withColumn("state", F.when(F.col("old").isNull(), "new").when(delta <= epsilon, "unchanged").otherwise("revised")).withColumn("abs_delta", delta).withColumn("rel_delta", delta / F.abs("old"))


def observe(ledger: DataFrame, incoming: DataFrame, run: str, abs_tol: float = 1e-9, rel_tol: float = 1e-6) -> DataFrame:
    """Rows to append to the observation ledger: revision 1 for new keys, +1 where the value moved beyond tolerance.

    ``ledger``: code, day, factor, revision_no. ``alert`` marks changes of known keys.
    """
    latest = ledger.groupBy("code", "day").agg(F.max(F.struct("revision_no", "factor")).alias("l")).select("code", "day", F.col("l.revision_no").alias("_rev"), F.col("l.factor").alias("_old"))
    rows = incoming.join(latest, ["code", "day"], "left")
    delta = F.abs(F.col("factor") - F.col("_old"))
    moved = F.col("_old").isNotNull() & (delta > abs_tol) & (delta > rel_tol * F.abs("_old"))
    return (rows.where(F.col("_old").isNull() | moved).select("code", "day", "factor", (F.coalesce("_rev", F.lit(0)) + 1).alias("revision_no"), F.col("_old").isNotNull().alias("alert"),
                                                            F.sha2(F.to_json(F.array("code", F.col("day").cast("string"), F.col("factor").cast("string"))), 256).alias("observation_id")).withColumn("run", F.lit(run)))


def factor_events(factors: DataFrame, known_codes: DataFrame | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Days on which a code's factor differs from the one before; codes seen for the first time give none (Q6)."""
    w = Window.partitionBy("code").orderBy("day")
    rows = factors.withColumn("previous", F.lag("factor").over(w)).where(F.abs(F.col("factor") - F.col("previous")) > tolerance)
    return rows if known_codes is None else rows.join(known_codes.select("code").distinct(), "code", "left_semi")


def dividend_triggers(dividends: DataFrame, as_of, queued: DataFrame, applied: DataFrame) -> DataFrame:
    """Trigger events of implemented dividends, not queued yet and not applied with the same payload."""
    payload = F.sha2(F.to_json(F.array("code", F.col("ex_date").cast("string"), F.col("cash").cast("string"), F.col("stock").cast("string"))), 256)
    ids = F.sha2(F.concat_ws("|", "code", F.col("ex_date").cast("string")), 256)
    rows = dividends.where(F.col("proc") == "实施").withColumn("payload_hash", payload).withColumn("trigger_id", ids)
    one = rows.groupBy("trigger_id").agg(F.min_by(F.struct("code", "ex_date", "payload_hash"), F.struct("ann_date", "payload_hash")).alias("r")).select("trigger_id", "r.*")
    state = F.when(F.col("ex_date") > F.lit(as_of).cast("date"), "scheduled").otherwise("pending")
    return one.withColumn("state", state).join(queued, "trigger_id", "left_anti").join(applied.select("trigger_id", "payload_hash"), ["trigger_id", "payload_hash"], "left_anti")


def staging_violations(staged: DataFrame, kind: str = "ratio", relative: float = 1e-3, tick: float = 0.01) -> DataFrame:
    """Per code: missing, doubled, not positive and inconsistently scaled rows of a fresh daily table (Q8)."""
    ratio = [F.col(f"{p}_front") / F.col(p) for p in PRICES]
    gap = [F.col(f"{p}_front") - F.col(p) for p in PRICES]
    spread = F.greatest(*ratio) / F.least(*ratio) - 1 if kind == "ratio" else F.greatest(*gap) - F.least(*gap)
    limit = relative if kind == "ratio" else tick
    nulls = sum((F.col(f"{p}_front").isNull().cast("int") for p in PRICES[1:]), F.col("open_front").isNull().cast("int"))
    keyed = staged.withColumn("_k", F.count("*").over(Window.partitionBy("code", "day")))
    return keyed.groupBy("code").agg(F.count_if(nulls > 0).alias("missing"), F.count_if(F.col("_k") > 1).alias("doubled"), F.count_if(F.least(*[F.col(f"{p}_front") for p in PRICES]) <= 0).alias("not_positive"),
                                     F.count_if((nulls == 0) & (spread > limit)).alias("inconsistent"))


def change_points(rows: DataFrame, value: str = "ratio", tolerance: float = 5e-4) -> DataFrame:
    """Segments of a series: a new one starts where the value leaves the segment's first value by over ``tolerance``.

    The reference value depends on where the last segment began, so this is a fold.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v, seg = frame[value].to_numpy(float), np.zeros(len(frame), np.int64)
        ref, k = np.nan, 0
        for i, x in enumerate(v):
            if not abs(x - ref) <= tolerance * abs(ref):  # also right at zero; a missing value starts a segment
                ref, k = x, k + 1
            seg[i] = k
        frame["segment"] = seg
        return frame

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", segment long"
    return fold(rows, ["code"], ["day"], run, schema)


def ratio_segments(rows: DataFrame, value: str = "ratio", tolerance: float = 5e-4) -> DataFrame:
    """Per segment: first and last day, size, median ratio, dispersion (Q10)."""
    return segment_summary(change_points(rows, value, tolerance), value)


def segment_summary(seg: DataFrame, value: str = "ratio", time: str = "day") -> DataFrame:
    """Per numbered segment: first and last day, size, median, dispersion (null where the least value is 0) (Q10)."""
    return seg.groupBy("code", "segment").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.percentile(value, 0.5).alias("ratio"),
                                              (F.max(value) / F.nullif(F.min(value), F.lit(0)) - 1).alias("dispersion"))


def unexplained_boundaries(segments: DataFrame, ex_dates: DataFrame) -> DataFrame:
    """Segment starts, but the first, that are no ex-date (Q11)."""
    return segments.where("segment > 1").select("code", F.col("start").alias("day")).join(ex_dates.select("code", "day"), ["code", "day"], "left_anti")


def apply_segments(bars: DataFrame, segments: DataFrame, prices: Sequence[str] = PRICES) -> DataFrame:
    """Multiply adjusted prices by the ratio of the segment that covers the day (Q12)."""
    got = asof(bars, segments.select("code", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("ratio").alias("_r")), ["code"], "day", "_s", ["_e", "_r"])
    k = F.when(F.col("day") <= F.col("_e"), F.col("_r")).otherwise(F.lit(1.0))
    return got.withColumns({f"{p}_front": F.col(f"{p}_front") * k for p in prices}).drop("_e", "_r")


def golden_check(fresh: DataFrame, stored: DataFrame, segments: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Per code, the largest deviation of fresh / stored from its segment's ratio (Q13)."""
    both = fresh.select("code", "day", F.col("close_front").alias("_f")).join(stored.select("code", "day", F.col("close_front").alias("_s")), ["code", "day"])
    got = asof(both, segments.select("code", F.col("start").alias("_t"), "ratio"), ["code"], "day", "_t", ["ratio"])
    dev = F.abs(F.col("_f") / F.col("_s") / F.col("ratio") - 1)
    return got.groupBy("code").agg(F.max(dev).alias("deviation"), F.count("*").alias("samples")).withColumn("ok", F.col("deviation") <= tolerance)


def diff_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per column: cells that differ by number, cells null on one side only, largest differences."""
    j = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values]).join(b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values]), list(keys))
    cells = j.select(F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"_a_{v}").alias("x"), F.col(f"_b_{v}").alias("y")) for v in values])).alias("c")).select("c.*")
    gap = F.abs(F.col("x") - F.col("y"))
    return cells.groupBy("column").agg(F.count_if(gap > tolerance).alias("different"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("one_null"), F.max(gap).alias("max_abs"),
                                       F.max(gap / F.abs(F.when(F.col("y") != 0, F.col("y")))).alias("max_rel"))


def changed_rows(new: DataFrame, old: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Rows that are new, or differ from the stored row in any compared column, nulls being equal."""
    values = [c for c in new.columns if c not in keys and c not in ignore]
    j = new.join(old.select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values], F.lit(True).alias("_known")), list(keys), "left")
    same = F.coalesce(F.col("_known"), F.lit(False))
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_o_{v}"))
    return j.where(~same).select(*new.columns)


def split_merge_events(bars: DataFrame, previous_close: str = "prev_close") -> DataFrame:
    """Per day, close before over quoted previous close: merge, none, cash or split, with a snapped ratio (Q16)."""
    w = Window.partitionBy("code").orderBy("day")
    ratio = F.lag("close").over(w) / F.when(F.col(previous_close) > 0, F.col(previous_close))
    rows = bars.withColumn("ratio", ratio).where(F.col("ratio").isNotNull())
    kind = F.when(F.col("ratio") < 0.99, "merge").when(F.col("ratio") <= 1.01, "none").when(F.col("ratio") < 1.10, "cash").otherwise("split")
    snapped = F.when((F.col("ratio") < 0.99) & (F.abs(F.col("ratio") / 0.5 - 1) <= 0.005), 0.5).otherwise(F.col("ratio"))
    return rows.select("code", "day", "ratio", kind.alias("kind"), snapped.alias("snapped"))


def halted_days(pool: DataFrame, days: DataFrame, bars: DataFrame) -> DataFrame:
    """(code, day) in the pool on a trading day without a bar (Q17): the pool's own span, not every pair of code and day."""
    cal = days.select("day").distinct()
    spans = pool.select("code", "list_date", F.coalesce("delist_date", F.lit("9999-12-31").cast("date")).alias("_end"), F.explode(F.sequence(F.year("list_date"), F.least(F.year(F.coalesce("delist_date", F.current_date())), F.year(F.current_date())))).alias("_y"))
    expected = spans.join(cal.withColumn("_y", F.year("day")), "_y").where((F.col("day") >= F.col("list_date")) & (F.col("day") < F.col("_end"))).select("code", "day")
    return expected.join(bars.select("code", "day"), ["code", "day"], "left_anti")


def actions_by_ex_date(dividends: DataFrame) -> DataFrame:
    """Implemented actions; cash before tax first, the older field as fallback (Q18)."""
    return dividends.where(F.col("proc") == "实施").select("code", "ex_date", F.coalesce("cash_before_tax", "cash").alias("cash"), F.coalesce("stock", F.lit(0.0)).alias("stock"))


def fill_eps(target: DataFrame, income: DataFrame, mark: str = "income_statement") -> DataFrame:
    """Missing eps of (code, end_date) from the latest announced statement that has it; announced at the later of both days (Q19).

    Rows whose new (code, end_date, ann_date) is taken already stay as they are.
    """
    best = income.where(F.col("eps").isNotNull()).groupBy("code", "end_date").agg(F.max(F.struct("ann_date", "eps")).alias("i"))
    j = target.join(best, ["code", "end_date"], "left")
    fill = F.col("eps").isNull() & F.col("i").isNotNull()
    moved = F.when(fill, F.greatest("ann_date", F.col("i.ann_date"))).otherwise(F.col("ann_date"))
    taken = target.select("code", "end_date", F.col("ann_date").alias("_new"), F.lit(True).alias("_taken")).distinct()
    j = j.withColumn("_new", moved).join(taken, ["code", "end_date", "_new"], "left")
    use = fill & (F.col("_taken").isNull() | (F.col("_new") == F.col("ann_date")))
    filled = {"eps": F.when(use, F.col("i.eps")).otherwise(F.col("eps")), "eps_source": F.when(use, mark), "ann_date": F.when(use, F.col("_new")).otherwise(F.col("ann_date"))}
    return j.withColumns(filled).select(*target.columns, "eps_source")


def risk_flags(bars: DataFrame, st_days: DataFrame, low_value: DataFrame) -> DataFrame:
    """Delisting risk by price (close below 1), market value or both (Q22). The other tables are (code, day) sets."""
    j = bars.join(st_days.select("code", "day", F.lit(True).alias("is_st")), ["code", "day"], "left").join(low_value.select("code", "day", F.lit(True).alias("_mv")), ["code", "day"], "left")
    price, value = F.col("close") < 1, F.coalesce(F.col("_mv"), F.lit(False))
    return j.withColumn("is_st", F.coalesce("is_st", F.lit(False))).withColumn("source", F.when(price & value, "both").when(price, "price").when(value, "market_cap").otherwise("none")).drop("_mv")


def only_source(df: DataFrame, authority: str, source: str = "data_source") -> DataFrame:
    """Rows of the authoritative source (Q23)."""
    return df.where(F.col(source) == authority)


def price_moves(bars: DataFrame, threshold: float, band: float = 0.003, previous_close: str = "prev_close") -> DataFrame:
    """Jumps of the quoted previous close against the close before; ``edge`` marks those near the threshold (Q17)."""
    w = Window.partitionBy("code").orderBy("day")
    gap = F.abs(F.col(previous_close) / F.lag("close").over(w) - 1)
    return bars.withColumn("gap", gap).where(F.col("gap") > threshold - band).select("code", "day", "gap", (F.col("gap") <= threshold + band).alias("edge"))


def chained_change(bars: DataFrame, official: Column | None = None) -> DataFrame:
    """Percent change: official unless absurd, then from adjusted, quoted, and raw previous closes."""
    w = Window.partitionBy("code").orderBy("day")
    front = (F.col("close_front") / F.lag("close_front").over(w) - 1) * 100 if "close_front" in bars.columns else F.lit(None).cast("double")
    quoted = (F.col("close") / F.when(F.col("prev_close") != 0, F.col("prev_close")) - 1) * 100 if "prev_close" in bars.columns else F.lit(None).cast("double")
    raw = (F.col("close") / F.lag("close").over(w) - 1) * 100
    derived = F.coalesce(front, quoted, raw)
    said = official if official is not None else F.lit(None).cast("double")
    return bars.withColumn("_d", derived).withColumn("pct_chg", F.when(said.isNull(), F.col("_d")).when((F.abs(said) > 200) & (F.abs(F.col("_d")) < 30), F.col("_d")).when(F.abs(said) > 200, F.lit(None)).otherwise(said)).drop("_d")


def factor_runs(factors: DataFrame, spike_low: float = 0.5, spike_high: float = 2.0) -> DataFrame:
    """Runs of equal factors as segment starts; one-day spikes against the run before are dropped."""
    seg = islands(factors, ["code"], ["day"], F.col("factor")).groupBy("code", "segment").agg(F.min("day").alias("day"), F.max("day").alias("last_day"), F.first("factor").alias("factor"))
    w = Window.partitionBy("code").orderBy("day")
    jump = F.col("factor") / F.lag("factor").over(w)
    return seg.withColumn("_j", jump).where(~F.coalesce((F.col("day") == F.col("last_day")) & ((F.col("_j") < spike_low) | (F.col("_j") > spike_high)), F.lit(False))).drop("_j")


def write_front(stored: DataFrame, fresh: DataFrame, prices: Sequence[str] = PRICES) -> DataFrame:
    """``stored`` with the adjusted columns of ``fresh`` where its (code, day) has a fresh row; nothing else changes (Q9)."""
    new = fresh.select("code", "day", *[F.col(f"{p}_front").alias(f"_{p}") for p in prices], F.lit(True).alias("_fresh"))
    joined = stored.join(new, ["code", "day"], "left")
    return joined.withColumns({f"{p}_front": F.when(F.col("_fresh"), F.col(f"_{p}")).otherwise(F.col(f"{p}_front")) for p in prices}).select(*stored.columns)


def post_checks(before: DataFrame, after: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Violations per check after a rewrite: rows kept, price relation, one scale per row, returns as before but at scale changes (Q14)."""
    w = Window.partitionBy("code").orderBy("day")
    scale = [F.col(f"{p}_front") / F.col(p) for p in PRICES]
    mean = (scale[0] + scale[1] + scale[2] + scale[3]) / 4
    rows = after.withColumn("_s", mean).withColumn("_r", F.col("close_front") / F.lag("close_front").over(w)).withColumn("_q", F.col("close") / F.lag("close").over(w)).withColumn("_same", F.abs(F.col("_s") / F.lag("_s").over(w) - 1) <= tolerance)
    counts = rows.agg(F.count_if((F.col("high_front") < F.greatest("open_front", "low_front", "close_front") - 1e-9) | (F.col("low_front") > F.least("open_front", "high_front", "close_front") + 1e-9)).alias("PriceRelation"),
                      F.count_if(F.greatest(*[F.abs(x / mean - 1) for x in scale]) > tolerance).alias("ScaleConsistency"),
                      F.count_if(F.col("_same") & (F.abs(F.col("_r") / F.col("_q") - 1) > 2 * tolerance)).alias("ReturnConsistency"))
    lost = before.select("code", "day").join(after.select("code", "day"), ["code", "day"], "left_anti").agg(F.count("*").alias("RowConservation"))
    both = counts.crossJoin(lost)  # one row each
    names = ("PriceRelation", "ScaleConsistency", "ReturnConsistency", "RowConservation")
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("count")) for n in names])).alias("r")).select("r.*")


def grid_coverage(minutes: DataFrame, grid: DataFrame) -> DataFrame:
    """Per code and day: expected, present, missing and illegal minute bars (Q15). ``grid``: day, minute."""
    have = minutes.select("code", F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute")).distinct()
    legal = have.join(grid.select("day", "minute", F.lit(1).alias("_g")), ["day", "minute"], "left")
    size = grid.groupBy("day").agg(F.count("*").alias("expected"))
    per = legal.groupBy("code", "day").agg(F.count("_g").alias("present"), F.count_if(F.col("_g").isNull()).alias("illegal"))
    return per.join(size, "day").withColumn("missing", F.col("expected") - F.col("present")).select("code", "day", "expected", "present", "missing", "illegal")
