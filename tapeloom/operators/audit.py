"""Data-quality audits: all counts of a table in one aggregation, then one row per check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.kernels import asof, spare
from tapeloom.operators.validate import STEP_MS

PRICES = ("open", "high", "low", "close")


def count_checks(df: DataFrame, table: str, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """(check, table, count, severity) for predicates; one pass over the table however many there are."""
    named = {f"c{k}": name for k, name in enumerate(checks)}
    counts = df.agg(*[F.count_if(F.coalesce(checks[name][0], F.lit(False))).alias(c) for c, name in named.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(c).alias("count"), F.lit(checks[name][1]).alias("severity")) for c, name in named.items()])
    return counts.select(F.explode(rows).alias("r")).select("r.check", F.lit(table).alias("table"), "r.count", "r.severity")


def bar_checks(now=None) -> dict[str, tuple[Column, str]]:
    """D2, D3, D8 for a bar table."""
    o, h, low, c = (F.col(x) for x in PRICES)
    ratio = F.col("amount") / F.when(c * F.col("volume") != 0, c * F.col("volume"))
    out = {"CodeFormat": (~F.col("code").rlike(r"^\d{6}$"), "error"), "RequiredValueNull": (F.col("code").isNull() | F.col("day").isNull() | c.isNull(), "error"),
           "RawPriceOHLC": ((h < F.greatest(o, low, c) - 1e-9) | (low > F.least(o, h, c) + 1e-9), "error"), "VolumeAmountNegative": ((F.col("volume") < 0) | (F.col("amount") < 0), "error"),
           "UnitConsistency": (~ratio.between(0.5, 2.0), "warn"), "NotPositive": (c <= 0, "error")}
    return out | ({"FutureTimestamp": (F.col("day") > F.lit(now).cast("date"), "error")} if now else {})


def adjustment_checks(family: str, tolerance: float = 0.02) -> dict[str, tuple[Column, str]]:
    """D4."""
    adjusted = [F.col(f"{p}_{family}") for p in PRICES]
    missing = sum((a.isNull().cast("int") for a in adjusted[1:]), adjusted[0].isNull().cast("int"))
    factor = [a / F.col(p) for a, p in zip(adjusted, PRICES)]
    mean = (factor[0] + factor[1] + factor[2] + factor[3]) / 4
    return {f"AdjustmentCompleteness_{family}": ((missing > 0) & (missing < 4), "error"), f"AdjustmentCoverage_{family}": (missing == 4, "warn"),
            f"AdjustmentFactorConsistency_{family}": (F.greatest(*[F.abs(f / mean - 1) for f in factor]) > tolerance, "error")}


def dividend_checks() -> dict[str, tuple[Column, str]]:
    """D11."""
    return {"DividendTaxInversion": (F.col("cash_after_tax") > F.col("cash_before_tax"), "error"), "DividendNegative": (F.col("cash_before_tax") < 0, "error"), "DividendNonImplemented": (F.col("proc") != "实施", "info")}


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Number of keys with several rows, and their surplus rows."""
    return df.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus"))


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def anchor_check(adjusted: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Per code: newest front and oldest back price against the raw one."""
    ends = adjusted.groupBy("code").agg(F.max_by(F.struct("close", "close_front"), "day").alias("z"), F.min_by(F.struct("close", "close_back"), "day").alias("a"))
    front, back = F.abs(F.col("z.close_front") / F.col("z.close") - 1), F.abs(F.col("a.close_back") / F.col("a.close") - 1)
    return ends.select("code", (front > tolerance).alias("front_off"), (back > tolerance).alias("back_off"))


def return_consistency(adjusted: DataFrame, change: str = "pct_chg", limit: float = 1.0) -> DataFrame:
    """Rows whose adjusted return differs from the stated change by over ``limit`` points."""
    w = Window.partitionBy("code").orderBy("day")
    gap = F.abs((F.col("close_front") / F.lag("close_front").over(w) - 1) * 100 - F.col(change))
    return adjusted.withColumn("gap", gap).where(F.col("gap") > limit)


def watermark_consistency(df: DataFrame, stored: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Stored watermark against the actual maximum, both ways round."""
    actual = df.groupBy(*keys).agg(F.max(F.to_date(time)).alias("actual"))
    j = actual.join(stored, list(keys), "full")
    return j.withColumn("state", F.when(F.col("actual").isNull(), "empty").when(F.col("last_date").isNull(), "missing").when(F.col("last_date") > F.col("actual"), "ahead").when(F.col("last_date") < F.col("actual"), "behind").otherwise("ok"))


def watermark_matrix(df: DataFrame, time: str, table: str) -> DataFrame:
    """Rows and last time per month."""
    return df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.max(F.to_date(time)).alias("last_day")).withColumn("table", F.lit(table))


def minute_against_daily(minutes: DataFrame, daily: DataFrame, warn: float = 0.003, error: float = 0.005) -> DataFrame:
    """Last minute close of a day against the daily close (D13); minutes without a price do not count, and any price is infinitely far from a daily close of zero."""
    last = minutes.groupBy("code", F.to_date("ts").alias("day")).agg(F.max_by("price", F.when(F.col("price").isNotNull(), F.col("ts"))).alias("last_price"))
    dev = F.when(F.col("close") != 0, F.abs(F.col("last_price") / F.col("close") - 1)).when(F.col("last_price").isNotNull() & F.col("close").isNotNull(), float("inf"))
    return last.join(daily.select("code", "day", "close"), ["code", "day"]).withColumn("level", F.when(dev > error, "error").when(dev > warn, "warn").otherwise("ok"))


def caliber_votes(ex_dates: DataFrame, factors: DataFrame, bars: DataFrame, least: int = 20) -> DataFrame:
    """Per probe whether prices moved by 1, 1/k or 1/k² over an ex-date with factor step k, and the table's vote."""
    w = Window.partitionBy("code").orderBy("day")
    step = factors.withColumn("k", F.col("factor") / F.lag("factor").over(w)).where(F.col("k").isNotNull() & (F.abs(F.col("k") - 1) > 1e-9)).select("code", "day", "k")
    move = bars.withColumn("move", F.col("close") / F.lag("close").over(w)).select("code", "day", "move")
    probes = ex_dates.join(step, ["code", "day"]).join(move, ["code", "day"]).where(F.col("move") > 0)
    gap = [F.abs(F.log(F.col("move"))), F.abs(F.log(F.col("move") * F.col("k"))), F.abs(F.log(F.col("move") * F.col("k") * F.col("k")))]
    kind = F.when((gap[0] <= gap[1]) & (gap[0] <= gap[2]), "adjusted").when(gap[1] <= gap[2], "raw").otherwise("twice")
    votes = probes.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # three rows
    return votes.withColumn("share", F.col("n") / total).withColumn("enough", total >= least)


def factor_checks(factors: DataFrame) -> DataFrame:
    """Falls and jumps over 2x or under 0.5x per code."""
    w = Window.partitionBy("code").orderBy("day")
    step = F.col("factor") / F.lag("factor").over(w)
    return factors.withColumn("s", step).groupBy("code").agg(F.count_if(F.col("s") < 1).alias("falls"), F.count_if((F.col("s") > 2) | (F.col("s") < 0.5)).alias("jumps"))


def spike_days(factors: DataFrame, share: float = 0.05) -> DataFrame:
    """Days on which over ``share`` of the codes change their factor for that day only."""
    w = Window.partitionBy("code").orderBy("day")
    one = (F.lag("factor").over(w) == F.lead("factor").over(w)) & (F.lag("factor").over(w) != F.col("factor"))
    return factors.withColumn("one", one).groupBy("day").agg((F.count_if(F.col("one")) / F.count("*")).alias("share")).where(F.col("share") > share)


def invariant(adjusted: DataFrame, factors: DataFrame, anchors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Recompute front prices of the whole population: ok, broken, skipped (no factor)."""
    rows = asof(adjusted.select("code", "day", "close", "close_front"), factors, ["code"], "day", "day", ["factor"]).join(anchors, "code", "left")
    want = F.col("close") * F.col("factor") / F.col("latest")
    state = F.when(want.isNull(), "skipped").when(F.col("close_front").isNull(), "unknown").when(F.abs(F.col("close_front") - want) / F.abs(want) > tolerance, "broken").otherwise("ok")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def golden_rows(stored: DataFrame, pinned: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Pinned rows that are missing or differ."""
    j = pinned.join(stored.select(*keys, F.col(value).alias("_v")), list(keys), "left")
    return j.withColumn("state", F.when(F.col("_v").isNull(), "missing").when(F.abs(F.col("_v") - F.col(value)) > tolerance, "differs").otherwise("ok")).drop("_v")


def share_sources(a: DataFrame, b: DataFrame, value: str = "shares", accuracy: int | None = 100_000) -> DataFrame:
    """Percent difference of two sources' share counts: mean, median, median absolute, 95th percentile.

    Quantiles are sketches that merge, a rank off by at most 1 / ``accuracy`` of the
    rows; None asks for exact ones, which one task counts by distinct value.
    """
    x, y = spare(["code"], "_a", "_b")
    gap = (F.col(x) - F.col(y)) / F.col(y) * 100
    j = a.select("code", F.col(value).alias(x)).join(b.select("code", F.col(value).alias(y)), "code").where(F.col(y) != 0).withColumn("g", gap)

    def quantile(c: Column, q: float) -> Column:
        return F.percentile(c, q) if accuracy is None else F.percentile_approx(c, q, accuracy)

    return j.agg(F.count("*").alias("n"), F.avg("g").alias("mean"), quantile(F.col("g"), 0.5).alias("median"), quantile(F.abs("g"), 0.5).alias("median_abs"), quantile(F.abs("g"), 0.95).alias("p95"))


def queue_health(queue: DataFrame, targets: DataFrame, now, overdue_days: int = 3) -> DataFrame:
    """Dead, overdue, stale and orphan triggers."""
    known = targets.select("trigger_id", F.lit(True).alias("_k")).distinct()
    age = F.datediff(F.lit(now).cast("date"), F.col("created"))
    return queue.join(known, "trigger_id", "left").agg(F.count_if(F.col("state") == "dead").alias("dead"), F.count_if((F.col("state") == "pending") & (age > overdue_days)).alias("overdue"),
                                                      F.count_if((F.col("state") == "running") & (age > 1)).alias("stale"), F.count_if(F.col("_k").isNull()).alias("orphans"))


def ex_date_returns(adjusted: DataFrame, ex_dates: DataFrame) -> DataFrame:
    """Raw and adjusted return and their gap on each ex-date."""
    w = Window.partitionBy("code").orderBy("day")
    rows = adjusted.withColumn("raw_return", F.col("close") / F.lag("close").over(w) - 1).withColumn("front_return", F.col("close_front") / F.lag("close_front").over(w) - 1)
    return rows.join(ex_dates.select("code", "day"), ["code", "day"]).select("code", "day", "raw_return", "front_return", (F.col("front_return") - F.col("raw_return")).alias("gap"))


def ledger_conservation(ledger: DataFrame, quarantine_counts: DataFrame) -> DataFrame:
    """Batches whose counts do not add up, and whether their rejects can be traced."""
    j = ledger.join(quarantine_counts, "batch_id", "left")
    lost = F.col("rows_aligned") != F.col("rows_passed") + F.col("rows_rejected") + F.col("rows_fixed")
    return j.select("batch_id", lost.alias("not_conserved"), (F.col("rows_written") > F.col("rows_passed")).alias("overwritten"), (F.col("rows_rejected") != F.coalesce("quarantined", F.lit(0))).alias("untraced"))


def fingerprint(df: DataFrame, row: Column | None = None) -> DataFrame:
    """Order-free fingerprint: rows, xor and sum of row hashes (A16); ``row`` is the hash, of all columns by default."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]) if row is None else row
    return df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("xor_hash"), F.sum(row.cast("decimal(38,0)")).alias("sum_hash"))


def canonical_line(df: DataFrame) -> Column:
    """A row as text: its columns in order of name, parted by \\x1f, null as \\x1e."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in sorted(df.columns)])


def canonical_digest(df: DataFrame, prefix: int = 4) -> DataFrame:
    """(shard, n, digest): sha256 over the sorted sha256 of a shard's rows, whatever their order.

    A shard is the first ``prefix`` hex digits of the row's hash, so 16 ** prefix
    shards share the rows evenly; choose it so that a shard's hashes fit a task.
    """
    h = df.select(F.sha2(canonical_line(df), 256).alias("h"))
    return (h.groupBy(F.substring("h", 1, prefix).alias("shard")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("h")).alias("all"))
            .select("shard", "n", F.sha2(F.array_join("all", ""), 256).alias("digest")))


def stratified_sample(df: DataFrame, per_code: int = 20, total: int = 5000, seed: int = 7) -> DataFrame:
    """At most ``per_code`` rows of each code, the latest among them, and at most ``total``, all by a hash of code and day (K4)."""
    latest, hashed, n = spare(df.columns, "_l", "_h", "_n")
    w = Window.partitionBy("code")
    ranked = df.withColumn(latest, F.row_number().over(w.orderBy(F.col("day").desc()))).withColumn(hashed, F.md5(F.concat_ws("|", "code", F.col("day").cast("string"), F.lit(str(seed)))))
    picked = ranked.withColumn(n, F.row_number().over(w.orderBy((F.col(latest) != 1).cast("int"), hashed))).where(F.col(n) <= per_code)
    return picked.orderBy(n, hashed, "code", "day").limit(total).drop(latest, hashed, n)


def golden_days(segments: DataFrame, bars: DataFrame) -> DataFrame:
    """First, median and last day of each segment's bars (K5)."""
    rows = asof(bars.select("code", "day"), segments.select("code", F.col("start").alias("_s"), "segment"), ["code"], "day", "_s", ["segment"]).where(F.col("segment").isNotNull())
    w = Window.partitionBy("code", "segment")
    placed = rows.withColumn("_n", F.row_number().over(w.orderBy("day"))).withColumn("_c", F.count("*").over(w))
    middle = F.round((F.col("_c") - 1) * 0.5).cast("int") + 1
    return placed.where((F.col("_n") == 1) | (F.col("_n") == F.col("_c")) | (F.col("_n") == middle)).select("code", "segment", "day")


def source_checks(authority: str | None = None, allow_fallback: bool = True, source: str = "data_source") -> dict[str, tuple[Column, str]]:
    """Rows without a source, and rows of another source than the table's authority; errors where no fallback is allowed."""
    severity = "error" if authority is not None and not allow_fallback else "warning"
    out = {"SourceTraceability": (F.col(source).isNull(), severity)}
    return out | ({"AuthoritySourceViolation": (F.col(source) != authority, severity)} if authority is not None else {})


def frequency_checks(df: DataFrame, freq: str = "freq", time: str = "time") -> dict[str, tuple[Column, str]]:
    """Unknown bar lengths and times off their grid; one row for a table without the columns."""
    if not {freq, time} <= set(df.columns):
        return {"FrequencyColumns": (F.lit(True), "error")}
    step = F.create_map(*[F.lit(x) for kv in STEP_MS.items() for x in kv])
    known = F.coalesce(F.col(freq).isin(list(STEP_MS)), F.lit(False))
    return {"FrequencyValue": (~known, "error"), "FrequencyGrid": (known & (F.col(time) % F.try_element_at(step, F.col(freq)) != 0), "error")}


def all_null_fields(df: DataFrame, table: str, fields: Sequence[str], origin: str, source: str = "data_source") -> DataFrame:
    """(check, table, field, count) of fields that are null in every row of a source that has rows."""
    own = df.where(F.col(source) == origin).agg(F.count("*").alias("rows"), *[F.count(c).alias(f"c{k}") for k, c in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c{k}").alias("known")) for k, c in enumerate(fields)])
    return (own.select("rows", F.explode(rows).alias("f")).where("rows > 0 and f.known = 0")
            .select(F.lit("GrowthFieldAllNull").alias("check"), F.lit(table).alias("table"), "f.field", F.col("rows").alias("count")))
