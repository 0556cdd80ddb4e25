"""From source tables to canonical ones: mapping, dates, units, derived fields, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators.kernels import asof, latest_per_key, spare


def map_columns(df: DataFrame, copies: dict[str, str], renames: dict[str, str]) -> DataFrame:
    """Copy columns, then rename those that are there; two columns of one name are an error."""
    df = df.withColumns({new: F.col(old) for new, old in copies.items() if old in df.columns})
    names = [renames.get(c, c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"columns collide after mapping: {sorted(n for n in names if names.count(n) > 1)}")
    return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns})


def mapping_for(rules: dict, table: str, source: str, freq: str | None = None) -> dict[str, str]:
    """Mapping of a table, the one of its frequency first; none means names stay."""
    for key in ([f"{table}_{freq}"] if freq else []) + [table]:
        if key in rules and source in rules[key]:
            return rules[key][source]
    return {}


def to_epoch_ms(value: Column, zone_hours: int = 8) -> Column:
    """Epoch milliseconds from ms, s, yyyyMMdd or ISO text, in the exchange's zone (P5); null if none fits."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^\d+(\.0+)?$"), F.regexp_replace(text, r"\.0+$", "").cast("long"))

    def local(ts: Column) -> Column:
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
        return F.floor(micros / 1000) - zone_hours * 3_600_000

    day = F.try_to_timestamp(F.when(F.length(text) == 8, text), F.lit("yyyyMMdd")).cast("timestamp_ntz")
    iso = text.try_cast("timestamp_ntz")
    compact = F.when((F.length(text) == 8) & number.isNotNull(), local(day))
    return F.coalesce(compact, F.when(number > 1_000_000_000_000, number), F.when(number > 1_000_000_000, number * 1000), F.when(number.isNull(), local(iso)))


def convert_units(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * f for c, f in factors.items() if c in df.columns})


def round_fields(df: DataFrame, price_decimals: int = 2) -> DataFrame:
    """Half-even rounding of prices, volume, amount and change."""
    digits = {"open": price_decimals, "high": price_decimals, "low": price_decimals, "close": price_decimals, "volume": 0, "amount": 2, "pct_chg": 4}
    return df.withColumns({c: F.bround(c, n) for c, n in digits.items() if c in df.columns})


def suspend_flag(volume: Column) -> Column:
    """1 for zero volume; an unknown volume counts as traded."""
    return F.when(F.coalesce(volume, F.lit(1)) == 0, 1).otherwise(0)


def fold_to_midnight(df: DataFrame, time: str = "ts", keys: Sequence[str] = ("code",)) -> DataFrame:
    """Rows stamped within a day move to its start; the latest stamp wins (P25)."""
    value = [c for c in df.columns if c not in (*keys, time)]
    one = df.groupBy(*keys, F.date_trunc("day", time).alias("_d")).agg(F.max_by(F.struct(*value), time).alias("r"), F.count("*").alias("stamps"))
    return one.select(*keys, F.col("_d").alias(time), "r.*", "stamps")


def clip_landing(df: DataFrame, start: str, end: str, date_col: str, codes: DataFrame | None = None, code_col: str = "code") -> DataFrame:
    """Landing rows within yyyyMMdd bounds, with standard codes, of the wanted ones."""
    day = F.substring(F.regexp_replace(F.col(date_col).cast("string"), "[^0-9]", ""), 1, 8)
    out = df.where(day.between(start, end) & F.col(code_col).rlike(r"^\d{6}\.(SH|SZ|BJ)$"))
    return out if codes is None else out.join(codes, code_col, "left_semi")


SIDES = {"买": "buy", "买入": "buy", "卖": "sell", "卖出": "sell", "buy": "buy", "sell": "sell", "b": "buy", "s": "sell"}


def clean_trades(df: DataFrame, numbers: Sequence[str] = ("volume", "price", "amount")) -> DataFrame:
    """Zero-padded codes, sides by their names, strict numbers: a value that is none raises."""
    table = F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv])
    return df.withColumns({"code": F.lpad(F.split_part(F.trim("code"), F.lit("."), F.lit(1)), 6, "0"), "action": F.try_element_at(table, F.lower(F.trim("action"))), **{c: F.col(c).cast("double") for c in numbers}})


def read_trades(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    schema = "date string, code string, action string, volume string, price string, amount string, commission string, tax string"
    return clean_trades(spark.read.csv(path, schema=schema, header=True, encoding=encoding, mode="FAILFAST"))


def research_signals(df: DataFrame) -> DataFrame:
    """Buy and overweight ratings by number or word."""
    rating = F.lower(F.trim(F.col("rating").cast("string")))
    return df.where(rating.isin("006", "007", "6", "7", "buy", "overweight", "买入", "增持")).withColumns(
        {"code": F.lpad(F.split_part(F.trim(F.col("code").cast("string")), F.lit("."), F.lit(1)), 6, "0"), "day": F.split_part(F.trim(F.col("time").cast("string")), F.lit(" "), F.lit(1))})


def positions(df: DataFrame) -> DataFrame:
    """Seed positions; what may be sold defaults to the amount."""
    return df.withColumn("enable_amount", F.coalesce("enable_amount", "amount") if "enable_amount" in df.columns else F.col("amount"))


def strategy_events(df: DataFrame, columns: dict[str, str], event_type: str, source: str) -> DataFrame:
    """Mapped event rows with a JSON payload and a key from its hash."""
    named = df.select(*[F.col(old).alias(new) for new, old in columns.items()])
    rest = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    out = named if set(df.columns) <= set(named.columns) else df.select(*[F.col(old).alias(new) for new, old in columns.items()], rest.alias("payload"))
    out = out if "payload" in out.columns else named.withColumn("payload", F.to_json(F.struct(*named.columns)))
    key = F.sha2(F.concat_ws("|", F.lit(event_type), F.lit(source), "payload"), 256)
    return out.withColumns({"event_type": F.lit(event_type), "source": F.lit(source), "event_date": F.col("event_date").try_cast("date"), "source_key": key}).dropDuplicates(["source_key"])


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], seq: str | None = None) -> DataFrame:
    """Stored rows with incoming ones put in their place by key, the last of several winning.

    The plain-file form of a merge: write the result over the partitions that
    the incoming rows touch.
    """
    order = [seq] if seq else [c for c in incoming.columns if c not in key]
    new = latest_per_key(incoming, key, order).select(*incoming.columns)
    new = new.drop(seq) if seq and seq not in stored.columns else new
    return stored.join(new, list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_counts(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """submitted, new and updated rows of an upsert."""
    once = incoming.select(*key).distinct().join(stored.select(*key, F.lit(1).alias("_k")).distinct(), list(key), "left")
    counts = once.agg(F.count_if(F.col("_k").isNull()).alias("new"), F.count_if(F.col("_k").isNotNull()).alias("updated"))
    return incoming.agg(F.count("*").alias("submitted")).crossJoin(counts)  # one row each


def clean_intervals(df: DataFrame, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Intervals whose end is not before their start (Q20)."""
    return df.where(F.col(end).isNull() | (F.col(start) <= F.col(end)))


def build_fund_reference(funds: DataFrame, bars: DataFrame, active: Column | None = None) -> DataFrame:
    """Exchange-traded funds but not their feeders, one row a code, list and delist days from bars (Q21)."""
    own = funds.where(F.upper("name").contains("ETF") & ~F.col("name").contains("联接"))
    one = latest_per_key(own, ["code"], ["name"])
    span = bars.groupBy("code").agg(F.min("day").alias("list_date"), F.date_add(F.max("day"), 1).alias("_end"))
    out = one.join(span, "code", "left")
    ended = F.lit(True) if active is None else ~active
    return out.withColumn("delist_date", F.when(ended, F.col("_end"))).drop("_end")


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """(day, item) from lines like ``2024-01-02 ...: [a, b]``."""
    day, items = F.regexp_extract(value, r"(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(value, r"\[([^\]]*)\]", 1)
    rows = lines.where(day != "").select(F.to_date(day).alias("day"), F.explode(F.split(items, r"\s*,\s*")).alias("item"))
    return rows.select("day", F.trim(F.translate("item", "'\"", "")).alias("item")).where("item <> ''")


def safe_watermark(stored: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored watermark, or the actual last day where it is missing or ahead (R2)."""
    j = actual.join(stored, list(keys), "left")
    return j.withColumn("resume_from", F.when(F.col("last_date").isNull() | (F.col("last_date") > F.col("actual")), F.col("actual")).otherwise(F.col("last_date")))


def previous_trading_day_filter(df: DataFrame, cutoff: Column, end: str = "bar_end") -> DataFrame:
    """Only completed bars are visible."""
    return df.where(F.col(end) <= cutoff)


def second_latest(df: DataFrame, day: str = "day") -> DataFrame:
    """The cross-section of the second-latest day, so that the newest day may still fill."""
    days = df.select(day).distinct().withColumn("_n", F.row_number().over(Window.orderBy(F.col(day).desc())))  # distinct days only
    return df.join(F.broadcast(days.where("_n = 2").select(day)), day)  # one row


def unique_names(df: DataFrame) -> bool:
    return len({c.lower() for c in df.columns}) == len(df.columns)


def repaired_days(change_log: DataFrame, last_sync, table: str, time: str = "changed_at") -> DataFrame:
    """The distinct days of ``table`` that a change log (table_name, day, changed_at) names after the last sync."""
    return change_log.where((F.col("table_name") == table) & (F.col(time) > F.lit(last_sync).cast("timestamp"))).select("day").distinct()


def apply_corrections(current: DataFrame, pulled: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """``current`` with its rows of the repaired ``days`` replaced by those of ``pulled``; running it twice changes nothing."""
    named = days.select(F.col("day").alias(day)).distinct()
    return current.join(named, day, "left_anti").unionByName(pulled.join(named, day, "left_semi").select(*current.columns))


def pending_ranges(missed: DataFrame, table: str, reason: str = "filtered") -> DataFrame:
    """(table_name, code, range_start, range_end, days, status, reason): runs of consecutive days of rows left out, to be filled later."""
    w = Window.partitionBy("code").orderBy("day")
    runs = (missed.where(F.col("code").isNotNull() & F.col("day").isNotNull()).select("code", "day").distinct()
            .withColumn("run", F.date_sub("day", F.row_number().over(w))))
    return (runs.groupBy("code", "run").agg(F.min("day").alias("range_start"), F.max("day").alias("range_end"), F.count("*").alias("days"))
            .select(F.lit(table).alias("table_name"), "code", "range_start", "range_end", "days", F.lit("pending").alias("status"), F.lit(reason).alias("reason")))


def merge_pending(ledger: DataFrame, found: DataFrame, reopen: bool = False) -> DataFrame:
    """The ledger with new ranges added; one that is resolved stays so unless ``reopen``."""
    key = ["table_name", "code", "range_start", "range_end"]
    fresh = found.join(ledger.select(*key), key, "left_anti")
    kept = ledger
    if reopen:
        again = found.select(*key, F.lit(True).alias("again")).distinct()
        kept = ledger.join(again, key, "left").withColumn("status", F.when(F.col("again"), "pending").otherwise(F.col("status"))).select(*ledger.columns)
    return kept.unionByName(fresh.select(*ledger.columns))


def deferred_watermark(watermarks: DataFrame, ledger: DataFrame) -> DataFrame:
    """(table_name, last_date, safe_date): a table's watermark, held back to the day before its first pending range."""
    first = ledger.where(F.col("status") == "pending").groupBy("table_name").agg(F.min("range_start").alias("first"))
    return watermarks.join(first, "table_name", "left").select("table_name", "last_date", F.least("last_date", F.date_sub("first", 1)).alias("safe_date"))


def rows_to_rerun(source: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of ``source`` (code, day) inside a pending range (R5). A code's ranges are disjoint, so the last that began decides."""
    (until,) = spare(source.columns, "_until")
    open_ = ledger.where(F.col("status") == "pending").select("code", F.col("range_start").alias("since"), F.col("range_end").alias(until))
    met = asof(source, open_, ["code"], "day", "since", [until])
    return met.where(F.col("day") <= F.col(until)).drop(until)
