"""Row validation: every rule of a table in one pass, then a split.

Rules are predicates that mark a row for rejection. ``validate`` adds the names
of all rules a row breaks and the offending values; accepted and rejected rows
are two filters over that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.kernels import spare

#: Bar length in milliseconds (fixed values).
STEP_MS = {"1min": 60_000, "5min": 300_000, "15min": 900_000, "30min": 1_800_000, "60min": 3_600_000}


@dataclass
class ColumnSpec:
    kind: str = "string"
    required: bool = False
    regex: str | None = None
    enum: Sequence | None = None
    gt: float | None = None
    ge: float | None = None


@dataclass
class TableSpec:
    columns: dict[str, ColumnSpec]
    primary_key: Sequence[str] = ()
    code_fields: Sequence[str] = ("code",)
    time_key: str | None = "time"
    expected_freq: str | None = None
    amount_unit: str | None = None
    statement: bool = False
    families: Sequence[str] = ("front", "back")
    factor_tolerance: dict[str, float] = field(default_factory=lambda: {"front": 0.02, "back": 0.02})


@dataclass
class Rule:
    name: str
    columns: Sequence[str]
    rejects: Column


def _any_null(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def required_rules(spec: TableSpec, present: Sequence[str]) -> list[Rule]:
    """V1: a missing column rejects all rows; null and blank values reject theirs."""
    out = []
    for name, c in spec.columns.items():
        if c.required:
            out.append(Rule("RequiredColumns", [], F.lit(True)) if name not in present else
                       Rule("RequiredValueNull", [name], F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")))
    return out


def column_rules(spec: TableSpec, present: Sequence[str]) -> list[Rule]:
    """Code format, type, enumeration, range, infinity."""
    out = []
    for name in spec.code_fields:
        if name in present:
            out.append(Rule("CodeFormat", [name], ~F.coalesce(F.col(name).rlike(spec.columns.get(name, ColumnSpec()).regex or r"^\d{6}$"), F.lit(False))))
    for name, c in spec.columns.items():
        if name not in present:
            continue
        if c.kind == "number":
            number = F.col(name).try_cast("double")
            out.append(Rule("TypeCheck", [name], F.col(name).isNotNull() & number.isNull()))
            out.append(Rule("InfCheck", [name], F.abs(number) == F.lit(float("inf"))))
            if c.gt is not None:
                out.append(Rule("PositiveNumeric", [name], number <= c.gt))
            if c.ge is not None:
                out.append(Rule("RangeCheck", [name], number < c.ge))
        if c.enum is not None:
            out.append(Rule("EnumCheck", [name], F.col(name).isNotNull() & ~F.col(name).isin(list(c.enum))))
    return out


def special_treatment_rule() -> Rule:
    """V4: a row must say whether its security is under special treatment."""
    return Rule("IsSTNull", ["is_st"], F.col("is_st").isNull())


def time_rule(time: str) -> Rule:
    """V3."""
    return Rule("DateValid", [time], F.col(time).isNull() | (F.col(time) <= 0) | (F.col(time) > 4_000_000_000_000))


def price_rules(suffix: str = "", tolerance: float = 1e-9) -> list[Rule]:
    """V5 for raw prices."""
    o, h, low, c = (f"{p}{suffix}" for p in ("open", "high", "low", "close"))
    bad = (F.col(h) < F.greatest(F.col(low), F.col(o), F.col(c)) - tolerance) | (F.col(low) > F.least(F.col(h), F.col(o), F.col(c)) + tolerance)
    return [Rule("OHLCLogic" if not suffix else f"AdjustmentOHLC{suffix}", [o, h, low, c], ~_any_null(o, h, low, c) & bad)]


def unit_rule() -> Rule:
    """V6: amount over close times volume, for amounts in yuan."""
    ratio = F.col("amount") / F.when(F.col("close") * F.col("volume") != 0, F.col("close") * F.col("volume"))
    return Rule("UnitCheck", ["amount", "close", "volume"], ~ratio.between(0.5, 2.0))


def frequency_rules(expected: str | None, time: str = "time") -> list[Rule]:
    """V10."""
    step = F.create_map(*[F.lit(x) for kv in STEP_MS.items() for x in kv])
    known = F.col("freq").isin(list(STEP_MS))
    out = [Rule("FrequencyMissing", ["freq"], F.col("freq").isNull()), Rule("FrequencyInvalid", ["freq"], F.col("freq").isNotNull() & ~known),
           Rule("FrequencyGrid", ["freq", time], known & (F.col(time) % F.try_element_at(step, F.col("freq")) != 0))]
    return out + ([Rule("FrequencyMismatch", ["freq"], F.col("freq") != expected)] if expected else [])


def adjustment_rules(family: str, tolerance: float) -> list[Rule]:
    """V11, V12 for one family of adjusted prices."""
    raw = ("open", "high", "low", "close")
    adjusted = [f"{p}_{family}" for p in raw]
    missing = sum((F.col(c).isNull().cast("int") for c in adjusted[1:]), F.col(adjusted[0]).isNull().cast("int"))
    factors = [F.col(a) / F.when(F.col(p) != 0, F.col(p)) for a, p in zip(adjusted, raw)]
    mean = reduce(lambda a, b: a + b, factors) / 4
    spread = F.greatest(*[F.abs(f / mean - 1) for f in factors])
    return [Rule(f"AdjustmentCompleteness_{family}", adjusted, (missing > 0) & (missing < 4)), Rule(f"AdjustmentPositive_{family}", adjusted, F.least(*[F.col(c) for c in adjusted]) <= 0),
            *price_rules(f"_{family}"), Rule(f"AdjustmentFactorConsistency_{family}", adjusted, (missing == 0) & ~_any_null(*raw) & (spread > tolerance))]


def announcement_rule(statement: bool, now) -> Rule:
    """An announcement over a week ahead, or, for statements, before its period's end."""
    late = F.col("ann_date") > F.date_add(F.lit(now).cast("date"), 7)
    return Rule("AnnDateLogic", ["ann_date", "end_date"], late | (F.lit(statement) & (F.col("ann_date") < F.col("end_date"))))


def rules_for(df: DataFrame, spec: TableSpec) -> list[Rule]:
    have = df.columns
    out = required_rules(spec, have) + column_rules(spec, have)
    if spec.time_key and spec.time_key in have:
        out.append(time_rule(spec.time_key))
    if {"open", "high", "low", "close"} <= set(have):
        out += price_rules()
        if spec.amount_unit == "yuan":
            out.append(unit_rule())
        for f in spec.families:
            if f"open_{f}" in have:
                out += adjustment_rules(f, spec.factor_tolerance[f])
    if "is_st" in have:
        out.append(special_treatment_rule())
    if "freq" in have:
        out += frequency_rules(spec.expected_freq, spec.time_key or "time")
    return out


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``failed_rules`` (distinct, in order of the rules) and ``error_values``."""
    if not rules:
        return df.withColumns({"failed_rules": F.array().cast("array<string>"), "error_values": F.create_map().cast("map<string,string>")})
    hit = [F.coalesce(r.rejects, F.lit(False)) for r in rules]
    names = F.array_distinct(F.array_compact(F.array(*[F.when(h, r.name) for h, r in zip(hit, rules)])))
    marked: dict[str, Column] = {}
    for h, r in zip(hit, rules):
        for c in r.columns:
            marked[c] = marked[c] | h if c in marked else h
    pairs = [F.when(h, F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))) for c, h in marked.items()]
    values = F.map_from_entries(F.array_compact(F.array(*pairs))) if pairs else F.create_map().cast("map<string,string>")
    return df.withColumns({"failed_rules": names, "error_values": values})


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("failed_rules") == 0).drop("failed_rules", "error_values")


def rejected(checked: DataFrame, batch_id: str, table: str, source: str) -> DataFrame:
    """Quarantine rows: the row as JSON, the rules it broke, the values (V18). Every rejected row is kept."""
    own = [c for c in checked.columns if c not in ("failed_rules", "error_values")]
    return checked.where(F.size("failed_rules") > 0).select(
        F.lit(batch_id).alias("batch_id"), F.lit(table).alias("table_name"), F.lit(source).alias("source"), F.to_json(F.struct(*own)).alias("original_payload"),
        "failed_rules", "error_values", F.lit("pending").alias("status"))


def keep_one_per_key(df: DataFrame, key: Sequence[str], seq: str, flag: str | None = "update_flag") -> DataFrame:
    """Of rows with one key the flagged one stays, else the last by ``seq``."""
    order = ([F.coalesce(F.col(flag), F.lit(0)).desc()] if flag and flag in df.columns else []) + [F.col(seq).desc()]
    (n,) = spare(df.columns, "_n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(n) == 1).drop(n)


def rule_counts(checked: DataFrame) -> DataFrame:
    """Rejected rows per rule."""
    return checked.select(F.explode("failed_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def count_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule_counts`` of ``validate`` in one aggregation, without building a list for each row; rules without hits are left out."""
    by_name: dict[str, Column] = {}
    for r in rules:
        hit = F.coalesce(r.rejects, F.lit(False))
        by_name[r.name] = by_name[r.name] | hit if r.name in by_name else hit
    if not by_name:
        return df.sparkSession.createDataFrame([], "rule string, n long")
    counts = df.agg(*[F.count_if(hit).alias(f"c{k}") for k, hit in enumerate(by_name.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"c{k}").alias("n")) for k, name in enumerate(by_name)])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def quarantine_status(quarantine: DataFrame, now, archive_after_days: int, time: str = "ingested_at") -> DataFrame:
    """Pending rows older than the limit become archived."""
    old = (F.col("status") == "pending") & (F.datediff(F.lit(now).cast("date"), F.to_date(time)) > archive_after_days)
    return quarantine.withColumn("status", F.when(old, "archived").otherwise(F.col("status")))


def mark_quarantine(quarantine: DataFrame, done: DataFrame, status: str, now, key: str = "quarantine_id") -> DataFrame:
    """Rows named in ``done`` (by ``key``) become ``fixed`` or ``replayed``, with the time in ``fixed_at`` or ``replayed_at``."""
    if status not in ("fixed", "replayed"):
        raise ValueError("status is fixed or replayed")
    stamp = f"{status}_at"
    old = F.col(stamp) if stamp in quarantine.columns else F.lit(None).cast("timestamp")
    (hit,) = spare(quarantine.columns, "_hit")
    marked = quarantine.join(done.select(key).distinct().withColumn(hit, F.lit(True)), key, "left")
    return marked.withColumns({"status": F.when(F.col(hit), status).otherwise(F.col("status")),
                               stamp: F.when(F.col(hit), F.lit(now).cast("timestamp")).otherwise(old)}).drop(hit)


def quarantine_stats(quarantine: DataFrame) -> DataFrame:
    """Rows by table and status."""
    return quarantine.groupBy("table_name", "status").agg(F.count("*").alias("n"))


def rule_alerts(quarantine: DataFrame, per_day: int, time: str = "ingested_at") -> DataFrame:
    """(table_name, rule, day, n) of rules that rejected over ``per_day`` rows of a table in a day."""
    each = quarantine.select("table_name", F.explode("failed_rules").alias("rule"), F.to_date(time).alias("day"))
    return each.groupBy("table_name", "rule", "day").agg(F.count("*").alias("n")).where(F.col("n") > per_day)
