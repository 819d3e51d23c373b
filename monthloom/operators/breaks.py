"""Level adjustment at known break dates.

When breaks are at least one window apart, the windows of a break lie between its
neighbours, so both carry the same earlier factor and the ratio of adjusted means
equals the ratio of raw means. All means then come from one aggregation and the
factors from one fold. Closer breaks are handled one after the other; as every
pass groups on the series key, the further passes need no shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.arrays import let
from monthloom.functions.numeric import nan_to_null
from monthloom.operators.series import SERIES, observations, unpack
from monthloom.params import BreakRule


def _dates(rule: BreakRule) -> list[str]:
    return sorted(set(rule.category) | set(rule.topic))


def _kind_filter(rule: BreakRule, day: str) -> Column:
    kinds = [k for k, days in (("category", rule.category), ("topic", rule.topic)) if day in days]
    return F.col("kind").isin(*kinds)


def _window_mean(day: str, months: int, after: bool) -> Column:
    edge = F.lit(day).cast("date")
    far = F.add_months(edge, months if after else -months)
    month = F.col("month")
    inside = (month >= edge) & (month < far) if after else (month < edge) & (month >= far)
    return F.avg(F.when(inside, F.col("value")))


def _with_steps(long: DataFrame, rule: BreakRule) -> DataFrame:
    """One row per series: its observations, span, and one step per break date."""
    clean = long.withColumn("value", nan_to_null(F.col("value").cast("double")))
    days = _dates(rule)
    means = []
    for i, day in enumerate(days):
        means.append(_window_mean(day, rule.window_months, after=False).alias(f"before{i}"))
        means.append(_window_mean(day, rule.window_months, after=True).alias(f"after{i}"))
    observed = F.when(F.col("value").isNotNull(), F.col("month"))
    grouped = clean.groupBy(*SERIES).agg(
        observations().alias("obs"),
        F.min(observed).alias("first_month"),
        F.max(observed).alias("last_month"),
        *means,
    )
    steps = F.array(
        *[
            F.struct(
                F.lit(day).cast("date").alias("break_date"),
                F.col(f"before{i}").alias("before"),
                F.col(f"after{i}").alias("after"),
                _kind_filter(rule, day).alias("used"),
            )
            for i, day in enumerate(days)
        ]
    )
    return grouped.withColumn("steps", F.filter(steps, lambda s: s["used"]))


def break_window_means(long: DataFrame, rule: BreakRule) -> DataFrame:
    """Means on both sides of every break date that applies to the series' kind."""
    return (
        _with_steps(long, rule)
        .select(*SERIES, F.explode("steps").alias("s"))
        .select(
            *SERIES,
            "s.break_date",
            F.col("s.before").alias("mean_before"),
            F.col("s.after").alias("mean_after"),
            F.try_divide("s.before", "s.after").alias("raw_ratio"),
        )
    )


def _fold(rule: BreakRule) -> Column:
    """array<(break_date, factor)>: the cumulative factor in force from each date."""
    start = F.struct(
        F.lit(1.0).alias("factor"),
        F.array().cast("array<struct<break_date:date,factor:double>>").alias("path"),
    )

    def step(acc: Column, s: Column) -> Column:
        ratio = F.try_divide(s["before"], s["after"])
        applies = (
            (s["break_date"] >= F.col("first_month"))
            & (s["break_date"] <= F.col("last_month"))
            & s["before"].isNotNull()
            & s["after"].isNotNull()
            & (s["after"] * acc["factor"] >= F.lit(rule.min_level))
            & (F.abs(ratio - F.lit(1.0)) >= F.lit(rule.min_change))
        )

        def extend(factor: Column) -> Column:
            entry = F.struct(s["break_date"].alias("break_date"), factor.alias("factor"))
            return F.struct(
                factor.alias("factor"), F.array_append(acc["path"], entry).alias("path")
            )

        return let(F.when(applies, acc["factor"] * ratio).otherwise(acc["factor"]), extend)

    return F.aggregate("steps", start, step, lambda acc: acc["path"])


def _adjust_once(long: DataFrame, rule: BreakRule) -> DataFrame:
    def factor_at(path: Column, o: Column) -> Column:
        return F.aggregate(
            path,
            F.lit(1.0),
            lambda acc, p: F.when(o["month"] >= p["break_date"], p["factor"]).otherwise(acc),
        )

    def scaled(path: Column) -> Column:
        return F.transform("obs", lambda o: o["value"] * factor_at(path, o))

    return _with_steps(long, rule).select(
        *SERIES,
        F.col("obs.month").alias("months"),
        let(_fold(rule), scaled).alias("values"),
    )


def _apart(days: list[str], months: int) -> bool:
    parsed = [date.fromisoformat(d) for d in days]
    gaps = [
        (b.year - a.year) * 12 + b.month - a.month for a, b in zip(parsed, parsed[1:])
    ]
    return all(g >= months for g in gaps)


def adjust_breaks(long: DataFrame, rule: BreakRule) -> DataFrame:
    """Rescale everything from each applicable break on; returns packed series."""
    if all(_apart(sorted(d), rule.window_months) for d in (rule.category, rule.topic)):
        return _adjust_once(long, rule)
    packed = None
    for day in _dates(rule):
        single = BreakRule(
            category=tuple(d for d in rule.category if d == day),
            topic=tuple(d for d in rule.topic if d == day),
            window_months=rule.window_months,
            min_level=rule.min_level,
            min_change=rule.min_change,
        )
        packed = _adjust_once(long if packed is None else unpack(packed), single)
    return packed
