"""Target lags that never bridge a calendar gap."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from monthloom.functions.calendar import month_ordinal
from monthloom.functions.numeric import is_close
from monthloom.operators.checks import require_none
from monthloom.operators.target import TARGET

def _by_month() -> WindowSpec:
    return Window.partitionBy("entity").orderBy("month")


def lag_name(k: int, target: str = TARGET) -> str:
    return f"{target}_lag{k}"


def without_target_lags(features: Sequence[str], target: str = TARGET) -> list[str]:
    """Feature names minus precomputed target lags, which the lag setting controls."""
    pattern = re.compile(re.escape(target) + r"_lag[0-9]+")
    return [f for f in features if not pattern.fullmatch(f)]


def model_features(
    base: Sequence[str], lag_count: int, target: str = TARGET
) -> list[str]:
    """Base features, then the lag columns, each name once and in order."""
    lags = [lag_name(k, target) for k in range(1, lag_count + 1)]
    return list(dict.fromkeys([*base, *lags]))


def _expected(k: int, target: str):
    gap = month_ordinal(F.col("month")) - F.lag(month_ordinal(F.col("month")), k).over(_by_month())
    return F.when(gap == k, F.lag(target, k).over(_by_month()))


def inconsistent_lags(panel: DataFrame, lag_count: int, target: str = TARGET) -> DataFrame:
    """Rows whose precomputed lag column disagrees with the target history."""
    present = [k for k in range(1, lag_count + 1) if lag_name(k, target) in panel.columns]
    if not present:
        return panel.select("entity", "month").limit(0)
    pairs = F.array(
        *[
            F.struct(
                F.lit(lag_name(k, target)).alias("column"),
                F.col(lag_name(k, target)).alias("found"),
                F.col(f"_expected{k}").alias("expected"),
            )
            for k in present
        ]
    )
    checked = panel.withColumns({f"_expected{k}": _expected(k, target) for k in present}).select(
        "entity", "month", F.inline(pairs)
    )
    agrees = F.coalesce(is_close(F.col("found"), F.col("expected")), F.lit(False))
    return checked.filter(F.col("expected").isNotNull() & ~agrees)


def add_target_lags(
    panel: DataFrame, lag_count: int, target: str = TARGET, check: bool = True
) -> DataFrame:
    """Add `target_lag1..k`; columns that are already there are checked and kept."""
    if lag_count < 0:
        raise ValueError("lag_count must not be negative.")
    names = [lag_name(k, target) for k in range(1, lag_count + 1)]
    if check and set(names) & set(panel.columns):
        require_none(
            inconsistent_lags(panel, lag_count, target),
            "A precomputed lag column disagrees with the target history.",
        )
    new = {
        lag_name(k, target): _expected(k, target)
        for k in range(1, lag_count + 1)
        if lag_name(k, target) not in panel.columns
    }
    return panel.withColumns(new) if new else panel
