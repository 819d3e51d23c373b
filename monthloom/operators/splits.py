"""Rolling splits: W distinct panel months of training, then one test month.

Months are numbered 0, 1, 2, ... along the distinct months of the panel. That axis
has one row per calendar month at most, whatever the panel's size; it is the only
table here that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom import params
from monthloom.functions.calendar import month_ordinal, month_setting
from monthloom.operators.checks import DataCheckError, require_none


def month_axis(panel: DataFrame) -> DataFrame:
    """(month_idx, month) for every distinct month of the panel, in order."""
    return panel.agg(F.array_sort(F.collect_set("month")).alias("months")).select(
        F.posexplode("months").alias("month_idx", "month")
    )


def with_month_idx(panel: DataFrame, axis: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(axis), "month")


def rolling_splits(axis: DataFrame, window: int, test_start: Column | None = None) -> DataFrame:
    """(test_idx, test_month, train_start, train_end), one row per test month."""
    if window < 2:
        raise ValueError("A training window needs at least 2 months.")
    months = axis.agg(F.array_sort(F.collect_list(F.struct("month_idx", "month"))).alias("m"))
    splits = months.select(F.col("m.month").alias("m")).select(
        F.posexplode("m").alias("test_idx", "test_month"), "m"
    )
    full = splits.filter(F.col("test_idx") >= window).select(
        "test_idx",
        "test_month",
        F.get("m", F.col("test_idx") - window).alias("train_start"),
        F.get("m", F.col("test_idx") - 1).alias("train_end"),
    )
    return full if test_start is None else full.filter(F.col("test_month") >= test_start)


def require_splits(splits: DataFrame) -> None:
    if splits.isEmpty():
        raise DataCheckError("No test month has a full training window before it.")


def training_rows(indexed: DataFrame, splits: DataFrame, window: int) -> DataFrame:
    """Every row once per split that trains on it, as an equi-join on the test month:
    a row of month i serves the tests i+1 .. i+W, clipped to the first and last split.
    Keep `indexed` narrow."""
    span = splits.agg(
        F.struct(F.min("test_idx").alias("first"), F.max("test_idx").alias("last")).alias("s")
    ).scalar()
    first = F.greatest(F.col("month_idx") + 1, span["first"])
    last = F.least(F.col("month_idx") + window, span["last"])
    return (
        indexed.filter(first <= last)
        .withColumn("test_idx", F.explode(F.sequence(first, last)))
        .join(F.broadcast(splits.select("test_idx")), "test_idx")
    )


def test_rows(indexed: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of the test months with their split's bounds."""
    return indexed.withColumnRenamed("month_idx", "test_idx").join(
        F.broadcast(splits.select("test_idx", "train_start", "train_end")), "test_idx"
    )


def split_rows(
    indexed: DataFrame, splits: DataFrame, window: int, needed: list[str]
) -> DataFrame:
    """Train and test rows of every split, without rows that lack a needed column;
    splits with an empty side are left out."""
    clean = indexed.dropna(subset=needed)
    train = training_rows(clean, splits, window).drop("month_idx")
    test = test_rows(clean, splits).drop("train_start", "train_end")
    months = clean.select("month_idx").distinct()  # decides which splits have both sides
    both = (
        training_rows(months, splits, window)
        .select("test_idx")
        .distinct()
        .join(months.withColumnRenamed("month_idx", "test_idx"), "test_idx")
    )
    rows = train.withColumn("role", F.lit("train")).unionByName(
        test.withColumn("role", F.lit("test"))
    )
    return rows.join(F.broadcast(both), "test_idx")


# ---------------------------------------------------------- validation design


def axis_gaps(axis: DataFrame) -> DataFrame:
    """Months of the axis that are not followed by the next calendar month."""
    months = axis.agg(F.array_sort(F.collect_list("month")).alias("m"))
    pairs = F.arrays_zip(
        F.slice("m", 1, F.size("m") - 1).alias("month"), F.slice("m", 2, F.size("m")).alias("next")
    )
    return (
        months.filter(F.size("m") > 1)
        .select(F.inline(pairs).alias("month", "next_month"))
        .filter(month_ordinal(F.col("next_month")) - month_ordinal(F.col("month")) != 1)
    )


def validation_design(
    axis: DataFrame,
    windows: list[int],
    validation_months: int,
    holdout_months: int | None = None,
    tuning_end: str | None = None,
    mode: str = "at_or_before",
) -> DataFrame:
    """(month_idx, month, role, max_window) with role train, validation or holdout.

    mode `at_or_before`: tuning ends with the last month up to `tuning_end`, and the
    largest window must fit before the first validation month.
    mode `exact`: `tuning_end` must be a month of the panel, the axis must have no
    gaps, and windows that do not fit are dropped; `max_window` is the room there is.
    """
    if mode not in ("at_or_before", "exact"):
        raise ValueError(f"Unknown mode {mode!r}.")
    if validation_months < 1 or not windows:
        raise ValueError("validation_months and windows must be positive.")
    if mode == "exact":
        require_none(axis_gaps(axis), "The panel has a gap in its months.")
    n = axis.count()
    if tuning_end is None:
        reserved = params.HOLDOUT_MONTHS if holdout_months is None else holdout_months
        last = n - reserved - 1
        if reserved < 1 or last < 0:
            raise DataCheckError(f"Cannot hold out {reserved} of {n} months.")
    else:
        end = month_setting(tuning_end)
        test = F.last_day("month") == end if mode == "exact" else F.last_day("month") <= end
        found = axis.filter(test).agg(F.max("month_idx").alias("last")).first().last
        if found is None:
            raise DataCheckError(f"No panel month for the tuning end {tuning_end}.")
        last = found
        if n - last - 1 < 1:
            raise DataCheckError("Tuning must leave at least one month as holdout.")
    first = last - validation_months + 1
    if mode == "at_or_before" and first < max(windows):
        raise DataCheckError(
            f"Only {max(0, last - max(windows) + 1)} validation months remain before "
            f"month {last} with a window of {max(windows)}."
        )
    if mode == "exact":
        if validation_months >= last + 1:
            raise DataCheckError("More validation months than development months.")
        if min(windows) > first:
            raise DataCheckError(f"No window fits; at most {first} months are possible.")
    role = (
        F.when(F.col("month_idx") > last, "holdout")
        .when(F.col("month_idx") >= first, "validation")
        .otherwise("train")
    )
    return axis.select(
        "month_idx", "month", role.alias("role"), F.lit(first).alias("max_window")
    )


def feasible_windows(design: DataFrame, windows: list[int]) -> list[int]:
    room = design.first().max_window
    return sorted({w for w in windows if w <= room})
