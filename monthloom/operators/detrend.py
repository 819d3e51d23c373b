"""Removal of the slow trend that an entity's features share.

Per series: shift to positive, log, Hodrick-Prescott trend, standardised trend.
Per entity: first principal component of the standardised trends, rescaled to the
spread of the average trend and subtracted from every log series.

Only month-by-month matrices are formed. An entity's features are split over groups
of about sqrt(features x 512) rows, each of which sums its own month-by-month matrix;
the groups' matrices are then added up per entity. Both the rows of a group and the
matrices of an entity grow with the square root of its feature count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom import params
from monthloom.functions.arrays import dot, let, mean
from monthloom.operators.checks import DataCheckError
from monthloom.operators.coverage import require_complete_calendar
from monthloom.operators.series import SERIES, pack
from monthloom.operators.skew import join_by_entity
from monthloom.session import cut_lineage

GROUP_SCALE = 512.0


# ------------------------------------------------------------------ per series


def shift_to_positive(packed: DataFrame) -> DataFrame:
    """Add 1 - min to every series whose minimum lies below 1."""
    def moved(low: Column) -> Column:
        return F.when(
            low < 1.0, F.transform("values", lambda v: v + (F.lit(1.0) - low))
        ).otherwise(F.col("values"))

    return packed.withColumn("values", let(F.array_min("values"), moved))


def flag_varying(packed: DataFrame) -> DataFrame:
    return packed.withColumn("varying", F.array_min("values") != F.array_max("values"))


def hp_filter(y: np.ndarray, lam: float) -> np.ndarray:
    """Trend of each row of `y`: solves (I + lam D'D) x = y, D the second difference.

    The matrix is pentadiagonal and common to all rows, so it is factorised once and
    the substitutions run over the months with all rows at a time.
    """
    n = y.shape[1]
    if n < 3:
        return y.copy()
    main, first, second = np.ones(n), np.zeros(n), np.zeros(n)
    main[:-2] += lam
    main[1:-1] += 4.0 * lam
    main[2:] += lam
    first[: n - 2] -= 2.0 * lam
    first[1 : n - 1] -= 2.0 * lam
    second[: n - 2] += lam

    pivot, low1, low2 = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        p, off = main[i], first[i]
        if i >= 1:
            p -= low1[i - 1] ** 2 * pivot[i - 1]
            off -= low1[i - 1] * low2[i - 1] * pivot[i - 1]
        if i >= 2:
            p -= low2[i - 2] ** 2 * pivot[i - 2]
        pivot[i], low1[i], low2[i] = p, off / p, second[i] / p

    x = y.T.astype(float).copy()
    for i in range(1, n):
        x[i] -= low1[i - 1] * x[i - 1]
        if i >= 2:
            x[i] -= low2[i - 2] * x[i - 2]
    x /= pivot[:, None]
    for i in range(n - 2, -1, -1):
        x[i] -= low1[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= low2[i] * x[i + 2]
    return x.T


def _standardise(rows: np.ndarray) -> np.ndarray:
    spread = rows.std(axis=1, keepdims=True)
    spread[spread == 0.0] = 1.0
    return (rows - rows.mean(axis=1, keepdims=True)) / spread


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as rows by months."""
    lengths = pc.list_value_length(column).unique().to_pylist()
    if len(lengths) > 1:
        raise DataCheckError(f"Series of unequal length: {sorted(lengths)} months.")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else [0] * (rows + 1)
    return pa.ListArray.from_arrays(offsets, matrix.ravel())


def _add_trend(batches: Iterator[pa.RecordBatch], lam: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        trend = hp_filter(_matrix(batch.column("logs")), lam)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, _lists(trend), _lists(_standardise(trend))],
            [*batch.schema.names, "trend", "score"],
        )


def with_trend(packed: DataFrame, lam: float = params.HP_LAMBDA) -> DataFrame:
    """Varying series only, with `logs`, `trend` and the standardised `score`. All
    series of a call share one calendar, so an Arrow batch is one dense matrix."""
    logs = packed.filter("varying").select(
        *SERIES, "months", F.transform("values", lambda v: F.log(v)).alias("logs")
    )
    return logs.mapInArrow(
        lambda batches: _add_trend(batches, lam),
        "entity string, feature string, kind string, months array<date>, "
        "logs array<double>, trend array<double>, score array<double>",
    )


# ------------------------------------------------------------------ per entity


def _one_row(**cells) -> pa.Table:
    return pa.table({k: [v.tolist() if isinstance(v, np.ndarray) else v] for k, v in cells.items()})


def _partial_products(group: pa.Table) -> pa.Table:
    """One group's share of the entity's month-by-month matrix and of its trend sum."""
    z = _matrix(group.column("score").combine_chunks())
    trend = _matrix(group.column("trend").combine_chunks())
    gram = z.T @ z
    return _one_row(
        entity=group.column("entity")[0].as_py(),
        n=len(z),
        gram=gram[np.triu_indices(len(gram))],
        trend_sum=trend.sum(axis=0),
    )


def _leading_component(group: pa.Table) -> pa.Table:
    """Score of the first component, unoriented, raw and rescaled."""
    sums = _matrix(group.column("trend_sum").combine_chunks()).sum(axis=0)
    months = len(sums)
    upper = np.triu_indices(months)
    gram = np.zeros((months, months))
    gram[upper] = _matrix(group.column("gram").combine_chunks()).sum(axis=0)
    gram = gram + np.triu(gram, 1).T
    values, vectors = np.linalg.eigh(gram)
    pc1 = vectors[:, -1] * np.sqrt(max(values[-1], 0.0))
    average = sums / pc.sum(group.column("n")).as_py()
    spread = pc1.std(ddof=1) if months > 1 else 0.0
    if not np.isfinite(spread) or spread < 1e-6:
        scaled = np.zeros(months)
    else:
        scaled = (pc1 - pc1.mean()) / spread * average.std(ddof=1)
    return _one_row(
        entity=group.column("entity")[0].as_py(),
        pc1=pc1,
        pc1_rescaled=scaled,
        average_trend=average,
    )


def common_trend(
    shifted: DataFrame, lam: float = params.HP_LAMBDA, orient: str = "loading"
) -> DataFrame:
    """(entity, pc1, pc1_rescaled) as month arrays, from shifted series with `varying`.

    The sign of a component is arbitrary. `loading` makes the largest absolute feature
    loading positive (ties: first feature name); `mean_trend` makes the component move
    with the average trend, which saves one pass over the series.
    """
    if orient not in ("loading", "mean_trend"):
        raise ValueError(f"Unknown orientation {orient!r}.")
    trended = with_trend(shifted, lam)
    # counted before the trend step, which would otherwise run once more for it
    sizes = cut_lineage(
        shifted.filter("varying").groupBy("entity").agg(F.count(F.lit(1)).alias("n_features"))
    )
    n_groups = F.ceil(F.sqrt(F.col("n_features") / F.lit(GROUP_SCALE)))
    partial = (
        join_by_entity(trended.select("entity", "feature", "trend", "score"), sizes)
        .withColumn("part", F.pmod(F.xxhash64("feature"), n_groups))
        .select("entity", "part", "trend", "score")
        .groupBy("entity", "part")
        .applyInArrow(
            lambda table: _partial_products(table),
            "entity string, n long, gram array<double>, trend_sum array<double>",
        )
    )
    component = cut_lineage(
        partial.groupBy("entity").applyInArrow(
            lambda table: _leading_component(table),
            "entity string, pc1 array<double>, pc1_rescaled array<double>, "
            "average_trend array<double>",
        )
    )
    if orient == "mean_trend":
        # the component's scores sum to zero, so the average trend need not be centred
        signed = component.withColumn("pull", dot(F.col("pc1"), F.col("average_trend")))
    else:
        loading = dot(F.col("score"), F.col("pc1"))
        pulls = (
            join_by_entity(
                trended.select("entity", "feature", "score"), component.select("entity", "pc1")
            )
            .select("entity", "feature", loading.alias("loading"))
            .groupBy("entity")
            .agg(F.min_by("loading", F.struct(-F.abs("loading"), "feature")).alias("pull"))
        )
        signed = component.join(pulls, "entity")
    sign = F.when(F.col("pull") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return signed.select(
        "entity",
        F.transform("pc1", lambda x: x * sign).alias("pc1"),
        F.transform("pc1_rescaled", lambda x: x * sign).alias("pc1_rescaled"),
    )


def remove_trend(shifted: DataFrame, trend: DataFrame) -> DataFrame:
    """Subtract the entity's trend from the log, and restore each series' mean.
    Constant series stay as they are, in shifted units. `trend` is a written table."""
    joined = join_by_entity(shifted, trend.select("entity", "pc1_rescaled"), "left")
    flat = F.zip_with("values", "pc1_rescaled", lambda v, p: F.exp(F.log(v) - p))

    def restored(level: Column) -> Column:
        scale = F.coalesce(F.try_divide(mean(F.col("values")), mean(level)), F.lit(1.0))
        return let(scale, lambda s: F.transform(level, lambda v: v * s))

    use = F.col("varying") & F.col("pc1_rescaled").isNotNull()
    return joined.select(
        *SERIES,
        "months",
        F.when(use, let(flat, restored)).otherwise(F.col("values")).alias("values"),
    )


def detrend(
    packed: DataFrame, lam: float = params.HP_LAMBDA, orient: str = "loading"
) -> DataFrame:
    """Packed, complete series of all entities to detrended packed series."""
    shifted = flag_varying(shift_to_positive(packed))
    return remove_trend(shifted, cut_lineage(common_trend(shifted, lam, orient)))


def detrend_long(
    long: DataFrame, lam: float = params.HP_LAMBDA, orient: str = "loading"
) -> DataFrame:
    """Check the common calendar, then detrend a long table; returns packed series."""
    require_complete_calendar(long)
    return detrend(pack(long), lam, orient)
