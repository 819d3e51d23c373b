"""Rolling gradient-boosted trees with Spark ML, one distributed fit per split."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom import params
from monthloom.operators import packed
from monthloom.operators.checks import DataCheckError
from monthloom.operators.forecast import prediction_rows
from monthloom.operators.splits import month_axis, with_month_idx
from monthloom.operators.target import TARGET
from monthloom.session import path_exists, scratch_path, scratch_root

#: Training rows in a partition of a fit, unless the settings name the number of partitions.
#: Spark ML samples rows by partition and place, so the number follows from the window's rows
#: alone: the same data give the same trees on any cluster.
ROWS_PER_PARTITION = 20_000
DEPTHWISE = "Boosted trees (depth-wise)"
LEAFWISE = "Boosted trees (leaf-wise)"


@dataclass(frozen=True)
class BoostingSettings:
    """Tree settings in the study's terms.

    `column_fraction` is drawn per tree node, and `min_gain` is in Spark ML's scale.
    Leaf penalties do not exist in Spark ML, so a non-zero one is refused.
    """

    model: str = DEPTHWISE
    n_estimators: int = 300
    learning_rate: float = 0.03
    max_depth: int = 3
    num_leaves: int | None = None
    min_rows: float = 10
    min_gain: float = 0.0
    subsample: float = 0.8
    column_fraction: float = 0.6
    max_bin: int = 256
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    seed: int = params.SEED
    fit_partitions: int | None = None

    def __post_init__(self) -> None:
        if self.n_estimators < 1:
            raise ValueError("n_estimators must be positive.")
        if self.fit_partitions is not None and self.fit_partitions < 1:
            raise ValueError("fit_partitions must be positive.")
        if self.reg_alpha or self.reg_lambda:
            raise ValueError("Spark ML has no L1 or L2 leaf penalty; set both to 0.")

    @property
    def depth(self) -> int:
        """Depth bound; a leaf limit of L allows ceil(log2 L) levels."""
        if self.num_leaves is None:
            return self.max_depth
        return max(1, min(self.max_depth, math.ceil(math.log2(self.num_leaves))))

    def partitions(self, n_rows: int) -> int:
        return self.fit_partitions or max(1, math.ceil(n_rows / ROWS_PER_PARTITION))

    def regressor(self, target: str) -> GBTRegressor:
        fraction = "all" if self.column_fraction >= 1.0 else str(self.column_fraction)
        return GBTRegressor(
            featuresCol="features_vec",
            labelCol=target,
            predictionCol="prediction",
            maxIter=self.n_estimators,
            stepSize=self.learning_rate,
            maxDepth=self.depth,
            minInstancesPerNode=max(1, math.ceil(self.min_rows)),
            minInfoGain=self.min_gain,
            subsamplingRate=self.subsample,
            featureSubsetStrategy=fraction,
            maxBins=self.max_bin,
            seed=self.seed,
        )


def leafwise_defaults(**changes) -> BoostingSettings:
    settings = dict(
        model=LEAFWISE, max_depth=4, num_leaves=15, min_rows=30, max_bin=255
    )
    return BoostingSettings(**{**settings, **changes})


@dataclass(frozen=True)
class StagedPanel:
    """The panel with month numbers, written by month, and its list of months. A fit
    reads only the partitions of its own window."""

    rows: DataFrame
    months: list
    target: str


def stage(
    panel: DataFrame,
    columns: Sequence[str],
    target: str = TARGET,
    axis: DataFrame | None = None,
) -> StagedPanel:
    """Write keys, target and the given columns once for all fits. Month numbers count
    the months of the whole panel."""
    axis = month_axis(panel) if axis is None else axis
    spark = panel.sparkSession
    folder = scratch_path(spark, "panel")
    (
        with_month_idx(panel, axis)
        .select("month_idx", "month", "entity", target, *columns)
        .filter(F.col(target).isNotNull())
        # rows of a month go together; adaptive execution splits large months and merges
        # small ones, so files have a sensible size at any scale
        .hint("rebalance", "month_idx")
        .write.partitionBy("month_idx")
        .parquet(folder)
    )
    months = [r.month for r in axis.orderBy("month_idx").collect()]
    return StagedPanel(spark.read.parquet(folder), months, target)


@dataclass(frozen=True)
class RollingData:
    """The rows of a staged panel that have all of some features, and how many each
    month has."""

    rows: DataFrame
    months: list
    counts: dict[int, int]
    features: tuple[str, ...]
    target: str
    #: (position, feature) of a design that is one vector already; then `features` is empty.
    names: DataFrame | None = None

    def n_train(self, test_idx: int, window: int) -> int:
        return sum(self.counts.get(i, 0) for i in range(test_idx - window, test_idx))


def with_features(staged: StagedPanel, features: Sequence[str]) -> RollingData:
    rows = staged.rows.dropna(subset=list(features))
    counts = {r.month_idx: r["count"] for r in rows.groupBy("month_idx").count().collect()}
    return RollingData(rows, staged.months, counts, tuple(features), staged.target)


def prepare_packed(
    rows: DataFrame,
    dictionary: DataFrame,
    entities: DataFrame,
    more: Sequence[str] = (),
    target: str = TARGET,
    axis: DataFrame | None = None,
) -> RollingData:
    """The rolling data of a packed panel; `more` are further columns, such as lags. The plan
    does not grow with the number of features."""
    vectors = packed.design(rows.dropna(subset=list(more)) if more else rows, entities, more)
    staged = stage(vectors, ["features_vec"], target, month_axis(rows) if axis is None else axis)
    counts = {r.month_idx: r["count"] for r in staged.rows.groupBy("month_idx").count().collect()}
    names = packed.design_names(dictionary, entities, more)
    return RollingData(staged.rows, staged.months, counts, (), target, names)


def prepare(
    panel: DataFrame, features: Sequence[str], target: str = TARGET, axis: DataFrame | None = None
) -> RollingData:
    return with_features(stage(panel, features, target, axis), features)


def fit_split(data: RollingData, test_idx: int, window: int, settings: BoostingSettings) -> PipelineModel:
    """The rows are laid out by their content alone, so a fit can be repeated exactly."""
    train = (
        data.rows.filter(F.col("month_idx").between(test_idx - window, test_idx - 1))
        .repartition(settings.partitions(data.n_train(test_idx, window)), "entity", "month")
        .sortWithinPartitions("month_idx", "entity")
    )
    stages = [settings.regressor(data.target)]
    if data.names is None:
        stages.insert(0, VectorAssembler(inputCols=list(data.features), outputCol="features_vec"))
    return Pipeline(stages=stages).fit(train)


def predict_split(
    data: RollingData, model: PipelineModel, test_idx: int, window: int, name: str
) -> DataFrame:
    test = (
        data.rows.filter(F.col("month_idx") == test_idx)
        .withColumn("train_start", F.lit(data.months[test_idx - window]))
        .withColumn("train_end", F.lit(data.months[test_idx - 1]))
    )
    return prediction_rows(
        model.transform(test), name, F.col(data.target), F.col("prediction")
    )


def usable_splits(
    data: RollingData, window: int, test_idx: Sequence[int] | None = None
) -> list[int]:
    """Test months with a full window and rows on both sides."""
    wanted = range(len(data.months)) if test_idx is None else test_idx
    return [
        t
        for t in wanted
        if t >= window and data.counts.get(t, 0) and data.n_train(t, window)
    ]


@dataclass(frozen=True)
class RollingResult:
    """Forecasts, importances and the last model; `fitted` are the splits this run had to fit."""

    predictions: DataFrame
    importances: DataFrame
    last_model: PipelineModel
    fitted: tuple[int, ...] = ()


def _version(rows: DataFrame) -> str:
    """A digest of the rows, whatever their order and layout: two sums of row hashes."""
    row = F.struct(*sorted(rows.columns))
    found = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(row).cast("decimal(20,0)")).alias("a"),
        F.bit_xor(F.xxhash64(row, F.lit(1))).alias("b"),
    ).first()
    return f"{found.n}-{found.a}-{found.b}"


def fit_digest(data: RollingData, window: int, settings: BoostingSettings) -> str:
    """What a fit depends on: settings, window, features, target, months and rows."""
    record = [asdict(settings), window, data.features, data.target, [str(m) for m in data.months]]
    versions = [_version(data.rows), _version(data.names) if data.names is not None else None]
    text = json.dumps([*record, *versions], sort_keys=True, default=list)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def _commit_split(
    folder: str, data: RollingData, t: int, window: int, settings: BoostingSettings, keep_model: bool
) -> None:
    """Fit one split and write its importances, its model if it is the last, and its forecasts.
    The forecasts come last: the marker that Spark leaves on them commits the split."""
    spark = data.rows.sparkSession
    model = fit_split(data, t, window, settings)
    weights = model.stages[-1].featureImportances
    held = [(t, int(i), float(w)) for i, w in zip(weights.indices, weights.values)]
    spark.createDataFrame(held, "test_idx int, position int, importance double").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{folder}/importances/split={t}")
    if keep_model:
        model.write().overwrite().save(f"{folder}/models/split={t}")
    forecast = predict_split(data, model, t, window, settings.model)
    forecast.write.mode("overwrite").parquet(f"{folder}/predictions/split={t}")


def rolling_boosting(
    data: RollingData,
    window: int,
    settings: BoostingSettings,
    test_idx: Sequence[int] | None = None,
    parallel_fits: int | None = None,
    log_folder: str | None = None,
) -> RollingResult:
    """Fit and forecast every split; as many fits run side by side as the cluster has cores,
    at most eight, unless `parallel_fits` says otherwise.

    Below `log_folder` (by default the session's scratch) a split is committed in a folder
    named by a digest of settings, features and rows. A run that was stopped, or another one
    that needs the same fits, takes the committed splits and fits the others only.
    """
    spark: SparkSession = data.rows.sparkSession
    splits = usable_splits(data, window, test_idx)
    if not splits:
        raise DataCheckError("No split has training and test rows.")
    log = log_folder or f"{scratch_root(spark)}/fits"
    folder = f"{log.rstrip('/')}/{fit_digest(data, window, settings)}"
    done = {t for t in splits if path_exists(spark, f"{folder}/predictions/split={t}/_SUCCESS")}
    if splits[-1] in done and not path_exists(spark, f"{folder}/models/split={splits[-1]}/metadata/_SUCCESS"):
        done.discard(splits[-1])  # it was not the last split of the run that committed it
    left = [t for t in splits if t not in done]

    def run(t: int) -> None:
        _commit_split(folder, data, t, window, settings, keep_model=t == splits[-1])

    slots = parallel_fits or min(8, spark.sparkContext.defaultParallelism)
    with ThreadPoolExecutor(max_workers=slots) as pool:
        for _ in pool.map(inheritable_thread_target(spark)(run), left):
            pass
    predictions = spark.read.parquet(*[f"{folder}/predictions/split={t}" for t in splits])
    held = spark.read.schema("test_idx int, position int, importance double").parquet(
        *[f"{folder}/importances/split={t}" for t in splits]
    )
    return RollingResult(
        predictions,
        named_importances(held, data, splits),
        PipelineModel.load(f"{folder}/models/split={splits[-1]}"),
        tuple(left),
    )


def named_importances(held: DataFrame, data: RollingData, splits: Sequence[int]) -> DataFrame:
    """(test_idx, feature, importance) of every split and feature; those without a use are 0."""
    spark = held.sparkSession
    names = data.names
    if names is None:
        names = spark.createDataFrame(list(enumerate(data.features)), "position int, feature string")
    every = names.withColumn("test_idx", F.explode(F.array(*(F.lit(t) for t in splits))))
    return every.join(held, ["test_idx", "position"], "left").select(
        "test_idx", "feature", F.coalesce("importance", F.lit(0.0)).alias("importance")
    )


def normalised(importances: DataFrame) -> DataFrame:
    """Shares per split; a split whose importances sum to zero stays as it is."""
    totals = importances.groupBy("test_idx").agg(F.sum("importance").alias("total"))
    share = F.when(F.col("total") > 0, F.col("importance") / F.col("total"))
    return importances.join(totals, "test_idx").select(
        "test_idx", "feature", F.coalesce(share, F.col("importance")).alias("importance")
    )


def importance_table(importances: DataFrame) -> DataFrame:
    """Mean and population spread of each feature's share over the splits."""
    return (
        normalised(importances)
        .groupBy("feature")
        .agg(
            F.avg("importance").alias("mean_importance"),
            F.stddev_pop("importance").alias("importance_std"),
        )
        .orderBy(F.desc("mean_importance"), "feature")
    )
