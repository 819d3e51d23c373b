"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import gc
import tempfile
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(master: str, shuffle_partitions: int, app: str = "monthloom") -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only where none is named (tests,
    one machine) a fresh temporary folder is set, once per session."""
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(
        CHECKPOINT_SETTING
    )
    current = context.getCheckpointDir()
    if current is None:
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder every executor can reach.")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="monthloom-checkpoint-"))
    return named or context.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """The session's part of the shared folder; `release` deletes it."""
    return _scratch(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's part of the shared folder."""
    return f"{_scratch(spark)}/{name}-{uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/staged/{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and go on from the files: several
    consumers share one computation, later plans prune columns and know sizes, and a
    lost executor costs a read. `release` deletes what a session has staged."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    if scope := _innermost(spark):
        scope.made.append((staged, path))
    return staged


class _Scope:
    def __init__(self):
        self.made: list[tuple[DataFrame, str]] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df


#: Open scopes of the running thread and session, innermost last. Another thread, such as one
#: that fits a model, has its own: what it stages is not deleted with someone else's scope.
_open: ContextVar[tuple[tuple[str, _Scope], ...]] = ContextVar("open_scopes", default=())


def _innermost(spark: SparkSession) -> _Scope | None:
    own = [scope for app, scope in _open.get() if app == spark.sparkContext.applicationId]
    return own[-1] if own else None


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are deleted at the end, but for those given to `keep` and any
    that are read later: give all of them. The driver is asked to collect its garbage, upon
    which Spark removes the shuffle files of the finished steps from all executors."""
    scope = _Scope()
    token = _open.set((*_open.get(), (spark.sparkContext.applicationId, scope)))
    try:
        yield scope
    finally:
        _open.reset(token)
    outer = _innermost(spark)
    for df, path in scope.made:
        if not any(df is k for k in scope.kept):
            _delete(spark, path)
        elif outer:
            outer.made.append((df, path))
    reclaim(spark)


def reclaim(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def path_exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete the tables this session has staged; call it when their results are written."""
    _delete(spark, _scratch(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """`stage` under the name the monthly panel jobs use."""
    return stage(df)
