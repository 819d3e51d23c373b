"""The driver tables as series, rates and files of the panel model.

Money is summed in whole cents, so a sum does not depend on the order in which
partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.functions.calendar import month_end, month_start
from monthloom.operators.coverage import calendar_array, skeleton
from monthloom.operators.series import SERIES
from monthloom.params import BreakRule
from monthloom.session import cut_lineage

TOPIC_TYPES = ("PROMO", "STANDARD")
BREAKS = BreakRule(
    category=("1997-01-01", "1999-01-01"),
    topic=("1997-01-01", "1999-01-01", "2000-01-01"),
)
WINDOW, VALIDATION, HOLDOUT = 24, 6, 12
WINDOWS, LAGS = (12, 24, 36), (0, 1, 2, 3)
REFERENCE_REGION, REFERENCE_NATION = "AFRICA", "NATION_0"
#: Entity code by customer nation; a nation that is not listed has none.
AREA_CODES = {f"NATION_{k}": f"N{k:02d}" for k in range(0, 25, 2)}
WORDS_ONLY, REPEATING = "NATION_3", "NATION_5"
EXCLUDED_SERIES = ("10050", "10100", "20")
EXCLUDED_ENTITIES = ("NATION_3", "NATION_7")
DIMENSIONS = {"o_orderstatus": "F", "o_orderpriority": "5-LOW"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: str) -> Column:
    return F.floor(F.col(col) * 100.0 + 0.5)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nationkey, nation, region)"""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").alias("nationkey"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their supplier's nation and region and their part."""
    supplier = (
        table(spark, sf_dir, "supplier")
        .join(places(spark, sf_dir), F.col("s_nationkey") == F.col("nationkey"))
        .select("s_suppkey", "nation", "region")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )


def feature_series(
    spark: SparkSession, sf_dir: str, grain: str = "region", by_brand: bool = False
) -> DataFrame:
    """Long series: shipped value by entity, part type (and brand) and month."""
    feature = F.concat_ws("_", "p_brand", "p_type") if by_brand else F.col("p_type")
    kind = F.when(F.col("p_type").isin(*TOPIC_TYPES), "topic").otherwise("category")
    return (
        shipments(spark, sf_dir)
        .groupBy(
            F.col(grain).alias("entity"),
            feature.alias("feature"),
            kind.alias("kind"),
            month_start(F.col("l_shipdate")).alias("month"),
        )
        .agg((F.sum(cents("l_extendedprice")).cast("double") / 100.0).alias("value"))
    )


def filled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region series on the complete calendar; absent cells count as no shipments."""
    long = cut_lineage(feature_series(spark, sf_dir))
    return (
        skeleton(long)
        .join(long, [*SERIES, "month"], "left")
        .select(*SERIES, "month", F.coalesce("value", F.lit(0.0)).alias("value"))
    )


def brand_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finer feature, brand by type by size, with uneven coverage over nations."""
    feature = F.concat_ws("_", "p_brand", "p_type", F.col("p_size").cast("string"))
    return shipments(spark, sf_dir).select(F.col("nation").alias("entity"), feature.alias("feature"))


def rates(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    """Level by entity and month end: mean order value in 10,000s. At the grain of a
    customer there are months without an order, so gaps of every length, at any scale."""
    entity = (
        F.concat(F.lit("CUSTOMER_"), F.col("c_custkey").cast("string"))
        if grain == "customer"
        else F.col(grain)
    )
    customer = (
        table(spark, sf_dir, "customer")
        .join(places(spark, sf_dir), F.col("c_nationkey") == F.col("nationkey"))
        .select("c_custkey", entity.alias("entity"))
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_custkey", "o_totalprice", "o_orderdate")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("entity", month_end(F.col("o_orderdate").cast("date")).alias("month"))
        .agg(F.sum(cents("o_totalprice")).alias("sum_cents"), F.count(F.lit(1)).alias("n_orders"))
        .select(
            "entity",
            "month",
            (F.col("sum_cents").cast("double") / F.col("n_orders") / 1e6).alias("level"),
        )
    )


def panel_keys(rate_rows: DataFrame) -> DataFrame:
    """Every entity with every month end from the first to the last of the table."""
    months = calendar_array(rate_rows.select(month_start(F.col("month")).alias("month")))
    return (
        rate_rows.select("entity")
        .distinct()
        .withColumn("month", F.explode(months))
        .withColumn("month", F.last_day("month"))
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, entity): each part that a nation shipped stands for one series file."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    supplier = (
        table(spark, sf_dir, "supplier")
        .join(places(spark, sf_dir), F.col("s_nationkey") == F.col("nationkey"))
        .select("s_suppkey", F.col("nation").alias("entity"))
    )
    return (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select((F.col("l_partkey") * 10).cast("string").alias("series_id"), "entity")
        .distinct()
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, name) of all parts."""
    series_id = F.col("p_partkey") * 10
    return (
        table(spark, sf_dir, "part")
        .select(
            series_id.cast("string").alias("series_id"),
            F.concat(
                F.when(series_id >= 10000, "t_").otherwise(""),
                F.regexp_replace("p_name", " ", "_"),
                F.lit("_"),
                F.col("p_size").cast("string"),
            ).alias("name"),
        )
    )


def series_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): the nation series as the text files they would come in, with the
    faults such files have. By its last digit a cell is censored, blank or misspelt; files
    of one nation hold no number, and those of another repeat each January."""
    digit = F.col("cents") % 10
    number = (F.col("cents").cast("double") / 100.0).cast("decimal(20,2)").cast("string")
    cell = (
        F.when(F.col("entity") == WORDS_ONLY, F.lit("n/a"))
        .when(digit == 0, "<1")
        .when(digit == 1, "")
        .when(digit == 2, F.concat(number, F.lit("d")))
        .when(digit == 3, F.concat(F.lit("  "), number, F.lit(" ")))
        .otherwise(number)
    )
    line = F.concat(F.date_format("month", "yyyy-MM"), F.lit(","), cell)
    twice = (F.col("entity") == REPEATING) & (F.month("month") == 1)
    text = F.concat(
        F.lit("id,series\nunit,x\n"),
        F.array_join(F.array_sort(F.flatten(F.collect_list("lines"))), "\n"),
        F.lit("\n"),
    )
    return (
        shipments(spark, sf_dir)
        .groupBy(F.col("nation").alias("entity"), "p_type", month_start(F.col("l_shipdate")).alias("month"))
        .agg(F.sum(cents("l_extendedprice")).alias("cents"))
        .select(
            F.concat_ws("/", "entity", "p_type").alias("path"),
            F.when(twice, F.array(line, line)).otherwise(F.array(line)).alias("lines"),
        )
        .groupBy("path")
        .agg(F.encode(text, "UTF-8").alias("content"))
    )


def rate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the text rows of a rate file: by its last digit a key spoils its month or
    its value."""
    digit = F.col("o_orderkey") % 10
    price = (cents("o_totalprice").cast("double") / 100.0).cast("decimal(20,2)").cast("string")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf_dir, "orders")
        .select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("REF_AREA"),
            F.when(digit == 1, "soon")
            .otherwise(F.date_format("o_orderdate", "yyyy-MM"))
            .alias("TIME_PERIOD"),
            F.when(digit == 2, F.concat(price, F.lit("f"))).otherwise(price).alias("OBS_VALUE"),
        )
    )
