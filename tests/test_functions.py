import datetime as dt

import pytest
from pyspark.sql import functions as F

from monthloom.functions import arrays, calendar, numeric, text


def one(spark, column, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, month",
    [
        ("2020-01", dt.date(2020, 1, 1)),
        ("  2020-12\t", dt.date(2020, 12, 1)),
        ("2020-3", dt.date(2020, 3, 1)),
        ("2020-13", None),
        ("2020-00", None),
        ("2020-01-05", None),
        ("0000-01", None),
        ("May 2020", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_month(spark, raw, month):
    frame = spark.createDataFrame([(raw,)], "r string")
    assert frame.select(calendar.parse_month(F.col("r")).alias("m")).first().m == month


@pytest.mark.parametrize(
    "raw, value",
    [
        ("<1", 0.5),
        (" <1 ", 0.5),
        ("<2", None),
        ("17", 17.0),
        (" 1.5e2 ", 150.0),
        (".5", 0.5),
        ("1d", None),
        ("1f", None),
        ("0x1A", None),
        ("nan", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_series_value(spark, raw, value):
    frame = spark.createDataFrame([(raw,)], "r string")
    assert frame.select(text.parse_series_value(F.col("r")).alias("v")).first().v == value


def test_month_helpers(spark):
    day = F.lit("2023-12-31").cast("date")
    assert one(spark, calendar.month_ordinal(day)) == 2023 * 12 + 12
    assert one(spark, calendar.next_month_end(day)) == dt.date(2024, 1, 31)
    assert one(spark, calendar.month_text(day)) == "2023-12"
    assert one(spark, calendar.day_text(day)) == "2023-12-31"
    assert one(spark, calendar.month_setting("2024-02")) == dt.date(2024, 2, 29)
    with pytest.raises(Exception):
        one(spark, calendar.month_setting("soon"))


def test_numeric_helpers(spark):
    nan = F.lit(float("nan"))
    assert one(spark, numeric.nan_to_null(nan)) is None
    assert one(spark, numeric.is_finite(nan)) is False
    assert one(spark, numeric.is_finite(F.lit(float("inf")))) is False
    assert one(spark, numeric.is_finite(F.lit(None).cast("double"))) is False
    assert one(spark, numeric.is_finite(F.lit(-2.0))) is True
    assert one(spark, numeric.is_close(F.lit(100.0), F.lit(100.0009))) is True
    assert one(spark, numeric.is_close(F.lit(100.0), F.lit(100.01))) is False
    assert one(spark, numeric.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numeric.log_floored(F.lit(None).cast("double"), 1e-6)) is None
    assert one(spark, numeric.log_floored(F.lit(0.0), 1.0)) == 0.0
    assert one(spark, numeric.level_ape(F.lit(1e-9), F.lit(1.0))) is None
    assert one(spark, numeric.level_ape(F.lit(2.0), F.lit(1.0))) == 0.5


def test_array_helpers(spark):
    xs = F.array(*[F.lit(float(i)) for i in (1, 2, 3)])
    assert one(spark, arrays.mean(xs)) == 2.0
    assert one(spark, arrays.dot(xs, xs)) == 14.0
    assert one(spark, arrays.let(arrays.total(xs), lambda t: t * t)) == 36.0
    assert one(spark, arrays.mean(F.array().cast("array<double>"))) is None


def test_base_name(spark):
    assert one(spark, text.base_name(F.lit("s3://b/x/y/3_US_m_all.csv"))) == "3_US_m_all.csv"
