import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.operators import forecast, splits
from monthloom.operators.checks import DataCheckError


def month_end(i):
    y, m = 2000 + i // 12, i % 12 + 1
    return dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1)


def axis_of(spark, indices):
    rows = [(month_end(i),) for i in indices]
    return splits.month_axis(spark.createDataFrame(rows + rows[:1], "month date"))


def test_windows_count_panel_months(spark):
    """The window runs over the months that the panel has, also across a gap."""
    axis = axis_of(spark, [0, 1, 2, 5, 6])
    rows = splits.rolling_splits(axis, 3).orderBy("test_idx").collect()
    assert [(r.test_idx, r.test_month, r.train_start, r.train_end) for r in rows] == [
        (3, month_end(5), month_end(0), month_end(2)),
        (4, month_end(6), month_end(1), month_end(5)),
    ]
    late = splits.rolling_splits(axis, 3, F.lit(month_end(6)))
    assert [r.test_idx for r in late.collect()] == [4]
    with pytest.raises(ValueError):
        splits.rolling_splits(axis, 1)
    with pytest.raises(DataCheckError):
        splits.require_splits(splits.rolling_splits(axis, 5))


def test_split_rows_skip_empty_sides(spark):
    rows = [("A", month_end(i), None if i == 4 else 1.0) for i in range(6)]
    frame = spark.createDataFrame(rows, "entity string, month date, target double")
    axis = splits.month_axis(frame)
    out = splits.split_rows(
        splits.with_month_idx(frame, axis), splits.rolling_splits(axis, 2), 2, ["target"]
    )
    counts = {(r.test_idx, r.role): r["count"] for r in out.groupBy("test_idx", "role").count().collect()}
    # test month 4 has no row with a target; test month 5 trains on month 3 only
    assert counts == {
        (2, "train"): 2, (2, "test"): 1, (3, "train"): 2, (3, "test"): 1,
        (5, "train"): 1, (5, "test"): 1,
    }


def design(spark, n, mode, **options):
    axis = axis_of(spark, range(n))
    out = splits.validation_design(axis, [12, 24], 6, mode=mode, **options)
    rows = out.orderBy("month_idx").collect()
    return [r.role for r in rows], rows[0].max_window, out


def test_validation_design(spark):
    roles, room, _ = design(spark, 60, "at_or_before", holdout_months=10)
    assert (roles.count("train"), roles.count("validation"), roles.count("holdout")) == (44, 6, 10)
    assert room == 44
    # default holdout of 24 months leaves too little for the largest window
    with pytest.raises(DataCheckError, match="validation months remain"):
        design(spark, 50, "at_or_before")
    # the other mode drops the window that does not fit
    _, room, frame = design(spark, 50, "exact")
    assert room == 20 and splits.feasible_windows(frame, [12, 24]) == [12]
    with pytest.raises(DataCheckError, match="No window fits"):
        design(spark, 40, "exact")


def test_tuning_end(spark):
    roles, _, _ = design(spark, 60, "at_or_before", tuning_end="2004-03")
    assert roles.count("holdout") == 60 - 51
    axis = axis_of(spark, [i for i in range(60) if i != 50])
    out = splits.validation_design(axis, [12], 6, tuning_end="2004-03", mode="at_or_before")
    assert out.filter("role = 'holdout'").count() == 9
    with pytest.raises(DataCheckError, match="gap in its months.*2004-02"):
        splits.validation_design(axis, [12], 6, tuning_end="2004-02", mode="exact")
    with pytest.raises(DataCheckError, match="No panel month"):
        design(spark, 60, "exact", tuning_end="2030-01")
    with pytest.raises(DataCheckError, match="No panel month"):
        design(spark, 60, "at_or_before", tuning_end="1990-01")
    with pytest.raises(DataCheckError, match="at least one month as holdout"):
        design(spark, 60, "exact", tuning_end="2004-12")
    with pytest.raises(DataCheckError, match="Cannot hold out"):
        design(spark, 20, "exact", holdout_months=20)


# ------------------------------------------------------------------ regression


def dummy_ols(train, test, entities, reference):
    """Least squares with intercept and dummies: centred design, smallest coefficients."""
    columns = [e for e in entities if e != reference]

    def design_matrix(rows):
        return np.array([[x, *[float(e == c) for c in columns]] for e, x, _ in rows])

    a, y = design_matrix(train), np.array([r[2] for r in train])
    coef, *_ = np.linalg.lstsq(a - a.mean(axis=0), y - y.mean(), rcond=1e-10)
    return (design_matrix(test) - a.mean(axis=0)) @ coef + y.mean()


def fixed(spark, train, test, reference):
    """One test month, with all training rows in the month before it."""
    schema = "test_idx int, entity string, x double, y double"
    rows = spark.createDataFrame([(0, *r) for r in train], schema).withColumnRenamed("test_idx", "month_idx")
    asked = spark.createDataFrame([(1, *r) for r in test], schema)
    moments = forecast.rolling_moments(rows.repartition(3), asked, 2)
    out = forecast.fixed_effect_forecasts(moments, asked, ["test_idx"], reference)
    return {(r.entity, r.x): (r.prediction, r.rank_deficient) for r in out.collect()}


def sample(seed, entities, n=12, constant_x=False):
    rng = np.random.default_rng(seed)
    base = {e: rng.uniform(2, 9) for e in entities}
    return [
        (e, float(base[e] + (0 if constant_x else rng.normal())), float(rng.normal() + base[e] / 5))
        for e in entities
        for _ in range(n)
    ]


@pytest.mark.parametrize(
    "trained, deficient",
    [
        ("ABCD", set()),
        ("ABC", {"D"}),           # an entity without training rows
        ("BCD", set("ABCD")),     # the reference itself is absent
        ("BC", set("ABCD")),
    ],
)
@pytest.mark.parametrize("constant_x", [False, True])
def test_fixed_effects_equal_dummy_ols(spark, trained, deficient, constant_x):
    entities = "ABCD"
    train = sample(4, trained, constant_x=constant_x)
    test = [(e, 5.5 + i, 0.0) for i, e in enumerate(entities)]
    got = fixed(spark, train, test, "A")
    want = dummy_ols(train, test, entities, "A")
    for (e, x, _), value in zip(test, want):
        prediction, flag = got[e, x]
        assert prediction == pytest.approx(value, rel=1e-9, abs=1e-9), e
        assert flag == (constant_x or e in deficient)


def test_slope_ignores_entity_constants(spark):
    train = sample(9, "ABC")
    test = [("A", 3.0, 0.0)]
    moved = [(e, x, y + {"A": 0, "B": 100, "C": -40}[e]) for e, x, y in train]
    a, b = fixed(spark, train, test, "A"), fixed(spark, moved, test, "A")
    assert a["A", 3.0][0] == pytest.approx(b["A", 3.0][0], abs=1e-9)


def test_rolling_autoregression_equals_refits(spark):
    rng = np.random.default_rng(2)
    rows = [
        (e, month_end(i), float(rng.normal(5)), float(rng.normal()))
        for e in "ABC"
        for i in range(20)
        if not (e == "C" and 3 <= i <= 11)
    ]
    frame = spark.createDataFrame(rows, "entity string, month date, level_lag1 double, target double")
    axis = splits.month_axis(frame)
    indexed = splits.with_month_idx(frame, axis)
    windows = splits.rolling_splits(axis, 6)
    got = forecast.pooled_ar(indexed, windows, 6, reference="A").collect()
    idx = {month_end(i): i for i in range(20)}
    assert len(got) == sum(idx[r[1]] >= 6 for r in rows)
    for r in got:
        t = idx[r.month]
        train = [(e, x, y) for e, m, x, y in rows if t - 6 <= idx[m] < t]
        x = next(x for e, m, x, _ in rows if e == r.entity and m == r.month)
        want = dummy_ols(train, [(r.entity, x, 0.0)], "ABC", "A")[0]
        assert r.prediction == pytest.approx(want, abs=1e-9)
        assert (r.train_start, r.train_end) == (month_end(t - 6), month_end(t - 1))
    walk = forecast.random_walk(indexed, windows)
    assert walk.columns == list(forecast.PREDICTION_COLUMNS)
    assert {r.prediction for r in walk.collect()} == {0.0} and walk.count() == len(got)


def test_moments_are_those_of_each_window(spark):
    rng = np.random.default_rng(5)
    rows = [
        (e, i, float(rng.normal()), float(rng.normal()))
        for e in "AB"
        for i in range(14)
        if rng.random() < 0.7 and not (e == "B" and i > 9)
    ]
    frame = spark.createDataFrame(rows, "entity string, month_idx int, x double, y double")
    tests = spark.createDataFrame([(t,) for t in range(5, 14)], "test_idx int")
    found = {(r.entity, r.test_idx): r for r in forecast.rolling_moments(frame, tests, 4).collect()}
    for e in "AB":
        for t in range(5, 14):
            inside = [(x, y) for f, i, x, y in rows if f == e and t - 4 <= i <= t - 1]
            assert ((e, t) in found) == bool(inside)
            if inside:
                x, y = np.array(inside).T
                assert found[e, t].mean_x == pytest.approx(x.mean())
                assert found[e, t].sxy == pytest.approx(((x - x.mean()) * (y - y.mean())).sum(), abs=1e-9)
