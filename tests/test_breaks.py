import datetime as dt
import math
import random

import pytest

from monthloom.operators.breaks import adjust_breaks, break_window_means
from monthloom.operators.series import pack, unpack
from monthloom.params import BreakRule

LONG = "entity string, feature string, kind string, month date, value double"


def months(start_year, n):
    return [dt.date(start_year + i // 12, i % 12 + 1, 1) for i in range(n)]


def long_frame(spark, series):
    """series: {(entity, feature, kind): [(month, value), ...]}"""
    rows = [(*key, m, v) for key, pairs in series.items() for m, v in pairs]
    return spark.createDataFrame(rows, LONG)


def shift(day, k):
    o = day.year * 12 + day.month - 1 + k
    return dt.date(o // 12, o % 12 + 1, 1)


def sequential(pairs, days, rule):
    """Adjust one break after the other on the adjusted series."""
    pairs = sorted((m, v) for m, v in pairs if v is not None and not math.isnan(v))
    for day in sorted(dt.date.fromisoformat(d) for d in days):
        if not pairs or day < pairs[0][0] or day > pairs[-1][0]:
            continue
        before = [v for m, v in pairs if shift(day, -rule.window_months) <= m < day]
        after = [v for m, v in pairs if day <= m < shift(day, rule.window_months)]
        if not before or not after:
            continue
        b, a = sum(before) / len(before), sum(after) / len(after)
        if a < rule.min_level or abs(b / a - 1) < rule.min_change:
            continue
        pairs = [(m, v * b / a if m >= day else v) for m, v in pairs]
    return dict(pairs)


def collected(frame):
    out = {}
    for r in unpack(frame).collect():
        out.setdefault((r.entity, r.feature, r.kind), {})[r.month] = r.value
    return out


RULE = BreakRule(category=("2011-01-01", "2013-01-01"), topic=("2011-01-01", "2012-01-01", "2014-01-01"))


def random_series(seed):
    rng = random.Random(seed)
    span = months(2009, 84)
    series = {}
    for i in range(40):
        kind = rng.choice(["topic", "category"])
        first, last = sorted(rng.sample(range(85), 2))
        zero = range(*sorted(rng.sample(range(84), 2))) if rng.random() < 0.4 else ()
        series[("E", f"f{i}", kind)] = [
            (m, None if rng.random() < 0.1 else 0.0 if j in zero else rng.uniform(0.5, 60))
            for j, m in enumerate(span)
            if first <= j <= last
        ]
    return {k: v for k, v in series.items() if v}


@pytest.mark.parametrize(
    "rule",
    [
        RULE,
        # closer than a window: one pass per break
        BreakRule(category=("2011-01-01", "2011-05-01", "2011-07-01"), topic=("2012-01-01", "2012-03-01")),
    ],
)
def test_matches_sequential_adjustment(spark, rule):
    series = random_series(7)
    got = collected(adjust_breaks(long_frame(spark, series), rule))
    for key, pairs in series.items():
        want = sequential(pairs, rule.topic if key[2] == "topic" else rule.category, rule)
        have = got.get(key, {})
        assert have.keys() == want.keys()
        for m in want:
            assert have[m] == pytest.approx(want[m], rel=1e-11, abs=1e-12)


def test_edge_cases(spark):
    rule = BreakRule(category=("2011-01-01", "2013-01-01"), topic=())
    span = months(2010, 60)
    cat = lambda name: ("E", name, "category")
    level = lambda f: [(m, f(m)) for m in span]
    series = {
        cat("late"): [(m, 5.0) for m in span if m.year >= 2011],
        cat("within1pct"): level(lambda m: 100.0 if m.year < 2011 else 100.5),
        cat("tiny_after"): level(lambda m: 5.0 if m.year < 2011 else 1e-9),
        cat("zero_before"): level(lambda m: 0.0 if m.year < 2011 else 5.0),
        cat("doubled"): level(lambda m: 5.0 if m.year < 2011 else 10.0),
    }
    got = collected(adjust_breaks(long_frame(spark, series), rule))
    assert set(got[cat("late")].values()) == {5.0}
    assert got[cat("within1pct")][span[-1]] == 100.5
    assert got[cat("tiny_after")][span[-1]] == 1e-9
    assert {v for m, v in got[cat("zero_before")].items() if m.year >= 2011} == {0.0}
    assert set(got[cat("doubled")].values()) == {5.0}


def test_values_before_the_first_break_stay(spark):
    series = random_series(11)
    got = collected(adjust_breaks(long_frame(spark, series), RULE))
    for key, pairs in series.items():
        for m, v in pairs:
            if m < dt.date(2011, 1, 1) and v is not None:
                assert got[key][m] == v


def test_window_means_use_the_kinds_calendar(spark):
    series = {("E", "a", "topic"): [(m, 1.0) for m in months(2010, 60)],
              ("E", "b", "category"): [(m, 2.0) for m in months(2010, 60)]}
    rows = break_window_means(long_frame(spark, series), RULE).collect()
    assert {(r.feature, r.break_date.year) for r in rows} == {
        ("a", 2011), ("a", 2012), ("a", 2014), ("b", 2011), ("b", 2013)
    }
    assert all(r.raw_ratio == 1.0 for r in rows)


def test_no_shuffle_between_close_breaks(spark):
    """The further passes of close breaks reuse the partitioning of the first."""
    rule = BreakRule(category=("2011-01-01", "2011-05-01", "2011-07-01"), topic=())
    frame = adjust_breaks(long_frame(spark, random_series(3)), rule)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pack_drops_missing(spark):
    key = ("E", "a", "topic")
    frame = long_frame(spark, {key: [(dt.date(2020, 2, 1), 2.0), (dt.date(2020, 1, 1), 1.0),
                                     (dt.date(2020, 3, 1), None), (dt.date(2020, 4, 1), float("nan"))]})
    row = pack(frame).first()
    assert row["values"] == [1.0, 2.0]
    assert row.months == [dt.date(2020, 1, 1), dt.date(2020, 2, 1)]
