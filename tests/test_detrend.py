import datetime as dt
import re

import numpy as np
import pytest

from monthloom.operators import detrend, skew, transforms
from monthloom.operators.checks import DataCheckError
from monthloom.operators.series import pack, unpack

LAM = 129600.0


def months(n):
    return [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(n)]


def frame(spark, series, kind="category"):
    rows = [
        (entity, feature, kind, m, float(v))
        for (entity, feature), values in series.items()
        for m, v in zip(months(len(values)), values)
    ]
    return spark.createDataFrame(
        rows, "entity string, feature string, kind string, month date, value double"
    ).repartition(4)


def dense_hp(y, lam=LAM):
    n = len(y)
    d = np.zeros((n - 2, n))
    for i in range(n - 2):
        d[i, i : i + 3] = [1, -2, 1]
    return np.linalg.solve(np.eye(n) + lam * d.T @ d, y)


def reference_detrend(block):
    """block: {feature: values} of one entity, by dense algebra and SVD."""
    shifted = {f: v + (1 - v.min()) if v.min() < 1 else v for f, v in block.items()}
    varying = sorted(f for f, v in shifted.items() if v.min() != v.max())
    if not varying:
        return shifted
    logs = np.array([np.log(shifted[f]) for f in varying])
    trend = np.array([dense_hp(y) for y in logs])
    z = (trend - trend.mean(axis=1, keepdims=True)) / trend.std(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(z.T, full_matrices=False)
    pc1 = u[:, 0] * s[0]
    loading = vt[0]
    pc1 = pc1 * np.sign(loading[np.argmax(np.abs(loading))])
    scaled = (pc1 - pc1.mean()) / pc1.std(ddof=1) * trend.mean(axis=0).std(ddof=1)
    out = dict(shifted)
    for f, y in zip(varying, logs):
        flat = np.exp(y - scaled)
        out[f] = flat * shifted[f].mean() / flat.mean()
    return out


def random_block(seed, n_features, n_months):
    rng = np.random.default_rng(seed)
    common = np.cumsum(rng.normal(0.01, 0.02, n_months))
    return {
        f"f{i:04d}": np.exp(3 + rng.normal(1, 0.5) * common + rng.normal(0, 0.1, n_months))
        for i in range(n_features)
    }


def by_series(df):
    out = {}
    for r in unpack(df).orderBy("month").collect():
        out.setdefault((r.entity, r.feature), []).append(r.value)
    return out


@pytest.mark.parametrize("n", [3, 4, 5, 12, 200])
def test_hp_filter_equals_dense_solve(n):
    rows = np.random.default_rng(n).normal(size=(7, n)).cumsum(axis=1)
    got = detrend.hp_filter(rows, LAM)
    want = np.array([dense_hp(y) for y in rows])
    assert np.allclose(got, want, atol=1e-7)


def test_hp_filter_of_a_line_is_the_line():
    line = np.linspace(1, 9, 50)[None, :]
    assert np.allclose(detrend.hp_filter(line, LAM), line, atol=1e-8)
    assert np.array_equal(detrend.hp_filter(line[:, :2], LAM), line[:, :2])


def test_detrend_against_svd(spark):
    blocks = {"A": random_block(1, 9, 60), "B": random_block(2, 25, 60)}
    blocks["A"]["flat"] = np.full(60, 0.25)
    blocks["A"]["negative"] = np.random.default_rng(5).normal(0, 3, 60)
    blocks["C"] = {"only": np.full(60, 4.0)}
    series = {(e, f): v for e, b in blocks.items() for f, v in b.items()}
    got = by_series(detrend.detrend_long(frame(spark, series)))
    assert got.keys() == series.keys()
    for e, block in blocks.items():
        want = reference_detrend(block)
        for f in block:
            assert np.allclose(got[e, f], want[f], rtol=1e-7), (e, f)
    assert set(got["A", "flat"]) == {1.0}
    assert set(got["C", "only"]) == {4.0}


def test_detrending_keeps_the_mean(spark):
    block = random_block(8, 12, 48)
    got = by_series(detrend.detrend(pack(frame(spark, {("A", f): v for f, v in block.items()}))))
    for f, v in block.items():
        assert np.mean(got["A", f]) == pytest.approx(v.mean(), rel=1e-12)


def test_a_large_entity_is_split_over_groups(spark, monkeypatch):
    """Partial matrices of several groups add up to the one-group result."""
    blocks = {"BIG": random_block(3, 60, 40), "SMALL": random_block(4, 3, 40)}
    packed = pack(frame(spark, {(e, f): v for e, b in blocks.items() for f, v in b.items()}))
    shifted = detrend.flag_varying(detrend.shift_to_positive(packed))
    whole = {r.entity: r.pc1 for r in detrend.common_trend(shifted).collect()}
    monkeypatch.setattr(detrend, "GROUP_SCALE", 1.0)
    split = {r.entity: r.pc1 for r in detrend.common_trend(shifted).collect()}
    assert whole.keys() == split.keys()
    for e in whole:
        assert np.allclose(whole[e], split[e], atol=1e-9)


def test_many_entities_take_the_salted_join(spark, monkeypatch):
    """The two ways of joining per-entity results give the same series."""
    blocks = {e: random_block(i, 7, 36) for i, e in enumerate("ABC")}
    blocks["D"] = {"only": np.full(36, 4.0)}
    packed = pack(frame(spark, {(e, f): v for e, b in blocks.items() for f, v in b.items()}))
    want = by_series(detrend.detrend(packed))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    salted = detrend.detrend(packed)
    got = by_series(salted)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-10) for k in want)
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity#" in plan and "_salt#" in plan


def test_series_are_never_shuffled_by_entity_alone(spark):
    packed = pack(frame(spark, {("A", f): v for f, v in random_block(1, 5, 24).items()}))
    shifted = detrend.flag_varying(detrend.shift_to_positive(packed)).repartition(3)
    plan = detrend.detrend(packed)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(entity#\d+, \d+\)", plan)
    sizes = shifted.groupBy("entity").count()
    parts = skew.join_by_entity(shifted, sizes)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in parts and "SortMergeJoin" not in parts


def test_orientation(spark):
    block = random_block(6, 10, 60)
    packed = pack(frame(spark, {("A", f): v for f, v in block.items()}))
    shifted = detrend.flag_varying(detrend.shift_to_positive(packed))
    loading = np.array(detrend.common_trend(shifted).first().pc1)
    mean_trend = np.array(detrend.common_trend(shifted, orient="mean_trend").first().pc1)
    average = np.mean([dense_hp(np.log(v)) for v in block.values()], axis=0)
    assert np.corrcoef(mean_trend, average)[0, 1] > 0
    assert np.allclose(np.abs(loading), np.abs(mean_trend), atol=1e-9)
    with pytest.raises(ValueError):
        detrend.common_trend(shifted, orient="up")


def test_incomplete_calendar_is_an_error(spark):
    rows = frame(spark, {("A", "x"): range(1, 30), ("A", "y"): range(1, 30)})
    gap = rows.filter("not (feature = 'y' and month = date'2001-03-01')")
    with pytest.raises(DataCheckError, match="feature=y.*first_missing=2001-03"):
        detrend.detrend_long(gap)


def test_log_transforms(spark):
    values = [0.0, *range(1, 24)]
    rows = frame(spark, {("A", "c"): values}).unionByName(
        frame(spark, {("A", "t_x"): values}, kind="topic")
    )
    got = by_series(transforms.log_transforms(pack(rows)))
    floor = np.log(np.maximum(values, 1e-6))
    assert np.allclose(got["A", "t_x"], floor)
    assert got["A", "c"][:12] == [None] * 12
    assert np.allclose(got["A", "c"][12:], floor[12:] - floor[:-12])
