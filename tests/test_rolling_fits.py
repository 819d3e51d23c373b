"""Rolling fits that go on where a stopped run ended, and share what is committed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from monthloom import session
from monthloom.operators import boosting
from monthloom.operators.boosting import BoostingSettings

SETTINGS = BoostingSettings(n_estimators=2, min_rows=1, max_depth=2)
TESTS = range(12, 17)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(2)
    rows = [
        (e, dt.date(2020 + m // 12, m % 12 + 1, 28), rng.random(), rng.random(), float(rng.randint(0, 9)))
        for e in "ABCD" for m in range(17)
    ]
    return spark.createDataFrame(rows, "entity string, month date, x double, y double, target double")


def run(panel, log, settings=SETTINGS, parallel=2):
    data = boosting.prepare(panel, ["x", "y"])
    return boosting.rolling_boosting(data, 12, settings, TESTS, parallel, str(log))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_stopped_run_goes_on(panel, tmp_path, monkeypatch):
    whole = run(panel, tmp_path / "whole")
    assert whole.fitted == tuple(TESTS)
    fit, seen = boosting.fit_split, []

    def fails_later(data, t, window, settings):
        if t >= 14:
            raise RuntimeError("lost driver")
        seen.append(t)
        return fit(data, t, window, settings)

    monkeypatch.setattr(boosting, "fit_split", fails_later)
    with pytest.raises(RuntimeError, match="lost driver"):
        run(panel, tmp_path / "log", parallel=1)
    assert seen == [12, 13]
    monkeypatch.setattr(boosting, "fit_split", fit)
    resumed = run(panel, tmp_path / "log")
    assert resumed.fitted == (14, 15, 16)
    assert rows(resumed.predictions) == rows(whole.predictions)
    assert rows(resumed.importances) == rows(whole.importances)
    assert resumed.importances.count() == 5 * 2
    monkeypatch.setattr(boosting, "fit_split", None)  # nothing is fitted any more
    again = run(panel.repartition(7), tmp_path / "log")
    assert again.fitted == () and rows(again.predictions) == rows(whole.predictions)
    assert again.last_model.stages[-1].getNumTrees == 2


def test_other_settings_or_rows_are_other_fits(panel, tmp_path):
    data = boosting.prepare(panel, ["x", "y"])
    digest = boosting.fit_digest(data, 12, SETTINGS)
    assert digest == boosting.fit_digest(boosting.prepare(panel.repartition(3), ["x", "y"]), 12, SETTINGS)
    others = [
        boosting.fit_digest(data, 11, SETTINGS),
        boosting.fit_digest(data, 12, BoostingSettings(n_estimators=3, min_rows=1, max_depth=2)),
        boosting.fit_digest(boosting.prepare(panel, ["x"]), 12, SETTINGS),
        boosting.fit_digest(boosting.prepare(panel.withColumn("x", F.col("x") + 1), ["x", "y"]), 12, SETTINGS),
        boosting.fit_digest(boosting.prepare(panel.where("entity <> 'D'"), ["x", "y"]), 12, SETTINGS),
    ]
    assert len({digest, *others}) == 6


def test_a_torn_split_is_fitted_again(panel, tmp_path):
    before = rows(run(panel, tmp_path).predictions)
    (folder,) = tmp_path.iterdir()
    (folder / "predictions" / "split=13" / "_SUCCESS").unlink()
    second = run(panel, tmp_path)
    assert second.fitted == (13,) and rows(second.predictions) == before


def test_partitions_of_a_fit_follow_its_rows():
    assert [BoostingSettings().partitions(n) for n in (0, 1, 20_000, 20_001, 200_000)] == [1, 1, 1, 2, 10]
    assert BoostingSettings(fit_partitions=3).partitions(10**9) == 3


def test_scopes_belong_to_their_thread(spark):
    from concurrent.futures import ThreadPoolExecutor

    with session.scratch(spark) as scope:
        own = session.stage(spark.range(3))
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(lambda: session.stage(spark.range(4))).result()
        assert len(scope.made) == 1 and scope.made[0][0] is own
    assert other.count() == 4
    with pytest.raises(Exception, match="exist|FILE"):
        own.count()
