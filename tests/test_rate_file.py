import datetime as dt

import pytest

from monthloom.operators.checks import DataCheckError
from monthloom.params import RATE_DIMENSIONS
from monthloom.sources.rate_file import load_rates

COLUMNS = ["EXTRA", "REF_AREA", *RATE_DIMENSIONS, "TIME_PERIOD", "OBS_VALUE"]


def row(area="USA", period="2020-01", value="3.5", **changes):
    dims = {**RATE_DIMENSIONS, **changes}
    return ["x", area, *dims.values(), period, value]


def write(tmp_path, rows, columns=COLUMNS):
    path = tmp_path / "rates.csv"
    path.write_text("\n".join([",".join(columns), *[",".join(r) for r in rows]]) + "\n")
    return str(path)


def test_load(spark, tmp_path):
    path = write(tmp_path, [row(), row("DEU", "2020-02", "4"), row(SEX="")])
    with pytest.raises(DataCheckError, match="repeats an entity and month"):
        load_rates(spark, path)
    path = write(tmp_path, [row(), row("DEU", "2020-02", "4", SEX="")])
    rows = {(r.entity, r.month): r.level for r in load_rates(spark, path).collect()}
    assert rows == {("US", dt.date(2020, 1, 31)): 3.5, ("DE", dt.date(2020, 2, 29)): 4.0}


@pytest.mark.parametrize(
    "rows, message",
    [
        ([row(), row(SEX="F", period="2020-02")], "other series.*dimension=SEX, value=F"),
        ([row("XXX")], "no entity code.*XXX"),
        ([row(period="Q1")], "invalid keys or values"),
        ([row(value="")], "invalid keys or values"),
        ([row(value="1d")], "invalid keys or values"),
    ],
)
def test_errors(spark, tmp_path, rows, message):
    with pytest.raises(DataCheckError, match=message):
        load_rates(spark, write(tmp_path, rows))


def test_missing_column(spark, tmp_path):
    with pytest.raises(DataCheckError, match="lacks the columns.*OBS_VALUE"):
        load_rates(spark, write(tmp_path, [row()[:-1]], COLUMNS[:-1]))
