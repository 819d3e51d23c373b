import datetime as dt

import pytest

from monthloom.operators.checks import DataCheckError
from monthloom.sources import series_files as sf

HEAD = "Category: All\n\n"


def write(folder, name, body, encoding="utf-8", head=HEAD):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes((head + body).encode(encoding))


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "3_US_m_all.csv", "2020-01,5\n2020-02,<1\n2020-03, 7 \n")
    write(tmp_path, "deep/er/10001_de_M_x.CSV", "2020-01,1\r\n2020-02,2\r\n", "utf-8-sig")
    write(tmp_path, "99999_FR_m_y.csv", "2020-01,4\n2020-02,bad\n2020-13,9\n2020-03,\n2020-04,1d\n",
          "latin-1", head="Catégorie\n\n")
    write(tmp_path, "55_FR_m_q.csv", '"2020-01","8",extra\n')
    write(tmp_path, "3_US_w_all.csv", "2020-01,5\n")
    write(tmp_path, "3_US_m_a.b.csv", "2020-01,5\n")
    write(tmp_path, "10052_IT_m_all.csv", "2020-01,5\n")
    write(tmp_path, "10052_CN_m_all.csv", "2020-01,5\n")
    write(tmp_path, "3_CN_m_all.csv", "2020-01,5\n")
    return tmp_path


def catalogue(spark):
    return spark.createDataFrame(
        [("3", "arts"), ("10001", "t_inflation")], "series_id string, name string"
    )


def test_listing_and_exclusions(spark, folder):
    files = sf.list_series_files(spark, str(folder))
    found = {(r.series_id, r.entity): r.label for r in files.collect()}
    assert found == {
        ("3", "US"): None,
        ("10001", "DE"): None,
        ("99999", "FR"): None,
        ("55", "FR"): None,
        ("10052", "IT"): "series",
        ("10052", "CN"): "series",
        ("3", "CN"): "entity",
    }
    counts = {(r.label, r.code): r.n_files for r in sf.excluded_counts(files).collect()}
    assert counts == {("series", "10052"): 2, ("entity", "CN"): 1}


def test_reading(spark, folder):
    rows = sf.read_series(spark, str(folder), catalogue(spark)).collect()
    got = {(r.entity, r.feature, r.kind, r.month.isoformat()[:7], r.value) for r in rows}
    assert got == {
        ("US", "arts", "category", "2020-01", 5.0),
        ("US", "arts", "category", "2020-02", 0.5),
        ("US", "arts", "category", "2020-03", 7.0),
        ("DE", "t_inflation", "topic", "2020-01", 1.0),
        ("DE", "t_inflation", "topic", "2020-02", 2.0),
        ("FR", "t_99999", "topic", "2020-01", 4.0),
        ("FR", "cat_55", "category", "2020-01", 8.0),
    }


def test_excluded_files_are_not_opened(spark, folder):
    """The name filter prunes the listing, so only retained files are scanned."""
    lines = sf.parse_lines(sf.keyed_files(spark, str(folder)))
    lines.collect()
    scan = lines._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 4


def test_no_files(spark, tmp_path):
    write(tmp_path, "3_US_w_all.csv", "2020-01,5\n")
    with pytest.raises(DataCheckError, match="No monthly series files"):
        sf.read_series(spark, str(tmp_path))


def test_nothing_left(spark, tmp_path):
    write(tmp_path, "3_CN_m_all.csv", "2020-01,5\n")
    with pytest.raises(DataCheckError, match="No series files remain"):
        sf.read_series(spark, str(tmp_path))


def test_two_files_for_one_feature(spark, folder):
    write(folder, "again/3_US_m_other.csv", "2020-01,5\n")
    with pytest.raises(DataCheckError, match="same entity and feature.*feature=arts"):
        sf.read_series(spark, str(folder), catalogue(spark))


def test_file_without_usable_row(spark, folder):
    write(folder, "77_US_m_all.csv", "junk\n")
    with pytest.raises(DataCheckError, match="no usable row.*77_US"):
        sf.read_series(spark, str(folder))


def test_repeated_month(spark, folder):
    write(folder, "77_US_m_all.csv", "2020-01,1\n2020-1,2\n")
    with pytest.raises(DataCheckError, match="repeats a month.*2020-01"):
        sf.read_series(spark, str(folder))


def test_catalogue_must_be_unique(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text("series_id,name\n3,arts\n3,other\n")
    with pytest.raises(DataCheckError, match="repeats a series id"):
        sf.read_catalogue(spark, str(path))


def test_months_are_dates(spark, folder):
    row = sf.read_series(spark, str(folder)).filter("entity = 'DE'").orderBy("month").first()
    assert row.month == dt.date(2020, 1, 1)
