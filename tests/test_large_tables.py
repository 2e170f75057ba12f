"""What the large tables ask of the shared steps: a line is made and split
once per row, and a table is written by folders without another shuffle or a sort."""

import datetime
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from wardstat import queries as Q
from wardstat.schemas import ADMISSIONS
from wardstat.sources import files as FS
from wardstat.sources import fixtures as fx
from wardstat.sources import lake as LK


def _rows(years):
    day = datetime.date(2020, 1, 4)
    return [(str(i), "0-10", "F", region, "1", "PROMO", day, year, "Yes", 1.5)
            for i, (year, region) in enumerate((y, r) for y in years for r in ("ASIA", "EUROPE", None))]


@pytest.fixture
def written(monkeypatch):
    """(plan, open folders) of every frame that is written."""
    seen = []

    def noting(f):
        def write(self, *args, **kwargs):
            seen.append((self._df._jdf.queryExecution().toString(), self._df.sparkSession.conf.get(LK.OPEN_FOLDERS_SETTING)))
            return f(self, *args, **kwargs)
        return write
    for name in ("save", "parquet"):
        monkeypatch.setattr(DataFrameWriter, name, noting(getattr(DataFrameWriter, name)))
    return seen


def _star(spark, path):
    tables = {
        "region": ([(0, "ASIA"), (1, None)], "r_regionkey int, r_name string"),
        "nation": ([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        "customer": ([(1, 0), (2, 1)], "c_custkey long, c_nationkey int"),
        "orders": ([(1, 1), (2, 2), (3, None)], "o_orderkey long, o_custkey long"),
        "part": ([(1, 5, "PROMO"), (2, None, None)], "p_partkey long, p_size int, p_type string"),
        "lineitem": ([(1, 1, 7, "R", "F", datetime.datetime(2020, 1, 4, 23), 2.0), (1, 1, 7, "R", "F", datetime.datetime(2020, 1, 4, 23), 2.0),
                      (2, 2, None, None, None, None, None), (3, 1, 7, "N", "O", None, 1.0)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string,"
                     " l_shipdate timestamp_ntz, l_extendedprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_fact_is_written_where_it_is_joined(spark, tmp_out, written):
    before = spark.conf.get(LK.OPEN_FOLDERS_SETTING)
    sf_dir = _star(spark, f"{tmp_out}/tables")
    written.clear()
    path = fx.ingest_admissions(spark, sf_dir, f"{tmp_out}/fact")
    [(plan, folders)] = written
    assert "rebalance" not in plan.lower()
    assert int(folders) == LK.OPEN_FOLDERS
    assert spark.conf.get(LK.OPEN_FOLDERS_SETTING) == before
    day = datetime.date(2020, 1, 4)
    one = ("1", "0-10", "F", "ASIA", "7", "PROMO", day, 2020, "Yes", 2.0)
    bare = ("2", "90+", "M", None, None, None, None, None, "No", None)
    got = [tuple(r) for r in fx.read_admissions_fact(spark, path).collect()]
    assert sorted(got, key=str) == sorted([one, one, bare], key=str)


def test_lake_of_a_table_by_folder(spark, tmp_out, written):
    years = [None, *range(1990, 2020)]  # 93 folders: more than a task keeps open
    adm = spark.createDataFrame(_rows(years), ADMISSIONS).coalesce(1)
    path = LK.write_lake(adm, f"{tmp_out}/by-folder", by_folder=True)
    plan, folders = written[-1]
    assert "rebalance" not in plan.lower() and int(folders) == LK.OPEN_FOLDERS
    got = LK.read_lake(spark, path)
    assert sorted(map(str, got.collect())) == sorted(map(str, LK.with_partition_columns(adm).select(got.columns).collect()))
    assert got.select("part_year", "part_region").distinct().count() == 3 * len(years) > LK.OPEN_FOLDERS


def test_registered_lakes_are_not_shuffled(spark, tmp_out, written, monkeypatch):
    monkeypatch.setattr(Q, "_adm", lambda s, d: s.createDataFrame(_rows([2020]), ADMISSIONS))
    monkeypatch.setattr(Q, "_once", lambda s, key, build: build())
    for lake in (Q._lake, Q._csv_lake):
        written.clear()
        lake(spark, tmp_out)
        assert "rebalance" not in written[-1][0].lower()


def test_lines_are_made_and_split_once(spark, monkeypatch):
    monkeypatch.setattr(Q, "_adm", lambda s, d: s.createDataFrame(_rows(range(2000, 2008)), ADMISSIONS))
    df = Q.q_filter_bad_date(spark, "")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bsplit\(", plan)) == 1
    assert len(re.findall(r"concat_ws\(", plan)) == 2  # whole and cut lines
    assert len(re.findall(r"gettimestamp\(", plan)) == 1
    day = datetime.date(2020, 1, 4)
    assert sorted(map(tuple, df.collect())) == sorted(
        (str(i), "PROMO", day, "Weekend") for i, r in enumerate(_rows(range(2000, 2008)))
        if i % 7 and i % 13 and i % 11 and r[3] is not None)


def test_null_and_short_lines_go(spark):
    lines = spark.createDataFrame([(None,), ("",), (",,,",), ("patient_id,b,c,d,e,f",), ("1,b,c,d,e,f,,",)], "value string")
    got = FS.parse_lines(lines, min_fields=6).select("patient_id", "disease", F.col("admission_date").isNull()).collect()
    assert [tuple(r) for r in got] == [("1", "f", True)]
