"""Hand-made frames for the edge-case rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardstat.functions import scalars as S
from wardstat.operators import aggregates as A
from wardstat.operators import gold as G
from wardstat.operators import upload as U
from wardstat.operators import windows as W
from wardstat.operators.joins import join_dim
from wardstat.schemas import ADMISSIONS_TEXT
from wardstat.sources import files as FS

COLS = ADMISSIONS_TEXT.fieldNames()


def _text_adm(spark, rows):
    return spark.createDataFrame(rows, ADMISSIONS_TEXT)


def _row(date="2020-01-06", readmitted="Yes", disease="Asthma", region="North", year="2020",
         pid="1", hosp="H1", cost="100.0"):
    return (pid, "0-10", "M", region, hosp, disease, date, year, readmitted, cost)


# --- dates ----------------------------------------------------------------------

def test_bad_dates_are_skipped_and_day_type_is_right(spark):
    dates = ["2020-02-30", "2021-1-5", "2021", None, "2020-01-04", "2020-01-06"]
    df = _text_adm(spark, [_row(date=d) for d in dates])
    out = {r.day_type: r.total_admissions for r in A.weekend_readmission(df).collect()}
    assert out == {"Weekend": 1, "Weekday": 1}


def test_parse_date_is_strict(spark):
    df = spark.createDataFrame([("2021-1-5",), ("2021",), ("2020-02-30",), ("2020-01-04",)], "s string")
    got = [r.d for r in df.select(S.parse_date("s").alias("d")).collect()]
    assert got == [None, None, None, dt.date(2020, 1, 4)]


def test_day_type_weekend_weekday(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 4),), (dt.date(2020, 1, 5),), (dt.date(2020, 1, 6),), (None,)],
                               "d date")
    assert [r.t for r in df.select(S.day_type("d").alias("t")).collect()] == \
        ["Weekend", "Weekend", "Weekday", None]


# --- short lines -------------------------------------------------------------------

LINES = [
    ",".join(COLS),                                                   # header
    "1,0-10,M,North,H1,Asthma,2020-01-06,2020,Yes,100.0",             # 10 fields
    "2,0-10,M,North,H1,Asthma,2020-01-06,2020,Yes,",                  # 9, empty cost
    "3,0-10,M,North,H1,Asthma,2020-01-06,2020,,",                     # 8, empty readmitted and cost
    "4,0-10,M,North,H1",                                              # 5
    "",                                                               # empty
]


@pytest.mark.parametrize("min_fields,kept", [(6, 3), (8, 3), (9, 2), (10, 1)])
def test_short_lines(spark, min_fields, kept):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    assert FS.parse_lines(lines, min_fields=min_fields).count() == kept


def test_line_fields_and_types(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    parsed = FS.typed_admissions(FS.parse_lines(lines, min_fields=9)).orderBy("patient_id").collect()
    assert parsed[0].treatment_cost == 100.0 and parsed[0].year == 2020
    assert parsed[1].treatment_cost is None and parsed[1].readmitted == "Yes"


# --- Yes variants -------------------------------------------------------------------

def test_yes_variants(spark):
    df = spark.createDataFrame([(v,) for v in ["Yes", "YES", "yes", "No", "", None]], "r string")
    row = df.agg(F.sum(S.flag("r")).alias("exact"), F.sum(S.flag("r", "Yes", True)).alias("ci"),
                 F.sum(S.flag_in_set("r")).alias("inset")).first()
    assert (row.exact, row.ci, row.inset) == (1, 3, 1.0)


def test_rate_variants_rows_vs_ids(spark):
    df = _text_adm(spark, [_row(readmitted="YES"), _row(readmitted="No", pid=None)])
    spark_job = A.readmission_rates(df).first()
    line_job = A.readmission_rates(df, ignore_case=True, count_col=None).first()
    assert (spark_job.total_admissions, spark_job.readmitted_count) == (1, 0)
    assert (line_job.total_admissions, line_job.readmitted_count, line_job.readmission_rate) == (2, 1, 0.5)


# --- upload roles -------------------------------------------------------------------

def _roles(spark, cols, types=None):
    types = types or ["string"] * len(cols)
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(cols, types))
    return U.find_roles(spark.createDataFrame([], schema).schema)


def test_roles_first_in_column_order_and_traps(spark):
    r = _roles(spark, ["patient", "updated", "capacity", "Disease", "admission_date", "Outcome"])
    assert (r.target, r.disease, r.region, r.time_var) == ("Outcome", "Disease", "capacity", "updated")
    r = _roles(spark, ["statement", "reward", "DIAGNOSIS"])
    assert (r.region, r.disease, r.target) == ("statement", "DIAGNOSIS", None)


def test_roles_fallbacks(spark):
    r = _roles(spark, ["n", "label", "score"], ["int", "string", "double"])
    assert (r.disease, r.region, r.time_var, r.target) == ("label", "label", "n", None)
    r = _roles(spark, ["a", "b"], ["int", "int"])
    assert r.disease == "a"


def test_one_column_in_two_roles_is_copied(spark):
    df = spark.createDataFrame([("Emergency", "Flu", "X")], "`Admission Type` string, illness string, ward string")
    mapped = U.prepare_upload(df)
    assert set(mapped.columns) >= {"target", "disease", "region", "time_var", "is_target"}
    row = mapped.first()
    assert row.target == "Emergency" and row.time_var == "Emergency" and row.is_target == 1.0


def test_region_falls_back_to_disease_copy(spark):
    df = spark.createDataFrame([("Flu", "No"), ("Cold", "Yes")], "disease string, outcome string")
    mapped = U.prepare_upload(df)
    assert {r.region for r in mapped.collect()} == {"Flu", "Cold"}
    assert G.kpis(mapped).first().regions_analyzed == 2


def test_target_types(spark):
    s = U.prepare_upload(spark.createDataFrame([("a", None), ("b", "Yes"), ("c", "No")], "disease string, status string"))
    assert sorted(r.is_target for r in s.collect()) == [0.0, 0.0, 1.0]
    assert G.kpis(s).first().avg_readmission_rate == "33.3%"
    n = U.prepare_upload(spark.createDataFrame([("a", None), ("b", 1), ("c", 0)], "disease string, outcome int"))
    assert G.kpis(n).first().avg_readmission_rate == "50.0%"
    b = U.prepare_upload(spark.createDataFrame([("a", True), ("b", False)], "disease string, outcome boolean"))
    assert sorted(r.is_target for r in b.collect()) == [0.0, 1.0]
    t = U.prepare_upload(spark.createDataFrame([("a", "bad")], "disease string, outcome_code string"))
    assert t.first().is_target == 0.0


def test_no_target_and_empty_input(spark):
    df = U.prepare_upload(spark.createDataFrame([("Flu", "N")], "disease string, region string"))
    assert "is_target" not in df.columns
    k = G.kpis(df).first()
    assert (k.total_records_processed, k.top_disease, k.avg_readmission_rate) == ("1", "Flu", "0%")
    empty = U.prepare_upload(spark.createDataFrame([], "disease string, region string, status string"))
    k = G.kpis(empty).first()
    assert (k.total_records_processed, k.regions_analyzed, k.top_disease, k.avg_readmission_rate) == \
        ("0", 0, "Unknown", "0%")


def test_kpis_formats_and_null_region(spark):
    rows = [("Flu", None, "Yes")] * 3 + [("Cold", "N", "No")] * 2 + [("Cold", "S", "No")] * 1 \
        + [("Flu", "N", "No")] * 1200
    df = U.prepare_upload(spark.createDataFrame(rows, "disease string, region string, outcome string"))
    k = G.kpis(df).first()
    assert k.total_records_processed == "1,206"
    assert k.regions_analyzed == 3          # N, S and NULL
    assert k.top_disease == "Flu"
    assert k.avg_readmission_rate == "0.2%"


def test_top_disease_tie_goes_to_smallest_name(spark):
    df = U.prepare_upload(spark.createDataFrame([("B", "x"), ("A", "y")], "disease string, region string"))
    assert G.kpis(df).first().top_disease == "A"
    assert G.kpi_top_disease(df).first().top_disease == "A"


def test_required_columns(spark):
    df = spark.createDataFrame([("1", None)], "patient_id string, Region string")
    rep = {r.column: (r.present, r.non_null_count) for r in U.check_columns(df, ["patient_id", "region", "disease"]).collect()}
    assert rep == {"patient_id": (True, 1), "region": (True, 0), "disease": (False, 0)}
    with pytest.raises(U.MissingColumnsError) as e:
        U.require_columns(df, ["patient_id", "disease"])
    assert e.value.exit_code == 2


def test_upload_accepts_csv_only(spark):
    with pytest.raises(ValueError):
        U.read_upload(spark, "/tmp/data.txt")


# --- pivots ---------------------------------------------------------------------------

def test_pivot_null_disease_and_empty_cell(spark):
    df = U.prepare_upload(spark.createDataFrame(
        [("2020-01-01", None, "N", "Yes"), ("2020-02-01", "Flu", "N", "No"), ("2021-01-01", "Cold", "S", "Yes")],
        "admission_date string, disease string, region string, outcome string"))
    t = G.trends(df)
    assert "null" in t.columns
    rows = {r.year: r.asDict() for r in t.collect()}
    assert rows["2020"]["Flu"] == 1 and rows["2021"]["Flu"] == 0
    rm = {r.region: r.asDict() for r in G.rate_matrix(df, ["Flu", "Cold"]).collect()}
    assert rm["N"]["Cold"] == 0.0 and rm["S"]["Cold"] == 1.0
    rm_null = {r.region: r.asDict() for r in G.rate_matrix(df, ["Flu", "Cold"], fill=None).collect()}
    assert rm_null["N"]["Cold"] is None


# --- LAG ------------------------------------------------------------------------------

def test_lag_crosses_year_gaps(spark):
    rows = [_row(year="2020"), _row(year="2020"), _row(year="2022"),
            _row(year="2021", disease="Flu", region="South")]
    df = _text_adm(spark, rows).withColumn("year", F.col("year").cast("int"))
    out = {(r.region, r.disease, r.year): (r.total_cases, r.prev_year_cases, r.yoy_difference)
           for r in W.yoy_growth(df).collect()}
    assert out[("North", "Asthma", 2020)] == (2, None, None)
    assert out[("North", "Asthma", 2022)] == (1, 2, -1)
    assert out[("South", "Flu", 2021)] == (1, None, None)


# --- dimension join -------------------------------------------------------------------------

def test_inner_dimension_join_drops_orphans(spark):
    fact = _text_adm(spark, [_row(hosp="H1", cost="10.0"), _row(hosp="H9", cost="30.0")]) \
        .withColumn("treatment_cost", F.col("treatment_cost").cast("double"))
    dim = spark.createDataFrame([("H1", "One", 50, "Public"), ("H2", "Two", 75, "Private")],
                                "hospital_id string, hospital_name string, bed_count int, hospital_type string")
    assert [r.hospital_id for r in join_dim(fact, dim, "hospital_id").collect()] == ["H1"]
    res = A.avg_cost(fact, dim).collect()
    assert [(r.hospital_type, r.avg_cost) for r in res] == [("Public", 10.0)]


# --- scalars ---------------------------------------------------------------------------------

def test_ansi_safe_casts_and_formats(spark):
    df = spark.createDataFrame([("abc", 60000, 0.12345, 7)], "s string, n long, x double, h int")
    r = df.select(S.cast_double("s").alias("d"), S.format_thousands("n").alias("t"),
                  S.format_pct("x").alias("p"), S.pad_id("h").alias("id"),
                  S.ratio(F.lit(1), F.lit(0)).alias("z"),
                  S.format_rate(F.lit(10), F.lit(3), F.lit(0.3)).alias("fr"),
                  S.clamp(F.lit(84.0)).alias("lo"), S.clamp(F.lit(101.0)).alias("hi"),
                  S.concat_key(F.lit("a"), F.lit(None).cast("string")).alias("k")).first()
    assert r.d is None and r.t == "60,000" and r.p == "12.3%" and r.id == "HOSP_007" and r.z is None
    assert r.fr == "10,3,0.3000" and r.lo == 85.0 and r.hi == 100.0 and r.k == "a|null"


def test_year_prefix(spark):
    df = spark.createDataFrame([(dt.date(2021, 3, 4), "1999-x", 2020)], "d date, s string, n int")
    r = df.select(S.year_prefix("d").alias("a"), S.year_prefix("s").alias("b"), S.year_prefix("n").alias("c")).first()
    assert (r.a, r.b, r.c) == ("2021", "1999", "2020")



def test_percent_text_rounds_like_python(spark):
    vals = [5 / 16, 0.2465, 0.02675, 0.15, 12.345, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.p for r in df.select(S.format_pct("x").alias("p")).collect()]
    assert got == [None if v is None else f"{v * 100:.1f}%" for v in vals]
    assert got[0] == "31.2%"


def test_stray_role_named_columns_are_not_taken_as_roles(spark):
    df = spark.createDataFrame([("Flu", "N", "Yes", 1.0)],
                               "disease string, region string, target string, is_target double")
    mapped = U.prepare_upload(df)
    assert "target" not in mapped.columns and "is_target" not in mapped.columns
    assert {"target_src", "is_target_src"} <= set(mapped.columns)
    assert G.kpis(mapped).first().avg_readmission_rate == "0%"
