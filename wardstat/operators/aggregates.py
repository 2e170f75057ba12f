"""Grouped aggregates over the admissions fact.

Every function takes an admissions ``DataFrame`` (``schemas.ADMISSIONS``
columns; any source: parquet, CSV, lake, the fixture view) and returns a
``DataFrame``.  Aggregates are algebraic (count / sum), so Spark runs them
as partial aggregation before the shuffle and final aggregation after it:
a key holding a third of all rows costs one partial row per map task, not
a third of the data in one reducer.

Where the reference computes the same measure with different edge-case
rules (case of ``Yes``, rows versus non-null ids), the rule is a parameter
and the default follows the job the function is named after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

# Decimals kept of a cost that comes as a double.
DOUBLE_SCALE = 10


def _total(count_col: str | None):
    """COUNT(col) (non-null values) or COUNT(*) (rows)."""
    return F.count(count_col) if count_col else F.count(F.lit(1))


def readmission_rates(adm: DataFrame, ignore_case: bool = False,
                      count_col: str | None = "patient_id") -> DataFrame:
    """Readmission rate by region and disease (flagship).

    Defaults follow the DataFrame job: non-null ``patient_id`` counted,
    exact ``Yes`` match, rate rounded to four places.  The line-oriented
    job counts every row and matches ``yes`` in any case:
    ``readmission_rates(adm, ignore_case=True, count_col=None)``.
    """
    return (adm.groupBy("region", "disease")
            .agg(_total(count_col).alias("total_admissions"),
                 F.sum(S.flag("readmitted", "Yes", ignore_case)).cast("long").alias("readmitted_count"))
            .withColumn("readmission_rate",
                        F.round(S.ratio("readmitted_count", "total_admissions"), 4)))


def disease_frequency(adm: DataFrame) -> DataFrame:
    """Admissions by region, age band and disease."""
    return adm.groupBy("region", "age_band", "disease").agg(F.count(F.lit(1)).alias("cases"))


def yearly_disease_counts(adm: DataFrame) -> DataFrame:
    """Admissions by year and disease."""
    return adm.groupBy("year", "disease").agg(F.count(F.lit(1)).alias("cases"))


def with_day_type(adm: DataFrame, date_col: str = "admission_date") -> DataFrame:
    """Adds ``day_type`` from a strictly parsed ISO date and drops rows whose
    date does not parse (``2020-02-30``, ``2021-1-5``, NULL).  A column
    that is already a DATE needs no parsing, only the NULL check."""
    return adm.withColumn("_adm_date", S.date_of(adm, date_col)).where(F.col("_adm_date").isNotNull()) \
        .withColumn("day_type", S.day_type("_adm_date")).drop("_adm_date")


def weekend_readmission(adm: DataFrame) -> DataFrame:
    """Readmission by disease and Weekend/Weekday (rows counted, ``yes`` in
    any case, bad dates skipped)."""
    return (with_day_type(adm)
            .groupBy("disease", "day_type")
            .agg(F.count(F.lit(1)).alias("total_admissions"),
                 F.sum(S.flag("readmitted", "Yes", True)).cast("long").alias("readmitted_count"))
            .withColumn("readmission_rate",
                        F.round(S.ratio("readmitted_count", "total_admissions"), 4)))


def weekend_compare(adm: DataFrame) -> DataFrame:
    """One row per disease with ``weekday_rate`` and ``weekend_rate``.

    A single aggregation with conditional sums (no pivot job to discover
    values, no self-join); a disease seen only on one day type gets NULL
    for the other.
    """
    df = with_day_type(adm)
    yes = S.flag("readmitted", "Yes", True)
    wkend = F.col("day_type") == S.WEEKEND_LABEL

    def rate(is_weekend):
        cond = wkend if is_weekend else ~wkend
        return F.round(S.ratio(F.sum(F.when(cond, yes)), F.count(F.when(cond, F.lit(1)))), 4)

    return df.groupBy("disease").agg(rate(False).alias("weekday_rate"),
                                     rate(True).alias("weekend_rate"))


def exact_cost(df: DataFrame, col: str = "treatment_cost") -> F.Column:
    """The column as a decimal: with its own scale if it is one already, else
    with ``DOUBLE_SCALE`` decimals (amounts of money have far fewer)."""
    kind = df.schema[col].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else DOUBLE_SCALE
    return F.col(col).cast(T.DecimalType(38, scale))


def avg_cost(adm: DataFrame, dim: DataFrame) -> DataFrame:
    """AVG(treatment_cost) by hospital_type and disease over the inner join
    with the hospital dimension, ordered by the average, highest first.

    The fact is aggregated by (hospital_id, disease) *before* the join, so
    the join and its shuffle see one row per hospital and disease rather
    than one per admission, and a hospital holding a third of the rows is
    reduced map-side like any other.  Sums are exact decimals, so the
    result does not depend on row order.
    """
    per_hospital = (adm.where(F.col("hospital_id").isNotNull())
                    .groupBy("hospital_id", "disease")
                    .agg(F.sum(exact_cost(adm)).alias("_cost_sum"),
                         F.count("treatment_cost").alias("_cost_n")))
    joined = per_hospital.join(dim.select("hospital_id", "hospital_type"), "hospital_id", "inner")
    return (joined.groupBy("hospital_type", "disease")
            .agg(S.ratio(F.sum("_cost_sum"), F.sum("_cost_n")).alias("avg_cost"))
            .orderBy(F.desc("avg_cost"), "hospital_type", "disease"))


def cases_by_region_year(adm: DataFrame, region: str = "region", year: str = "year") -> DataFrame:
    """COUNT(patient_id) by region, year, disease.  ``region``/``year`` may
    name the lake's partition columns instead."""
    return (adm.groupBy(F.col(region).alias("region"), F.col(year).alias("year"), "disease")
            .agg(F.count("patient_id").alias("total_cases")))


def regional_burden(df: DataFrame) -> DataFrame:
    """Rows per region."""
    return df.groupBy("region").agg(F.count(F.lit(1)).alias("cases"))
