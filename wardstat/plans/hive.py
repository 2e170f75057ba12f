"""The warehouse analytics in SQL, run through ``spark.sql`` over the tables
registered by ``sources.lake.register_tables``.

Both statements work on an aggregate of the fact: the cost query joins one
row per hospital and disease with the dimension (never one per admission), the
growth query puts one LAG over the yearly counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.aggregates import DOUBLE_SCALE, cases_by_region_year
from ..schemas import DATABASE, DIMENSION_TABLE, FACT_TABLE

FACT = f"{DATABASE}.{FACT_TABLE}"
DIMENSION = f"{DATABASE}.{DIMENSION_TABLE}"


def avg_cost_sql(spark: SparkSession, fact: str = FACT, dim: str = DIMENSION) -> DataFrame:
    return spark.sql(f"""
        SELECT hospital_type, disease, try_divide(CAST(sum(spent) AS DOUBLE), sum(paid)) AS avg_cost
        FROM (SELECT hospital_id, disease, count(treatment_cost) AS paid,
                     sum(CAST(treatment_cost AS DECIMAL(38, {DOUBLE_SCALE}))) AS spent
              FROM {fact} GROUP BY ALL)
        INNER JOIN {dim} USING (hospital_id)
        GROUP BY ALL
        ORDER BY avg_cost DESC, hospital_type, disease""")


def yoy_growth_sql(spark: SparkSession, fact: str = FACT) -> DataFrame:
    per_year = cases_by_region_year(spark.table(fact), "part_region", "part_year")
    return spark.sql("""
        SELECT *, total_cases - prev_year_cases AS yoy_difference
        FROM (SELECT region, year, disease, total_cases,
                     lag(total_cases) OVER (PARTITION BY region, disease ORDER BY year) AS prev_year_cases
              FROM {per_year})
        ORDER BY region, disease, year""", per_year=per_year)


def show_partitions(spark: SparkSession, fact: str = FACT) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {fact}")
