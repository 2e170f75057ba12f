"""A key holding a third of all rows: results stay exact and the work is
split, not funnelled into one task."""

import glob

import pytest
from pyspark.sql import functions as F

from wardstat.operators import aggregates as A
from wardstat.operators.joins import join_dim
from wardstat.schemas import ADMISSIONS
from wardstat.sources import lake as LK

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _skewed_fact(spark, n=300_000):
    """A third of the rows in hospital "1" and region "HOT"."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.col("id").cast("string").alias("patient_id"),
        F.lit("0-10").alias("age_band"), F.lit("M").alias("gender"),
        F.when(hot, F.lit("HOT")).otherwise(F.concat(F.lit("R"), (F.col("id") % 4).cast("string"))).alias("region"),
        F.when(hot, F.lit("1")).otherwise((F.col("id") % 997).cast("string")).alias("hospital_id"),
        F.concat(F.lit("D"), (F.col("id") % 5).cast("string")).alias("disease"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("admission_date"),
        F.lit(2020).alias("year"),
        F.when(F.col("id") % 7 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("readmitted"),
        (F.col("id") % 1000 + 0.25).alias("treatment_cost"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in ADMISSIONS.fields])


def test_hot_key_join_is_split_by_aqe(skew_conf):
    spark = skew_conf
    fact = _skewed_fact(spark)
    dim = spark.range(1000).select(F.col("id").cast("string").alias("hospital_id"),
                                   F.lit("t").alias("hospital_type"))
    j = join_dim(fact.select("hospital_id", "treatment_cost"), dim, "hospital_id")
    rows = j.collect()
    assert len(rows) == 300_000
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_key_aggregates_are_exact(skew_conf):
    fact = _skewed_fact(skew_conf)
    got = {}
    for r in A.readmission_rates(fact).collect():
        t, y = got.get(r.region, (0, 0))
        got[r.region] = (t + r.total_admissions, y + r.readmitted_count)
    assert got["HOT"] == (100_000, len([i for i in range(0, 300_000, 3) if i % 7 == 0]))
    assert sum(v[0] for v in got.values()) == 300_000


def test_hot_folder_is_written_by_several_tasks(skew_conf, tmp_out):
    fact = _skewed_fact(skew_conf)
    path = LK.write_lake(fact, f"{tmp_out}/lake")
    hot_files = glob.glob(f"{path}/part_year=2020/part_region=HOT/*.parquet")
    assert len(hot_files) > 1
    assert LK.read_lake(skew_conf, path).count() == 300_000
