"""Explicit schemas.  Nothing in the library infers a schema except the
upload path, whose columns are unknown by design."""

from pyspark.sql import types as T

# Identifiers users of the reference address their data by.
DATABASE = "healthcare_db"
FACT_TABLE = "patient_records"
DIMENSION_TABLE = "hospitals_dim"
VITALS_TOPIC = "icu_vitals"

# The admissions fact, in column order (the order matters for headerless
# text files and for role mapping, which scans columns left to right).
ADMISSIONS = T.StructType([
    T.StructField("patient_id", T.StringType()),
    T.StructField("age_band", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("hospital_id", T.StringType()),
    T.StructField("disease", T.StringType()),
    T.StructField("admission_date", T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("readmitted", T.StringType()),
    T.StructField("treatment_cost", T.DoubleType()),
])

# The same columns as raw text, for line-oriented input where every field
# is parsed explicitly afterwards.
ADMISSIONS_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in ADMISSIONS.fields])

HOSPITALS_DIM = T.StructType([
    T.StructField("hospital_id", T.StringType()),
    T.StructField("hospital_name", T.StringType()),
    T.StructField("bed_count", T.IntegerType()),
    T.StructField("hospital_type", T.StringType()),
])

# One vitals message.  ``timestamp`` is a time of day only (HH:MM:SS);
# event time comes from the source (broker timestamp or ``ts``).
VITALS_MESSAGE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("heart_rate", T.DoubleType()),
    T.StructField("blood_pressure_systolic", T.DoubleType()),
    T.StructField("oxygen_level", T.DoubleType()),
])

# Vitals rows derived from the event table.
VITALS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("patient_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("heart_rate", T.DoubleType()),
    T.StructField("oxygen_level", T.DoubleType()),
])

# Prediction request rows for batch scoring.
PREDICTION_REQUEST = T.StructType([
    T.StructField("age_band", T.StringType()),
    T.StructField("disease", T.StringType()),
    T.StructField("treatment_cost", T.DoubleType()),
    T.StructField("gender", T.StringType()),
])

# Partition columns of the lake layout.
LAKE_PARTITIONS = ["part_year", "part_region"]
