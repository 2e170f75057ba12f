"""End-to-end batch jobs.

``process_upload``: uploaded CSV -> role mapping -> gold tables (the
upload job).  ``run_batch``: ingest -> frequency job -> model training,
in that dependency order (the daily job; scheduling itself is left to the
platform's scheduler).  Both are plain sequences of Spark jobs; each
output is written by executors, never collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import gold as G
from ..operators import ml as ML
from ..operators import upload as U
from ..schemas import ADMISSIONS
from ..sources import files as FS
from ..sources import gold as GS
from ..sources import lake as LK


def gold_tables(df: DataFrame, diseases: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The gold tables of a role-mapped upload; target tables only when a
    target column was found."""
    out = {"gold_kpis": G.kpis(df),
           "gold_trends": G.trends(df, diseases),
           "gold_regional": A.regional_burden(df)}
    if "is_target" in df.columns:
        out["gold_readmissions"] = G.rate_matrix(df, diseases)
    return out


def process_upload(spark: SparkSession, csv_path: str, gold_dir: str,
                   diseases: Sequence[str] | None = None,
                   required: Sequence[str] = ()) -> dict[str, str]:
    """Read an uploaded CSV, map roles, flag the target and write the gold
    tables as JSON under ``gold_dir``; returns table -> path.

    The mapped frame's columns that the gold tables need are persisted, so
    the CSV is parsed once for all of them and nothing else is kept.  ``required`` columns are
    checked first (``MissingColumnsError``, exit code 2).
    """
    raw = U.read_upload(spark, csv_path)
    if required:
        U.require_columns(raw, list(required))
    mapped = U.prepare_upload(raw)
    df = mapped.select(*[c for c in ("disease", "region", "time_var", "is_target") if c in mapped.columns]).persist()
    try:
        return {name: GS.write_gold(t, name, gold_dir, partitions=1 if name == "gold_kpis" else None)
                for name, t in gold_tables(df, diseases).items()}
    finally:
        df.unpersist()


def run_batch(spark: SparkSession, admissions: DataFrame, out_dir: str,
              train: bool = True) -> dict[str, str]:
    """Daily batch run: ingest the admissions into the partitioned lake,
    then the frequency job (``key<TAB>count`` text) and, reading the same
    lake, model training with its metrics record.  Returns output -> path.
    """
    out = {"lake": LK.write_lake(admissions, f"{out_dir}/lake")}
    lake = LK.read_lake(spark, out["lake"])
    freq = A.disease_frequency(lake)
    out["disease_frequency"] = FS.write_kv(
        FS.kv_lines(freq, ["region", "age_band", "disease"], F.col("cases").cast("string")),
        f"{out_dir}/disease_frequency")
    if train:
        model, _, score, secs = ML.train_onehot(lake.select(*ADMISSIONS.fieldNames()))
        out["model"] = ML.save_model(model, f"{out_dir}/model")
        meta = ML.model_meta(spark, "RandomForestClassifier", score, secs)
        out["model_meta"] = GS.write_gold(meta, "ml_model_meta", out_dir, partitions=1)
    return out


# --- the line-oriented jobs: text lines in, key<TAB>value text out ------------------------

def _count_value(df: DataFrame) -> F.Column:
    return F.col("cases").cast("string")


def _rate_value(df: DataFrame) -> F.Column:
    from ..functions import scalars as S
    return S.format_rate("total_admissions", "readmitted_count",
                         S.ratio("readmitted_count", "total_admissions"))


# job -> (fields needed, aggregate over parsed text columns, key columns, value)
LINE_JOBS = {
    "frequency": (6, A.disease_frequency, ["region", "age_band", "disease"], _count_value),
    "rates": (9, lambda df: A.readmission_rates(df, ignore_case=True, count_col=None),
              ["region", "disease"], _rate_value),
    "yearly": (8, A.yearly_disease_counts, ["year", "disease"], _count_value),
    "weekend": (9, A.weekend_readmission, ["disease", "day_type"], _rate_value),
}


def line_job(spark: SparkSession, job: str, input_path: str) -> DataFrame:
    """(key, value) text of one line-oriented job over raw lines under
    ``input_path`` (nested folders read; header lines skipped; lines with
    too few fields dropped; ``yes`` matched in any case, rows counted)."""
    min_fields, agg, keys, value = LINE_JOBS[job]
    parsed = FS.parse_lines(FS.read_data_lines(spark, input_path), min_fields=min_fields, headers=False)
    out = agg(parsed)
    return FS.kv_lines(out, keys, value(out))


def run_line_job(spark: SparkSession, job: str, input_path: str, output_path: str) -> str:
    """Write a line-oriented job's result as key-sorted ``key<TAB>value``."""
    return FS.write_kv(line_job(spark, job, input_path), output_path)
