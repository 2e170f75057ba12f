"""Gold tables of the upload path: KPIs, trend pivot, rate pivot.

Inputs are role-mapped frames (``upload.prepare_upload``): columns
``disease``, ``region``, ``time_var`` and, when a target was found,
``is_target``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import ensure_checkpoint_dir

# The KPI texts for "no disease" and "no target rate".
UNKNOWN_DISEASE = "Unknown"
NO_RATE = "0%"


def kpis(df: DataFrame) -> DataFrame:
    """One row: total rows (``60,000`` text), distinct regions (a NULL
    region counts as one), most frequent disease (``Unknown`` if none) and
    the mean target as ``12.3%`` (``0%`` without a target or mean).

    The rows are aggregated by (disease, region); grouping sets
    (disease), (region) and () over that small result give the per-disease
    counts, the region groups and the totals together, and a final one-row
    aggregate picks the values: one scan, no join.
    """
    has_target = "is_target" in df.columns
    tgt = F.col("is_target") if has_target else F.lit(None).cast("double")
    # Counts and target sums are additive: aggregate the rows to one per
    # (disease, region) first, so the grouping-set expansion works on those
    # few rows instead of tripling every input row.
    base = (df.groupBy("disease", "region")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(tgt).alias("t_sum"), F.count(tgt).alias("t_n")))
    by_sets = (base.groupingSets([["disease"], ["region"], []], "disease", "region")
               .agg(F.grouping_id().alias("gid"),
                    F.sum("n").alias("n"),
                    F.sum("t_sum").alias("t_sum"),
                    F.sum("t_n").alias("t_n")))
    disease_level, region_level, grand = 1, 2, 3
    g = F.col("gid")
    one = by_sets.agg(
        F.max(F.when(g == grand, F.col("n"))).alias("total"),
        F.count(F.when(g == region_level, F.lit(1))).alias("regions_analyzed"),
        F.min(F.when(g == disease_level,
                     F.struct((-F.col("n")).alias("neg_n"), F.col("disease").alias("d"))))["d"]
        .alias("top"),
        F.max(F.when(g == grand, S.ratio("t_sum", "t_n"))).alias("mean_target"),
        F.max(F.when(g == disease_level, F.lit(1))).alias("any_disease"),
    )
    return one.select(
        S.format_thousands(F.coalesce(F.col("total"), F.lit(0))).alias("total_records_processed"),
        F.col("regions_analyzed"),
        F.when(F.col("any_disease").isNull(), F.lit(UNKNOWN_DISEASE)).otherwise(F.col("top"))
        .alias("top_disease"),
        F.coalesce(S.format_pct("mean_target"), F.lit(NO_RATE)).alias("avg_readmission_rate"),
    )


def kpi_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"))


def kpi_regions(df: DataFrame) -> DataFrame:
    """Distinct regions, a NULL region counting as one value; 0 without rows."""
    null_region = F.coalesce(F.max(F.col("region").isNull().cast("int")), F.lit(0))
    return df.agg((F.count_distinct("region") + null_region).cast("long").alias("regions_analyzed"))


def kpi_top_disease(df: DataFrame) -> DataFrame:
    """Most frequent disease and its count (ties -> smallest name, a NULL
    disease counting as one); ``Unknown`` and 0 without rows."""
    counts = df.groupBy("disease").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("disease").alias("d"))).alias("m"))
    return top.select(F.when(F.col("m").isNull(), F.lit(UNKNOWN_DISEASE)).otherwise(F.col("m.d")).alias("top_disease"),
                      F.coalesce(-F.col("m.neg_n"), F.lit(0)).cast("long").alias("cases"))


def kpi_target_rate(df: DataFrame) -> DataFrame:
    if "is_target" not in df.columns:
        return df.agg(F.lit(NO_RATE).alias("avg_readmission_rate"))
    return df.agg(F.coalesce(S.format_pct(F.avg("is_target")), F.lit(NO_RATE))
                  .alias("avg_readmission_rate"))


def _small(df: DataFrame) -> DataFrame:
    """A grouped result (one row per pair of keys) kept under the shared
    checkpoint folder: ``pivot`` looks for its columns and then aggregates, and
    neither is to scan the rows behind it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def trends(df: DataFrame, diseases: Sequence[str] | None = None) -> DataFrame:
    """Rows = year (first four characters of ``time_var``), one column per
    disease with the row count, 0 where absent, ordered by year.

    The rows are grouped by year and disease in one scan, and that small result is pivoted.
    The diseases are found in the data (at most ``spark.sql.pivotMaxValues``,
    more is an error) unless given; given values are taken as the whole
    domain (a disease outside them has no column).  A NULL disease becomes
    a ``null`` column.
    """
    per = _small(df.groupBy(S.year_prefix("time_var").alias("year"), "disease").agg(F.count(F.lit(1)).alias("n")))
    return per.groupBy("year").pivot("disease", _listed(diseases)).agg(F.sum("n")).fillna(0).orderBy("year")


def pivot_mean(df: DataFrame, rows: str, columns: str, value: str, values: Sequence | None = None,
               fill: float | None = 0.0) -> DataFrame:
    """One row per ``rows``, one column per value of ``columns``, with the
    mean of ``value`` rounded to two places; cells without one are ``fill``
    (``None``: NULL).  One scan, then a pivot of the grouped result."""
    per = _small(df.groupBy(rows, columns).agg(F.avg(value).alias("mean")))
    out = per.groupBy(rows).pivot(columns, _listed(values)).agg(F.round(F.max("mean"), 2))
    return out if fill is None else out.fillna(fill)


def rate_matrix(df: DataFrame, diseases: Sequence[str] | None = None,
                fill: float | None = 0.0) -> DataFrame:
    """Rows = region, one column per disease with round(mean target, 2).

    Empty cells are 0 by default (indistinguishable from a zero rate);
    ``fill=None`` keeps them NULL.
    """
    return pivot_mean(df, "region", "disease", "is_target", diseases, fill)


def _listed(values: Sequence | None) -> list | None:
    return None if values is None else list(values)
