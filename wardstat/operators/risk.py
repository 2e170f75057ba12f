"""Rule-based readmission risk scores.

Both rules are row-wise ``when`` sums over built-in expressions.  The
weights are decimals, so scores are exact and equal in every engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Fixed values of the prior rule (the readmission probability behind the
# reference's synthetic data): base, older-age, high-risk-disease and
# weekend increments.
PRIOR_BASE = "0.15"
PRIOR_OLD_AGE = "0.10"
PRIOR_DISEASE = "0.05"
PRIOR_WEEKEND = "0.08"
OLD_AGE_BANDS = ["71-80", "81-90", "90+"]
PRIOR_DISEASES = ["Heart Disease", "Sepsis", "COPD"]

# Fixed values of the fallback rule (used when no model is available):
FALLBACK_DISEASE = "Heart Disease"
FALLBACK_DISEASE_BASE = "0.35"
FALLBACK_BASE = "0.15"
FALLBACK_AGE_MARKERS = ["71", "81"]
FALLBACK_AGE_PENALTY = "0.2"
FALLBACK_CAP = "0.95"
HIGH_RISK_THRESHOLD = 0.4
HIGH_RISK = "High Risk"
LOW_RISK = "Low Risk"


def _dec(x: str) -> Column:
    return F.lit(x).cast("decimal(4,2)")


def risk_prior(adm: DataFrame, diseases: Sequence[str] = PRIOR_DISEASES,
               old_bands: Sequence[str] = OLD_AGE_BANDS) -> DataFrame:
    """Adds ``prior_risk`` (double): base + increments for an old age band,
    a high-risk disease and a weekend admission (strictly parsed date)."""
    wkend = S.day_type(S.date_of(adm, "admission_date")) == F.lit(S.WEEKEND_LABEL)
    score = (_dec(PRIOR_BASE)
             + F.when(F.col("age_band").isin(list(old_bands)), _dec(PRIOR_OLD_AGE)).otherwise(_dec("0"))
             + F.when(F.col("disease").isin(list(diseases)), _dec(PRIOR_DISEASE)).otherwise(_dec("0"))
             + F.when(F.coalesce(wkend, F.lit(False)), _dec(PRIOR_WEEKEND)).otherwise(_dec("0")))
    return adm.withColumn("prior_risk", score.cast("double"))


def prior_calibration(adm: DataFrame, diseases: Sequence[str] = PRIOR_DISEASES) -> DataFrame:
    """Expected (mean prior) versus observed readmission rate by age band,
    disease and day type; sums are exact decimals."""
    scored = risk_prior(adm, diseases)
    scored = scored.withColumn("day_type", S.day_type(S.date_of(adm, "admission_date")))
    return (scored.groupBy("age_band", "disease", "day_type")
            .agg(F.count(F.lit(1)).alias("admissions"),
                 S.ratio(F.sum(F.col("prior_risk").cast("decimal(10,2)")), F.count(F.lit(1)))
                 .alias("expected_rate"),
                 S.ratio(F.sum(S.flag("readmitted")), F.count(F.lit(1))).alias("observed_rate")))


def risk_fallback(df: DataFrame, disease: str = FALLBACK_DISEASE,
                  threshold: float = HIGH_RISK_THRESHOLD) -> DataFrame:
    """Adds ``risk`` (double), ``probability`` (``55.0%``) and
    ``prediction`` (High/Low Risk, strictly above the threshold)."""
    base = F.when(F.col("disease") == F.lit(disease), _dec(FALLBACK_DISEASE_BASE)).otherwise(_dec(FALLBACK_BASE))
    old = F.lit(False)
    for marker in FALLBACK_AGE_MARKERS:
        old = old | F.coalesce(F.col("age_band").contains(marker), F.lit(False))
    risk = F.least(_dec(FALLBACK_CAP), base + F.when(old, _dec(FALLBACK_AGE_PENALTY)).otherwise(_dec("0")))
    return (df.withColumn("risk", risk.cast("double"))
            .withColumn("probability", F.format_string("%.1f%%", (risk * F.lit(100)).cast("double")))
            .withColumn("prediction", F.when(F.col("risk") > F.lit(threshold), F.lit(HIGH_RISK))
                        .otherwise(F.lit(LOW_RISK))))
