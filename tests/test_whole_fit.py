"""The forests are fitted on all rows, also beyond two million of them."""

import functools

import pytest
from pyspark.sql import functions as F

import wardstat.queries as Q
from wardstat.operators import ml as ML
from wardstat.operators.ranking import roc_auc

ROWS = 2_600_000  # more than two million of them are in the training part


@pytest.fixture(scope="module")
def adm(spark):
    n = F.col("id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    df = spark.range(ROWS).select(
        n.cast("string").alias("patient_id"), pick(["0-10", "51-60", "90+"], n).alias("age_band"), pick(["F", "M"], F.xxhash64(n) % 2 + 2).alias("gender"),
        pick(["PROMO", "SMALL"], F.floor(n / 7)).alias("disease"), F.when(n % 3 == 0, "Yes").otherwise("No").alias("readmitted"),
        (n % 9973).cast("double").alias("treatment_cost"))
    df = df.persist()
    yield df
    df.unpersist()


def _root_rows(model):
    return [r["rows"] for r in ML.forest_nodes(model).where("node = 0").collect()]


def test_onehot_forest_is_fitted_on_the_whole_training_part(adm):
    model, test, _, _ = ML.train_onehot(adm, num_trees=2)
    train_rows = ROWS - test.count()
    assert train_rows > 2_000_000
    assert ML.forest_facts(ML.forest_nodes(model), train_rows).first()["roots_hold_fit"], _root_rows(model)


def test_evaluator_takes_every_score(spark):
    x = F.xxhash64("id") % 1_000_000
    df = spark.range(5_000).select((x / 1e6).alias("score"), (F.xxhash64(F.col("id") + 7) % 2 == 0).cast("double").alias(ML.LABEL))
    assert abs(ML.evaluator_auc(df, "score") - roc_auc(df, "score", ML.LABEL).first()["auc"]) < 1e-9


def test_ordinal_query_compares_with_all_rows(spark, adm, monkeypatch):
    held, facts, train = [], ML.forest_facts, ML.train_ordinal
    monkeypatch.setattr(Q, "_adm", lambda s, d: adm)
    monkeypatch.setattr(ML, "train_ordinal", functools.partial(train, num_trees=2, max_depth=2))
    monkeypatch.setattr(ML, "forest_facts", lambda nodes, fit_rows: held.append(fit_rows) or facts(nodes, fit_rows))
    got = Q.q_ml_train_rf_ordinal(spark, "").collect()
    assert held == [ROWS]
    assert sum(r["rows"] for r in got) == ROWS and all(r["roots_hold_fit"] and r["rows"] == r["walked_rows"] for r in got)


def test_recorded_model_is_fitted_on_the_recorded_rows(spark, adm, monkeypatch):
    fitted, real = [], ML.onehot_pipeline

    class Noting:
        def __init__(self, num_trees, seed):
            self.pipeline = real(1, seed)

        def fit(self, df):
            fitted.append(df.count())
            return self.pipeline.fit(df)
    monkeypatch.setattr(Q, "_adm", lambda s, d: adm)
    monkeypatch.setattr(ML, "onehot_pipeline", Noting)
    row = Q.q_sink_model_meta(spark, "").first()
    assert fitted == [row["train_rows"]] and row["train_rows"] + row["test_rows"] == ROWS


def test_layout_keeps_all_rows_and_spreads_a_common_one(spark):
    n = F.col("id")
    rows = spark.range(2_100_000).select(F.when(n % 2 == 0, "x").alias("a"), F.when(n % 2 == 1, n).cast("double").alias("b"))
    laid = ML.fit_layout(rows)
    parts = laid.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("common")).collect()
    assert sum(r["n"] for r in parts) == 2_100_000 and sum(r["common"] for r in parts) == 1_050_000
    assert len(parts) == 34 and max(r["n"] for r in parts) < 2 * ML.PARTITION_ROWS
