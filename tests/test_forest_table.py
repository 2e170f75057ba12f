"""The fitted forests as tables: a walk over the nodes is the model, and the
checks of the model queries fail for a wrong one."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import wardstat.queries as Q
from conftest import SF_SMALL
from wardstat.operators import ml as ML
from wardstat.operators.ranking import roc_auc
from wardstat.sources import fixtures as fx


@pytest.fixture(scope="module")
def adm(spark):
    return fx.admissions_fact(spark, SF_SMALL)


@pytest.fixture(scope="module")
def ordinal(adm):
    return ML.train_ordinal(adm, num_trees=12)


@pytest.fixture(scope="module")
def onehot(adm):
    return ML.train_onehot(adm, num_trees=9)


def _apart(model, rows):
    both = ML.walked(model, model.transform(rows).withColumn("p", vector_to_array("probability")[1]))
    return both.agg(F.max(F.abs(F.col("p") - F.col("walked"))).alias("d"), F.count(F.lit(1)).alias("n")).first()


def test_walk_is_the_ordinal_forest(spark, adm, ordinal):
    odd = spark.createDataFrame([("0-10", "Male", "no such disease", 5.0), (None, None, None, 1e9), ("?", "F", "PROMO", None)],
                                "age_band string, gender string, disease string, treatment_cost double")
    rows = adm.select("age_band", "gender", "disease", F.col("treatment_cost").cast("double").alias("treatment_cost")).unionByName(odd)
    got = _apart(ordinal, rows)
    assert got["d"] <= 1e-9 and got["n"] == adm.count() + 3


def test_walk_is_the_onehot_forest(adm, onehot):
    model, test, _, _ = onehot
    got = _apart(model, test)
    assert got["d"] <= 1e-9 and got["n"] == test.count()


def test_exact_auc_of_the_forest_is_the_evaluators(onehot):
    model, test, score, _ = onehot
    assert abs(ML.auc_table(model, test).first()["auc"] - score) < 2e-3
    few = model.transform(test).select(F.round(vector_to_array("probability")[1], 2).alias("score"), ML.LABEL)
    assert abs(roc_auc(few, "score", ML.LABEL).first()["auc"] - ML.evaluator_auc(few, "score")) < 1e-9


def test_nodes_make_trees(adm, ordinal):
    nodes = ML.forest_nodes(ordinal)
    assert nodes.columns == ML.NODE_COLUMNS
    rows = nodes.collect()
    for t in range(12):
        own = {r["node"]: r for r in rows if r["tree"] == t}
        children = sorted(c for r in own.values() if r["feature"] is not None for c in (r["left"], r["right"]))
        assert children == sorted(set(own) - {0})
        assert all(0 <= r["probability"] <= 1 for r in own.values())
    facts = ML.forest_facts(nodes, adm.count()).first()
    assert (facts["trees"], facts["roots_hold_fit"], facts["children_add_up"]) == (12, True, True)
    assert not ML.forest_facts(nodes, adm.count() // 2).first()["roots_hold_fit"]
    broken = nodes.withColumn("rows", F.when(F.col("node") == 1, F.col("rows") + 1).otherwise(F.col("rows")))
    assert not ML.forest_facts(broken, adm.count()).first()["children_add_up"]


def test_score_checks_hold_and_catch_a_wrong_mapping(adm, ordinal):
    requests = adm.select("age_band", "disease", "treatment_cost", "gender").limit(300)
    checks = ["in_range", "class_agrees", "text_agrees", "walk_agrees", "unseen_as_first"]
    good = Q._checked_scores(ordinal, requests)
    assert good.select(*[F.min(c) for c in checks]).first() == (True,) * 5
    # unseen values keep the index behind the last label instead of code 0
    wrong = SQLTransformer(statement="SELECT *, " + ", ".join(f"{c}_indexed + 0.0 AS {c}_code" for c in ML.CATEGORICAL) + " FROM __THIS__")
    stages = list(ordinal.stages)
    stages[1] = wrong
    bad = Q._checked_scores(PipelineModel(stages), requests).agg(F.min("unseen_as_first"), F.min("walk_agrees")).first()
    assert bad == (False, True)


def test_forest_checks_catch_another_model(spark, adm, ordinal):
    """A forest of other rows, or one that says the same for everybody, does
    not pass for a forest of these."""
    rows = ML.with_label(adm)
    share = rows.agg(F.avg(ML.LABEL)).first()[0]
    good = Q._forest_rows(ordinal, rows, adm.count(), share).collect()
    assert all(r["mean_matches"] and r["roots_hold_fit"] and r["rows"] == r["walked_rows"] for r in good)
    flipped = adm.withColumn("readmitted", F.when(F.col("readmitted") == "Yes", "No").otherwise("Yes"))
    other = Q._forest_rows(ML.train_ordinal(flipped, num_trees=3), rows, adm.count(), share).collect()
    assert not any(r["mean_matches"] for r in other)


def test_record_keeps_the_run_apart(spark, adm):
    train, test = ML.split(adm)
    record = ML.model_record(ML.model_meta(spark, "RandomForestClassifier", 0.61, 2.5), train, test).first()
    assert (record["model_type"], record["status"], record["train_rows"], record["test_rows"]) == \
        ("RandomForestClassifier", ML.READY, train.count(), test.count())
    assert record["run"].asDict() == {"auc_score": 0.61, "training_time_seconds": 2.5}
