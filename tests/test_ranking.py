"""Running totals and the exact area under ROC against plain counting."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from wardstat.operators import ranking as K
from wardstat.operators import windows as W


def plain_auc(rows):
    pos = [s for s, y in rows if s is not None and y is not None and y > 0.5]
    neg = [s for s, y in rows if s is not None and y is not None and y <= 0.5]
    if not pos or not neg:
        return len(pos), len(neg), None
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return len(pos), len(neg), won / (len(pos) * len(neg))


def frame(spark, rows):
    return spark.createDataFrame([(s, y, 1, "x") for s, y in rows], "score double, label double, below long, won string")


@pytest.mark.parametrize("seed,scores", [(1, 3), (2, 50), (3, 100_000)])
def test_auc_matches_all_pairs(spark, seed, scores):
    rng = random.Random(seed)
    rows = [(rng.randrange(scores) / scores, float(rng.random() < 0.3)) for _ in range(700)]
    rows += [(None, 1.0), (0.5, None), (0.0, 1.0), (1.0, 0.0)]
    got = K.roc_auc(frame(spark, rows).repartition(7)).first()
    p, n, auc = plain_auc(rows)
    assert (got["positives"], got["negatives"]) == (p, n) and abs(got["auc"] - auc) < 1e-12


@pytest.mark.parametrize("rows", [[], [(0.1, 1.0)], [(0.1, 0.0), (0.2, 0.0)], [(None, 1.0)]])
def test_auc_of_one_class_is_null(spark, rows):
    p, n, _ = plain_auc(rows)
    assert tuple(K.roc_auc(frame(spark, rows)).first()) == (p, n, None)


def test_auc_of_ties_and_of_a_perfect_score(spark):
    assert K.roc_auc(frame(spark, [(0.5, 1.0), (0.5, 0.0)] * 10)).first()["auc"] == 0.5
    assert K.roc_auc(frame(spark, [(0.9, 1.0), (0.1, 0.0)] * 10)).first()["auc"] == 1.0
    assert K.roc_auc(frame(spark, [(0.1, 1.0), (0.9, 0.0)] * 10)).first()["auc"] == 0.0


def test_auc_equals_the_evaluator_and_not_the_layout(spark):
    rng = random.Random(9)
    rows = [(round(rng.random(), 2), float(rng.random() < 0.4)) for _ in range(900)]
    df = frame(spark, rows)
    other = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(df)
    got = {K.roc_auc(df.repartition(k)).first()["auc"] for k in (1, 3, 8)}
    assert len(got) == 1 and abs(got.pop() - other) < 1e-9


def test_curve_ends_at_one(spark):
    rows = [(0.9, 1.0), (0.9, 0.0), (0.7, 1.0), (0.1, 0.0)]
    got = {r["score"]: tuple(r)[1:] for r in K.roc_curve(frame(spark, rows)).collect()}
    assert got == {0.9: (1, 1, 0.5, 0.5), 0.7: (2, 1, 1.0, 0.5), 0.1: (2, 2, 1.0, 1.0)}


def test_running_totals_over_many_partitions(spark):
    rows = [(i, i % 7, 1.0 * i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, a long, b double").orderBy(F.rand(3))
    got = {r["k"]: (r["before_a"], r["before_b"]) for r in W.running_totals(df, ["k"], {"before_a": "a", "before_b": "b"}, 6).collect()}
    assert got == {i: (sum(x % 7 for x in range(i)), float(sum(range(i)))) for i in range(500)}
    down = W.running_totals(df, [F.desc("k")], {"t": "a"}, 3).where("k = 0").first()["t"]
    assert down == sum(x % 7 for x in range(1, 500))
    assert W.running_totals(df.limit(0), ["k"], {"t": "a"}).collect() == []
