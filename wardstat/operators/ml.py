"""Readmission models with Spark ML.

Two forests, as in the reference:

* ``onehot``: string-indexed age band, gender and disease, one-hot
  encoded, plus treatment cost; 20 trees; trained on an 80 % split and
  evaluated by area under ROC on the rest.
* ``ordinal``: the same columns as alphabetical integer codes (no
  one-hot, treated as ordered numbers), plus cost; 50 trees of depth 5,
  seed 42.  This is the model used for scoring:
  an unseen value gets code 0.

Both are fitted on all rows of their training part.  Training and
evaluation are distributed Spark ML jobs; nothing is collected to the
driver but the fitted model and the metric.  Node ids are not cached
between tree levels: they would take a number per row and tree, and the
forest that executors receive on every pass instead has at most 63 nodes a
tree.
"""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import scratch_path
from .ranking import roc_auc
from .risk import HIGH_RISK, HIGH_RISK_THRESHOLD, LOW_RISK

CATEGORICAL = ["age_band", "gender", "disease"]
NUMERIC = ["treatment_cost"]
# Column order of the ordinal model's feature vector.
ORDINAL_ORDER = ["age_band", "disease", "gender"]
LABEL = "label"
# Fixed value: the status text of a trained model's record.
READY = "Ready for Production"


# Partitions of a training set, whatever the cluster: bagging draws per
# partition, so the layout is part of the model.  A set of more than
# FIT_PARTITIONS * PARTITION_ROWS rows has more of them.
FIT_PARTITIONS = 32
PARTITION_ROWS = 62_500
# Equal rows that stay together in one partition, at most.
EQUAL_ROWS = 1_000


def row_hash(*cols: str) -> F.Column:
    """A number from 0 to 999,999 made of a row's text: the first eight
    hexadecimal digits of the md5 of its columns' texts joined by ``|``."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 1_000_000


def fit_layout(df: DataFrame, fit_rows: int | None = None) -> DataFrame:
    """The rows to fit on -- all of them -- laid out by their content alone:
    dealt by hash to ``FIT_PARTITIONS`` partitions, or as many as hold about
    ``PARTITION_ROWS`` each, and sorted.  So the same rows give the same forest
    on any cluster and from any files.

    Equal rows are counted and dealt in pieces of ``EQUAL_ROWS``, so a very
    common row is spread as well.  Only a caller that gives ``fit_rows`` gets
    less: a share of the row hashes, about so many rows.
    """
    total = df.count()
    if fit_rows is not None and total > fit_rows:
        df = df.where(row_hash(*df.columns) < int(1_000_000 * fit_rows / total))
        total = fit_rows
    cols = df.columns
    pieces = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_rows")) \
        .withColumn("_piece", F.explode(F.expr(f"sequence(0L, (_rows - 1) DIV {EQUAL_ROWS})")))
    # A null leaves the hash as it is: the first piece goes where the row alone does.
    salt = F.when(F.col("_piece") > 0, F.col("_piece"))
    dealt = pieces.repartition(max(FIT_PARTITIONS, -(-total // PARTITION_ROWS)), *cols, salt).sortWithinPartitions(*cols, "_piece")
    each = F.expr(f"sequence(1L, least({EQUAL_ROWS}, _rows - _piece * {EQUAL_ROWS}))")
    return dealt.withColumn("_row", F.explode(each)).select(*cols)


def with_label(adm: DataFrame) -> DataFrame:
    """label = 1.0 when readmitted is exactly ``Yes``, else 0.0."""
    return adm.withColumn(LABEL, S.flag("readmitted", "Yes").cast("double"))


def indexers(order: str = "frequencyDesc") -> list[StringIndexer]:
    """One multi-column indexer: all label counts come from a single pass."""
    return [StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_indexed" for c in CATEGORICAL],
                          handleInvalid="keep", stringOrderType=order)]


def onehot_pipeline(num_trees: int = 20, seed: int | None = 42) -> Pipeline:
    """Index -> one-hot -> assemble -> forest."""
    enc = [OneHotEncoder(inputCols=[f"{c}_indexed" for c in CATEGORICAL],
                         outputCols=[f"{c}_vec" for c in CATEGORICAL])]
    asm = VectorAssembler(inputCols=[f"{c}_vec" for c in CATEGORICAL] + NUMERIC, outputCol="features")
    rf = RandomForestClassifier(labelCol=LABEL, featuresCol="features", numTrees=num_trees, seed=seed)
    return Pipeline(stages=indexers() + enc + [asm, rf])


def _ordinal_codes(model) -> SQLTransformer:
    """Integer codes from fitted alphabetical indexers; an unseen value
    (index == number of labels, from ``handleInvalid="keep"``) becomes 0.
    The arithmetic drops the nominal metadata, so the forest treats the
    codes as ordered numbers."""
    parts = []
    for c, labels in zip(CATEGORICAL, model.labelsArray):
        n = len(labels)
        parts.append(f"CASE WHEN {c}_indexed >= {n} THEN 0.0 ELSE {c}_indexed + 0.0 END AS {c}_code")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def train_ordinal(adm: DataFrame, num_trees: int = 50, max_depth: int = 5,
                  seed: int = 42, fit_rows: int | None = None) -> PipelineModel:
    """Fit the ordinal-code forest on all rows (``fit_layout``; a caller's
    ``fit_rows`` bounds the trees' rows, the codes come from all in any case)."""
    rows = with_label(adm).select(*CATEGORICAL, *NUMERIC, LABEL)
    data = fit_layout(rows, fit_rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        idx_models = Pipeline(stages=indexers("alphabetAsc")).fit(rows).stages
        codes = _ordinal_codes(idx_models[0])
        asm = VectorAssembler(inputCols=[f"{c}_code" for c in ORDINAL_ORDER] + NUMERIC,
                              outputCol="features", handleInvalid="keep")
        rf = RandomForestClassifier(labelCol=LABEL, featuresCol="features", numTrees=num_trees,
                                    maxDepth=max_depth, seed=seed)
        head = PipelineModel(stages=list(idx_models) + [codes, asm])
        forest = rf.fit(head.transform(data))
        return PipelineModel(stages=list(idx_models) + [codes, asm, forest])
    finally:
        data.unpersist()


def split(adm: DataFrame, train_fraction: float = 0.8, seed: int = 42,
          method: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Train/test split.

    ``hash`` (default): a row goes to train when ``row_hash`` of its content falls
    below the fraction -- the same split whatever the layout, partitioning
    or run (identical rows land on the same side), without a sort.
    ``random``: seeded ``randomSplit`` (per-row Bernoulli draw); repeatable
    for the same physical layout of the input only.
    """
    labelled = with_label(adm)
    if method == "random":
        train, test = labelled.randomSplit([train_fraction, 1.0 - train_fraction], seed=seed)
        return train, test
    if method != "hash":
        raise ValueError(f"unknown split method {method!r}")
    in_train = row_hash(*adm.columns) < F.lit(round(train_fraction * 1_000_000))
    return labelled.where(in_train), labelled.where(~in_train)


def train_onehot(adm: DataFrame, num_trees: int = 20, seed: int = 42, train_fraction: float = 0.8,
                 split_method: str = "hash", fit_rows: int | None = None) -> tuple[PipelineModel, DataFrame, float, float]:
    """Fit the one-hot forest on the whole training split (unless a caller
    gives ``fit_rows``); returns the model, the test split, its area under ROC
    and the seconds that training and evaluation took."""
    train, test = split(adm, train_fraction, seed, split_method)
    train = fit_layout(train.select(*CATEGORICAL, *NUMERIC, LABEL), fit_rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        t0 = time.time()
        model = onehot_pipeline(num_trees, seed).fit(train)
        score = auc(model, test)
        return model, test, score, time.time() - t0
    finally:
        train.unpersist()


def auc(model: PipelineModel, test: DataFrame) -> float:
    """Area under ROC on ``test`` by Spark's evaluator, over the curve of every
    score (``auc_table`` gives it as a DataFrame)."""
    pred = model.transform(test)
    return BinaryClassificationEvaluator(labelCol=LABEL, metricName="areaUnderROC", numBins=0).evaluate(pred)


def evaluator_auc(df: DataFrame, score: str, label: str = LABEL) -> float:
    """The same evaluator over any score column."""
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0).evaluate(df)


def auc_table(model: PipelineModel, test: DataFrame) -> DataFrame:
    """One row: positives, negatives and the exact area under ROC of the
    model's probability on ``test`` (``ranking.roc_auc``)."""
    pred = model.transform(test).select(vector_to_array("probability")[1].alias("score"), LABEL)
    return roc_auc(pred, "score", LABEL)


# --- the forest as data ---------------------------------------------------------------

NODE_COLUMNS = ["tree", "node", "feature", "threshold", "left", "right", "rows", "probability"]


def forest_nodes(model: PipelineModel) -> DataFrame:
    """The fitted forest as a table, one row per node: ``tree``, ``node`` (0
    is the root), the ``feature`` that it asks for and the ``threshold`` (the
    left child takes values up to it), the children ``left`` and ``right``
    (all NULL for a leaf), the training ``rows`` that came by, and the
    ``probability`` of the positive class there.

    A split of a 0/1 feature is written as the threshold 0.5.  The forest is
    saved with Spark ML's own writer under the checkpoint folder and read back as
    the table that the writer makes.
    """
    forest = model.stages[-1]
    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    forest.write().overwrite().save(path)
    n = F.col("nodeData")
    split = n["split"]
    is_split = n["leftChild"] >= 0
    binary = split["numCategories"] == 2
    # The left child takes the listed categories: {0} is "up to 0.5", {1} the other way round.
    turned = binary & (split["leftCategoriesOrThreshold"][0] == 1.0)
    children = [F.when(turned, n["rightChild"]).otherwise(n["leftChild"]), F.when(turned, n["leftChild"]).otherwise(n["rightChild"])]
    counts = n["impurityStats"]
    rows = spark.read.parquet(f"{path}/data")
    if not rows.where(is_split & (split["numCategories"] > 2)).isEmpty():
        raise ValueError("splits of features with more than two categories have no threshold")
    return rows.select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(is_split, split["featureIndex"]).alias("feature"),
        F.when(is_split, F.when(binary, F.lit(0.5)).otherwise(F.try_element_at(split["leftCategoriesOrThreshold"], F.lit(1)))).alias("threshold"),
        F.when(is_split, children[0]).alias("left"), F.when(is_split, children[1]).alias("right"),
        n["rawCount"].alias("rows"), F.try_divide(counts[1], counts[0] + counts[1]).alias("probability"))


def feature_columns(model: PipelineModel) -> list[Column]:
    """The forest's features as expressions over a request's own columns,
    in the order of its vector: built from the fitted labels alone."""
    labels = dict(zip(CATEGORICAL, model.stages[0].labelsArray, strict=True))
    onehot = any(type(s).__name__ == "OneHotEncoderModel" for s in model.stages)
    out = []
    for c in CATEGORICAL if onehot else ORDINAL_ORDER:
        if onehot:
            out += [F.when(F.col(c) == label, 1.0).otherwise(0.0) for label in labels[c]]
        else:  # an unseen or missing value has code 0
            place = F.array_position(F.array(*[F.lit(x) for x in labels[c]]), F.col(c))
            out.append(F.coalesce(F.greatest(place - 1, F.lit(0)), F.lit(0)).cast("double"))
    return out + [F.col(c).cast("double") for c in NUMERIC]


def walked(model: PipelineModel, df: DataFrame, name: str = "walked", nodes: DataFrame | None = None) -> DataFrame:
    """Adds the positive class's probability by walking the node table with
    expressions: a row goes down every tree by nested ``CASE``, and the leaves'
    probabilities are averaged.  No model is called.

    The node table is taken to the driver to write the expressions; it is as
    large as the model, whatever the data.
    """
    table = (forest_nodes(model) if nodes is None else nodes).select(NODE_COLUMNS).collect()
    tree: dict[tuple[int, int], object] = {(r["tree"], r["node"]): r for r in table}
    features = feature_columns(model)
    names = [f"_feature_{i}" for i in range(len(features))]

    def down(t: int, node: int) -> str:
        r = tree[t, node]
        if r["feature"] is None:
            return "CAST(NULL AS DOUBLE)" if r["probability"] is None else f"{r['probability']!r}D"
        return (f"CASE WHEN {names[r['feature']]} <= {r['threshold']!r}D THEN {down(t, r['left'])}"
                f" ELSE {down(t, r['right'])} END")
    trees = sorted({t for t, _ in tree})
    votes = F.aggregate(F.array(*[F.expr(down(t, 0)) for t in trees]), F.lit(0.0), lambda a, b: a + b)
    with_features = df.withColumns(dict(zip(names, features, strict=True)))
    return with_features.withColumn(name, votes / len(trees)).drop(*names)


def forest_facts(nodes: DataFrame, fit_rows: int) -> DataFrame:
    """One row about a forest that was fitted on ``fit_rows`` rows: ``trees``,
    ``roots_hold_fit`` (each tree was grown on a bootstrap of as many rows, six
    standard deviations at most apart) and ``children_add_up`` (the rows of
    every split are those of its children)."""
    apart = F.abs(F.col("rows") - fit_rows) <= 6 * (max(1, fit_rows) ** 0.5)
    side = lambda c: nodes.select("tree", F.col("node").alias(c), F.col("rows").alias(f"{c}_rows"))
    splits = nodes.join(side("left"), ["tree", "left"]).join(side("right"), ["tree", "right"])
    whole = splits.agg(F.coalesce(F.min(F.col("rows") == F.col("left_rows") + F.col("right_rows")), F.lit(True)).alias("children_add_up"))
    roots = nodes.where("node = 0").agg(F.count(F.lit(1)).alias("trees"), F.min(apart).alias("roots_hold_fit"))
    return roots.withColumn("children_add_up", F.col("trees").isNotNull() & whole.scalar())


def score(model: PipelineModel, df: DataFrame, threshold: float = HIGH_RISK_THRESHOLD) -> DataFrame:
    """Batch scoring: ``probability`` (P(readmitted)), ``probability_text``
    (``23.4%``) and ``prediction`` (High Risk strictly above the
    threshold).  Input columns: age_band, gender, disease, treatment_cost."""
    pred = model.transform(df)
    p1 = vector_to_array("probability")[1]
    keep = [c for c in df.columns]
    return (pred.select(*keep, p1.alias("probability"))
            .withColumn("probability_text", S.format_pct("probability", 1))
            .withColumn("prediction", F.when(F.col("probability") > F.lit(threshold), F.lit(HIGH_RISK))
                        .otherwise(F.lit(LOW_RISK))))


def model_meta(spark: SparkSession, model_type: str, auc_score: float, seconds: float,
               features: list[str] | None = None, status: str = READY) -> DataFrame:
    """One-row metrics record of a trained model."""
    return spark.createDataFrame(
        [(model_type, float(auc_score), float(seconds), features or CATEGORICAL + NUMERIC, status)],
        "model_type string, auc_score double, training_time_seconds double, "
        "features_used array<string>, status string")


def model_record(meta: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """A metrics record in two parts: what the data and the settings fix
    (``model_type``, ``features_used``, ``status``, ``train_rows``,
    ``test_rows``) and, in the struct ``run``, what one run measured
    (``auc_score``, ``training_time_seconds``)."""
    rows = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return meta.select("model_type", "features_used", "status", rows(train).alias("train_rows"), rows(test).alias("test_rows"),
                       F.struct("auc_score", "training_time_seconds").alias("run"))


def save_model(model: PipelineModel, path: str) -> str:
    """Persist the fitted pipeline (encoders included)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
