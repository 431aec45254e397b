"""Candidate classifiers of media, their selection, calibration and evaluation, on MLlib.

Rows: a key, label (0 or 1), split (train, validation, test, test_holdout), generator, and one column per feature.
Null features count as 0. Training needs both classes; otherwise a ValueError says which set lacks one.
Scores are votes of models, never conclusions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names of sources that are no generators.
NOT_GENERATORS = ("real", "camera", "unknown")
NAMES = ("logistic", "kernel_svm", "forest", "boosting")
SEED = 42


def kernel_features(width: int, count: int = 128, seed: int = SEED):
    """Random Fourier features of the Gaussian kernel with gamma 1 / width over scaled features."""
    rng = np.random.default_rng(seed)
    weights, phase = rng.normal(0, np.sqrt(2.0 / width), (width, count)), rng.uniform(0, 2 * np.pi, count)

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        if values.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.sqrt(2.0 / count) * np.cos(np.stack(values.to_numpy()) @ weights + phase)))

    return project


@dataclass
class Model:
    """A fitted candidate: its prepared stages, its estimator, and the calibrators of its folds if any."""

    name: str
    features: list[str]
    scaler: PipelineModel
    parts: list[tuple[object, LogisticRegressionModel | None]]

    def prepared(self, rows: DataFrame) -> DataFrame:
        lost = [c for c in self.features if c not in rows.columns]
        if lost:
            raise ValueError(f"features missing: {', '.join(lost)}")
        return prepare(rows, self.features, self.scaler, self.name)

    def score(self, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
        """rows with score (mean over parts) and predicted."""
        out = self.prepared(rows)
        for i, (fitted, calibrator) in enumerate(self.parts):
            out = with_score(out, fitted, calibrator, f"part_{i}")
        mean = reduce(lambda a, b: a + b, [F.col(f"part_{i}") for i in range(len(self.parts))]) / len(self.parts)
        return out.select(*rows.columns, mean.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def prepare(rows: DataFrame, features: list[str], scaler: PipelineModel, name: str) -> DataFrame:
    out = scaler.transform(rows.fillna(0.0, features))
    if name == "kernel_svm":
        out = out.withColumn("vector", array_to_vector(kernel_features(len(features))(vector_to_array("vector"))))
    return out


def estimator(name: str, trees: int, count: int):
    if name == "logistic":
        made = LogisticRegression(regParam=1.0 / max(1, count))
    elif name == "kernel_svm":
        made = LinearSVC(regParam=1.0 / (2.0 * max(1, count)), maxIter=50)
    elif name == "forest":
        made = RandomForestClassifier(numTrees=trees, maxDepth=10, seed=SEED)
    elif name == "boosting":
        made = GBTClassifier(maxIter=100, maxDepth=4, seed=SEED)
    else:
        raise ValueError(f"unknown candidate {name}")
    if name != "kernel_svm":
        made = made.setProbabilityCol("tmp_probability")
    return made.setFeaturesCol("vector").setLabelCol("label").setWeightCol("weight").setPredictionCol("tmp_prediction").setRawPredictionCol("tmp_raw")


def with_score(prepared: DataFrame, fitted, calibrator: LogisticRegressionModel | None, column: str) -> DataFrame:
    """prepared with the probability of class 1: the calibrated margin, else the model's own, else the logistic of its margin."""
    out = fitted.transform(prepared)
    margin = vector_to_array("tmp_raw")[1]
    if calibrator is not None:
        slope, shift = float(calibrator.coefficients[0]), float(calibrator.intercept)
        value = 1 / (1 + F.exp(-(margin * slope + shift)))
    elif "tmp_probability" in out.columns:
        value = vector_to_array("tmp_probability")[1]
    else:
        value = 1 / (1 + F.exp(-margin))
    return out.withColumn(column, value).drop("tmp_prediction", "tmp_raw", "tmp_probability")


def class_counts(rows: DataFrame, what: str) -> dict[int, int]:
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if set(counts) < {0, 1}:
        raise ValueError(f"{what} lacks a class: {counts}")
    return counts


def fit(rows: DataFrame, features: list[str], name: str, key: str, trees: int = 300, calibrate: bool = False, folds: int = 5) -> Model:
    """One candidate. Classes weigh alike. With calibrate, each fold's model is calibrated on the rows it hasn't seen."""
    counts = class_counts(rows, "training set")
    total = sum(counts.values())
    scaler = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="assembled"), StandardScaler(inputCol="assembled", outputCol="vector", withMean=True)]).fit(rows.fillna(0.0, features))
    weight = F.when(F.col("label") == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0]))
    ready = prepare(rows, features, scaler, name).withColumn("weight", weight).withColumn("fold", fold_of(key, min(folds, *counts.values()) or 1)).persist()
    try:
        if not calibrate:
            return Model(name, features, scaler, [(estimator(name, trees, total).fit(ready), None)])
        folds = min(folds, *counts.values())
        if folds < 3:
            raise ValueError(f"calibration needs 3 rows of each class: {counts}")
        parts = []
        for k in range(folds):
            fitted = estimator(name, trees, total).fit(ready.filter(F.col("fold") != k))
            unseen = fitted.transform(ready.filter(F.col("fold") == k)).select("label", F.array(vector_to_array("tmp_raw")[1]).alias("m")).select("label", array_to_vector("m").alias("margin"))
            parts.append((fitted, LogisticRegression(featuresCol="margin", labelCol="label").fit(unseen)))
        return Model(name, features, scaler, parts)
    finally:
        ready.unpersist()


def stratified(rows: DataFrame, key: str, folds: int) -> DataFrame:
    """rows with `stratum_fold`: each class is dealt out over the folds one by one in the order of a hash of the key, so that
    folds differ by one row of a class at most.

    The numbers of a class come in two steps, in parts by hash and by the sizes of the parts before, so that no task orders
    a whole class.
    """
    parts = 1024
    hashed = rows.withColumn("order_", F.xxhash64(F.col(key), F.lit(SEED))).withColumn("part_", F.pmod("order_", F.lit(parts)))
    sizes = hashed.groupBy("label", "part_").agg(F.count("*").alias("size_"))
    before = sizes.withColumn("before_", F.sum("size_").over(Window.partitionBy("label").orderBy("part_")) - F.col("size_")).drop("size_")
    numbered = hashed.withColumn("place_", F.row_number().over(Window.partitionBy("label", "part_").orderBy("order_", key)) - 1)
    placed = numbered.join(F.broadcast(before), ["label", "part_"])
    return placed.withColumn("stratum_fold", ((F.col("place_") + F.col("before_")) % folds).cast("int")).select(*rows.columns, "stratum_fold")


def fold_of(key: str, folds: int):
    """Fold by a hash of the key: the same on every run, without a sort."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(folds)).cast("int")


def areas(scored: DataFrame, by: list[str]) -> DataFrame:
    """grp (a struct of by), roc_auc (ties count half) and pr_auc (average precision): exact, null if a class lacks. Scores
    are summed up by buckets, of which there are few, and within each."""
    grp = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    cells = scored.select(grp.alias("grp"), F.floor(F.col("score") * 4096).alias("bucket"), "score", "label").groupBy("grp", "bucket", "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    before = Window.partitionBy("grp").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = cells.groupBy("grp", "bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn")).select("grp", "bucket", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("p_above"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n_above"))
    within = Window.partitionBy("grp", "bucket").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.join(above, ["grp", "bucket"]).withColumn("tp", F.col("p_above") + F.sum("p").over(within)).withColumn("fp", F.col("n_above") + F.sum("n").over(within))
    sums = placed.groupBy("grp").agg(F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"), F.sum(F.col("p") * (F.col("n") / 2 - F.col("fp"))).alias("roc"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select("grp", F.when(both, 1 + F.try_divide(F.try_divide("roc", "p"), F.col("n"))).alias("roc_auc"), F.when(both, F.try_divide("pr", "p")).alias("pr_auc"))


def metrics(scored: DataFrame, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Counts, rates and areas of scored rows (label, score), per group or overall; empty denominators give 0, one-class areas null."""
    by = by or []
    hit, real = F.col("score") >= threshold, F.col("label") == 1
    cells = scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(real & hit).alias("tp"), F.count_if(~real & hit).alias("fp"), F.count_if(~real & ~hit).alias("tn"), F.count_if(real & ~hit).alias("fn"),
        F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"),
    )

    def rate(top: str, bottom: str):
        return F.coalesce(F.try_divide(F.expr(top).cast("double"), F.expr(bottom).cast("double")), F.lit(0.0))

    rates = cells.select(*by, "n", "tp", "fp", "tn", "fn", rate("tp + tn", "n").alias("accuracy"), rate("tp", "tp + fp").alias("precision"), rate("tp", "tp + fn").alias("sensitivity"),
                         rate("tn", "tn + fp").alias("specificity"), rate("fp", "tn + fp").alias("false_positive_rate"), rate("2 * tp", "2 * tp + fp + fn").alias("f1"), "brier")
    rates = rates.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)
    grp = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    return rates.withColumn("grp", grp).join(areas(scored, by), "grp", "left").drop("grp")


def balanced_accuracy(scored: DataFrame) -> float:
    return metrics(scored).first()["balanced_accuracy"]


def select(rows: DataFrame, features: list[str], key: str, names: tuple[str, ...] = NAMES, trees: int = 300) -> tuple[str, dict[str, float], dict[str, Model]]:
    """Name of the candidate of the best balanced accuracy (the first of equals), all accuracies, and all candidates fitted
    on the training rows. Accuracy is that on the validation split or, if that lacks a class, over stratified folds."""
    train, check = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    both = check.select("label").distinct().count() == 2
    models, marks = {name: fit(train, features, name, key, trees) for name in names}, {}
    for name in names:
        if both:
            marks[name] = balanced_accuracy(models[name].score(check))
        else:
            folds = min(5, *class_counts(train, "training set").values())
            if folds < 2:
                raise ValueError("selection needs 2 rows of each class")
            dealt = stratified(train, key, folds).persist()
            parts = [fit(dealt.filter(F.col("stratum_fold") != k), features, name, key, trees).score(dealt.filter(F.col("stratum_fold") == k)) for k in range(folds)]
            marks[name] = balanced_accuracy(reduce(DataFrame.unionByName, [p.select("label", "score") for p in parts]))
            dealt.unpersist()
    return max(marks, key=marks.get), marks, models


def benchmark(rows: DataFrame, features: list[str], key: str, names: tuple[str, ...] = NAMES, trees: int = 300) -> DataFrame:
    """Every candidate on the test split, and which one validation chooses: model, chosen, validation, metrics. The models stay `validated: false`."""
    chosen, marks, models = select(rows, features, key, names, trees)
    test = rows.filter("split IN ('test', 'test_holdout')")
    parts = [metrics(model.score(test)).select(F.lit(name).alias("model"), F.lit(name == chosen).alias("chosen"), F.lit(marks[name]).alias("validation"), "*", F.lit(False).alias("validated")) for name, model in models.items()]
    return reduce(DataFrame.unionByName, parts)


def leave_one_generator_out(rows: DataFrame, features: list[str], key: str, name: str, trees: int = 300) -> DataFrame:
    """For each generator a model that has not seen it, held against it and the real test rows; one-class sets are skipped."""
    generators = [r[0] for r in rows.filter(~F.lower("generator").isin(*NOT_GENERATORS)).select("generator").distinct().orderBy("generator").collect()]
    parts = []
    for held in generators:
        own = F.col("generator") == held
        train = rows.filter(~own & F.col("split").isin("train", "validation"))
        test = rows.filter((own & F.col("split").isin("validation", "test", "test_holdout")) | ((F.col("label") == 0) & (F.col("split") == "test")))
        if train.select("label").distinct().count() == 2 and test.select("label").distinct().count() == 2:
            parts.append(metrics(fit(train, features, name, key, trees).score(test)).select(F.lit(held).alias("held"), "*"))
    empty = rows.limit(0).select("label", F.lit(0.0).alias("score"))
    return reduce(DataFrame.unionByName, parts) if parts else metrics(empty, []).filter("n > 0").select(F.lit("").alias("held"), "*")


def ablation(rows: DataFrame, sets: dict[str, list[str]], key: str, name: str, trees: int = 300) -> DataFrame:
    """The same candidate on several feature sets."""
    train, test = rows.filter("split = 'train'"), rows.filter("split IN ('test', 'test_holdout')")
    parts = [metrics(fit(train, features, name, key, trees).score(test)).select(F.lit(label).alias("features"), "*") for label, features in sets.items()]
    return reduce(DataFrame.unionByName, parts)
