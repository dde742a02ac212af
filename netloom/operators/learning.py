"""Classifiers on feature tables: training rows, reproducible splits, fitting, scoring, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import QuantileDiscretizer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed


def training_rows(df: DataFrame, to_remove: Column, unsure: Column, artefact: Column, unsure_is_remove: bool = False) -> DataFrame:
    """``df`` with label (1: remove) and part: normal, artefact or unsure."""
    part = F.when(artefact, "artefact").when(unsure & F.lit(not unsure_is_remove), "unsure").otherwise("normal")
    return df.withColumn("label", F.when(to_remove | (unsure & F.lit(unsure_is_remove)), 1).otherwise(0)).withColumn("part", part)


def hashed_split(df: DataFrame, key: str, label: str, share: float, seed: int, balance: bool = False, parts: int = 4096) -> DataFrame:
    """``df`` with train: rows of least md5 of key and seed, per class as many as ``share`` of the class, or of the smaller class.

    Rows are counted in parts of the hash range. Of each class only the part in which the last one
    lies is ranked; in those before it all rows are taken, in those after it none.
    """
    hashed = df.withColumn("__h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("__p", F.floor(F.conv(F.substring("__h", 1, 4), 16, 10).cast("int") * parts / 65536))
    counts = checkpointed(hashed.groupBy(F.col(label).alias("__l"), "__p").agg(F.count("*").alias("__n")))
    upto = counts.withColumn("__u", F.sum("__n").over(Window.partitionBy("__l").orderBy("__p")))
    sizes = counts.groupBy("__l").agg(F.sum("__n").alias("__s"))
    take = sizes.withColumn("__t", F.round(F.lit(share) * (F.min("__s").over(Window.partitionBy(F.lit(0))) if balance else F.col("__s")))).drop("__s")
    # one row a class: its last part, and how many rows of it are taken
    last = upto.join(take, "__l").where("__u >= __t").groupBy("__l").agg(F.min(F.struct("__p", (F.col("__t") - F.col("__u") + F.col("__n")).alias("__k"))).alias("__m"))
    last = F.broadcast(checkpointed(last.select("__l", F.col("__m.__p").alias("__q"), F.col("__m.__k").alias("__k"))))
    joined = hashed.join(last, F.col(label) == F.col("__l"))
    plain = joined.where("__p <> __q").withColumn("train", F.col("__p") < F.col("__q"))
    ranked = joined.where("__p = __q").withColumn("train", F.row_number().over(Window.partitionBy(label).orderBy("__h", key)) <= F.col("__k"))
    return plain.unionByName(ranked).drop("__h", "__p", "__l", "__q", "__k")


#: Levels of a feature that boosted trees tell apart: Spark's own default for its bins.
LEVELS = 32


def train(rows: DataFrame, features: Sequence[str], label: str = "label", kind: str = "forest", seed: int = 7) -> Model:
    """A forest of 100 trees, or boosted trees, on the given features.

    Boosted trees read their rows again for each level of each tree, but see ``LEVELS`` levels of a
    feature alone. So rows are cut into levels by quantiles of all rows and equal ones stand once,
    weighted by their number: what is read again and again doesn't grow with the rows.
    """
    if kind == "forest":
        classifier = RandomForestClassifier(numTrees=100, labelCol=label, seed=seed)
        return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"), classifier]).fit(rows)
    levels = [f"__level_{f}" for f in features]
    cut = QuantileDiscretizer(numBuckets=LEVELS, inputCols=list(features), outputCols=levels, handleInvalid="skip").fit(rows)
    weighted = checkpointed(cut.transform(rows).groupBy(*levels, label).agg(F.count("*").cast("double").alias("__weight")))
    classifier = GBTClassifier(labelCol=label, seed=seed, maxBins=LEVELS, weightCol="__weight")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=levels, outputCol="features", handleInvalid="skip"), classifier]).fit(weighted)
    return PipelineModel(stages=[cut, *fitted.stages])


def score(model: Model, rows: DataFrame) -> DataFrame:
    """``rows`` with prediction."""
    scored = model.transform(rows).drop("features", "rawPrediction", "probability")
    return scored.drop(*(c for c in scored.columns if c.startswith("__level_")))


def validation(rows: DataFrame, label: Column, prediction: Column) -> DataFrame:
    """Counts, rates over predicted totals, precision and recall: one row."""
    n = lambda c: F.count(F.when(c, 1))
    counts = rows.agg(n((label == 1) & (prediction == 1)).alias("tp"), n((label == 0) & (prediction == 0)).alias("tn"), n((label == 0) & (prediction == 1)).alias("fp"), n((label == 1) & (prediction == 0)).alias("fn"))
    return counts.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.col("tp") / (F.col("tp") + F.col("fn")), "false_rate": F.col("fp") / (F.col("tp") + F.col("fp"))})


def folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``df`` with fold, by md5 of key and seed."""
    return df.withColumn("fold", F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % k)


def cross_validated(rows: DataFrame, features: Sequence[str], trees: Sequence[int], depths: Sequence[int], k: int, label: str = "label", fold: str = "fold", seed: int = 7) -> DataFrame:
    """Mean loss (share of wrong predictions) over the folds for each number of trees and depth: trees, depth, loss."""
    forest = RandomForestClassifier(labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).build()
    ready = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(rows).select("features", label, fold)
    right = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    found = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=right, numFolds=k, foldCol=fold).fit(ready)
    losses = [(m[forest.numTrees], m[forest.maxDepth], 1.0 - float(a)) for m, a in zip(grid, found.avgMetrics, strict=True)]
    return rows.sparkSession.createDataFrame(losses, "trees int, depth int, loss double")  # one row a setting
