"""Training at scale with Spark ML (L1-L9) and block assembly."""

from __future__ import annotations

import itertools
import random
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactica.operators.metrics import errors
from tactica.sources.tables import shared_dir


def assemble(base: DataFrame, blocks: dict[str, DataFrame], key: str = "pid", widths: dict[str, int] | None = None) -> DataFrame:
    """base with one array column for each block, joined by key (J7). A block has key and one array.

    Every row of base stays: one that a block lacks has zeros, as many as the block's other rows have
    (or as ``widths`` says).
    """
    for name, block in blocks.items():
        column = next(c for c in block.columns if c != key)
        block = block.select(key, F.col(column).cast("array<double>").alias(name))
        width = (widths or {}).get(name)
        if width is None:
            first = block.select(F.size(name)).first()
            width = first[0] if first else 0
        base = base.join(block, key, "left").withColumn(name, F.coalesce(name, F.array_repeat(F.lit(0.0), width)))
    return base


def written(matrix: DataFrame) -> DataFrame:
    """The matrix as a table in the shared folder: what fits it many times reads it, and its plan runs once."""
    path = f"{shared_dir(matrix.sparkSession)}/table-{uuid.uuid4().hex}"
    matrix.write.parquet(path)
    return matrix.sparkSession.read.schema(matrix.schema).parquet(path)


def features(matrix: DataFrame, blocks: Iterable[str]) -> DataFrame:
    return matrix.withColumn("features", array_to_vector(F.concat(*[F.col(b) for b in blocks])))


def boosted(seed: int = 42, **params) -> GBTRegressor:
    """Boosted trees that stop early on the rows of split val, weighted by ``weight``."""
    defaults = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "validationIndicatorCol": "is_val", "weightCol": "weight"}
    return GBTRegressor(labelCol="y", featuresCol="features", predictionCol="yhat", seed=seed, **(defaults | params))


def forest(seed: int = 42, **params) -> RandomForestRegressor:
    defaults = {"numTrees": 500, "maxDepth": 12, "weightCol": "weight"}
    return RandomForestRegressor(labelCol="y", featuresCol="features", predictionCol="yhat", seed=seed, **(defaults | params))


class Line:
    """A baseline learner: least squares of y on the mean of a row's features, its slope times ``shrink``.

    It has what the plans ask of any learner (fit, then transform), and two numbers as its model.
    """

    def __init__(self, shrink: float = 1.0):
        self.shrink, self.slope, self.intercept = shrink, 0.0, 0.0

    @staticmethod
    def _x():
        from pyspark.ml.functions import vector_to_array

        from tactica.functions.arrays import mean

        return mean(vector_to_array("features"))

    def fit(self, rows: DataFrame) -> Line:
        found = rows.select("y", self._x().alias("x")).agg(F.regr_slope("y", "x"), F.avg("y"), F.avg("x")).first()
        model = Line(self.shrink)
        model.slope = self.shrink * (found[0] or 0.0)
        model.intercept = (found[1] or 0.0) - model.slope * (found[2] or 0.0)
        return model

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("yhat", F.lit(self.intercept) + F.lit(self.slope) * self._x())


def train(matrix: DataFrame, blocks: Iterable[str], learner=None):
    """A model of y on the rows of splits train (and val, for early stopping). matrix has y, split."""
    rows = features(matrix, blocks).filter("split <> 'test'")
    rows = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
    learner = learner or boosted()
    rows = rows.withColumn("is_val", F.col("split") == "val") if isinstance(learner, GBTRegressor) else rows.filter("split = 'train'")
    return learner.fit(rows)


def predict(model, matrix: DataFrame, blocks: Iterable[str], key: str = "pid", name: str = "model") -> DataFrame:
    keep = [c for c in (key, "split", "fold", "y") if c in matrix.columns]
    return model.transform(features(matrix, blocks)).select(*keep, F.lit(name).alias("model"), "yhat")


def cross_validate(matrix: DataFrame, blocks: list[str], learners: dict[str, Callable], k: int = 5) -> DataFrame:
    """One row for each model and fold: training seconds and errors on both sides (L3). matrix has y, fold."""
    spark, rows, matrix = matrix.sparkSession, [], written(matrix)
    strays = matrix.filter(F.col("fold").isNull() | ~F.col("fold").between(0, k - 1)).select("fold").first()
    if strays:
        raise ValueError(f"fold {strays[0]} would never be validated: folds are 0 to {k - 1}")
    for name, make in learners.items():
        for fold in range(k):
            part = matrix.withColumn("split", F.when(F.col("fold") == fold, "val").otherwise("train"))
            began = time.time()
            model = train(part, blocks, make())
            took = time.time() - began
            by = {r["split"]: (r["mse"], r["rmse"]) for r in errors(predict(model, part, blocks), ["split"]).collect()}
            rows.append((name, fold, took, *by.get("train", (None, None)), *by.get("val", (None, None))))
    return spark.createDataFrame(rows, "model string, fold int, training_time_seconds double, train_mse double, train_rmse double, val_mse double, val_rmse double")


def search(matrix: DataFrame, blocks: list[str], space: dict[str, list], trials: int, seed: int = 42, learner: Callable = boosted) -> tuple[dict, DataFrame]:
    """(best parameters, table of trials): the defaults first, then random draws, by the error on split val (L4)."""
    rng, spark, matrix = random.Random(seed), matrix.sparkSession, written(matrix)
    maps = [{}] + [{k: rng.choice(v) for k, v in space.items()} for _ in range(max(trials - 1, 0))]
    rows = []
    for i, params in enumerate(maps):
        scored = predict(train(matrix, blocks, learner(**params)), matrix.filter("split = 'val'"), blocks)
        rows.append((i, repr(sorted(params.items())), errors(scored, ["model"]).first()["mse"]))
    best = min(rows, key=lambda r: (r[2], r[0]))
    return maps[best[0]], spark.createDataFrame(rows, "trial int, params string, val_mse double")


def block_sets(blocks: list[str], subsets: bool = False) -> list[list[str]]:
    """All blocks and all but one; or every non-empty subset."""
    if subsets:
        return [list(c) for n in range(len(blocks), 0, -1) for c in itertools.combinations(blocks, n)]
    return [list(blocks), *[[b for b in blocks if b != d] for d in blocks if len(blocks) > 1]]


def ablate(matrix: DataFrame, blocks: list[str], subsets: bool = False, learner: Callable = boosted) -> DataFrame:
    """blocks, mse, rmse on split val of every set of blocks, best first."""
    rows, matrix = [], written(matrix)
    for chosen in block_sets(blocks, subsets):
        e = errors(predict(train(matrix, chosen, learner()), matrix.filter("split = 'val'"), chosen), ["model"]).first()
        rows.append(("+".join(chosen), e["mse"], e["rmse"]))
    return matrix.sparkSession.createDataFrame(rows, "blocks string, mse double, rmse double").orderBy("rmse", "blocks")


def specialists(matrix: DataFrame, base: list[str], groups: dict[str, list[str]], learner: Callable = boosted) -> DataFrame:
    """Predictions of one model for each group: the base blocks with the group's own."""
    out, matrix = None, written(matrix)
    for name, own in groups.items():
        p = predict(train(matrix, [*base, *own], learner()), matrix, [*base, *own], name=name)
        out = p if out is None else out.unionByName(p)
    return out


def stack_columns(predictions: DataFrame, models: list[str], key: str = "pid") -> DataFrame:
    """key, stack: each model's prediction, then their mean, population deviation, least and largest."""
    from tactica.functions.arrays import mean, std_pop

    by = predictions.filter(F.col("model").isin(models)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("model", "yhat"))).alias("by"))
    p = by.filter(F.size("by") == len(models)).select(key, F.array(*[F.col("by")[m] for m in models]).alias("p"))
    return p.select(key, F.concat("p", F.array(mean(F.col("p")), std_pop(F.col("p")), F.array_min("p"), F.array_max("p"))).alias("stack"))


def stack(predictions: DataFrame, matrix: DataFrame, base: list[str], models: list[str], key: str = "pid", learner: Callable = boosted) -> DataFrame:
    """Predictions of a meta model on the base blocks and the stacked predictions."""
    joined = matrix.join(stack_columns(predictions, models, key), key)
    return predict(train(joined, [*base, "stack"], learner()), joined, [*base, "stack"], key, "stacked")


def importances(model) -> DataFrame:
    """feature_id f<i>, gain (normalised) of every feature with any."""
    from pyspark.sql import SparkSession

    found = [(f"f{i}", float(g)) for i, g in enumerate(model.featureImportances.toArray()) if g > 0]
    return SparkSession.getActiveSession().createDataFrame(found, "feature_id string, gain double")


def node_table(model) -> DataFrame:
    """The trees of a fitted forest or boosted model as rows: tree, weight (of its prediction), node, feature (-1: a
    leaf), threshold (a row of at most that goes left), left, right, prediction, gain (of the split, times its rows).

    The model is saved in the shared folder and its table of nodes read again.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    trees = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "about", "weight").select("tree", "weight")
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    split = F.col("leftChild") >= 0
    return nodes.join(trees, "tree").select(
        "tree", "weight", F.col("id").alias("node"), F.when(split, F.col("split.featureIndex")).otherwise(-1).alias("feature"), F.when(split, F.element_at("split.leftCategoriesOrThreshold", 1)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), "prediction", F.when(split, F.col("gain") * F.col("rawCount")).otherwise(0.0).alias("gain"))


def raw_gains(model) -> DataFrame:
    """feature_id, gain (of a split of the feature, on average, not normalised), total_gain (of all), splits; largest
    gain first (L8)."""
    found = node_table(model).filter("feature >= 0").groupBy("feature").agg(F.avg("gain").alias("gain"), F.sum("gain").alias("total_gain"), F.count(F.lit(1)).alias("splits"))
    return found.select(F.concat(F.lit("f"), F.col("feature")).alias("feature_id"), "gain", "total_gain", "splits").orderBy(F.desc("gain"), "feature_id")
