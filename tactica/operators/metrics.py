"""Errors, fold summaries and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("train_mse", "train_rmse", "val_mse", "val_rmse")


def errors(predictions: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """mse and rmse of each group."""
    mse = F.avg(F.pow(F.col(y) - F.col(yhat), F.lit(2)))
    return predictions.groupBy(*by).agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def residuals(predictions: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return predictions.withColumn("residual", F.col(yhat) - F.col(y))


def fold_summary(folds: DataFrame, by: str = "model", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and population deviation of each metric, and the best and worst fold by val_rmse (ties: lowest fold)."""
    metrics = tuple(m for m in metrics if m in folds.columns)
    stats = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    kept = F.struct("fold", *metrics)
    best = F.min_by(kept, F.struct("val_rmse", "fold")).alias("best")
    worst = F.min_by(kept, F.struct((-F.col("val_rmse")).alias("v"), "fold")).alias("worst")
    out = folds.groupBy(by).agg(*stats, best, worst)
    picks = [F.col(f"{w}.{c}").alias(f"{w}_{c}") for w in ("best", "worst") for c in ("fold", *metrics)]
    return out.select(by, *[s for m in metrics for s in (f"{m}_mean", f"{m}_std")], *picks)


def with_final_average(folds: DataFrame) -> DataFrame:
    """fold (text), mse, rmse, and a row "Final Average": the root of the mean of the folds' mse."""
    rows = folds.select(F.col("fold").cast("string").alias("fold"), "mse", "rmse")
    return rows.unionByName(folds.agg(F.lit("Final Average").alias("fold"), F.avg("mse").alias("mse"), F.sqrt(F.avg("mse")).alias("rmse")))


def leaderboard(summary: DataFrame, column: str = "val_rmse_mean", key: str = "model") -> DataFrame:
    return summary.orderBy(column, key)


def top_features(importances: DataFrame, k: int = 30) -> DataFrame:
    return importances.orderBy(F.desc("gain"), "feature_id").limit(k)
