"""Histograms, vocabularies, samples, splits, folds and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Labels that are encoded as a column each.
MOST_LABELS = 10_000


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    """A bucket of the key that no order, partitioning or run changes."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % buckets


def histogram(df: DataFrame, column: str, width: int = 100) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy((F.floor(F.col(column) / width) * width).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def labels_of(column: str) -> Column:
    """Labels of a space-separated list; null and blank give none."""
    return F.filter(F.split(F.trim(F.coalesce(F.col(column), F.lit(""))), "\\s+"), lambda x: x != "")


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(labels_of(column)).alias("label")).distinct()


def multi_hot(df: DataFrame, key: str, column: str, words: list[str]) -> DataFrame:
    """key, encoded: 0 or 1 for each word of the sorted vocabulary; no labels give zeros."""
    words = sorted(words)
    own = df.select(key, labels_of(column).alias("__own"))
    return own.select(key, F.array(*[F.array_contains("__own", w).cast("int") for w in words]).alias("encoded"))


def encode_labels(ids: DataFrame, themes: DataFrame, key: str, column: str, fit_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Left join of labels on the ids, then multi-hot over the vocabulary of all (or of ``fit_on``)."""
    side = themes.groupBy(key).agg(F.min(column).alias(column))
    joined = ids.select(key).join(side, key, "left")
    found = vocabulary(fit_on if fit_on is not None else joined, column).limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:  # one column each: this many are no vocabulary of tags
        raise ValueError(f"{column} has more than {MOST_LABELS} labels")
    words = sorted(r[0] for r in found)
    return multi_hot(joined, key, column, words), words


def sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """``rows`` rows without replacement, the same for a seed whatever the order."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(rows)


def split(df: DataFrame, key: str, seed: int = 42, test: float = 0.1, val_of_rest: float = 1 / 9) -> DataFrame:
    """Adds split: test, then val out of the rest, then train."""
    n = 1_000_000
    first, second = hash_bucket(F.col(key), seed, n), hash_bucket(F.col(key), seed + 1, n)
    return df.withColumn("split", F.when(first < round(test * n), "test").when(second < round(val_of_rest * n), "val").otherwise("train"))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", hash_bucket(F.col(key), seed, k).cast("int"))


def reuse_split(df: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    return df.join(splits.select(key, "split"), key)


def weight(deviation: Column) -> Column:
    return F.lit(1.0) / F.greatest(deviation.cast("double"), F.lit(1.0))


def standardise(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less the training mean, over the training (population) deviation; a zero deviation divides by 1."""
    if not columns:
        return df
    stats = [f(F.when(train, F.col(c).cast("double"))).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*stats).first()  # two numbers for each column
    scaled = {c: (F.col(c) - F.lit(row[f"m_{i}"])) / F.lit(row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}
    return df.withColumns(scaled)
