"""Cleaning and joins on the puzzle key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast.
SMALL = 100_000
ELOS = (1100, 1300, 1500, 1700, 1900)


def stable_ratings(df: DataFrame, column: str = "RatingDeviation", most: float = 90, enabled: bool = True) -> DataFrame:
    """Rows with a deviation of at most ``most``; null goes; a missing column keeps all."""
    return df.filter(F.col(column) <= most) if enabled and column in df.columns else df


def rating_band(rating: Column, low: float = 1200, high: float = 1800) -> Column:
    return F.when(rating < low, "low").when(rating <= high, "middle").when(rating > high, "high")


def column_family(df: DataFrame, part: str) -> list[str]:
    """Names that contain ``part``, in lexical order."""
    return sorted(c for c in df.columns if part in c)


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def parse_source(label: str, family: str = "maia", elos: Iterable[int] = ELOS) -> tuple[int, list[str] | None, int | None]:
    """(version, types, level) of family-1-level, family-2-level (both types), family-2-type[-level].

    A level left out means all levels (None).
    """
    parts = label.lower().split("-")
    if len(parts) < 3 or parts[0] != family or parts[1] not in ("1", "2"):
        raise ValueError(f"not a source: {label}")
    version = int(parts[1])
    typed = version == 2 and parts[2] in ("rapid", "blitz")
    types = None if version == 1 else [parts[2]] if typed else ["rapid", "blitz"]
    rest = parts[3:] if typed else parts[2:]
    level = int(rest[0]) if rest else None
    if level is not None and level not in tuple(elos):
        raise ValueError(f"{level} is not one of {tuple(elos)}")
    return version, types, level


def select_source(probs: DataFrame, label: str, family: str = "maia") -> DataFrame:
    """The rows of a move-probability table that a source label names; prunes its folders."""
    version, types, level = parse_source(label, family)
    names = [f"{family}1"] if version == 1 else [f"{family}2_{t}" for t in types]
    probs = probs.filter(F.col("source").isin(names))
    return probs if level is None else probs.filter(F.col("elo") == level)


def choose_blocks(blocks: Iterable[str] | None = None, stockfish: bool = False, maia1: bool = True, maia2: bool = True) -> list[str]:
    """The explicit list, or the default blocks by flags."""
    if blocks is not None:
        return list(blocks)
    return ["struct", "themes", "advanced", *["stockfish"] * stockfish, *["maia2"] * maia2, *["maia1"] * maia1]


def one_per_key(df: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """The row of the smallest values for each key, so that a join cannot multiply rows."""
    return df.groupBy(key).agg(F.min(F.struct(*columns)).alias("__row")).select(key, "__row.*")


def left_with_defaults(df: DataFrame, side: DataFrame, key: str, columns: dict[str, object]) -> DataFrame:
    """Left join of a side table's columns, nulls and missing rows as the given defaults; row count kept."""
    side = one_per_key(side, key, columns)
    return df.join(side, key, "left").fillna(columns)


def needs_evaluation(df: DataFrame, side: DataFrame, key: str, column: str) -> DataFrame:
    """Left join of one column, with ``needs_eval`` where there is none."""
    return df.join(one_per_key(side, key, [column]), key, "left").withColumn("needs_eval", F.col(column).isNull())


def known_then_left(ids: DataFrame, side: DataFrame, key: str, columns: dict[str, object]) -> DataFrame:
    """The side table cut to known ids first (semi join), then joined to them."""
    return left_with_defaults(ids.select(key), side.join(ids.select(key).distinct(), key, "left_semi"), key, columns)


def unfinished(tasks: DataFrame, done: DataFrame, key: str, result: str) -> DataFrame:
    """Tasks without a finished row; a finished row has a non-null ``result``."""
    return tasks.join(done.filter(F.col(result).isNotNull()).select(key).distinct(), key, "left_anti")


def merge_results(done: DataFrame, new: DataFrame, result: str) -> DataFrame:
    return done.filter(F.col(result).isNotNull()).unionByName(new)


def lookup(df: DataFrame, column: str, vocabulary: DataFrame, key: str) -> DataFrame:
    """Left join of a vocabulary; what it lacks is null. One of SMALL rows at most is broadcast."""
    side = F.broadcast(vocabulary) if vocabulary.limit(SMALL + 1).count() <= SMALL else vocabulary
    return df.join(side, df[column] == vocabulary[key], "left").drop(vocabulary[key])


def named_importances(importances: DataFrame, names: DataFrame) -> DataFrame:
    """feature_id f<i> and gain with the i-th of an array of names; an unknown id keeps itself as name."""
    listed = names.select(F.posexplode("names").alias("i", "name")).select(F.concat(F.lit("f"), F.col("i")).alias("feature_id"), "name")
    return importances.join(listed, "feature_id", "left").withColumn("name", F.coalesce("name", "feature_id"))


def neighbours(df: DataFrame, key: str, order: str, columns: Iterable[str], back: int = 4, ahead: int = 1) -> DataFrame:
    """Columns of the previous and next rows of each key, up to ``back`` and ``ahead`` away."""
    w = Window.partitionBy(key).orderBy(order)
    more = {f"{c}_prev{k}": F.lag(c, k).over(w) for c in columns for k in range(1, back + 1)}
    return df.withColumns(more | {f"{c}_next{k}": F.lead(c, k).over(w) for c in columns for k in range(1, ahead + 1)})


def side_counter(df: DataFrame, key: str, order: str, side: Column, most: int = 5) -> DataFrame:
    """Running number of a row among its side's rows of a key; null from ``most`` on."""
    w = Window.partitionBy(key, "side").orderBy(order)
    numbered = df.withColumn("side", side).withColumn("number", F.row_number().over(w) - 1)
    return numbered.withColumn("number", F.when(F.col("number") < most, F.col("number")))


def quarantine(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with an error)."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())
