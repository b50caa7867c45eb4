"""Reading and writing: puzzles, side tables, the move-probability store and the block store."""

from __future__ import annotations

import re
import tempfile
import warnings
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUZZLES = T.StructType([
    T.StructField("PuzzleId", T.StringType()), T.StructField("FEN", T.StringType()), T.StructField("Moves", T.StringType()),
    T.StructField("Rating", T.IntegerType()), T.StructField("RatingDeviation", T.IntegerType()), T.StructField("Themes", T.StringType())])
EVALS = T.StructType([T.StructField("PuzzleId", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("SF_Material", "SF_Positional", "SF_Final_Eval", "SF_Last_Move_CP")]])


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a temporary one if the master
    is local, and an error if not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _own_dirs.get(app) or _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return found.rstrip("/")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, or ValueError naming what is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_puzzles(spark: SparkSession, path: str, extra: Iterable[str] = (), columns: Iterable[str] | None = None, rows: int | None = None) -> DataFrame:
    """Puzzles from CSV with a header (by the explicit schema plus ``extra`` double columns) or Parquet.

    ``columns`` prunes the scan; ``rows`` keeps the first by PuzzleId, as files have no order.
    """
    if path.endswith(".csv"):
        header = spark.read.option("header", True).csv(path).columns
        known = {f.name: f for f in PUZZLES} | {c: T.StructField(c, T.DoubleType()) for c in extra}
        schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
        df = spark.read.schema(schema).option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    require_columns(df, ["PuzzleId", "FEN", "Moves"])
    df = df.select(*columns) if columns else df
    return first_rows(df, rows) if rows else df


def first_rows(df: DataFrame, rows: int, key: str = "PuzzleId") -> DataFrame:
    return df.orderBy(key).limit(rows)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = (), header: bool = True) -> None:
    """CSV with a header if the path ends in .csv, Parquet otherwise."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    if path.endswith(".csv"):
        writer.option("header", header).csv(path)
    else:
        writer.parquet(path)


def write_move_probs(df: DataFrame, path: str) -> None:
    """The store of move probabilities, one folder for each source and skill level."""
    df.write.mode("overwrite").partitionBy("source", "elo").parquet(path)


def read_move_probs(spark: SparkSession, path: str, sources: Iterable[str], elos: Iterable[int] | None = None) -> DataFrame:
    """Only the folders of the sources and levels asked for; a missing source is warned about and left out."""
    store, sources = spark.read.parquet(path), list(sources)
    for s in sources:
        if store.filter(F.col("source") == s).isEmpty():  # one folder is looked into
            warnings.warn(f"no move probabilities of {s}", stacklevel=2)
    store = store.filter(F.col("source").isin(sources))
    return store.filter(F.col("elo").isin(list(elos))) if elos else store


def write_embeddings(df: DataFrame, path: str, key: str = "pid", column: str = "embedding") -> None:
    """Embeddings together with their ids, as one Parquet table."""
    df.select(key, F.col(column).cast("array<float>").alias(column)).write.mode("overwrite").parquet(path)


class BlockStore:
    """Feature blocks under one path, kept row by row; only what is missing is computed.

    A row belongs to a puzzle and to a hash of all that the puzzle's row says, so a new or changed puzzle costs
    one new row of each block, and rows of others are read. New rows are appended to the block's table;
    ``compact`` rewrites it without those that no puzzle asks for any more. Blocks in ``always`` are computed
    whole each time. ``version`` stands for what else a block depends on (side tables, code): a change makes all rows new.
    """

    def __init__(self, spark: SparkSession, path: str, always: Iterable[str] = (), version: str = ""):
        self.spark, self.path, self.always, self.version = spark, path.rstrip("/"), set(always), version

    def keyed(self, puzzles: DataFrame) -> DataFrame:
        """``puzzles`` with a column ``row_key``, two hashes of all its columns by name."""
        columns = [F.col(f"`{c}`") for c in sorted(puzzles.columns)]
        return puzzles.withColumn("row_key", F.concat_ws("-", F.hex(F.xxhash64(F.lit(self.version), *columns)), F.hex(F.hash(*columns, F.lit(self.version)))))

    def _generation(self, name: str) -> int:
        """The last generation of a block's table; -1 if there is none."""
        try:
            return self.spark.read.parquet(f"{self.path}/{name}").agg(F.max("generation")).first()[0]  # a listing of folders
        except AnalysisException:
            return -1

    def _stored(self, name: str) -> tuple[DataFrame | None, int]:
        last = self._generation(name)
        return (self.spark.read.parquet(f"{self.path}/{name}/generation={last}") if last >= 0 else None), last

    def load(self, names: Iterable[str], compute: Callable[[str, DataFrame], DataFrame | None], puzzles: DataFrame) -> dict[str, DataFrame]:
        """Every requested block as (PuzzleId, block) of ``puzzles``; ``compute(name, some puzzles)`` makes what
        is missing, of unique ids. ValueError if a block can be neither read nor computed."""
        out, keyed = {}, self.keyed(puzzles)
        wanted = keyed.select("PuzzleId", "row_key")
        for name in names:
            stored, last = (None, self._generation(name)) if name in self.always else self._stored(name)
            missing = keyed if stored is None else keyed.join(stored.select("PuzzleId", "row_key"), ["PuzzleId", "row_key"], "left_anti")
            if stored is None or not missing.isEmpty():
                if (block := compute(name, missing.drop("row_key"))) is None:
                    raise ValueError(f"block {name} is not available")
                made = block.join(missing.select("PuzzleId", "row_key"), "PuzzleId")
                target = max(last, 0) if name not in self.always else last + 1
                made.write.mode("append").parquet(f"{self.path}/{name}/generation={target}")
                stored, last = self._stored(name)
            out[name] = stored.join(wanted, ["PuzzleId", "row_key"], "left_semi").drop("row_key")
        return out

    def compact(self, name: str, puzzles: DataFrame) -> None:
        """The block's table as a new generation that holds the rows of ``puzzles`` alone, each once; readers of
        the old one are not disturbed. Older generations can be deleted when nobody reads them."""
        stored, last = self._stored(name)
        if stored is not None:
            kept = stored.join(self.keyed(puzzles).select("PuzzleId", "row_key"), ["PuzzleId", "row_key"], "left_semi").dropDuplicates(["PuzzleId", "row_key"])
            kept.write.parquet(f"{self.path}/{name}/generation={last + 1}")
