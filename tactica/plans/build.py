"""From puzzles and side tables to one matrix of feature blocks (W-A), and the jobs around it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactica.functions.arrays import curve_features
from tactica.functions.probs import concat_sources, wide_vector
from tactica.operators import features, relational, replay, sampling, scoring
from tactica.sources.tables import BlockStore, require_columns

from .models import assemble

EVAL_COLUMNS = ("SF_Material", "SF_Positional", "SF_Final_Eval", "SF_Last_Move_CP")
#: Widths of blocks that are known without looking at one.
WIDTHS = {"struct": len(features.STRUCT_NAMES), "advanced": len(features.ADVANCED_NAMES), "stockfish": len(EVAL_COLUMNS)}
SOURCES = {"maia1": ["maia1"], "maia2": ["maia2_rapid", "maia2_blitz"]}


def block_of(name: str, puzzles: DataFrame, evals=None, themes=None, move_probs=None) -> DataFrame | None:
    """(PuzzleId, one array column) of a named block; None if its side table is not given."""
    if name == "struct":
        return features.structure(puzzles).select("PuzzleId", F.array(*[F.col(c).cast("double") for c in features.STRUCT_NAMES]).alias(name))
    if name == "advanced":
        return features.advanced(puzzles).withColumnRenamed("advanced", name)
    if name == "curve":
        found = curve_features([F.col(c) for c in relational.column_family(puzzles, "success_prob_")])
        return puzzles.select("PuzzleId", F.array(*found.values()).cast("array<double>").alias(name))
    if name == "themes" and themes is not None:
        return sampling.encode_labels(puzzles, themes, "PuzzleId", "Themes")[0].withColumnRenamed("encoded", name)
    if name == "stockfish" and evals is not None:
        filled = relational.left_with_defaults(puzzles.select("PuzzleId"), evals, "PuzzleId", dict.fromkeys(EVAL_COLUMNS, 0.0))
        return filled.select("PuzzleId", F.array(*EVAL_COLUMNS).alias(name))
    if name in SOURCES and move_probs is not None:
        vectors = concat_sources(wide_vector(move_probs, key="pid"), SOURCES[name])
        return vectors.select(F.col("pid").alias("PuzzleId"), F.col("features").alias(name))
    return None


def build_matrix(puzzles: DataFrame, blocks=None, evals=None, themes=None, move_probs=None, store: BlockStore | None = None, most_deviation: float | None = 90) -> DataFrame:
    """pid, y, weight and one array column for each block.

    Filtered by deviation first; every block is keyed by PuzzleId, so none can go out of step with
    the filter. With a store only missing rows of blocks are computed. A block without its table is an error.
    """
    require_columns(puzzles, ["PuzzleId", "FEN", "Moves"])
    puzzles = relational.stable_ratings(puzzles, most=most_deviation or 0, enabled=most_deviation is not None)
    blocks = relational.choose_blocks(blocks, stockfish=evals is not None, maia1=move_probs is not None, maia2=False)
    def compute(name: str, some: DataFrame) -> DataFrame | None:
        return block_of(name, some, evals, themes, move_probs)

    if store is not None:
        found = store.load(blocks, compute, puzzles)
    else:
        found = {name: compute(name, puzzles) for name in blocks}
        if absent := [n for n, b in found.items() if b is None]:
            raise ValueError(f"blocks without their tables: {', '.join(absent)}")
    deviation = F.col("RatingDeviation") if "RatingDeviation" in puzzles.columns else F.lit(1)
    rating = F.col("Rating").cast("double") if "Rating" in puzzles.columns else F.lit(None).cast("double")
    base = puzzles.select(F.col("PuzzleId").alias("pid"), rating.alias("y"), sampling.weight(F.coalesce(deviation, F.lit(1))).alias("weight"))
    return assemble(base, {n: b.withColumnRenamed("PuzzleId", "pid") for n, b in found.items()}, widths=WIDTHS)


def score_unfinished(puzzles: DataFrame, scorer, source: str, done: DataFrame | None = None, fields: Iterable[str] = scoring.FIELDS) -> DataFrame:
    """Move probabilities of the puzzles that ``done`` lacks, joined with what it has (W-C). ``fields`` are what the
    scorer reads of a position ``p``; without any it gets none. ``done`` is read twice: a table, not a plan."""
    fields = list(fields)
    todo = puzzles if done is None else puzzles.join(done.filter("prob IS NOT NULL").select(F.col("pid").alias("PuzzleId")).distinct(), "PuzzleId", "left_anti")
    moves = scoring.with_policy(scoring.player_moves(replay.replay(todo, ["Moves"], dict.fromkeys(["white", "board", *fields]))), puzzles.sparkSession)
    new = scoring.score(moves.select(F.col("PuzzleId").alias("pid"), "move_idx", "policy_idx", *["p"] * bool(fields)), scorer, ["pid", "move_idx", "policy_idx"]).withColumn("source", F.lit(source))
    return new if done is None else done.filter("prob IS NOT NULL").unionByName(new)
