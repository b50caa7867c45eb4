"""Scoring jobs: player moves, move normalisation, the policy vocabulary, planes and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .replay import replay

ELOS, MOVES = (1100, 1300, 1500, 1700, 1900), 5
#: What moves, planes and most scorers need of a replayed position.
FIELDS = ("white", "f", "t", "promo", "cap", "board", "bd", "rights", "checkers")
#: Rows that a scorer gets at once: some 1,900 logits for each are in memory several times.
AT_ONCE = 500


def policy_vocabulary() -> list[str]:
    """All queen and knight moves by origin and target, then promotions from the seventh rank to q, r, b."""
    name = lambda s: "abcdefgh"[s % 8] + str(s // 8 + 1)

    def reaches(a: int, b: int) -> bool:
        f, r = abs(a % 8 - b % 8), abs(a // 8 - b // 8)
        return a != b and (f == 0 or r == 0 or f == r or {f, r} == {1, 2})

    moves = [name(a) + name(b) for a in range(64) for b in range(64) if reaches(a, b)]
    pawns = [name(a) + name(b) + p for a in range(48, 56) for b in range(56, 64) if abs(a % 8 - b % 8) <= 1 for p in "qrb"]
    return moves + pawns


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(policy_vocabulary())), "policy_idx int, move string").select("move", "policy_idx")


def normalised_move(uci: Column, black: Column, king_on_e1: Column, family: int = 1) -> Column:
    """The move as the vocabulary writes it.

    Family 1: ranks mirrored for Black, castling as king takes rook, one final n dropped.
    Family 2: final n's dropped only.
    """
    if family == 2:
        return F.regexp_replace(uci, "n+$", "")
    flip = lambda i: (9 - F.substring(uci, i, 1).cast("int")).cast("string")
    seen = F.when(black, F.concat(F.substring(uci, 1, 1), flip(2), F.substring(uci, 3, 1), flip(4), F.substring(uci, 5, 9))).otherwise(uci)
    castled = F.when(king_on_e1 & (seen == "e1g1"), "e1h1").when(king_on_e1 & (seen == "e1c1"), "e1a1").otherwise(seen)
    return F.regexp_replace(castled, "n$", "")


def player_moves(positions: DataFrame, moves: int = MOVES) -> DataFrame:
    """PuzzleId, move_idx, n, uci, move and the position (p) of the player's first moves (M1), of replayed
    positions that keep Moves and have white and board."""
    listed = F.filter(F.split(F.trim("Moves"), "\\s+"), lambda x: x != "").alias("uci")
    nodes = positions.select("PuzzleId", listed, F.posexplode(F.expr("slice(pos, 1, greatest(size(pos) - 1, 0))")).alias("n", "p")).filter(f"n % 2 = 1 AND n div 2 < {moves}")
    nodes = nodes.select("PuzzleId", F.expr("cast(n div 2 as int)").alias("move_idx"), "n", F.expr("get(uci, n)").alias("uci"), "p")
    king = F.expr("upper(substr(p.board, if(p.white, 5, 61), 1)) = 'K'")
    return nodes.withColumn("move", normalised_move(F.col("uci"), ~F.col("p.white"), king))


def with_policy(moves: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds policy_idx, -1 where the vocabulary lacks the move."""
    return moves.join(F.broadcast(policy_table(spark)), "move", "left").withColumn("policy_idx", F.coalesce("policy_idx", F.lit(-1)))


def best_places(p, k: int):
    """Places of the ``k`` highest values of each row, highest first, equal ones by place; only rows with equal values at the cut,
    or without a number, are sorted whole."""
    import numpy as np

    if p.shape[1] <= k:
        return np.argsort(-p, axis=1, kind="stable")
    high = p >= np.partition(p, p.shape[1] - k, axis=1)[:, [p.shape[1] - k]]
    clear = (high.sum(1) == k) & ~np.isnan(p).any(1)
    best = np.empty((len(p), k), np.int64)
    found = np.nonzero(high[clear])[1].reshape(-1, k)
    best[clear] = np.take_along_axis(found, np.argsort(-np.take_along_axis(p[clear], found, 1), axis=1, kind="stable"), 1)
    best[~clear] = np.argsort(-p[~clear], axis=1, kind="stable")[:, :k]
    return best


def score(rows: DataFrame, scorer: Callable[[pd.DataFrame], "pd.Series"], keep: Iterable[str], elos: Iterable[int] = ELOS, k: int = 5) -> DataFrame:
    """Every row at every level through ``scorer`` (frame with elo -> arrays of logits), reduced in the
    same batch to the probability of ``policy_idx`` and the k best (M3-M5, M14)."""
    import numpy as np

    keep = list(keep)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[i : i + AT_ONCE] for whole in batches for i in range(0, max(len(whole), 1), AT_ONCE)):
            z = np.stack([np.asarray(x, float) for x in scorer(b)]) if len(b) else np.zeros((0, 1))
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = best_places(p, k)
            idx = b["policy_idx"].to_numpy()
            own = np.where((idx >= 0) & (idx < p.shape[1]), p[np.arange(len(p)), np.clip(idx, 0, p.shape[1] - 1)], 0.0)
            yield b[[*keep, "elo"]].assign(prob=own, top5_probs=list(np.take_along_axis(p, best, 1)), top5_idx=list(best.astype("int32")))

    levels = F.explode(F.array(*[F.lit(int(e)) for e in elos]))
    return rows.withColumn("elo", levels).mapInPandas(run, f"{fields}, elo int, prob double, top5_probs array<double>, top5_idx array<int>")


def planes(p: str = "p") -> str:
    """SQL: set indices of the 112 x 64 input planes, seen from the side to move.

    Twelve piece planes (own pawn to king, then the other's) and an empty one, eight times over;
    then castling of each side (king's, queen's), Black to move, two zero planes and one of ones.
    """
    turned = f"transform(sequence(0, 63), s -> if({p}.white, {p}.bd[s], -{p}.bd[(s ^ 56)]))"
    pieces = f"filter(transform({turned}, (x, s) -> if(x = 0, -1, (abs(x) - 1 + if(x > 0, 0, 6)) * 64 + s)), i -> i >= 0)"
    repeated = f"flatten(transform(sequence(0, 7), r -> transform({pieces}, i -> r * 832 + i)))"
    rights = f"if({p}.white, {p}.rights, array({p}.rights[2], {p}.rights[3], {p}.rights[0], {p}.rights[1]))"
    whole = f"flatten(transform(filter(array(0, 1, 2, 3, 4, 7), k -> k = 7 OR k = 4 AND NOT {p}.white OR k < 4 AND get({rights}, k)), k -> transform(sequence(0, 63), s -> 6656 + k * 64 + s)))"
    return f"array_sort(concat({repeated}, {whole}))"


#: What the flipped planes need of a replayed position.
FLIPPED_FIELDS = ("white", "bd", "rights", "half", "full")


def flipped_planes(p: str = "p") -> str:
    """SQL: the other layout of the 112 x 64 planes (M18), as (index, value) pairs in order, for a sparse vector.

    Twelve piece planes, own pawn to king, then the other's, with the ranks turned over (the eighth comes
    first) whoever moves; from plane 104 on, whole planes: Black to move, the move's number by a hundred, own and the
    other's castling (king's, queen's), moves since a capture or a pawn's by a hundred, ones.
    """
    men = f"filter(transform({p}.bd, (x, s) -> if(x = 0, -1, (abs(x) - 1 + if((x > 0) = {p}.white, 0, 6)) * 64 + (s ^ 56))), i -> i >= 0)"
    own, other = (0, 1), (2, 3)
    right = lambda k: f"if({p}.white, {p}.rights[{own[k % 2] if k < 2 else other[k % 2]}], {p}.rights[{other[k % 2] if k < 2 else own[k % 2]}])"
    flags = [f"if({p}.white, 0D, 1D)", f"{p}.full / 100D", *[f"if({right(k)}, 1D, 0D)" for k in range(4)], f"{p}.half / 100D", "1D"]
    whole = f"flatten(transform(filter(transform(array({', '.join(flags)}), (v, k) -> named_struct('k', k, 'v', v)), c -> c.v <> 0D), c -> transform(sequence(0, 63), s -> named_struct('index', (104 + c.k) * 64 + s, 'value', c.v))))"
    return f"concat(array_sort(transform({men}, i -> named_struct('index', i, 'value', 1D))), {whole})"


def board_tensors(puzzles: DataFrame, positions: int = MOVES) -> DataFrame:
    """PuzzleId, step, planes (a sparse vector of 7,168 values in the flipped layout) of the start and of the board
    after each move, ``positions`` at most."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def sparse(index, value):
        return SparseVector(112 * 64, index, value)

    found = sparse_planes(puzzles, positions)
    return found.select("PuzzleId", "step", sparse("cells.index", "cells.value").alias("planes"))


def sparse_planes(puzzles: DataFrame, positions: int = MOVES) -> DataFrame:
    """PuzzleId, step, cells: the (index, value) pairs of ``board_tensors``, by built-in functions alone."""
    steps = replay(puzzles, fields=FLIPPED_FIELDS).select("PuzzleId", F.posexplode(F.slice("pos", 1, positions)).alias("step", "p"))
    return steps.select("PuzzleId", "step", F.expr(flipped_planes()).alias("cells"))


def embedding_steps(positions: DataFrame, steps: int = 10) -> DataFrame:
    """PuzzleId, step, p: the start and the board after each move that could be made, ``steps`` at most."""
    return positions.select("PuzzleId", F.posexplode(F.slice("pos", 1, steps)).alias("step", "p"))


def padded_steps(embeddings: DataFrame, key: str, size: int, steps: int = 10) -> DataFrame:
    """key, flat: the embeddings of all steps behind each other, zeros for absent steps."""
    cells = embeddings.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("step", "embedding"))).alias("by"))
    parts = [F.coalesce(F.try_element_at("by", F.lit(i)), F.array_repeat(F.lit(0.0).cast("double"), size)) for i in range(steps)]
    return cells.select(key, F.flatten(F.array(*parts)).alias("flat"))


def centred_pca(df: DataFrame, column: str, k: int) -> tuple[DataFrame, list[float]]:
    """Adds ``pca`` (k scores of the centred vectors) and returns the explained variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("__v", array_to_vector(F.col(column).cast("array<double>")))
    centred = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred)
    return model.transform(centred).withColumn("pca", vector_to_array("__p")).drop("__v", "__c", "__p"), list(model.explainedVariance.toArray())
