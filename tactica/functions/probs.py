"""Move-probability features (M8-M13): from a long table of moves to one ordered vector per puzzle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import cross_entropy, gap_and_ratio, tied_rank

MOVES, ELOS = 5, (1100, 1300, 1500, 1700, 1900)


def move_columns(probs: DataFrame) -> DataFrame:
    """Adds rank, gap and ratio of every move (M6, M7); without top-5 data, ``probs`` as it is."""
    if "top5_idx" not in probs.columns:
        return probs
    gap, ratio = gap_and_ratio(F.coalesce(F.get("top5_probs", F.lit(0)), F.lit(0.0)), F.col("prob"))
    return probs.withColumns({"rank": tied_rank(F.col("top5_idx"), F.col("top5_probs"), F.col("policy_idx"), F.col("prob")), "gap": gap, "ratio": ratio})


def level_statistics(probs: DataFrame, key: str = "pid", moves: int = MOVES) -> DataFrame:
    """key, source, elo and mean, min, max, ce_mean, ce_max, joint, log_joint over padded moves."""
    p, n = F.col("prob"), F.count_distinct("move_idx")
    ce = cross_entropy(p)
    least = F.when(n < moves, 0.0).otherwise(F.min(p))
    return probs.groupBy(key, "source", "elo").agg(
        (F.sum(p) / moves).alias("prob_mean"), least.alias("prob_min"), F.max(p).alias("prob_max"),
        (F.sum(ce) / moves).alias("ce_mean"), F.max(ce).alias("ce_max"),
        F.product(F.when(p > 0, p).otherwise(1.0)).alias("joint"), F.sum(-ce).alias("log_joint"))


def vector_names(elos=ELOS, extended: bool = True, value: bool = False) -> list[str]:
    flat = lambda s: [f"{s}_m{m}_{e}" for m in range(MOVES) for e in elos]
    per = lambda *names: [f"{s}_{e}" for s in names for e in elos]
    out = flat("prob") + per("prob_mean", "prob_min", "prob_max", "ce_mean", "ce_max", "joint", "log_joint")
    for s in ("rank", "gap", "ratio") * extended + ("value",) * value:
        out += flat(s) + per(f"{s}_mean", f"{s}_min", f"{s}_max")
    return out


def wide_vector(probs: DataFrame, key: str = "pid", elos=ELOS, value: bool = False) -> DataFrame:
    """key, source, features: the block of one source in the order of ``vector_names``.

    One shuffle by key; absent moves are 0, their rank is 6. A single level gives the specialist's
    36 columns (M13).
    """
    probs = move_columns(probs)
    extended = "rank" in probs.columns
    names = ["prob", *["rank", "gap", "ratio"] * extended, *["value"] * value]
    cell = F.struct((F.col("move_idx") * 10_000 + F.col("elo")).alias("at"), F.struct(*[F.col(c).cast("double").alias(c) for c in names]).alias("v"))
    grouped = probs.filter(F.col("elo").isin(list(elos)) & (F.col("move_idx") < MOVES)).groupBy(key, "source").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))

    def column(name: str, elo: int) -> str:
        """Array over moves of one value at one level."""
        pad = "6D" if name == "rank" else "0D"
        return f"transform(sequence(0, {MOVES - 1}), m -> coalesce(try_element_at(cells, m * 10000 + {elo}).{name}, {pad}))"

    def flat(name: str) -> str:
        cells = ", ".join(column(name, e) for e in elos)
        return f"flatten(transform(sequence(0, {MOVES - 1}), k -> transform(array({cells}), c -> c[k])))"

    per = lambda body: "array(" + ", ".join(body(e) for e in elos) + ")"
    mean = lambda c: f"aggregate({c}, 0D, (a, x) -> a + x) / {MOVES}"
    ce = lambda c: f"transform({c}, x -> if(x > 0, -ln(x + 1e-7D), 0D))"
    parts = [flat("prob")]
    parts += [per(lambda e, f=f: f(column("prob", e))) for f in (
        mean, lambda c: f"array_min({c})", lambda c: f"array_max({c})", lambda c: mean(ce(c)), lambda c: f"array_max({ce(c)})",
        lambda c: f"aggregate({c}, 1D, (a, x) -> a * if(x > 0, x, 1D))", lambda c: f"aggregate({ce(c)}, 0D, (a, x) -> a - x)")]
    for name in names[1:]:
        parts += [flat(name)] + [per(lambda e, f=f, name=name: f(column(name, e))) for f in (mean, lambda c: f"array_min({c})", lambda c: f"array_max({c})")]
    return grouped.select(key, "source", F.expr(f"concat({', '.join(parts)})").alias("features"))


def concat_sources(vectors: DataFrame, sources: list[str], key: str = "pid", width: int = 180) -> DataFrame:
    """The vectors of several sources behind each other; a source that a puzzle lacks gives zeros."""
    by = vectors.filter(F.col("source").isin(sources)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("source", "features"))).alias("by"))
    return by.select(key, F.concat(*[F.coalesce(F.try_element_at("by", F.lit(s)), F.array_repeat(F.lit(0.0), width)) for s in sources]).alias("features"))
