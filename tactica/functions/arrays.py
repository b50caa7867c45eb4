"""Row-wise numeric functions on arrays: curves (C1-C4), softmax and ranks (M3-M7), pooling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-7


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def moment(a: Column, k: int) -> Column:
    """Central moment, population style."""
    m = mean(a)
    return total(F.transform(a, lambda x: F.pow(x - m, F.lit(k)))) / F.size(a)


def std_pop(a: Column) -> Column:
    return F.sqrt(moment(a, 2))


def skew_biased(a: Column) -> Column:
    """m3 / m2^1.5; null for a constant array."""
    m2 = moment(a, 2)
    return F.when(m2 > 0, moment(a, 3) / F.pow(m2, F.lit(1.5)))


def difference(a: Column) -> Column:
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(2), n), F.slice(a, F.lit(1), n), lambda y, x: y - x)


def curve_features(columns: list[Column]) -> dict[str, Column]:
    """Eight statistics of a row's curve; nulls count as 0; no columns give no features."""
    if not columns:
        return {}
    a = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    return curve_features_of(a)


def curve_features_of(a: Column) -> dict[str, Column]:
    d1 = difference(a)
    d2 = difference(d1)
    return {
        "prob_mean": mean(a), "prob_std": std_pop(a), "prob_min": F.array_min(a), "prob_max": F.array_max(a), "prob_range": F.array_max(a) - F.array_min(a),
        "prob_skew": skew_biased(a), "inflection_idx": F.array_position(d2, F.array_min(d2)) - 1, "max_pairwise_drop": F.array_min(d1),
    }


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def at(a: Column, index: Column) -> Column:
    """Element at a 0-based index; 0 where there is none."""
    return F.coalesce(F.get(a, index), F.lit(0.0))


def top_k(probs: Column, k: int = 5) -> Column:
    """Structs (p, i) of the k largest, largest first; equal values by lowest index."""
    ranked = F.array_sort(F.transform(probs, lambda x, i: F.struct((-x).alias("neg"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct((-s["neg"]).alias("p"), s["i"].alias("i")))


def rank_in(top_idx: Column, policy: Column, k: int = 5) -> Column:
    """1..k, or k + 1 where the index is missing (null or -1) or not among the top."""
    place = F.array_position(top_idx, policy.cast("int"))
    return F.when(policy.isNull() | (policy < 0) | (place == 0) | place.isNull(), k + 1).otherwise(place).cast("int")


def tied_rank(top_idx: Column, top_probs: Column, policy: Column, p: Column, k: int = 5) -> Column:
    """``rank_in``, but equal probabilities share the best of their places, as does one that equals the last of the top and was cut."""
    place = F.array_position(top_idx, policy.cast("int"))
    own = F.when(place > 0, F.get(top_probs, (place - 1).cast("int"))).otherwise(p)
    first = F.array_position(top_probs, own)
    return F.when((policy >= 0) & (first > 0), F.least(first, F.lit(k + 1)).cast("int")).otherwise(rank_in(top_idx, policy, k))


def gap_and_ratio(top1: Column, p: Column) -> tuple[Column, Column]:
    return top1 - p, p / (top1 + EPS)


def cross_entropy(p: Column) -> Column:
    return F.when(p > 0, -F.ln(p + EPS)).otherwise(0.0)


def mean_pool(steps: Column, size: int, length: int) -> Column:
    """Mean over ``length`` steps of an array of arrays of ``size``; absent steps count as zeros."""
    zero = F.array_repeat(F.lit(0.0), size)
    summed = F.aggregate(F.slice(steps, 1, length), zero, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
    return F.transform(summed, lambda x: x / length)
