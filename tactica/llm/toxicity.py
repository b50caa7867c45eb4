"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings. Labelled sentences that mention a
group are also read with the group's name swapped for another of its kind; the squared change of
the score under the swap is penalised, so that the mention itself carries no weight. Features and
weights come from a bounded sample of labelled rows (``SAMPLE``, documented bound); scoring covers
every text, in one map over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table, text_or_empty, unused

#: Bounds of what is learned from and of the model, in rows and features.
SAMPLE, FEATURES, LEAST_TEXTS = 16_000, 4_096, 8
PREFIXES, SWAP_PENALTY, RIDGE, STEPS = (3, 4, 5, 6, 7, 8), 4.0, 1e-4, 300
THRESHOLD = 0.5

#: Names of groups, by kind; a swap puts the next of the same kind in the place of each.
GROUPS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"), ("mother", "father"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"),
    ("old", "young"), ("deaf", "blind", "disabled"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {w: kind[(i + 1) % len(kind)] for kind in GROUPS for i, w in enumerate(kind)}
WORD = re.compile(r"[^\W\d_]+")


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings marked with a star."""
    return words.union(*[{w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES])


def labelled(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, toxic) of at most SAMPLE labelled documents of the four training folds."""
    train = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    # at most SAMPLE pairs of integers: small whatever the input
    return docs.select("doc_id", text_or_empty(text_col).alias("text")).join(F.broadcast(train), "doc_id").select("text", "toxic")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(sorted(features(set(WORD.findall(t.lower())))), y) for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([int(r[1]) for r in rows], pa.int32())], ["found", "toxic"])


def select_features(train: DataFrame) -> list[str]:
    """The FEATURES features whose share among toxic texts differs most, in standard errors."""
    sets = train.mapInArrow(_sets, "found array<string>, toxic int")
    n, k = sets.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not k or k == n:
        return []
    rate = k / n
    z = (F.col("pos") - F.col("df") * rate) / F.sqrt(F.col("df") * rate * (1 - rate))
    counted = sets.select(F.explode("found").alias("f"), "toxic").groupBy("f").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("pos"))
    top = counted.filter(F.col("df") >= LEAST_TEXTS).orderBy(F.abs(z).desc(), "f").limit(FEATURES)
    return sorted(r[0] for r in top.select("f").collect())


def _rows(names: list[str]):
    at = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, lost, gained = [], [], []
            for t in b["text"].to_pylist():
                words = set(WORD.findall(t.lower()))
                have = {at[f] for f in features(words) if f in at}
                swapped = {SWAP.get(w, w) for w in words}
                other = {at[f] for f in features(swapped) if f in at} if swapped != words else have
                for out, ids in ((own, have), (lost, have - other), (gained, other - have)):
                    out.append(sorted(ids))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*[pa.array(x, lists) for x in (own, lost, gained)], pa.array([int(y) for y in b["toxic"].to_pylist()], pa.int32())], ["own", "lost", "gained", "toxic"])

    return rows


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> dict[str, float]:
    """feature -> weight, with the bias under the empty name. No labelled rows: an empty model.

    The gradient works on index lists of the bounded sample, SAMPLE x FEATURES at most.
    """
    train = durable(labelled(docs, labels, text_col))  # SAMPLE rows at most, read three times
    names = select_features(train)
    got = train.mapInArrow(_rows(names), "own array<int>, lost array<int>, gained array<int>, toxic int").toArrow()
    y = got["toxic"].to_numpy().astype(float)
    if not len(y):
        return {}
    n, m = len(y), len(names)

    def flat(column):
        c = got[column].combine_chunks()
        return c.flatten().to_numpy(), np.repeat(np.arange(n), np.diff(c.offsets.to_numpy()))

    (f, r), (g, q), (h, s) = flat("own"), flat("lost"), flat("gained")
    # features of x - x', row by row: what the swap adds or takes away; most rows have none
    swap_f, swap_r, sign = np.r_[g, h], np.r_[q, s], np.r_[np.ones(len(g)), -np.ones(len(h))]
    w, bias = np.zeros(m), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    seen_w, seen_b = np.full(m, 1e-8), 1e-8
    for _ in range(STEPS if m else 0):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r, w[f], n), -30, 30)))
        change = np.bincount(swap_r, sign * w[swap_f], n)
        grad = np.bincount(f, (p - y)[r], m) / n + SWAP_PENALTY * 2 * np.bincount(swap_f, sign * change[swap_r], m) / n + RIDGE * w
        grad_b = float((p - y).mean())
        seen_w += grad**2
        seen_b += grad_b**2
        w -= 0.3 * grad / np.sqrt(seen_w)
        bias -= 0.3 * grad_b / np.sqrt(seen_b)
    return {"": bias} | dict(zip(names, w.tolist(), strict=True))


def score(docs: DataFrame, model: dict[str, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1, from the text alone. A column that ``docs``
    has already is an error, not overwritten."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}")
    weight, bias = {k: v for k, v in model.items() if k}, model.get("")

    @F.pandas_udf("double")
    def toxic(texts):
        import pandas as pd

        if bias is None:
            return pd.Series(np.zeros(len(texts)))
        z = [bias + sum(weight.get(f, 0.0) for f in features(set(WORD.findall(t.lower())))) for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))

    return docs.withColumn(name, toxic(text_or_empty(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored under THRESHOLD, with the columns of ``docs``.

    Null and empty texts have the bias as their score; without labelled rows nothing is dropped.
    """
    name = unused(docs, "__toxic")
    return score(docs, fit(docs, labels, text_col), text_col, name).filter(F.col(name) < THRESHOLD).select(*docs.columns)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
