"""Near duplicates by MinHash: many universal hash minima, banding, verification by signature and on full
sets, components.

Documents with equal shingle sets are one class from the start. Classes that share a band are
candidates. In a few rounds every member of a bucket is checked against one centre of it, and the
links found are merged into components; then, in buckets that still hold several components, every
pair from different components is checked. So a bucket full of copies costs its size, not its
square, and no link between different components is lost. What is left of a large bucket meets in
blocks, as many as its size asks for.

A pair is verified by a parity sketch that refuses no similar pair, by its signatures (the minima's low
bytes, with a margin), and then on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table, text_or_empty, unused, with_rows
from .components import components

#: At similarity 0.8 a pair shares no band with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, BAND_ROWS = 32, 5
#: Equal minima, of all, under which a pair is refused: at similarity 0.8 that is 5.5 standard deviations
#: from what is expected, or 4e-8.
LEAST_EQUAL = 100
#: Bits of a set's parity sketch.
PARITY_BITS = 1_024
#: Members of a bucket up to which all that is left of it meets in one block.
BLOCK = 1_000
#: Rounds in which every member of a bucket meets one centre of it, before all that is left meets.
STAR_ROUNDS = 2
PERCENT = 80
_rng = np.random.default_rng(20240501)
MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)
WORDS_KEPT, PORTION = 100_000, 500_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(32))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of all words if fewer; empty without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : n - k + 1 + i]
    if len(_words) > WORDS_KEPT:
        _words.clear()
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of (a x + b mod 2^64) for non-empty sets, one row each."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(MULTIPLIERS)), np.uint64)
    for j, (a, b) in enumerate(zip(MULTIPLIERS, OFFSETS, strict=True)):
        out[:, j] = np.minimum.reduceat(flat * a + b, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(sig), np.uint64(band + 1))
        for r in range(BAND_ROWS):
            h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + sig[:, band * BAND_ROWS + r])
        keys[:, band] = h
    return keys.view(np.int64)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of the set's hashes fall on i. Two sketches differ in at most as
    many bits as the sets have elements apart, so a pair they refuse cannot be similar."""
    odd = (np.bincount((hashes >> np.uint64(11)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _portions(sets: Iterator[tuple], most: int = PORTION) -> Iterator[list[tuple]]:
    out, n = [], 0
    for x in sets:
        out.append(x)
        n += len(x[-1])
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


def low_bytes(sig: np.ndarray) -> np.ndarray:
    """The last byte of each minimum: what signatures are compared by."""
    return sig.astype(np.uint8).view(np.int8)


def sign(docs: DataFrame, k: int, text_col: str = "text", row_col: str = "__row") -> DataFrame:
    """row, doc_id, n, digest, bands, sig, sketch for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for b in batches:
            rows = zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), (shingle_set(t, k) for t in b["text"].to_pylist()), strict=True)
            for part in _portions(rows):
                full = [i for i, x in enumerate(part) if len(x[2])]
                bands, low, sketch, digest = ([None] * len(part) for _ in range(4))
                if full:
                    sig = signatures([part[i][2] for i in full])
                    for i, keys, own in zip(full, band_keys(sig), low_bytes(sig), strict=True):
                        bands[i], low[i], sketch[i], digest[i] = keys, own, parity_sketch(part[i][2]), xxhash.xxh3_128_digest(part[i][2].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([len(x[2]) for x in part], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, longs), pa.array(low, pa.list_(pa.int8())), pa.array(sketch, longs)],
                    ["row", "doc_id", "n", "digest", "bands", "sig", "sketch"])

    rows = docs.select(F.col(row_col).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, digest binary, bands array<bigint>, sig array<tinyint>, sketch array<bigint>")


def full_sets(docs: DataFrame, k: int, text_col: str = "text", row_col: str = "__row") -> DataFrame:
    """row, hashes: the whole sets of the rows of ``docs``; null and empty texts have empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _portions(zip(b["row"].to_pylist(), (shingle_set(t, k).view(np.int64) for t in b["text"].to_pylist()), strict=True)):
                lengths = np.cumsum([0] + [len(x[1]) for x in part]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([x[1] for x in part])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), hashes], ["row", "hashes"])

    return docs.select(F.col(row_col).alias("row"), text_or_empty(text_col).alias("text")).mapInArrow(run, "row long, hashes array<bigint>")


def _possible(percent: int) -> str:
    """SQL of what similar pairs fulfil: sizes near each other, few elements apart, and signatures alike."""
    alike = "aggregate(zip_with(a_sig, b_sig, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x)"
    apart = " + ".join(f"bit_count(a_sketch[{i}] ^ b_sketch[{i}])" for i in range(PARITY_BITS // 64))
    return f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) AND {100 + percent} * ({apart}) <= {100 - percent} * (a_n + b_n) AND {alike} >= {LEAST_EQUAL}"


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, many: bool) -> DataFrame:
    """The rows of ``pairs`` (a, b and more) whose full sets have 100 * intersection >= percent * union. ``many`` pairs are
    sorted to the sets; for few, Spark may send the pairs to the sets instead."""
    pairs = durable(pairs)
    a, b = sets.select(F.col("row").alias("a"), F.col("hashes").alias("a_set")), sets.select(F.col("row").alias("b"), F.col("hashes").alias("b_set"))
    if many:
        a, b = a.hint("merge"), b.hint("merge")
    both = F.size(F.array_intersect("a_set", "b_set")).alias("both")
    checked = pairs.join(b, "b").join(a, "a").select(*pairs.columns, both, (F.size("a_set") + F.size("b_set")).alias("sum"))
    return checked.filter(f"100 * both >= {percent} * (sum - both)").select(*pairs.columns)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id, first (the one row that represents it) of every row of ``docs``.

    component_id is the smallest doc_id reachable over links (null ids last); rows without words
    are linked with nothing, repeated rows are linked with each other. An empty table gives an
    empty result; columns but doc_id and the text are not looked at. ``row_col`` is a column that
    ``with_rows`` has made, if there is one.
    """
    if row_col is None:
        row_col = unused(docs)
        docs = with_rows(docs.select("doc_id", text_col), row_col)
    signed = durable(sign(docs, k, text_col, row_col))
    # rows are in the order of ids, so the smallest row of a component has its smallest id
    classes = durable(signed.filter("n > 0").groupBy("digest", "n").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("bands", "sig", "sketch")]))
    keys = classes.select(F.explode("bands").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    keys = durable(keys.join(shared, "key"))
    members = durable(keys.join(classes.select("node", "n", "sig", "sketch"), "node"))
    # the full sets of all that share a band with another, from one pass over the texts
    needed = keys.select(F.col("node").alias(row_col)).distinct().hint("merge")
    sets = durable(full_sets(docs.join(needed, row_col, "left_semi"), k, text_col, row_col))
    side = lambda df, x, *more: df.select("key", *more, *[F.col(c).alias(f"{x}_{c}" if c != "node" else x) for c in ("node", "n", "sig", "sketch", "label")])

    label = classes.select("node", F.col("node").alias("label"))
    for turn in range(STAR_ROUNDS + 1):
        # buckets that hold several components; the centre is another one each time
        labelled = members.join(label, "node")
        centre = F.min_by(F.struct("node", "n", "sig", "sketch", "label"), F.xxhash64("node", F.lit(turn)) if turn else F.col("node"))
        buckets = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), centre.alias("c"), F.mode("label", True).alias("most"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
        if turn < STAR_ROUNDS:
            one, other = side(buckets.select("key", "c.*"), "a"), side(labelled, "b").withColumnRenamed("key", "b_key")
            together = F.col("key") == F.col("b_key")
        else:
            # all outside a bucket's largest component against all of the bucket, in blocks: a bucket of m has
            # (m / BLOCK)^(2/3) strips each way, so that neither rows nor a block's pairs grow with m squared
            strips = F.greatest(F.lit(1), F.ceil(F.pow(F.col("size") / BLOCK, F.lit(2 / 3)))).cast("int")
            dealt = durable(labelled.join(buckets.select("key", "most", strips.alias("strips")), "key").withColumn("strip", F.pmod(F.xxhash64("node"), F.col("strips")).cast("int")))
            each = F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("other_strip")
            one = side(dealt.filter("label <> most").select("*", each), "a", "strip", "other_strip")
            other = side(dealt.select("*", each), "b", F.col("strip").alias("b_strip"), F.col("other_strip").alias("b_other")).withColumnRenamed("key", "b_key")
            together = (F.col("key") == F.col("b_key")) & (F.col("strip") == F.col("b_other")) & (F.col("other_strip") == F.col("b_strip"))
        pairs = one.join(other, together & F.expr(f"a_label <> b_label AND {_possible(percent)}")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("a_label", "b_label").alias("low"), F.greatest("a_label", "b_label").alias("high")).distinct()
        # links join whole components of the turn before, so a turn only walks what it has found itself
        found = confirm(pairs, sets, percent, many=turn == 0).select(F.col("low").alias("a"), F.col("high").alias("b"))
        joined = components(found).select(F.col("node").alias("label"), F.col("label").alias("now"))
        label = durable(label.join(joined, "label", "left").select("node", F.coalesce("now", "label").alias("label")))

    classes = durable(classes.select("node", "digest", "n", "copies").join(label, "node"))
    # classes of more than 1/512 of all rows are 512 at most and go to the tasks; other rows are joined by digest
    total = signed.count()
    large = classes.filter(F.col("copies") * 512 > total).select(F.col("digest").alias("l_digest"), F.col("n").alias("l_n"), F.col("label").alias("l_label"))
    small = classes.filter(F.col("copies") * 512 <= total).select(F.col("digest").alias("s_digest"), F.col("n").alias("s_n"), F.col("label").alias("s_label"))
    rows = signed.select("row", "doc_id", "n", "digest").join(F.broadcast(large), (F.col("digest") == F.col("l_digest")) & (F.col("n") == F.col("l_n")), "left")
    # rows that need no join, those without words among them, have a key of their own, so that they do not crowd
    key = F.when(F.col("l_label").isNull() & (F.col("n") > 0), F.col("digest")).otherwise(F.concat(F.lit("row "), F.col("row").cast("string")).cast("binary"))
    rows = rows.withColumn("key", key).join(small, (F.col("key") == F.col("s_digest")) & (F.col("n") == F.col("s_n")), "left")
    rows = rows.select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("l_label", "s_label", "row").alias("label"))
    if signed.filter("NOT doc_id <=> row").isEmpty():  # rows are the ids
        found = rows.withColumn("component_id", F.col("label"))
    else:
        found = rows.join(signed.select(F.col("row").alias("label"), F.col("doc_id").alias("component_id")), "label")
    return found.select("row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("label")).alias("first"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with the columns of ``docs``."""
    name = unused(docs)
    rows = with_rows(docs, name)
    stay = near_duplicates(rows, k, percent, text_col, name).filter("first").select(F.col("row").alias(name))
    return rows.join(stay, name, "left_semi").select(*docs.columns)


def query(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
