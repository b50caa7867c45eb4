"""Document fingerprints: the phrases of a Lempel-Ziv parse, compared by minimum hashes.

Each text is parsed into phrases, every one the longest known phrase and one more byte. The set of
phrase hashes, signed by universal-hash minima, is the fingerprint; the share of equal minima
estimates the overlap of two dictionaries, which is what a compressor would share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, table, text_or_empty

MINIMA = 64
_rng = np.random.default_rng(77001)
MULTIPLIERS = _rng.integers(1, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, MINIMA, np.uint64)
MASK = (1 << 61) - 1
#: Phrases signed at a time.
PORTION = 300_000


class Parse:
    """A Lempel-Ziv parse that can be continued: phrases as a trie, and a hash of each phrase."""

    def __init__(self, trie: dict[int, int] | None = None, hashes: list[int] | None = None, at: int = 0):
        self.trie, self.hashes, self.at = {} if trie is None else trie, [1] if hashes is None else hashes, at

    def copy(self) -> Parse:
        return Parse(self.trie.copy(), self.hashes.copy(), self.at)

    def feed(self, data: bytes) -> Parse:
        trie, hashes, at = self.trie, self.hashes, self.at
        get, n = trie.get, len(hashes)
        for c in data:
            key = at << 8 | c
            at = get(key, 0)
            if not at:
                trie[key] = n
                n += 1
                hashes.append((hashes[key >> 8] * 0x9E3779B97F4A7C1 + c + 1) & MASK)
        self.at = at
        return self

    def phrases(self) -> np.ndarray:
        """Hashes of the dictionary, with the unfinished last phrase; of an empty text, a fixed one."""
        return np.array(self.hashes, np.uint64)


def both(text: str) -> tuple[Parse, np.ndarray]:
    """The parse up to the half that an edit keeps, and the phrases of the whole text."""
    cut = len(text) - len(text) // 2
    first = Parse().feed(text[:cut].encode())
    return first, first.copy().feed(text[cut:].encode()).phrases()


def sign(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit minima of each set, one row each; every set holds the root."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = (flat ^ (flat >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    flat ^= flat >> np.uint64(29)
    root = np.array([len(s) == 1 for s in sets])
    if not root.all():  # the root is in every set and says nothing
        flat[starts[~root]] = flat[starts[~root] + 1]
    out = np.empty((len(sets), MINIMA), np.uint32)
    for j, (a, b) in enumerate(zip(MULTIPLIERS, OFFSETS, strict=True)):
        out[:, j] = np.minimum.reduceat(flat * a + b, starts) >> np.uint64(32)
    return out


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, part, ahead: the documents dealt into ranges of ids, and to each range the first
    document of the next one (``ahead``; after the last range, the first document of all).

    The ranges come from percentiles of the ids, so they hold about as many documents each; one
    exchange moves each text once, and the few range heads twice. Null ids sort last.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    # as exact as so many ranges ask for
    bounds = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0] or []
    sent = docs.sparkSession.sparkContext.broadcast(np.array(sorted(set(bounds)), np.int64))

    @F.pandas_udf("int")
    def part_of(ids):
        """How many bounds lie at or under each id."""
        return pd.Series(np.searchsorted(sent.value, ids.to_numpy(), "right"))

    # only the ids go to Python here; null beside integers would come as floating point, which large ids do not survive
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(sent.value))).otherwise(part_of(F.coalesce("doc_id", F.lit(0).cast("long")))).cast("int"))
    # at most ``parts`` rows
    order = Window.orderBy("part")
    heads = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))).alias("head"))
    heads = durable(heads).withColumn("to", F.lag("part").over(order))
    last = F.max("part").over(Window.partitionBy(F.lit(0)))
    heads = heads.select(F.coalesce("to", last).alias("to"), F.col("part").alias("head_part"), F.col("head.none").alias("none"), F.col("head.id").alias("id"))
    ahead = rows.join(F.broadcast(heads), (F.col("part") == F.col("head_part")) & (F.col("doc_id").isNull() == F.col("none")) & (F.coalesce("doc_id", F.lit(0)) == F.col("id")))
    ahead = ahead.select("doc_id", "text", F.col("to").alias("part"), F.lit(True).alias("ahead"))
    return rows.withColumn("ahead", F.lit(False)).unionByName(ahead)


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next id (equal ids: by text; nulls last; after the last:
    the first; a single document is its own). Empty texts share one fingerprint. An empty table
    gives an empty result.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, waiting = None, [], 0

        def rows():
            nonlocal now
            for b in batches:
                for doc, text, part, ahead in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["part"].to_pylist(), b["ahead"].to_pylist(), strict=True):
                    if now is not None and now[2] == part:
                        yield (now, (doc, text, part))
                    # of equal ids at a range's head, only the first stands ahead
                    now = None if ahead else (doc, text, part)

        def flush():
            sets = [x for row in done for x in row[3:]]
            sig = sign(sets)
            own, edited, following = sig[::3], sig[1::3], sig[2::3]
            written = [s.astype(">u4").tobytes().hex() for s in sig]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()), pa.array([r[2] for r in done], pa.string()),
                 pa.array(written[::3], pa.string()), pa.array(written[1::3], pa.string()),
                 pa.array((own == edited).mean(axis=1)), pa.array((own == following).mean(axis=1))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        ready: tuple | None = None  # the next document's text and parses, made for its predecessor
        for (doc, text, _), (_, next_text, _) in rows():
            shared, own = ready[1:] if ready and ready[0] is text else both(text)
            half = len(text) // 2
            kept, tail = text[: len(text) - half], next_text[:half]
            edited = shared.feed(tail.encode()).phrases()
            ready = (next_text, *both(next_text))
            done.append((doc, len(text), hashlib.sha256((kept + tail).encode()).hexdigest(), own, edited, ready[2]))
            waiting += len(own) + len(edited) + len(own)
            if waiting >= PORTION:
                yield flush()
                done, waiting = [], 0
        if done:
            yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = neighbours(docs, parts).repartition("part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.mapInArrow(run, schema)


def query(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
