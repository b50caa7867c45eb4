"""Importance resampling towards a target distribution, on hashed word n-grams.

Features (single words and pairs) fall into buckets by CRC-32. Two counts over all texts, of the
corpus and of the target, give every bucket a gain; a text's weight is the mean gain of its
features, and the texts of the highest weight plus Gumbel noise are drawn. The checksums of a
portion of texts are made at once: its distinct features, grouped by length into byte matrices,
are read column by column, and their buckets are scattered back to where the features stand.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import durable, table, text_or_empty, unused, with_rows

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Bytes of texts whose features are held at a time.
PORTION = 4 << 20
#: Longer features are rare and would make a matrix of one row each: zlib reads them.
LONGEST = 256
POLYNOMIAL = 0xEDB88320


def _table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(POLYNOMIAL), crc >> 1)
    return crc.astype(np.uint32)


TABLE = _table()


def crc32(line: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``line``: one byte matrix for each length, all its rows updated column by column."""
    out = np.empty(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, firsts = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, firsts)[1:], strict=True):
        if size > LONGEST:
            for r in rows.tolist():
                out[r] = zlib.crc32(line[start[r] : start[r] + size].tobytes())
            continue
        matrix = line[start[rows] + np.arange(size)[:, None]]  # one row a column of bytes, so that each is read in order
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[rows] = ~crc
    return out


def hashed(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, its bucket, words of each text) over the single words, then the pairs."""
    w = words.split(texts)
    pairs = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    code = w.code.astype(np.int64)
    coded = pa.array(code[pairs] * max(1, len(w.distinct)) + code[pairs + 1]).dictionary_encode()
    one, two = np.empty(len(w.distinct), np.int64), np.empty(len(coded.dictionary), np.int64)
    one[w.code], pair_code = np.arange(len(code)), coded.indices.to_numpy()
    two[pair_code] = pairs  # some place of every distinct feature
    start = np.r_[w.start[one], w.start[two]]
    length = np.r_[w.length[one], w.length[two] + 1 + w.length[two + 1]]
    bucket = (crc32(w.line, start, length) % np.uint32(buckets)).astype(np.int32)
    return np.r_[w.doc, w.doc[pairs]], np.r_[bucket[w.code], bucket[len(one) :][pair_code]], w.counts()


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks add up their own texts first, so at
    most ``buckets`` rows of each are exchanged and ``buckets`` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for part in words.portions(b, "text", PORTION):
                n += np.bincount(hashed(part["text"], buckets)[1], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["bucket", "n"])

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Of each bucket, a thousand times the log of its smoothed share in the target over that in the corpus."""
    s, t = bucket_counts(docs, text_col, buckets).tolist(), bucket_counts(target, text_col, buckets).tolist()
    all_s, all_t = sum(s), sum(t)
    return [math.floor(1000 * math.log(float((y + 1) * (all_s + buckets)) / float((x + 1) * (all_t + buckets)))) for x, y in zip(s, t, strict=True)]


def noise(seed: int, key) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_features, weight, score, n_words of every text, and the columns ``keep``.

    Null and empty texts have no features and weight 0; a null id has the noise of an empty one,
    equal ids have equal noise. An empty corpus or target counts as one without features.
    """
    gain = np.array(gains(docs, target, text_col, buckets), np.int64)
    carried = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in words.portions(b, "text", PORTION):
                doc, bucket, n_words = hashed(part["text"], buckets)
                n = np.bincount(doc, minlength=part.num_rows)
                weight = np.bincount(doc, gain[bucket], part.num_rows).astype(np.int64) // np.maximum(n, 1)  # whole numbers under 2^53
                score = weight + np.array([noise(seed, x) for x in part[id_col].to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in carried], *[pa.array(x.astype(np.int64)) for x in (n, weight, score, n_words)]], [*carried, "n_features", "weight", "score", "n_words"])

    rows = docs.select(*carried, text_or_empty(text_col).alias("text"))
    types = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried]
    return rows.mapInArrow(run, ", ".join([*types, "n_features long, weight long, score long, n_words long"]))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id") -> DataFrame:
    """``scored`` with ``rank``, null where a text is not drawn.

    Of the N texts with ``least_words`` words or more, the floor(percent * N / 100) highest scores are
    drawn, ties to the smaller id (nulls last). The order is one sort by ranges; a row's rank is its
    place in its range after the sizes of the ranges before, so no task sees more than a range.
    """
    spark, scored = scored.sparkSession, durable(scored)
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    by = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("weight"), F.col("n_features")]
    ordered = durable(scored.filter(able).orderBy(*by).withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # one row a range
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    drawn = percent * total // 100
    starts = spark.createDataFrame(before, "part long, before long")
    rank = F.col("before") + within + 1
    ranked = ordered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= drawn, rank)).select(*scored.columns, "rank")
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The drawn rows of ``docs``, with its columns."""
    key = unused(docs)
    docs_k = with_rows(docs, key, id_col, (text_col,))
    rows = docs_k.select(F.col(key).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = importance(rows, target.select(F.col(text_col).alias("text")), seed=seed, keep=("row_key",))
    drawn = draw(scored, percent, least_words).filter("rank IS NOT NULL").select(F.col("row_key").alias(key))
    return docs_k.join(drawn, key, "left_semi").select(*docs.columns)


def query(spark, sf_dir):
    scored = importance(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _features(name: str, rows: str) -> str:
    """CTE of (id, feature, n) over the words of ``rows``."""
    return f"""{name} AS MATERIALIZED (SELECT id, feature, count(*) AS n FROM (
  SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM {rows}) GROUP BY 1, 2)"""


ORACLE = f"""WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor({POLYNOMIAL}, c >> 1) ELSE c >> 1 END, n)) AS t),
d AS MATERIALIZED (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id AS id, {_WORDS} AS w FROM benchmark),
{_features("df", "d")}, {_features("bf", "b")},
feature AS MATERIALIZED (SELECT feature, xor(list_reduce(list_transform(range(strlen(feature)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM df UNION SELECT feature FROM bf)), tab),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN feature USING (feature) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM bf JOIN feature USING (feature) GROUP BY 1),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM df) AS s, (SELECT coalesce(sum(n), 0) FROM bf) AS t),
gain AS MATERIALIZED (SELECT r.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.t, 0) + 1) * (total.s + {BUCKETS}) AS DOUBLE) / CAST((coalesce(s.s, 0) + 1) * (total.t + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM range({BUCKETS}) r(bucket) LEFT JOIN s ON s.bucket = r.bucket LEFT JOIN t ON t.bucket = r.bucket, total),
weight AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM df JOIN feature USING (feature) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT d.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= {LEAST_WORDS} AS able,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weight USING (id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed"""
