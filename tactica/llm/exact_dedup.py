"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is one run: its distinct digests in order, each with the best row seen so
far. In each round ``fan_in`` neighbouring runs are sent to the place of the run that they become,
are merged there in order, digest by digest, and the better row survives; after
log(runs)/log(fan_in) rounds one run is left. A run is never in one task: it is dealt over the
shuffle partitions by its digests, in order within each, and a digest that holds a third of all
rows comes to at most one row per run and round. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, durable, text_or_empty, unused, with_rows

KEY = ["digest", "norm_chars", "second"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One small row per document: its digest, two checks of it, and its order among equals."""
    text = text_or_empty(text_col)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return (
        docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.spark_partition_id().alias("run"),
                    F.length(text).alias("n_chars"), F.regexp_replace(text, f"[{SPACE}]", "").alias("norm"))
        .select("doc_id", "row", "run", "n_chars", F.unhex(F.sha2("norm", 256)).alias("digest"),
                F.length("norm").alias("norm_chars"), F.xxhash64("norm").alias("second"))
    )


def merge_runs(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """digest -> the surviving row and the group's size, by rounds of multiway merges.

    The key of a merge is the digest with the text's length and a second hash, so a survivor is
    checked against what it absorbs in every round.
    """
    order = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    # the first runs are sorted and made distinct where they stand
    runs = rows.sortWithinPartitions("run", *KEY).groupBy("run", *KEY).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        left = -(-left // fan_in)
        # an exchange by run and digest, and one walk over rows that are then in order
        met = runs.withColumn("run", F.expr(f"cast(run div {fan_in} as int)")).repartition("run", "digest").sortWithinPartitions("run", *KEY)
        runs = met.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        if left == 1:
            return runs.drop("run")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, row (``row_col``, or a number), keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, and empty texts are
    equal to each other. The row with the most code points stays, then the smallest id (null ids
    last), then, among repeated rows, exactly one. An empty table gives an empty result; other
    columns are not looked at.
    """
    rows = durable(digest_rows(docs, id_col, text_col, row_col))
    return rows.join(merge_runs(rows, fan_in), KEY).select(
        "doc_id", "row", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    name = unused(docs)
    rows = with_rows(docs, name, id_col)
    kept = exact_duplicates(rows, id_col, text_col, row_col=name).filter("kept").select(F.col("row").alias(name))
    return rows.join(kept, name, "left_semi").select(*docs.columns)


def query(spark, sf_dir):
    from .common import table

    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
best AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN best USING (text_sha256)
"""
