"""What the text operators share: reading, durable intermediate tables, text columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactica.sources.tables import shared_dir

#: White space of the word definition used by most operators.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts the lineage, so lost executors cost no recomputation of what came before, and gives
    every later reader the same rows even where ``df`` is not deterministic.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(docs: DataFrame, name: str = "__row") -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def with_rows(docs: DataFrame, name: str = "__row", id_col: str = "doc_id", then: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with a number that tells rows apart, that follows the order of ids (null ids last; equal ones by
    the columns ``then``) and that no second reading changes.

    The id itself where ids are integers, unique and not null; otherwise row numbers, fixed in a
    durable copy (numbers given while reading would change with the cores that happen to be there).
    """
    if docs.schema[id_col].dataType.typeName() in ("long", "integer"):
        total, ids = docs.select(id_col).agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
        if total == ids:
            return docs.withColumn(name, F.col(id_col).cast("long"))
    return durable(docs.orderBy(F.col(id_col).asc_nulls_last(), *then).withColumn(name, F.monotonically_increasing_id()))
