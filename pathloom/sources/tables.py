"""Tables to spaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.space import ITEMS, Space

#: Types whose values are as different as their texts, so that rows are made distinct before they become text.
EXACT = {"tinyint", "smallint", "int", "bigint", "boolean", "date", "string"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(frame: DataFrame, tag: str | None, *items: str | Column, distinct: bool = True) -> Space:
    """The paths ``tag.item...`` of the rows of a table; rows with a null item are no fact.

    ``distinct`` may be false where the items hold a key of the table.
    """
    columns = [F.col(x) if isinstance(x, str) else x for x in items]
    texts = [f"_{i}" for i in range(len(columns))]
    rows = frame.select(*[c.alias(n) for c, n in zip(columns, texts)])
    if not {f.dataType.simpleString() for f in rows.schema} <= EXACT:
        rows = rows.select(*[F.col(n).cast("string").alias(n) for n in texts])
    rows = rows.where(reduce(Column.__and__, [F.col(n).isNotNull() for n in texts], F.lit(True)))
    rows = rows.distinct() if distinct else rows
    rows = rows.select(*[F.col(n).cast("string").alias(n) for n in texts])
    lead = [] if tag is None else [F.lit(tag)]
    path = F.array(*lead, *[F.col(f"_{i}") for i in range(len(texts))]).cast(ITEMS)
    return Space(rows.select(path.alias("path")), lengths={len(lead) + len(texts)})


def from_texts(frame: DataFrame, column: str = "value") -> Space:
    """Paths of dotted texts: empty items at the end are dropped, and the empty text is one empty item."""
    text = F.col(column)
    split = F.split(F.regexp_replace(text, r"\.+$", ""), r"\.")
    path = F.when(text == "", F.array(F.lit(""))).when(text.rlike(r"^\.+$"), F.array().cast(ITEMS)).otherwise(split)
    return Space(frame.where(text.isNotNull()).select(path.alias("path")).distinct())
