"""Metadata columns of an interval table: whatever its rows hold besides the coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIXED = ("row_id", "seqname", "start", "end", "strand")


def meta_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in FIXED]


def add(df: DataFrame, name: str, value: Column | DataFrame) -> DataFrame:
    """Adds or replaces a column: an expression, or a table (row_id, value) with exactly one value a row."""
    if isinstance(value, Column):
        return df.withColumn(name, value)
    own = value.select("row_id", F.col("value").alias(name), F.lit(True).alias("_has"))
    met = df.drop(name).join(own, "row_id", "left")
    missing = F.when(F.col("_has").isNull(), F.raise_error("column has another length than the table"))
    kind = dict(value.dtypes)["value"]
    return met.withColumn(name, F.coalesce(missing.cast(kind) if not kind.startswith(("array", "struct")) else F.col(name), F.col(name))).drop("_has")


def delete(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[n for n in names if n not in FIXED])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def column(df: DataFrame, name: str, kind: str) -> DataFrame | None:
    """(row_id, value) of a column of this type, or none where there is no such column."""
    return df.select("row_id", F.col(name).alias("value")) if dict(df.dtypes).get(name) == kind else None
