"""Keyed state and append-only history: change logs, folds, latest rows, missing counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_log(df: DataFrame, keys: list[str], order: list[str], tracked: list[str]) -> DataFrame:
    """Rows in which a tracked column is given and differs from the key's merged state, in which nulls don't overwrite; a key's first row counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    changed = [F.col(c).isNotNull() & ~F.last(c, ignorenulls=True).over(before).eqNullSafe(F.col(c)) for c in tracked]
    return df.withColumn("__first", F.lag(order[-1]).over(w).isNull()).withColumn("__changed", reduce(lambda a, b: a | b, changed)).where("__first or __changed").drop("__first", "__changed")


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """State of each key after all partial updates in order: the last value that is not null. One aggregation, no window."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns], F.count("*").alias("updates"))


def keep_last(df: DataFrame, keys: list[str], order: list[F.Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New values win unless they are null; keys of either side stay."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return old.join(n, keys, "full").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])
