"""Constraints over groups of parts; each returns the rows or groups that a caller refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated(rows: DataFrame, keys: list[str], most: int = 1) -> DataFrame:
    """Groups with more than ``most`` rows, as ``n``."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def declared_differs(headers: DataFrame, key: str, declared: Column, parts: DataFrame, part_key: str) -> DataFrame:
    """Headers whose declared number of parts isn't the actual one: key, ``declared``, ``actual``."""
    counts = parts.groupBy(F.col(part_key).alias("part_key")).agg(F.count(F.lit(1)).alias("actual"))
    joined = headers.select(key, declared.alias("declared")).join(counts, F.col(key) == F.col("part_key"), "left")
    return joined.select(key, "declared", F.coalesce("actual", F.lit(0)).alias("actual")).filter("declared <> actual")


def coverage(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Per group ``n, n_distinct, highest, complete``: complete if the numbers are 0 to n-1, each once."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(number).alias("n_distinct"), F.max(number).alias("highest"), F.min(number).alias("lowest"))
    complete = (F.col("n") == F.col("n_distinct")) & (F.col("lowest") == 0) & (F.col("highest") == F.col("n") - 1)
    return found.withColumn("complete", complete).drop("lowest")


def over_budget(rows: DataFrame, keys: list[str], cost: Column, most: int) -> DataFrame:
    """Groups whose summed cost exceeds ``most``, as ``total``."""
    return rows.groupBy(*keys).agg(F.sum(cost).alias("total")).filter(F.col("total") > most)


def first_refusal(rows: DataFrame, keys: list[str], order: list[str], refused: Column, keep: list[str]) -> DataFrame:
    """The first refused row of each group that has one."""
    first = F.min(F.struct(*order, *keep)).alias("first")
    return rows.filter(refused).groupBy(*keys).agg(first).select(*keys, *(F.col(f"first.{c}").alias(c) for c in dict.fromkeys([*order, *keep])))
