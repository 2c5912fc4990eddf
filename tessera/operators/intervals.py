"""Algebra of half-open spans [start, end) per group, without pairwise joins.

Spans shuffle once by group and slice of its order (``sliced``), so a group may hold any share of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sliced import Sliced


def merged(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", slice_rows: int | None = None) -> DataFrame:
    """Touching and overlapping spans of a group as one; empty, reversed and null spans vanish."""
    kept = spans.filter(F.col(end) > F.col(start)).select(*keys, start, end)
    cut = Sliced.of(kept, keys, [start, end], slice_rows).before(reach=("max", F.col(end)))
    new = ~F.coalesce(F.col(start) <= F.col("reach"), F.lit(False))
    numbered = cut.before(island=("count", new)).done().withColumn("island", F.col("island") + new.cast("int"))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def uncovered(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", slice_rows: int | None = None) -> DataFrame:
    """The gaps between a group's merged spans."""
    whole = merged(spans, keys, start, end, slice_rows)
    before = Sliced.of(whole, keys, [start], slice_rows).before(before_end=("last", F.col(end))).done()
    return before.filter("before_end IS NOT NULL").select(*keys, F.col("before_end").alias(start), F.col(start).alias(end))


def _swept(spans: DataFrame, cover: DataFrame, keys: list[str], start: str, end: str, at: str, spans_first: bool, slice_rows: int | None) -> DataFrame:
    """``spans`` with ``cover_end``: the end of the last span of disjoint ``cover`` that starts before ``at`` (or at it)."""
    own = spans.withColumns({"sweep_at": F.col(at), "sweep_turn": F.lit(0 if spans_first else 1), "sweep_end": F.lit(None).cast("long")})
    other = cover.select(*keys, F.col(start).alias("sweep_at"), F.lit(1 if spans_first else 0).alias("sweep_turn"), F.col(end).cast("long").alias("sweep_end"))
    both = own.unionByName(other, allowMissingColumns=True)
    found = Sliced.of(both, keys, ["sweep_at", "sweep_turn"], slice_rows).before(cover_end=("last", F.col("sweep_end"))).done()
    return found.filter(F.col("sweep_turn") == (0 if spans_first else 1)).drop("sweep_at", "sweep_turn", "sweep_end")


def overlapping(spans: DataFrame, cover: DataFrame, keys: list[str], start: str = "start", end: str = "end", slice_rows: int | None = None) -> DataFrame:
    """Rows of ``spans`` (not empty) that share a point with a span of ``cover`` in their group."""
    swept = _swept(spans.filter(F.col(end) > F.col(start)), merged(cover, keys, start, end, slice_rows), keys, start, end, end, True, slice_rows)
    return swept.filter(F.col("cover_end") > F.col(start)).drop("cover_end")


def not_inside(spans: DataFrame, cover: DataFrame, keys: list[str], start: str = "start", end: str = "end", slice_rows: int | None = None) -> DataFrame:
    """Rows of ``spans`` (not empty) that no single merged span of ``cover`` contains."""
    swept = _swept(spans.filter(F.col(end) > F.col(start)), merged(cover, keys, start, end, slice_rows), keys, start, end, start, False, slice_rows)
    return swept.filter(F.col("cover_end").isNull() | (F.col("cover_end") < F.col(end))).drop("cover_end")


def overlapping_previous(spans: DataFrame, keys: list[str], order: list[str], start: str = "start", end: str = "end", slice_rows: int | None = None) -> DataFrame:
    """Rows that start before the row before them in the group ends."""
    passed = Sliced.of(spans, keys, order, slice_rows).before(previous=("last", F.struct(F.col(end).alias("end")))).done()
    return passed.withColumn("previous_end", F.col("previous.end")).drop("previous").filter(F.col("previous_end") > F.col(start))
