"""Spans of large values, judged block by block: no task holds a whole value, and every span is an aggregate of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import all_zero
from tessera.operators import intervals, sequence

#: Bytes of a block.
BLOCK = 1 << 20


def blocks(rows: DataFrame, keys: list[str], value: Column, size: int = BLOCK) -> DataFrame:
    """``keys, block, piece``: the bytes of each value cut once, from 0; null and empty values have no blocks."""
    own = rows.select(*keys, value.cast("binary").alias("blob"))
    return sequence.reframed(own, F.col("blob"), size).select(*keys, F.col("n").alias("block"), "piece")


def _touched(spans: DataFrame, keys: list[str], size: int) -> DataFrame:
    """A row per block that a span of at least one byte touches: ``low`` and ``high`` within the block."""
    some = spans.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("end > start").distinct()
    first, last = F.floor(F.col("start") / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int")
    spread = some.withColumn("block", F.explode(F.sequence(first, last)))
    base = F.col("block").cast("long") * size
    return spread.withColumns({"low": F.greatest(F.col("start") - base, F.lit(0)).cast("int"), "high": F.least(F.col("end") - base, F.lit(size)).cast("int")})


def _part(piece: str) -> Column:
    return F.substring(F.col(piece), F.col("low") + 1, F.col("high") - F.col("low"))


def zero_spans(cut: DataFrame, spans: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """``keys, start, end, zero`` of each span (at least one byte, each once): whether the value has it and all its bytes are zero."""
    met = _touched(spans, keys, size).join(cut, [*keys, "block"], "left")
    found = F.coalesce((F.octet_length("piece") >= F.col("high")) & all_zero(_part("piece")), F.lit(False))
    return met.groupBy(*keys, "start", "end").agg(F.bool_and(found).alias("zero"))


def equal_spans(one: DataFrame, two: DataFrame, spans: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """``keys, start, end, same`` of each span (at least one byte, each once): whether both values have it and agree on it."""
    met = _touched(spans, keys, size).join(one, [*keys, "block"], "left").join(two.withColumnRenamed("piece", "other"), [*keys, "block"], "left")
    whole = (F.octet_length("piece") >= F.col("high")) & (F.octet_length("other") >= F.col("high"))
    return met.groupBy(*keys, "start", "end").agg(F.bool_and(F.coalesce(whole & (_part("piece") == _part("other")), F.lit(False))).alias("same"))


def gaps(used: DataFrame, sizes: DataFrame, keys: list[str], slice_rows: int | None = None) -> DataFrame:
    """``keys, start, end`` of the parts of [0, size) that no used span covers; ``sizes`` has one row per value.

    Spans may overlap and may reach beyond the value, where they count for nothing.
    """
    long = lambda column: column.cast("long")
    inside = used.join(sizes, keys).select(*keys, F.greatest(long(F.col("start")), F.lit(0)).alias("start"), F.least(long(F.col("end")), long(F.col("size"))).alias("end"))
    edges = F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("end")), F.struct(long(F.col("size")).alias("start"), long(F.col("size") + 1).alias("end"))))
    bounds = sizes.select(*keys, edges.alias("edge")).select(*keys, "edge.start", "edge.end")
    return intervals.uncovered(inside.unionByName(bounds), keys, slice_rows=slice_rows)


def unused_is_zero(rows: DataFrame, keys: list[str], value: Column, used: DataFrame, size: int = BLOCK, slice_rows: int | None = None) -> DataFrame:
    """``keys, n_gaps, covered``: of each value the number of parts that no used span covers, and whether all of them are zero."""
    sizes = rows.select(*keys, F.coalesce(F.octet_length(value.cast("binary")), F.lit(0)).alias("size"))
    open_ = zero_spans(blocks(rows, keys, value, size), gaps(used, sizes, keys, slice_rows), keys, size)
    told = open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"), F.bool_and("zero").alias("covered"))
    return sizes.select(*keys).join(told, keys, "left").select(*keys, F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("covered", F.lit(True)).alias("covered"))
