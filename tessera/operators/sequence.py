"""Ordered patterns over parts of a group: firsts, markers, runs, layouts, fixed pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sliced import Sliced


def first_of_kind(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The first row of each group as an aggregate, which reduces before the shuffle."""
    first = F.min(F.struct(*order, *keep)).alias("first")
    return rows.groupBy(*keys).agg(first).select(*keys, *(F.col(f"first.{c}").alias(c) for c in dict.fromkeys([*order, *keep])))


def before_marker(rows: DataFrame, keys: list[str], order: list[str], marker: Column) -> DataFrame:
    """Rows that precede the first marker of their group; groups without a marker keep none.

    The first marker of each group is an aggregate, and rows are compared with it where they are: no window.
    """
    names = [f"marker_key{n}" for n in range(len(keys))]
    first = rows.filter(marker).groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.min(F.struct(*order)).alias("marker_at"))
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & rows[k].eqNullSafe(first[n])
    return rows.join(first, same).filter(F.struct(*order) < F.col("marker_at")).drop(*names, "marker_at")


def last_before(rows: DataFrame, keys: list[str], order: list[str], control: Column, value: str, target: Column, name: str, slice_rows: int | None = None) -> DataFrame:
    """Rows where ``target`` holds, with the ``value`` of the last ``control`` row strictly before them, as ``name``; null values of controls are skipped."""
    only = rows.withColumns({"is_control": F.coalesce(control, F.lit(False)), "is_target": F.coalesce(target, F.lit(False))}).filter("is_control OR is_target")
    passed = Sliced.of(only, keys, order, slice_rows).before(**{name: ("last", F.when(F.col("is_control"), F.col(value)))})
    return passed.done().filter("is_target").drop("is_control", "is_target")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, slice_rows: int | None = None) -> DataFrame:
    """Runs of an equal value in order: the keys, the value, the first row's order columns and ``run_length``."""
    cut = Sliced.of(rows.select(*keys, *order, value), keys, order, slice_rows).before(run_previous=("last", F.struct(F.col(value).alias("value"))))
    new = ~F.coalesce(F.col("run_previous").isNotNull() & F.col("run_previous.value").eqNullSafe(F.col(value)), F.lit(False))
    # Before a run's first row all earlier runs have begun, before its others it has, too.
    numbered = cut.before(run=("count", new)).done().withColumn("run", F.col("run") + new.cast("int"))
    first = F.min(F.struct(*order)).alias("first")
    return numbered.groupBy(*keys, "run", value).agg(first, F.count(F.lit(1)).alias("run_length")).select(*keys, value, *(F.col(f"first.{c}").alias(c) for c in order), "run_length")


def prefix_layout(rows: DataFrame, order: str, length: Column, align: int = 1, block: int | None = None) -> DataFrame:
    """``rows`` with ``offset``: the sum of all lengths before a row by ``order``, each rounded up to ``align``.

    The whole table is one ordered key, cut into slices of about ``block`` rows: sums run within slices in parallel, and
    only one total per slice is summed in order, whatever the numbers of ``order`` are.
    """
    size = (F.floor((length + (align - 1)) / align) * align).cast("long")
    one = rows.withColumn("layout_all", F.lit(0))
    return Sliced.of(one, ["layout_all"], [order], block).before(offset=("sum", size)).done().drop("layout_all")


def renumbered(rows: DataFrame, order: str, name: str, block: int | None = None) -> DataFrame:
    """``rows`` with dense numbers from 0 by ``order``."""
    return prefix_layout(rows, order, F.lit(1), 1, block).withColumnRenamed("offset", name)


def reframed(rows: DataFrame, value: Column, size: int) -> DataFrame:
    """A row per piece of at most ``size`` characters or bytes: ``n`` from 0 and ``piece``; empty values have none.

    Texts are cut in one pass from their start, bytes by their offsets: the work is linear in the length of a value, and
    a piece's row doesn't carry the whole value unless the caller's columns do.
    """
    if dict(rows.select(value.alias("value")).dtypes)["value"] == "binary":
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(value) / size).cast("int") - 1))
        pieces = F.transform(places, lambda n: F.substring(value, n * size + 1, F.lit(size)))
    else:
        pieces = F.regexp_extract_all(value, F.lit("(?s).{1,%d}" % size), F.lit(0))
    return rows.filter(F.length(value) > 0).select("*", F.posexplode(pieces).alias("n", "piece"))


def concat_in_order(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The values of a group joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[value]), "").alias(name))


def expanded_runs(runs: DataFrame, keys: list[str], order: str, count: str, values: list[str], name: str = "n", slice_rows: int | None = None) -> DataFrame:
    """A row per element of run-length tables: ``name`` from 0 within the group and the run's values."""
    placed = Sliced.of(runs.filter(F.col(count) > 0), keys, [order], slice_rows).before(run_start=("sum", F.col(count))).done()
    return placed.select(*keys, *values, F.explode(F.sequence(F.col("run_start"), F.col("run_start") + F.col(count) - 1)).alias(name))


def in_force(rows: DataFrame, rules: DataFrame, keys: list[str], at: str, start: str, values: list[str], slice_rows: int | None = None) -> DataFrame:
    """``rows`` with the values of the last rule of their group that starts at or before ``at``; null before the first."""
    rule = rules.select(F.struct(*values).alias("rule")).schema["rule"].dataType
    own = rows.withColumns({"force_at": F.col(at).cast("long"), "force_turn": F.lit(1), "force_rule": F.lit(None).cast(rule)})
    other = rules.select(*keys, F.col(start).cast("long").alias("force_at"), F.lit(0).alias("force_turn"), F.struct(*values).alias("force_rule"))
    both = own.unionByName(other, allowMissingColumns=True)
    found = Sliced.of(both, keys, ["force_at", "force_turn"], slice_rows).before(force_last=("last", F.col("force_rule"))).done()
    return found.filter("force_turn = 1").select(*rows.columns, *(F.col(f"force_last.{v}").alias(v) for v in values))


def chunk_spans(chunks: DataFrame, runs: DataFrame, samples: DataFrame, keys: list[str], slice_rows: int | None = None) -> DataFrame:
    """``chunks`` (``keys, chunk, at``) with ``first_sample, n_samples, start, end, complete``: the bytes that each chunk holds.

    ``runs`` (``keys, first, per_chunk``) say how many samples a chunk has from ``first`` on: the run in force counts.
    Samples (``keys, n, size``, n from 0) fill the chunks one after the other, so a chunk's first sample is the sum of the
    counts before it, and its length the difference of two prefix sums of sizes. These are read off where the chunk's
    marks stand among the samples of its group, in the same pass that sums them. A chunk from ``at`` that asks for more
    samples than there are isn't ``complete`` and ends with the last; one before the first run has none.
    """
    ruled = in_force(chunks, runs, keys, "chunk", "first", ["per_chunk"], slice_rows).withColumn("n_samples", F.coalesce(F.col("per_chunk").cast("long"), F.lit(0)))
    placed = Sliced.of(ruled.drop("per_chunk"), keys, ["chunk"], slice_rows).before(first_sample=("sum", F.col("n_samples"))).done()
    mark = lambda place: F.struct(place.alias("n"), F.col("chunk"), F.col("at"), F.col("first_sample"), F.col("n_samples"))
    both = F.explode(F.array(mark(F.col("first_sample")), mark(F.col("first_sample") + F.col("n_samples"))))
    marks = placed.select(*keys, both.alias("mark")).select(*keys, F.col("mark.n").alias("n"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("size"), "mark")
    own = samples.select(*keys, F.col("n").cast("long").alias("n"), F.lit(1).alias("turn"), F.col("size").cast("long").alias("size"))
    swept = Sliced.of(own.unionByName(marks, allowMissingColumns=True), keys, ["n", "turn"], slice_rows).before(bytes=("sum", F.col("size")), seen=("count", F.col("turn") == 1)).done()
    found = swept.filter("turn = 0").groupBy(*keys, *(F.col(f"mark.{c}").alias(c) for c in ("chunk", "at", "first_sample", "n_samples"))).agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"), F.max("seen").alias("seen"))
    end = F.col("at") + F.col("high") - F.col("low")
    return found.select(*keys, "chunk", "at", "first_sample", "n_samples", F.col("at").alias("start"), end.alias("end"), (F.col("seen") >= F.col("first_sample") + F.col("n_samples")).alias("complete"))


def two_orders(rows: DataFrame, keys: list[str], place: str, number: str, values: list[str], slice_rows: int | None = None) -> DataFrame:
    """``keys, place``, ``values``: the pieces of each group in order of ``number``, standing in the places of the group's order.

    The first piece stands in the first place whatever piece was there, and so on. Groups whose numbers aren't 1 to n,
    each once, are refused: they have no rows. Each row goes once to its place and once to its number, and both meet in
    one aggregate: pieces of a group are neither collected nor paired.
    """
    ranked = Sliced.of(rows.select(*keys, place, F.col(number).cast("long").alias("piece_number"), F.struct(*values).alias("piece")), keys, [place], slice_rows).before(slot=("count", F.lit(True))).done()
    both = F.array(F.struct(F.col("slot").alias("at"), F.col(place).alias("place"), F.lit(None).cast(ranked.schema["piece"].dataType).alias("piece")), F.struct((F.col("piece_number") - 1).alias("at"), F.lit(None).cast(ranked.schema[place].dataType).alias("place"), F.col("piece")))
    spread = ranked.select(*keys, F.explode(both).alias("half")).select(*keys, "half.*")
    met = spread.groupBy(*keys, "at").agg(F.max("place").alias(place), F.first("piece", ignorenulls=True).alias("piece"), F.count("piece").alias("pieces"), F.count("place").alias("places"))
    names = [f"refused_key{n}" for n in range(len(keys))]
    bad = met.filter("pieces <> 1 OR places <> 1").select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).distinct()
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & met[k].eqNullSafe(bad[n])
    return met.join(bad, same, "left_anti").select(*keys, place, *(F.col(f"piece.{v}").alias(v) for v in values))
