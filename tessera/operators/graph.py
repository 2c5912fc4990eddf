"""Reachability and integrity of references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import stored


#: Levels that are kept apart before they are written as one table.
LEVELS_APART = 16


def closure(edges: DataFrame, seeds: DataFrame, levels: int = 10_000, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, node``: the seeds and everything reachable along ``edges`` (``keys, origin, target``); cycles end by themselves.

    Paths stay within a group of ``keys``; all groups take each step together, and one that has nothing new costs
    nothing any more. Each level joins only the nodes that are new and is written once; what was seen is the union of the
    levels, which are written as one table only every LEVELS_APART levels. Every level reads ``edges`` anew: they should be
    a stored table.
    """
    node = [*keys, "node"]
    fresh = stored(seeds.select(*node).distinct())
    parts = [fresh]
    for _ in range(levels):
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        steps = edges.select(*keys, F.col("origin").alias("node"), "target").join(fresh, node, "left_semi")
        targets = steps.select(*keys, F.col("target").alias("node")).distinct()
        fresh = stored(targets.join(reduce(DataFrame.unionByName, parts), node, "left_anti"))
        parts.append(fresh)
        if len(parts) > LEVELS_APART:
            parts = [stored(reduce(DataFrame.unionByName, parts))]
    raise ValueError(f"references go deeper than {levels} levels")


def stratified_removal(items: DataFrame, built_from: DataFrame, seeds: DataFrame, describes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys, node, fate`` of every item: removed, kept, or refused with its whole group.

    ``items`` (``keys, node, is_primary, may_describe``), ``built_from`` and ``describes`` (``keys, origin, target``) and
    ``seeds`` (``keys, node``) hold many groups. The strata, each a fixpoint before the next reads it negated:

    1. Candidates are the seeds and all that they are built from.
    2. Needed is what the other items are built from, themselves included. A group whose primary item is a candidate, or
       one of whose seeds is needed, is refused.
    3. Candidates that aren't needed go.
    4. An item that describes others goes if all that it describes goes; its group is refused if it mayn't describe.

    References to items that a group doesn't have are no references. A node that is listed twice counts once. Null keys equal
    nothing: an item of such a group is alone, and kept. Items and references are stored narrow before the first level, so
    that no level makes them again.
    """
    node = [*keys, "node"]
    known = stored(items.groupBy(*node).agg(F.bool_or("is_primary").alias("is_primary"), F.bool_or("may_describe").alias("may_describe")))
    ends = known.select(*keys, F.col("node").alias("target"))
    built, told = (stored(e.join(ends, [*keys, "target"], "left_semi").join(known.withColumnRenamed("node", "origin"), [*keys, "origin"], "left_semi").select(*keys, "origin", "target")) for e in (built_from, describes))
    own = stored(seeds.join(known, node, "left_semi").select(*node).distinct())
    candidates = closure(built, own, keys=keys)
    needed = closure(built, known.join(candidates, node, "left_anti"), keys=keys)
    gone = stored(candidates.join(needed, node, "left_anti").withColumn("is_gone", F.lit(True)))
    targets = told.join(gone.withColumnRenamed("node", "target"), [*keys, "target"], "left")
    loose = targets.groupBy(*keys, F.col("origin").alias("node")).agg(F.bool_and(F.col("is_gone").isNotNull()).alias("is_loose")).filter("is_loose")
    marked = known.join(gone, node, "left").join(loose, node, "left")
    for name, rows in (("is_candidate", candidates), ("is_seed", own), ("is_needed", needed)):
        marked = marked.join(rows.withColumn(name, F.lit(True)), node, "left")
    bad = F.col("is_primary") & F.col("is_candidate").isNotNull() | F.col("is_seed").isNotNull() & F.col("is_needed").isNotNull()
    bad = bad | F.col("is_loose").isNotNull() & F.col("is_gone").isNull() & ~F.col("may_describe")
    marked = stored(marked.withColumns({"is_bad": F.coalesce(bad, F.lit(False)), "goes": F.col("is_gone").isNotNull() | F.col("is_loose").isNotNull()}).select(*node, "is_bad", "goes"))
    refused = marked.filter("is_bad").select(*keys).distinct().withColumn("is_refused", F.lit(True))
    fate = F.when(F.col("is_refused").isNotNull(), "refused").when(F.col("goes"), "removed").otherwise("kept")
    return marked.join(refused, list(keys), "left").select(*node, fate.alias("fate"))


def selected_tracks(tracks: DataFrame, refs: DataFrame, keys: tuple[str, ...], removable: list[str], kept: list[str], dangling: list[str]) -> DataFrame:
    """``keys, node, fate, reason`` of every track: removed or kept, and why its group is refused, null if it isn't.

    ``tracks`` (``keys, node, kind, enabled``), ``refs`` (``keys, origin, kind, target``; rows of one origin and kind are
    one reference). Tracks of ``removable`` kinds go, and so do texts and disabled pictures that others name as chapters
    (``chap``), pictures only if nothing else refers to them. Then thumbnails go whose ``thmb`` targets all stay.
    Reasons, the first of which is told: ``kind`` if a kept track's kind isn't in ``kept``; ``needed`` if a removed track
    has a ``rndr`` reference to a kept one; ``depends`` if a kept track refers to a removed one, but by a kind of
    ``dangling`` all of whose targets go. Each rule is an aggregate over flagged references: no pairs of tracks. A target
    that the group doesn't have neither goes nor stays. Four rules read the references, which are stored before.
    """
    refs = stored(refs.select(*keys, "origin", "kind", "target"))
    node, at = [*keys, "node"], lambda name: [*(F.col(k) for k in keys), F.col(name).alias("node")]
    chapters = refs.filter("kind = 'chap'").select(*at("target")).distinct().withColumn("is_chapter", F.lit(True))
    others = refs.filter("kind <> 'chap'").select(*at("target")).distinct().withColumn("is_other", F.lit(True))
    seen = tracks.join(chapters, node, "left").join(others, node, "left")
    text, still = F.col("kind") == "text", (F.col("kind") == "vide") & ~F.col("enabled") & F.col("is_other").isNull()
    first = seen.withColumn("goes", F.coalesce(F.col("kind").isin(*removable) | F.col("is_chapter").isNotNull() & (text | still), F.lit(False))).select(*node, "kind", "goes")
    first = stored(first)
    thumbs = refs.filter("kind = 'thmb'").join(first.select(*keys, F.col("node").alias("target"), "goes"), [*keys, "target"], "left")
    stay = F.bool_and(F.coalesce(~F.col("goes"), F.lit(False)) & (F.col("target") != F.col("origin"))).alias("is_thumb")
    thumbs = thumbs.groupBy(*at("origin")).agg(stay).filter("is_thumb")
    final = first.join(thumbs, node, "left").select(*node, "kind", (F.col("goes") | F.col("is_thumb").isNotNull()).alias("goes"))
    final = stored(final)
    flagged = refs.join(final.select(*keys, F.col("node").alias("target"), F.col("goes").alias("target_goes")), [*keys, "target"], "left")
    whole = flagged.groupBy(*at("origin"), F.col("kind").alias("ref_kind")).agg(F.bool_or(F.coalesce("target_goes", F.lit(False))).alias("some"), F.bool_and(F.coalesce("target_goes", F.lit(False))).alias("all"))
    judged = final.join(whole, node, "left")
    needed = F.col("goes") & (F.col("ref_kind") == "rndr") & ~F.col("all")
    depends = ~F.col("goes") & F.col("some") & ~(F.col("ref_kind").isin(*dangling) & F.col("all"))
    reason = F.when(~F.col("goes") & ~F.coalesce(F.col("kind").isin(*kept), F.lit(False)), "a kind").when(needed, "b needed").when(depends, "c depends")
    reasons = judged.groupBy(*keys).agg(F.substring(F.min(reason), 3, 9).alias("reason"))
    return final.join(reasons, list(keys)).select(*node, F.when(F.col("goes"), "removed").otherwise("kept").alias("fate"), "reason")


def only_of(edges: DataFrame, removed: DataFrame, origin: str, target: str) -> DataFrame:
    """Origins whose targets are all removed, as an aggregate over the flagged edges."""
    gone = removed.select(F.col(removed.columns[0]).alias("gone_node")).distinct()
    flagged = edges.join(gone, F.col(target) == F.col("gone_node"), "left")
    return flagged.groupBy(origin).agg(F.bool_and(F.col("gone_node").isNotNull()).alias("all_gone")).filter("all_gone").select(origin)


def dangling(rows: DataFrame, key: str, registry: DataFrame, registry_key: str) -> DataFrame:
    """Rows whose key the registry doesn't have."""
    return rows.join(registry, rows[key] == registry[registry_key], "left_anti")
