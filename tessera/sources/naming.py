"""Names for a whole batch of copies at once: each file gets the first name that no file of its folder and none before it has.

Names are ``<base>_clean<suffix>``, then ``<base>_clean_1<suffix>`` and so on, the base cut to what file systems allow. A
name with one more digit cuts the base more, so numbers are dealt digit count by digit count: in each round the files
that still lack a name are grouped by folder, cut base and suffix; the r-th of a group, by ``file_id``, gets the r-th
number that isn't taken, by the count of taken numbers below it. Groups may be of any size.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import fitted
from tessera.operators.lineage import shared_folder
from tessera.operators.sliced import Sliced

_GROUP = ["folder", "stem", "suffix"]
#: Digits of the largest numbers.
DIGITS = 12


def listed(folders: DataFrame) -> DataFrame:
    """``folder, name`` of everything in each ``folder``, read on the executors; a folder that isn't there has nothing."""

    def look(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    names = [e.name for e in os.scandir(folder)]
                except (OSError, TypeError):
                    names = []
                for at in range(0, len(names), 10_000):
                    part = names[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([folder] * len(part), pa.string()), pa.array(part, pa.string())], ["folder", "name"])

    return folders.select("folder").distinct().mapInArrow(look, "folder string, name string")


def _stem(digits: int) -> Column:
    """What a name has before its number: the base cut for a number of so many digits."""
    tail = F.lit("_clean_" if digits else "_clean")
    room = F.concat(tail, F.lit("9" * digits), F.col("suffix"))
    whole = fitted(F.col("base"), room)
    return F.concat(F.substring(whole, F.lit(1), F.length(whole) - F.length(room)), tail)


def _dealt(files: DataFrame, taken: DataFrame, digits: int, slice_rows: int | None) -> DataFrame:
    """``file_id, number`` of the files whose group has a free number of so many digits for them."""
    low, high = (10 ** (digits - 1), 10**digits - 1) if digits else (0, 0)
    ranked = Sliced.of(files.select("file_id", "folder", _stem(digits).alias("stem"), "suffix"), _GROUP, ["file_id"], slice_rows).before(rank=("count", F.lit(True))).done()
    own = taken.filter(F.length("number") == digits).select(*_GROUP, (F.coalesce(F.col("number").cast("long"), F.lit(0)) if digits else F.lit(0)).cast("long").alias("number"))
    own = own.join(ranked.select(*_GROUP).distinct(), _GROUP, "left_semi").distinct()
    below = Sliced.of(own, _GROUP, ["number"], slice_rows).before(index=("count", F.lit(True))).done()
    # A taken number has number - low - index free ones before it: all files of at least that rank are behind it.
    marks = below.select(*_GROUP, (F.col("number") - low - F.col("index")).alias("at"), F.lit(0).alias("turn"))
    both = ranked.select(*_GROUP, F.col("rank").alias("at"), F.lit(1).alias("turn"), "file_id").unionByName(marks, allowMissingColumns=True)
    passed = Sliced.of(both, _GROUP, ["at", "turn"], slice_rows).before(skipped=("count", F.col("turn") == 0)).done().filter("turn = 1")
    return passed.select("file_id", *_GROUP, (low + F.col("at") + F.col("skipped")).alias("number")).filter(F.col("number") <= high)


def batch_names(files: DataFrame, taken: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """``file_id, folder, name`` of each of ``files`` (``file_id, folder, base, suffix``); ``taken`` has ``folder, name``.

    As if each file in order of ``file_id`` took its first free name. Ids are distinct; an empty base is a base like any
    other, nulls count as empty.
    """
    shared_folder(files.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    left = files.select("file_id", text("folder"), text("base"), text("suffix")).checkpoint()
    parts = r"(?s)^(.*_clean)(?:(_)(0|[1-9][0-9]*))?(\.[^.]*)?$"
    part = lambda n: F.regexp_extract("name", parts, n)
    known = taken.filter(F.col("name").rlike(parts)).select(text("folder"), F.concat(part(1), part(2)).alias("stem"), part(3).alias("number"), part(4).alias("suffix")).filter("number <> '0'").checkpoint()
    made = []
    for digits in range(DIGITS):
        if left.isEmpty():
            break
        found = _dealt(left, known, digits, slice_rows).checkpoint()
        number = F.col("number").cast("string") if digits else F.lit("")
        made.append(found.select("file_id", "folder", F.concat("stem", number, "suffix").alias("name")))
        left = left.join(found, "file_id", "left_anti").checkpoint()
    out = made[0] if made else left.select("file_id", "folder", F.col("base").alias("name"))
    for more in made[1:]:
        out = out.unionByName(more)
    return out
