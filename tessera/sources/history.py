"""Runs over a corpus, kept by label and compared with an earlier one; reports of another tool as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import compare


def save_run(outcomes: DataFrame, folder: str, label: str) -> None:
    """``outcomes`` (``file_id, status, error_key, digest``) as the partition of ``label``; a run of that label is replaced."""
    rows = outcomes.select("file_id", "status", "error_key", "digest").withColumn("run", F.lit(label))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(folder)


def load_run(spark: SparkSession, folder: str, label: str) -> DataFrame:
    return spark.read.parquet(folder).filter(F.col("run") == label).drop("run")


def compare_runs(spark: SparkSession, folder: str, now: str, then: str) -> DataFrame:
    """``file_id, now, before, note``: outcomes of two runs; a digest that differs counts as changed."""
    key = F.concat_ws(" ", "status", F.coalesce("error_key", F.lit("-")), F.coalesce("digest", F.lit("-"))).alias("outcome")
    one, two = (load_run(spark, folder, label).select("file_id", key) for label in (now, then))
    return compare.against_baseline(one, two, "file_id", "outcome")


def by_content(inputs: DataFrame, folder: str, version: str, run: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``inputs`` (with ``digest``) with what ``work`` says of their contents; only contents that no earlier run has seen are worked on.

    ``work`` gets one row of ``inputs`` per new digest and returns ``digest`` and columns of its own. Its rows are appended
    to the manifest in ``folder`` by Spark's own commit, as the part of ``version`` (change it with the rules) and ``run``,
    a column of the result, too. Rows of one digest share their outcome, and so do all runs. A run that fails adds nothing;
    of runs at the same time that see the same content for the first time, the one whose name is smallest counts.
    """
    spark = inputs.sparkSession
    try:
        known = spark.read.parquet(folder).filter(F.col("version") == version).select("digest").distinct()
        fresh = inputs.join(known, "digest", "left_anti")
    except AnalysisException:  # there is no manifest yet
        fresh = inputs
    found = work(fresh.dropDuplicates(["digest"]))
    found.withColumns({"version": F.lit(version), "run": F.lit(run)}).write.mode("append").partitionBy("version", "run").parquet(folder)
    manifest = spark.read.schema(f"{found._jdf.schema().toDDL()}, version string, run string").parquet(folder).filter(F.col("version") == version).drop("version")
    kept = manifest.groupBy("digest").agg(F.min_by(F.struct(*(c for c in manifest.columns if c != "digest")), "run").alias("outcome"))
    return inputs.join(kept, "digest").select(*inputs.columns, "outcome.*")


def tag_reports(reports: DataFrame) -> DataFrame:
    """Reports (``file_id, kind, json``: a list with one object of tags) as rows ``file_id, kind, key, values``.

    Values are texts; a list gives several. A report that can't be read gives no row: ``problems`` finds it.
    """
    first = F.get(F.from_json("json", "array<map<string,string>>"), F.lit(0))
    rows = reports.select("file_id", "kind", F.explode(first).alias("key", "value"))
    listed = F.from_json("value", "array<string>")
    return rows.select("file_id", "kind", "key", F.when(F.col("value").startswith("["), listed).otherwise(F.array("value")).alias("values"))


def problems(reports: DataFrame) -> DataFrame:
    """``file_id, problem`` of reports that can't be read or whose tool names an error or a warning."""
    first = F.get(F.from_json("json", "array<map<string,string>>"), F.lit(0))
    told = F.filter(F.map_entries(first), lambda e: F.element_at(F.split(e["key"], ":"), -1).isin("Error", "Warning"))
    text = F.when(first.isNull(), "unreadable").otherwise(F.get(told, F.lit(0))["value"])
    return reports.select("file_id", text.alias("problem")).filter("problem IS NOT NULL")
