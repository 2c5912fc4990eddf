"""Media queries on many files: every file ends as a row, and contents are neither broadcast nor one task's work."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import media, sanitise
from tessera.sources import fixtures, movie, parts

EMPTY = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0" + bytes(10)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Twelve hundred suppliers in one file."""
    path = str(tmp_path_factory.mktemp("many"))
    rows = spark.range(1200).select(F.col("id").alias("s_suppkey"), F.format_string("Supplier#%09d", "id").alias("s_name"))
    rows.coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return path


def broadcast(table) -> list[str]:
    """The subtrees of a plan that are broadcast."""
    lines, found = table._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((m for m in range(n + 1, len(lines)) if depth(lines[m]) <= depth(line)), len(lines))
            found.append("\n".join(lines[n:end]))
    return found


def test_file_without_parts_is_refused(spark):
    files = spark.createDataFrame([(1, bytearray(EMPTY)), (2, bytearray(fixtures.png()))], "file_id long, content binary")
    rows = sanitise.clean(files.withColumn("kind", parts.kind_of(F.col("content")))).collect()
    assert sorted((r.file_id, r.kind, r.status, r.error_key) for r in rows) == [(1, "WEBP", "refused", "damaged"), (2, "PNG", "cleaned", None)]


def test_contents_are_not_broadcast_and_are_made_by_several_tasks(spark, many):
    assert media._files(spark, many, (parts.HEIC,)).rdd.getNumPartitions() >= 3
    table = media.QUERIES["heif_clean"](spark, many)
    assert not [subtree for subtree in broadcast(table) if "result#" in subtree]
    assert table.count() == table.filter("NOT leaked").count() == 1200


def test_no_window_walks_to_the_end_of_a_file_for_each_part(spark):
    plan = sanitise.decided(parts.parts(fixtures.files(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing$()", "")


def _workers_in_a_row(table) -> int:
    """The most Python workers that one task of a plan keeps."""
    most, run = 0, 0
    for line in table._jdf.queryExecution().executedPlan().toString().splitlines():
        run = run + 1 if "MapInArrow" in line else 0 if "Exchange" in line or "Scan" in line else run
        most = max(most, run)
    return most


def test_videos_are_made_and_read_once(spark, many):
    plan = media.QUERIES["mp4_clean"](spark, many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_video_and_its_copy_are_planned_once_each(monkeypatch):
    planned, plain = [], movie.Plan.__init__
    monkeypatch.setattr(movie.Plan, "__init__", lambda self, data: (planned.append(data), plain(self, data))[1])
    content = next(c[1] for c in media.cases_of((parts.MP4,)) if c[2] == "cleaned")
    result, proven = sanitise.IN_PLACE[parts.MP4](content)
    assert proven and planned == [content, result] and result == movie.clean(content) and movie.difference(content, result) is None


def test_a_copy_that_differs_is_not_proven(monkeypatch):
    content, plain = next(c[1] for c in media.cases_of((parts.MP4,)) if c[2] == "cleaned"), movie._edited
    monkeypatch.setattr(movie, "_edited", lambda plan: plain(plan)[:-1] + b"\x55")
    assert sanitise.IN_PLACE[parts.MP4](content)[1] is False


def test_a_task_of_outcomes_keeps_one_python_worker(spark, many):
    assert _workers_in_a_row(media.media_outcomes(spark, many)) == 1
    assert _workers_in_a_row(media.damaged_outcomes(spark, many)) == 1
    assert _workers_in_a_row(media.media_parts(spark, many)) == 1


@pytest.mark.parametrize("damage", [False, True])
def test_outcomes_are_those_of_all_files_read_together(spark, many, damage):
    shown = lambda table: sorted((r.file_id, r.status, r.error_key or "", r.sha or "") for r in table.select("file_id", "status", "error_key", F.sha2("result", 256).alias("sha")).collect())
    files = media._files(spark, many, damage=damage)
    told = files.withColumn("kind", parts.kind_of(F.col("content")))
    assert shown(media._outcomes(spark, many, media.ALL, damage)) == shown(sanitise.clean(told))
