"""Every plan over the provided tables equals its SQL in DuckDB; operators on small edge cases."""

import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import names, scalars
from tessera.operators import compare, constraints, graph, intervals, sequence
from tessera.plans import media
from tessera.sources import fixtures, parts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def in_order(rows, columns):
    at = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(repr([int(r[n]) if isinstance(r[n], decimal.Decimal) else r[n] for n in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert in_order(df.collect(), df.columns) == in_order(want.fetchall(), want.columns)


def test_queries_without_sql(spark):
    """Mutated files end as one outcome each, whatever it is; parts are counted as their parsers list them."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"media_parts", "damaged_outcomes"}
    n = spark.read.parquet(f"{SF}/supplier.parquet").count()
    outcomes = catalog.QUERIES["damaged_outcomes"](spark, SF).collect()
    assert sum(r.n for r in outcomes) == n and {r.status for r in outcomes} <= {"cleaned", "refused"} and all((r.status == "cleaned") == (r.error_key == "") for r in outcomes)
    counted = catalog.QUERIES["media_parts"](spark, SF).collect()
    files = media._files(spark, SF)
    assert sum(r.n for r in counted) == parts.parts(files).count() and len({(r.kind, r.part, r.keep, r.refusal) for r in counted}) == len(counted)
    pngs = [bytes(r.content) for r in files.filter("kind = 'PNG'").collect()]
    ends = sum(r.n for r in counted if r.part == "IEND")
    assert ends <= len(pngs) and all(c.startswith(b"\x89PNG") for c in pngs)


def test_marked_files_are_the_cases_with_another_secret(spark):
    for name, content, *_ in media.cases_of(media.ALL):
        own = media.marked(content, b"0123456789a")
        assert len(own) == len(content) and fixtures.SECRET not in own, name


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_intervals(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12), (1, 11, 20), (1, 3, 3), (1, 9, 2), (2, 1, 2), (1, None, 4)], "k int, start long, end long")
    assert rows(intervals.merged(s, ["k"]), "k", "start", "end") == [(1, 0, 8), (1, 10, 20), (2, 1, 2)]
    assert rows(intervals.uncovered(s, ["k"]), "k", "start", "end") == [(1, 8, 10)]
    q = spark.createDataFrame([(1, 8, 10), (1, 7, 9), (1, 19, 30), (1, 20, 21), (3, 0, 9), (1, 11, 13), (1, 8, 8)], "k int, start long, end long")
    assert rows(intervals.overlapping(q, s, ["k"]), "k", "start") == [(1, 7), (1, 11), (1, 19)]
    assert rows(intervals.not_inside(q, s, ["k"]), "k", "start") == [(1, 7), (1, 8), (1, 19), (1, 20), (3, 0)]
    assert intervals.merged(s.limit(0), ["k"]).count() == 0


def test_sequence(spark):
    s = spark.createDataFrame([(1, n, v) for n, v in enumerate("aabbbac")] + [(2, 0, None), (2, 1, None)], "k int, n long, v string")
    assert rows(sequence.runs(s, ["k"], ["n"], "v"), "k", "n", "run_length") == [(1, 0, 2), (1, 2, 3), (1, 5, 1), (1, 6, 1), (2, 0, 2)]
    assert rows(sequence.before_marker(s, ["k"], ["n"], F.col("v") == "b"), "k", "n") == [(1, 0), (1, 1)]
    laid = sequence.prefix_layout(spark.createDataFrame([(n, n % 4) for n in range(100)], "id long, size long"), "id", F.col("size"), align=2, block=7)
    at = 0
    for n, offset in rows(laid, "id", "offset"):
        assert offset == at
        at += (n % 4 + 1) // 2 * 2
    cut = sequence.reframed(spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "id int, t string"), F.col("t"), 3)
    assert rows(cut, "id", "n", "piece") == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g")]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "origin int, target int")
    assert rows(graph.closure(edges, spark.createDataFrame([(1,)], "node int")), "node") == [(1,), (2,), (3,), (4,)]
    assert rows(graph.only_of(edges, spark.createDataFrame([(8,), (1,)], "g int"), "origin", "target"), "origin") == [(9,)]


def test_constraints_and_compare(spark):
    s = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (3, 0)], "k int, n int")
    assert rows(constraints.coverage(s, ["k"], "n"), "k", "complete") == [(1, True), (2, False), (3, False)]
    assert rows(constraints.repeated(s.withColumnRenamed("n", "at"), ["k", "at"]), "k", "n") == [(3, 2)]
    s = s.withColumnRenamed("n", "at")
    diff = compare.multiset_diff(s, s.filter("k <> 3").unionByName(s.filter("k = 1")))
    assert rows(diff, "k", "at", "n", "change") == [(1, 0, 1, "removed"), (1, 1, 1, "removed"), (3, 0, 2, "added")]


# Names with dates and what is left of them.
NAMES = [
    ("IMG_20240501_123456", "IMG"), ("Screenshot 2026-09-23 at 15.14.15", "Screenshot"), ("mmexport1714567890123", "mmexport"), ("a 2024-05-01 b", "a b"), ("x_20240501-y", "x-y"), ("20240501", ""), ("v1.2.3", "v1.2.3"), ("IMG_1234", "IMG_1234"),
    ("截屏2026-09-23 下午3.14.15", "截屏"), ("Captura de Tela 2024-05-01 às 12.34.56", "Captura de Tela"), ("Screen Shot 2021-05-04 at 10.23.45 AM", "Screen Shot"), ("Screenshot 2024-05-01 (2)", "Screenshot (2)"),
    ("Shot_2024-05-01-12-34-56-789_by.me", "Shot_by.me"), ("PXL_20240501_123456789.MP", "PXL.MP"), ("IMG-20240501-WA0001", "IMG-WA0001"), ("2024年5月1日 家", "家"), ("家 01.05.2024", "家"),
    ("Foto 2024-05-01 kello 12.34.56", "Foto kello"), ("IMG_20241350", "IMG_20241350"), ("13812345678", "13812345678"), ("a 25.61.61 b", "a 25.61.61 b"), ("x 2024-05-01 a las 1.02.03 p.m.", "x"), ("x 12:34:56pm y", "x y")]


def test_names(spark):
    for stem, want in NAMES:
        assert names.strip_dates(stem) == want
    got = spark.createDataFrame([(s,) for s, _ in NAMES] + [(None,)], "s string").select(names.without_dates("s")).collect()
    assert [r[0] for r in got] == [w for _, w in NAMES] + [None]
    long = next(names.candidates("é" * 200, ".jpg", "original"))
    assert len(long.encode()) <= 255 and long.endswith("é_clean.jpg")
    many = names.candidates("IMG_20240501", ".PNG")
    assert [next(many) for _ in range(3)] == ["IMG_clean.PNG", "IMG_clean_1.PNG", "IMG_clean_2.PNG"]
    assert next(names.candidates("x", ".PNG", "anonymous")).startswith("photo_")


def test_scalars(spark):
    one = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04"), "a\tb\x7f", 10, 7)], "b binary, t string, w int, h int")
    big, little, short, shown, plain, passes = one.select(
        scalars.unsigned(F.col("b"), 1, 4), scalars.unsigned(F.col("b"), 1, 2, True), scalars.unsigned(F.col("b"), 3, 4), scalars.visible(F.col("t")),
        scalars.scanline_bytes(F.col("w"), F.col("h"), F.lit(8), F.lit(False)), scalars.scanline_bytes(F.col("w"), F.col("h"), F.lit(8), F.lit(True)),
    ).first()
    assert (big, little, short, shown, plain) == (0x01020304, 0x0201, None, "a\\x09b\\x7f", 77)
    # 2x1 and 1x1 and 3x1 and 2x2 and 5x2 and 5x4 and 10x3 pixels, a byte before each line
    assert passes == 70 + 1 + 1 + 1 + 2 + 2 + 4 + 3


def test_pairs_of_shapes_are_spelled_out_only_where_they_fit(spark):
    from tessera.operators import compare

    shapes = [(None if n == 7 else 1 + n * 7 % 12, 1 + n * 5 % 9) for n in range(60)]
    rows = [(n, None if n == 3 else n % 2, *shapes[n]) for n in range(60)]
    table = spark.createDataFrame(rows, "id long, g long, w long, h long")
    got = sorted(map(tuple, compare.paired_shapes(table, ["g"], ["w", "h"], "id", scalars.same_proportions, "part", "big").collect()))
    fits = lambda a, b: None not in (a[2], b[2]) and a[2] <= b[2] and a[3] <= b[3] and abs(a[2] * b[3] - a[3] * b[2]) <= max(b[2], b[3])
    assert got == [(a[0], b[0]) for a in rows for b in rows if a[1] is not None and a[1] == b[1] and fits(a, b)] and len(got) > 60


def test_few_large_groups_of_shapes_are_many_tasks(spark):
    from tessera.plans import tabular

    assert tabular.same_shape(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 64


def test_lines_of_one_number_stand_as_they_are_stored(spark, tmp_path):
    """The second file is larger, so that Spark reads it first."""
    from tessera.plans import tabular

    spark.range(0, 70, 7).select((F.col("id") + 1).alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    made = duckdb.connect()
    for name, flag, more in (("a", "N", 0), ("b", "R", 5000)):
        rows = f"SELECT range * 7 + 1 AS l_orderkey, 1::INTEGER AS l_linenumber, '{flag}' AS l_returnflag FROM range(10) UNION ALL SELECT 1000 + range, 1, 'A' FROM range({more})"
        made.execute(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    for table in ("orders", "lineitem"):
        made.execute(f"CREATE TABLE {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = made.execute(tabular.ORACLE_SQL["pairwise_unequal"]).fetchall()
    assert sorted(map(tuple, tabular.pairwise_unequal(spark, str(tmp_path)).collect())) == sorted(want) == []
