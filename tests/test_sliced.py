"""Keys that hold most rows: cut into slices they give the rows that windows by key give, and no slice is large."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import compare, intervals, sequence, sliced


def events(n=3000, hot=0.9, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if draw.random() < hot else draw.choice(["a", "b", None])
        at = draw.choice([None, draw.randint(0, 500)])
        rows.append((key, at, i, draw.choice(["x", "x", "y", None]), draw.choice([None, draw.randint(-5, 50)])))
    return rows


SCHEMA = "k string, at long, id long, v string, n long"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(events(), SCHEMA).repartition(5).cache()


def told(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("slice_rows", [50, 400, 10_000])
def test_passes_equal_windows(table, slice_rows):
    cut = sliced.Sliced.of(table, ["k"], ["at", "id"], slice_rows)
    value = F.when(F.col("v") == "x", F.col("n"))
    got = cut.before(c=("count", F.col("v") == "x"), s=("sum", F.col("n")), m=("max", F.col("n")), last=("last", value), lag=("last", F.struct(F.col("n").alias("n"))))
    again = got.before(total=("sum", F.col("c")))
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = table.withColumns({
        "c": F.coalesce(F.sum(F.when(F.col("v") == "x", 1).otherwise(0).cast("long")).over(w), F.lit(0)), "s": F.coalesce(F.sum("n").over(w), F.lit(0)),
        "m": F.max("n").over(w), "last": F.last(value, ignorenulls=True).over(w), "lag": F.last(F.struct(F.col("n").alias("n"))).over(w)})
    want = want.withColumn("total", F.coalesce(F.sum("c").over(w), F.lit(0)))
    assert told(again.done()) == told(want)
    sizes = [r[0] for r in cut.rows.filter("slice >= 0").groupBy("k", "slice").count().select("count").collect()]
    assert cut.cut == (slice_rows < 3000) == bool(sizes) and (not sizes or max(sizes) <= 2 * slice_rows and len(sizes) > 4)


def test_one_exchange_of_rows_for_several_passes(table):
    cut = sliced.Sliced.of(table.select("k", "at", "id", "n"), ["k"], ["at", "id"], 100).before(m=("max", F.col("n"))).before(c=("count", F.col("m") > 3)).done()
    plan = cut._jdf.queryExecution().executedPlan().toString()
    row_exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line and "slice" in line]
    assert row_exchanges and "hashpartitioning(k#" in row_exchanges[0]
    main = plan[: plan.index("BroadcastExchange")]
    assert main.count("Exchange hashpartitioning") <= 1


def test_operators_agree_however_keys_are_cut(spark, table):
    spans = table.select("k", "id", F.col("at").alias("start"), (F.col("at") + F.col("n") % 4).alias("end"))
    some, others = spans.filter("id % 3 = 0"), spans.filter("id % 3 <> 0 AND id % 5 <> 0")
    runs = table.select("k", "id", F.greatest(F.col("n") % 4, F.lit(0)).alias("c"), "v")
    order = ["at", "id"]
    for make in (
        lambda s: intervals.merged(spans, ["k"], slice_rows=s), lambda s: intervals.uncovered(spans, ["k"], slice_rows=s),
        lambda s: intervals.overlapping(some, others, ["k"], slice_rows=s), lambda s: intervals.not_inside(some, others, ["k"], slice_rows=s),
        lambda s: intervals.overlapping_previous(spans, ["k"], ["start", "id"], slice_rows=s), lambda s: sequence.runs(table, ["k"], order, "v", s),
        lambda s: sequence.last_before(table, ["k"], order, F.col("v") == "x", "n", F.col("v") == "y", "found", s), lambda s: sequence.expanded_runs(runs, ["k"], "id", "c", ["v"], slice_rows=s),
        lambda s: sequence.in_force(some.withColumn("start", F.coalesce("start", F.lit(0))), others.filter("start IS NOT NULL").groupBy("k", "start").agg(F.max("end").alias("limit")), ["k"], "start", "start", ["limit"], s),
        lambda s: compare.zipped(table.filter("v = 'x'"), table.filter("v = 'y'"), ["k"], ["id"], ["n"], s), lambda s: sequence.prefix_layout(table.drop("k"), "id", F.coalesce("n", F.lit(0)), block=s),
    ):
        whole = told(make(None))
        assert whole and told(make(60)) == whole
    assert intervals.merged(spans.limit(0), ["k"]).count() == 0


def test_layout_of_sparse_numbers_is_cut_by_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 100_000).alias("id"), (F.col("id") % 3).alias("size"))
    cut = sliced.Sliced.of(rows.withColumn("one", F.lit(0)), ["one"], ["id"], 50)
    sizes = [r[0] for r in cut.rows.groupBy("slice").count().select("count").collect()]
    assert 8 < len(sizes) < 60 and max(sizes) <= 120
    laid = sequence.prefix_layout(rows, "id", F.col("size"), block=50).orderBy("id").collect()
    assert [r.offset for r in laid] == [sum(k % 3 for k in range(n)) for n in range(1000)]


def is_subsequence(now, then):
    rest = iter(then)
    return all(any(a == b for b in rest) for a in now)


def test_subsequences_with_repeated_values(spark):
    draw, now, then, want = random.Random(6), [], [], []
    for g in range(120):
        whole = [draw.choice(["a", "a", "b", None]) for _ in range(draw.randint(0, 12))]
        part = [v for v in whole if draw.random() < 0.6] if g % 3 else [draw.choice(["a", "b", None]) for _ in range(draw.randint(0, 8))]
        key = None if g == 7 else g
        then += [(key, 5 * n, v, "t") for n, v in enumerate(whole)]
        now += [(key, 3 * n, v, "n") for n, v in enumerate(part)]
        if part and not is_subsequence(part, whole):
            want.append((key,))
    schema = "g int, at int, v string, match_value string"
    one, two = spark.createDataFrame(now, schema).repartition(3), spark.createDataFrame(then, schema)
    for slice_rows in (None, 3):
        got = compare.not_subsequences(one, two, ["g"], "at", "v", slice_rows)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 15
    assert compare.not_subsequences(one.limit(0), two, ["g"], "at", "v").count() == 0


def test_reframed_texts_and_bytes(spark):
    value = "é𝄞a\nb" * 7
    for column, size in (("t", 3), ("t", 255), ("b", 4)):
        frame = spark.createDataFrame([(1, value, value.encode()), (2, "", b""), (3, None, None)], "id int, t string, b binary")
        got = sorted((r.n, r.piece if column == "t" else bytes(r.piece)) for r in sequence.reframed(frame, F.col(column), size).collect())
        whole = value if column == "t" else value.encode()
        assert got == [(n, whole[n * size : n * size + size]) for n in range(-(-len(whole) // size))]


def test_tasks_grow_with_the_rows(table, spark, monkeypatch):
    """A pass over more rows than the session's shuffles have room for is dealt over more tasks, once, with the same rows."""
    few = sliced.Sliced.of(table, ["k"], ["at", "id"]).before(c=("count", F.lit(True))).done()
    want = told(few)
    monkeypatch.setattr(sliced, "TASK_ROWS", 100)
    for slice_rows in (None, 400):
        many = sliced.Sliced.of(table, ["k"], ["at", "id"], slice_rows).before(c=("count", F.lit(True))).done()
        assert many.rdd.getNumPartitions() == 30 > int(spark.conf.get("spark.sql.shuffle.partitions")) and told(many) == want
