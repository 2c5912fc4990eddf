"""The engine's relational operators applied to whole tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import blobs, compare, constraints, graph, intervals, sequence, sliced
from tessera.operators.lineage import stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a plan under its name, with the SQL that equals it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _placed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table with ``file`` and ``row``, the place that a row has in it: what tells rows apart where SQL's ORDER BY doesn't.

    DuckDB leaves such rows as they are stored, files by name; in Spark they come as shuffles and file sizes have it.
    """
    table = _t(spark, d, name)
    file = F.col("_metadata.file_path") if len(table.inputFiles()) > 1 else F.lit("")
    return table.select("*", file.alias("file"), F.col("_metadata.row_index").alias("row"))


def _micros() -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """A span per event: from its time on, 36 s for each hundredth of its value."""
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", _micros().alias("start"), F.round(F.col("value") * 100).cast("long").alias("size"))
    return e.select("event_id", "user_id", "event_type", "start", (F.col("start") + F.col("size") * 36_000_000).alias("end"))


SPANS = """spans AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 36000000 AS e FROM events)"""


def _islands(source: str, name: str) -> str:
    return f"""{name}_f AS (SELECT user_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM ({source}) q WHERE e > s),
{name}_g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_f),
{name} AS (SELECT user_id, min(s) AS s, max(e) AS e FROM {name}_g GROUP BY user_id, g)"""


@query("WITH p(event_type, action) AS (VALUES ('view', 'keep'), ('click', 'keep'), ('purchase', 'rewrite')) SELECT coalesce(p.action, 'drop') AS action, count(*) AS n, count(DISTINCT e.event_type) AS kinds FROM events e LEFT JOIN p USING (event_type) GROUP BY 1")
def allowlist_parts(spark, d):
    policy = spark.createDataFrame([("view", "keep"), ("click", "keep"), ("purchase", "rewrite")], "event_type string, action string")
    joined = _t(spark, d, "events").select("event_type").join(F.broadcast(policy), "event_type", "left")  # three rows of policy
    return joined.groupBy(F.coalesce("action", F.lit("drop")).alias("action")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT user_id, epoch_us(ts) AS at, event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def refuse_unknown(spark, d):
    e = _t(spark, d, "events").select("user_id", _micros().alias("at"), "event_id", "event_type")
    return constraints.first_refusal(e, ["user_id"], ["at", "event_id"], ~F.col("event_type").isin("view", "click", "purchase"), ["event_type"])


@query("SELECT user_id, event_type, epoch_us(ts) AS at, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_of_kind(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", _micros().alias("at"), "event_id")
    return sequence.first_of_kind(e, ["user_id", "event_type"], ["at", "event_id"], [])


@query("""WITH f AS (SELECT user_id, ts AS m, event_id AS i FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN f USING (user_id) WHERE e.ts < f.m OR e.ts = f.m AND e.event_id < f.i""")
def before_marker(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return sequence.before_marker(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").drop("ts")


@query("""SELECT user_id, event_id, (SELECT v.event_id FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND (v.ts < p.ts OR v.ts = p.ts AND v.event_id < p.event_id) ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS last_view FROM events p WHERE event_type = 'purchase'""")
def last_control_before(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    found = sequence.last_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", "event_id", F.col("event_type") == "purchase", "last_view")
    return found.select("user_id", "event_id", "last_view")


@query("""WITH n AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS run_length FROM n GROUP BY user_id, event_type, g""")
def run_collapse(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return sequence.runs(e, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query(f"WITH {SPANS}, {_islands('SELECT * FROM spans', 'm')} SELECT user_id, s AS start, e AS \"end\" FROM m")
def interval_merge(spark, d):
    return intervals.merged(_spans(spark, d), ["user_id"])


@query(f"WITH {SPANS}, {_islands('SELECT * FROM spans', 'm')}, n AS (SELECT user_id, e AS start, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS \"end\" FROM m) SELECT * FROM n WHERE \"end\" IS NOT NULL")
def interval_uncovered(spark, d):
    return intervals.uncovered(_spans(spark, d), ["user_id"])


@query("WITH " + SPANS + ", " + _islands("SELECT * FROM spans WHERE event_type = 'purchase'", "m") + """ SELECT event_id, user_id, s AS start, e AS "end" FROM spans x WHERE event_type = 'error' AND e > s AND EXISTS (SELECT 1 FROM m WHERE m.user_id = x.user_id AND m.s < x.e AND x.s < m.e)""")
def interval_overlap(spark, d):
    s = _spans(spark, d)
    return intervals.overlapping(s.filter("event_type = 'error'"), s.filter("event_type = 'purchase'"), ["user_id"]).drop("event_type")


@query("WITH " + SPANS + ", " + _islands("SELECT * FROM spans WHERE event_type <> 'error'", "m") + """ SELECT event_id, user_id, s AS start, e AS "end" FROM spans x WHERE event_type = 'error' AND e > s AND NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = x.user_id AND m.s <= x.s AND x.e <= m.e)""")
def interval_inside(spark, d):
    s = _spans(spark, d)
    return intervals.not_inside(s.filter("event_type = 'error'"), s.filter("event_type <> 'error'"), ["user_id"]).drop("event_type")


@query(f"WITH {SPANS}, l AS (SELECT user_id, event_id, s, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS previous_end FROM spans) SELECT user_id, event_id, previous_end - s AS by_us FROM l WHERE previous_end > s")
def spans_disjoint_check(spark, d):
    found = intervals.overlapping_previous(_spans(spark, d), ["user_id"], ["start", "event_id"])
    return found.select("user_id", "event_id", (F.col("previous_end") - F.col("start")).alias("by_us"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeat_check(spark, d):
    return constraints.repeated(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT * FROM (SELECT o_orderkey, 1 + o_orderkey % 7 AS declared, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS actual FROM orders) WHERE declared <> actual")
def declared_vs_actual(spark, d):
    return constraints.declared_differs(_t(spark, d, "orders"), "o_orderkey", 1 + F.col("o_orderkey") % 7, _t(spark, d, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1 HAVING total > 200")
def sum_constraint(spark, d):
    return constraints.over_budget(_t(spark, d, "lineitem"), ["l_orderkey"], F.round("l_quantity").cast("long"), 200)


@query("SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS n_distinct, max(turn) AS highest, count(*) = count(DISTINCT turn) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS complete FROM conversations GROUP BY 1")
def coverage_check(spark, d):
    return constraints.coverage(_t(spark, d, "conversations"), ["conv_id"], "turn")


@query("WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000) SELECT 'order' AS kind, o_orderkey AS ref FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c) UNION ALL SELECT 'customer', c_custkey FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM o WHERE o_custkey IS NOT NULL)")
def dangling_refs(spark, d):
    o = _t(spark, d, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    c = _t(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey")
    one = graph.dangling(o, "o_custkey", c, "c_custkey").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("ref"))
    return one.unionByName(graph.dangling(c, "c_custkey", o, "o_custkey").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("ref")))


_EDGES = "SELECT 'r' || r_regionkey AS origin, 'n' || n_nationkey AS target FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"


def _edges(spark, d):
    pair = lambda t, a, x, b, y: _t(spark, d, t).select(F.concat(F.lit(a), x).alias("origin"), F.concat(F.lit(b), y).alias("target"))
    return pair("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(pair("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(pair("supplier", "n", "s_nationkey", "s", "s_suppkey"))


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT 'r1' UNION SELECT 'n3' UNION SELECT target FROM e JOIN r ON origin = node) SELECT DISTINCT node FROM r")
def closure(spark, d):
    return graph.closure(_edges(spark, d), spark.createDataFrame([("r1",), ("n3",)], "node string"))


@query("SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING bool_and(s_nationkey % 25 < 22)")
def closure_difference(spark, d):
    gone = _t(spark, d, "supplier").filter("s_nationkey % 25 < 22").select("s_suppkey")
    return graph.only_of(_t(spark, d, "lineitem").select("l_partkey", "l_suppkey"), gone, "l_partkey", "l_suppkey")


@query("SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING bool_and(p_size <= 25)")
def reference_integrity(spark, d):
    gone = _t(spark, d, "part").filter("p_size <= 25").select("p_partkey")
    return graph.only_of(_t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), gone, "l_orderkey", "l_partkey")


@query("WITH k AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS new_id FROM supplier WHERE s_acctbal > 0) SELECT coalesce(new_id, 0) AS new_id, count(*) AS n FROM lineitem LEFT JOIN k ON s_suppkey = l_suppkey GROUP BY 1")
def ref_remap(spark, d):
    kept = sequence.renumbered(_t(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey"), "s_suppkey", "new_id")
    counts = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(kept, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.groupBy(F.coalesce(F.col("new_id") + 1, F.lit(0)).alias("new_id")).agg(F.sum("n").alias("n"))


@query("SELECT doc_id, CAST(coalesce(sum(strlen(text) + strlen(text) % 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", strlen(text) AS size FROM documents")
def prefix_layout(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return sequence.prefix_layout(docs, "doc_id", F.col("size"), align=2).select("doc_id", "offset", F.col("size").cast("long").alias("size"))


@query("SELECT doc_id, CAST(n AS INTEGER) AS n, sha256(substring(text, CAST(n * 255 + 1 AS BIGINT), 255)) AS digest FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 255.0) AS BIGINT))) AS n FROM documents WHERE length(text) > 0)")
def reframe(spark, d):
    return sequence.reframed(_t(spark, d, "documents").select("doc_id", "text"), F.col("text"), 255).select("doc_id", "n", F.sha2("piece", 256).alias("digest"))


@query("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def ordered_concat_digest(spark, d):
    return sequence.concat_in_order(_t(spark, d, "conversations"), ["conv_id"], "turn", "text", "whole").select("conv_id", F.sha2("whole", 256).alias("digest"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_digest_dupes(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(f"WITH {SPANS} SELECT user_id, CAST(sum(e - s) AS BIGINT) AS total FROM (SELECT DISTINCT user_id, s, e FROM spans) q GROUP BY 1 HAVING total > 100000000000")
def budget(spark, d):
    spans = _spans(spark, d).select("user_id", "start", "end").distinct()
    return constraints.over_budget(spans, ["user_id"], F.col("end") - F.col("start"), 100_000_000_000)


@query("""WITH c AS (SELECT user_id % 20 AS tag, event_type AS value, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS net FROM events GROUP BY 1, 2)
SELECT tag, value, CASE WHEN net > 0 THEN 'added' ELSE 'removed' END AS change, CAST(abs(net) AS BIGINT) AS n FROM c WHERE net <> 0""")
def multiset_diff(spark, d):
    e = _t(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("tag"), F.col("event_type").alias("value"))
    return compare.multiset_diff(e.filter("event_id % 2 = 0").drop("event_id"), e.filter("event_id % 2 <> 0").drop("event_id"))


@query("""WITH s AS (SELECT l_orderkey, list(l_returnflag || l_linestatus || l_quantity::INT ORDER BY l_linenumber, l_quantity, l_returnflag, l_linestatus) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, (SELECT min(t.l_orderkey) FROM s t WHERE t.q = s.q AND t.l_orderkey <> s.l_orderkey) AS twin FROM s WHERE EXISTS (SELECT 1 FROM s t WHERE t.q = s.q AND t.l_orderkey <> s.l_orderkey)""")
def ordered_equality(spark, d):
    value = F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string"))
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", value.alias("value"))
    return compare.equal_sequences(lines, "l_orderkey", ["l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"], ["value"])


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id * 7919 % 5 = 0 THEN 'refused' ELSE 'cleaned' END AS st FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id * 104729 % 3 = 0 THEN 'refused' ELSE 'cleaned' END AS st FROM documents WHERE n_chars > 500)
SELECT a.doc_id, a.st AS now, b.st AS before, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.st = b.st THEN 'same' ELSE 'changed' END AS note FROM a LEFT JOIN b USING (doc_id)""")
def baseline_join(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    run = docs.select("doc_id", F.when(F.col("doc_id") * 7919 % 5 == 0, "refused").otherwise("cleaned").alias("status"))
    base = docs.filter("n_chars > 500").select("doc_id", F.when(F.col("doc_id") * 104729 % 3 == 0, "refused").otherwise("cleaned").alias("status"))
    return compare.against_baseline(run, base, "doc_id", "status")


@query("SELECT CASE WHEN event_type = 'error' THEN 'refused' ELSE 'cleaned' END AS status, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS large FROM events GROUP BY 1")
def outcome_summary(spark, d):
    e = _t(spark, d, "events").select(F.when(F.col("event_type") == "error", "refused").otherwise("cleaned").alias("status"), "value")
    return e.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("large"))


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)gps|latitude|serial|owner|@')")
def private_tag_filter(spark, d):
    return _t(spark, d, "documents").filter(F.col("text").rlike("(?i)gps|latitude|serial|owner|@")).select("doc_id", "source")


@query("SELECT page_id, CASE WHEN lower(regexp_extract(url, '(\\.[^./]*)$', 1)) IN ('.jpg', '.jpeg', '.com') THEN regexp_extract(url, '(\\.[^./]*)$', 1) ELSE '.jpg' END AS suffix FROM pages")
def output_suffix(spark, d):
    return _t(spark, d, "pages").select("page_id", scalars.output_suffix(F.col("url"), [".jpg", ".jpeg", ".com"], ".jpg").alias("suffix"))


@query("SELECT page_id, replace(replace(html, chr(10), '\\x0a'), chr(9), '\\x09') AS shown FROM pages")
def visible_escape(spark, d):
    return _t(spark, d, "pages").select("page_id", scalars.visible(F.col("html")).alias("shown"))


@query("""WITH n AS (SELECT page_id, html AS name FROM pages), c AS (SELECT page_id, name, unnest(range(0, least(length(name), 244) + 1)) AS k FROM n)
SELECT page_id, arg_max(substring(name, 1, CAST(k AS BIGINT)), k) || '_clean.html' AS fitted FROM c WHERE strlen(substring(name, 1, CAST(k AS BIGINT))) <= 244 GROUP BY 1""")
def fitted_name(spark, d):
    from tessera.functions.names import fitted

    return _t(spark, d, "pages").select("page_id", fitted(F.col("html"), F.lit("_clean.html")).alias("fitted"))


@query("SELECT s.p_partkey AS part, b.p_partkey AS big FROM part s JOIN part b ON s.p_brand = b.p_brand AND s.p_type = b.p_type WHERE s.p_size > 0 AND s.p_size <= b.p_size AND s.p_partkey % 90 + 1 <= b.p_partkey % 90 + 1 AND abs(s.p_size * (b.p_partkey % 90 + 1) - (s.p_partkey % 90 + 1) * b.p_size) <= greatest(b.p_size, b.p_partkey % 90 + 1)")
def same_shape(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("long").alias("w"), (F.col("p_partkey") % 90 + 1).alias("h"))
    return compare.paired_shapes(p, ["p_brand", "p_type"], ["w", "h"], "p_partkey", scalars.same_proportions, "part", "big")


@query("SELECT doc_id, CAST(('0x' || hex(encode(text))[1:8]) AS BIGINT) AS be32 FROM documents WHERE strlen(text) >= 4")
def byte_ints(spark, d):
    docs = _t(spark, d, "documents").filter(F.octet_length("text") >= 4)
    return docs.select("doc_id", scalars.unsigned(F.col("text").cast("binary"), 1, 4).alias("be32"))


_CRC_TABLE = """t AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda x, i: xor(x // 2, 3988292384 * (x % 2))) AS c FROM range(256) r(n)))"""


def _crc_sql(hexed: str) -> str:
    octets = f"list_transform(regexp_extract_all({hexed}, '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c // 256, tab[1 + xor(c % 256, b)])), 4294967295)"


@query(f"WITH {_CRC_TABLE} SELECT doc_id, {_crc_sql('hex(encode(text))')} AS crc FROM documents, t")
def crc(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ALL")
def part_totals(spark, d):
    lines = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'IMG' WHEN 1 THEN 'Screenshot' WHEN 2 THEN 'signal' WHEN 3 THEN '家庭聚会' WHEN 4 THEN 'a b' || user_id
WHEN 5 THEN 'DSC_' || user_id WHEN 6 THEN 'mmexport' ELSE 'IMG-WA' || user_id END AS base FROM events""")
def strip_name_dates(spark, d):
    from tessera.functions.names import without_dates

    at = lambda pattern: F.date_format("ts", pattern)
    shapes = [
        F.concat(F.lit("IMG_"), at("yyyyMMdd_HHmmss")), F.concat(F.lit("Screenshot "), at("yyyy-MM-dd 'at' HH.mm.ss")), F.concat(F.lit("signal-"), at("yyyy-MM-dd-HHmmss")),
        F.concat(F.lit("家庭聚会 "), at("dd.MM.yyyy")), F.concat(F.lit("a "), at("yyyy-MM-dd"), F.lit(" b"), F.col("user_id")), F.concat(F.lit("DSC_"), F.col("user_id")),
        F.concat(F.lit("mmexport"), F.lit(1_500_000_000_000) + F.col("event_id")), F.concat(F.lit("IMG-"), at("yyyyMMdd"), F.lit("-WA"), F.col("user_id")),
    ]
    stem = F.coalesce(*(F.when(F.col("event_id") % len(shapes) == n, shape) for n, shape in enumerate(shapes)))
    return _t(spark, d, "events").select("event_id", without_dates(stem).alias("base"))


@query("""WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events WHERE event_type = 'view'),
b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events WHERE event_type = 'click')
SELECT user_id, place::INTEGER AS place, a.value AS value_one, b.value AS value_two, CASE WHEN a.value IS NULL THEN 'one' WHEN b.value IS NULL THEN 'two' END AS missing FROM a FULL JOIN b USING (user_id, place)""")
def positional_zip(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return compare.zipped(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id"], ["event_id"], ["value"])


@query("""WITH l AS (SELECT l_orderkey AS k, list(l_returnflag ORDER BY l_linenumber) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey FROM orders LEFT JOIN l ON k = o_orderkey WHERE list_resize(['N', 'R', 'A', 'N', 'R', 'A', 'N'], 1 + o_orderkey % 7) IS DISTINCT FROM q""")
def pairwise_unequal(spark, d):
    flags = F.array(*map(F.lit, "NRANRAN"))
    wanted = _t(spark, d, "orders").select("o_orderkey", F.posexplode(F.slice(flags, F.lit(1), (1 + F.col("o_orderkey") % 7).cast("int")))).select("o_orderkey", F.col("pos").alias("at"), F.lit("").alias("file"), F.lit(0).cast("long").alias("row"), F.col("col").alias("flag"))
    found = _placed(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("at"), "file", "row", F.col("l_returnflag").alias("flag"))
    unequal = compare.pairwise_unequal(wanted, found, ["o_orderkey"], ["at", "file", "row"], ["flag"])
    return unequal.join(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")  # lines of no order are nobody's


@query("""SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 2 = 0 OR event_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2, event_id) = 1""")
def coalescing_merge(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return compare.coalesced(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1 AND event_id % 5 = 0"), ["user_id", "event_type"], ["event_id"])


@query("""WITH n AS (SELECT user_id, event_type AS v, max(CASE WHEN value > 80 THEN 1 ELSE 0 END) AS a, max(CASE WHEN value <= 40 THEN 1 ELSE 0 END) AS b FROM events GROUP BY 1, 2)
SELECT user_id, sum(a * b)::BIGINT AS shared, sum(a * (1 - b))::BIGINT AS only_one, sum((1 - a) * b)::BIGINT AS only_two FROM n WHERE a + b > 0 GROUP BY 1""")
def set_relations(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", "value")
    return compare.set_relations(e.filter("value > 80"), e.filter("value <= 40"), "user_id", "event_type")


@query("""WITH r AS (SELECT p_brand, p_type, p_size % 4 AS c, coalesce(sum(p_size % 4) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM part)
SELECT p_brand, p_type, unnest(range(s, s + c)) AS n FROM r""")
def run_expansion(spark, d):
    runs = _t(spark, d, "part").select("p_brand", "p_partkey", "p_type", (F.col("p_size") % 4).alias("count"))
    return sequence.expanded_runs(runs, ["p_brand"], "p_partkey", "count", ["p_type"])


_PASSES = "(0, 8, 0, 8), (4, 8, 0, 8), (0, 4, 4, 8), (2, 4, 0, 4), (0, 2, 2, 4), (1, 2, 0, 2), (0, 1, 1, 2)"


@query(f"""WITH p(x, dx, y, dy) AS (VALUES {_PASSES}), s AS (SELECT p_partkey, p_size AS w, p_partkey % 97 + 1 AS h, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 24 END AS b FROM part)
SELECT p_partkey, h * (1 + (w * b + 7) // 8) AS plain, (SELECT sum(CASE WHEN w > x AND h > y THEN ((h - y + dy - 1) // dy) * (1 + (((w - x + dx - 1) // dx) * b + 7) // 8) ELSE 0 END) FROM p)::BIGINT AS interlaced FROM s""")
def scanline_sizes(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_partkey") % 97 + 1).alias("h"), F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(24).alias("b"))
    size = lambda passes: scalars.scanline_bytes(F.col("w"), F.col("h"), F.col("b"), F.lit(passes))
    return p.select("p_partkey", size(False).alias("plain"), size(True).alias("interlaced"))


@query("""WITH e AS (SELECT user_id % 40 AS g, event_id, event_type || value AS v FROM events), o AS (SELECT g, v, max(event_id) AS pos FROM e WHERE event_id % 10 <> 3 GROUP BY 1, 2),
n AS (SELECT g, event_id, v FROM e WHERE event_id % 10 <> 3 OR g % 4 = 0), j AS (SELECT n.g, n.event_id, o.pos, max(o.pos) OVER (PARTITION BY n.g ORDER BY n.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM n LEFT JOIN o ON o.g = n.g AND o.v = n.v)
SELECT DISTINCT g FROM j WHERE pos IS NULL OR b >= pos""")
def subsequence_check(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") % 40).alias("g"), "event_id", F.concat("event_type", F.col("value").cast("string")).alias("v"))
    then = e.filter("event_id % 10 <> 3").groupBy("g", "v").agg(F.max("event_id").alias("event_id"))
    now = e.filter("event_id % 10 <> 3 OR g % 4 = 0")
    return compare.not_subsequences(now, then, ["g"], "event_id", "v")


#: Rows of one slice in the queries over a user that holds nine tenths of all events.
HOT_SLICE = 1024

HOT = "hot AS (SELECT CASE WHEN event_id % 10 < 9 THEN 0 ELSE user_id END AS user_id, event_id, ts, event_type, value FROM events)"
HOT_SPANS = SPANS.replace("FROM events", "FROM hot")


def _hot(rows: DataFrame) -> DataFrame:
    return rows.withColumn("user_id", F.when(F.col("event_id") % 10 < 9, 0).otherwise(F.col("user_id")))


@query(f"""WITH {HOT}, c AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM hot)
SELECT user_id, event_id, last_view FROM c WHERE event_type = 'purchase'""")
def hot_last_control(spark, d):
    e = _hot(_t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"))
    found = sequence.last_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", "event_id", F.col("event_type") == "purchase", "last_view", HOT_SLICE)
    return found.select("user_id", "event_id", "last_view")


@query(f"""WITH {HOT}, n AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM hot)
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS run_length FROM n GROUP BY user_id, event_type, g""")
def hot_run_collapse(spark, d):
    e = _hot(_t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"))
    return sequence.runs(e, ["user_id"], ["ts", "event_id"], "event_type", HOT_SLICE).drop("ts")


@query(f"WITH {HOT}, {HOT_SPANS}, {_islands('SELECT * FROM spans WHERE e - s < 36000000000', 'm')}, n AS (SELECT user_id, e AS start, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS \"end\" FROM m) SELECT * FROM n WHERE \"end\" IS NOT NULL")
def hot_interval_uncovered(spark, d):
    spans = _hot(_spans(spark, d)).filter(F.col("end") - F.col("start") < 36_000_000_000)
    return intervals.uncovered(spans, ["user_id"], slice_rows=HOT_SLICE)


@query(f"WITH {HOT}, {HOT_SPANS}, " + _islands("SELECT * FROM spans WHERE event_type = 'purchase' AND e - s < 36000000000", "m") + """ SELECT event_id, user_id, s AS start, e AS "end" FROM spans x WHERE event_type = 'error' AND e > s AND EXISTS (SELECT 1 FROM m WHERE m.user_id = x.user_id AND m.s < x.e AND x.s < m.e)""")
def hot_interval_overlap(spark, d):
    s = _hot(_spans(spark, d))
    cover = s.filter("event_type = 'purchase'").filter(F.col("end") - F.col("start") < 36_000_000_000)
    return intervals.overlapping(s.filter("event_type = 'error'"), cover, ["user_id"], slice_rows=HOT_SLICE).drop("event_type")


@query("""WITH e AS (SELECT user_id % 40 AS g, event_id, list_position(['click', 'error', 'purchase', 'view'], event_type) AS v FROM events),
t AS (SELECT g, list(v ORDER BY event_id) AS then_ FROM e WHERE event_id % 10 <> 3 GROUP BY 1),
n AS (SELECT g, list(v ORDER BY event_id) AS now_ FROM e WHERE event_id % 5 <> 1 AND (event_id % 10 <> 3 OR g % 4 = 0 AND event_id % 100 = 3) GROUP BY 1)
SELECT g FROM n LEFT JOIN t USING (g) WHERE list_reduce(list_prepend(0, now_), lambda p, v: CASE WHEN p < 0 THEN -1 ELSE coalesce(p + nullif(list_position(then_[p + 1:], v), 0), -1) END) < 0 OR then_ IS NULL""")
def subsequence_repeats(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") % 40).alias("g"), "event_id", "event_type")
    now = e.filter("event_id % 5 <> 1 AND (event_id % 10 <> 3 OR g % 4 = 0 AND event_id % 100 = 3)")
    return compare.not_subsequences(now, e.filter("event_id % 10 <> 3"), ["g"], "event_id", "event_type")


_PARTS = """x AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS f, min(l_quantity::BIGINT) % 7 AS m FROM lineitem GROUP BY 1, 2),
e AS (SELECT k, n AS o, 1 + p % 7 AS t FROM x WHERE m < 5 AND (k, 1 + p % 7) IN (SELECT (k, n) FROM x)), g AS (SELECT k, n AS o, 1 + s % 7 AS t FROM x WHERE m >= 5 AND (k, 1 + s % 7) IN (SELECT (k, n) FROM x))"""


def _parts(spark, d):
    """Each order as a group of parts with references, of which every line has one."""
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("node")).agg((F.min(F.col("l_quantity").cast("long")) % 7).alias("mode"), *(F.min(f"l_{c}").alias(c) for c in ("partkey", "suppkey", "returnflag")))
    lines = stored(lines)
    other = F.col("mode") >= 5
    built = lines.filter(~other).select("k", F.col("node").alias("origin"), (1 + F.col("partkey") % 7).alias("target"))
    return lines, built, lines.filter(other).select("k", F.col("node").alias("origin"), (1 + F.col("suppkey") % 7).alias("target"))


@query(f"""WITH RECURSIVE {_PARTS}, seed AS (SELECT k, n FROM x WHERE f = 'R' AND n > 1), c(k, n) AS (SELECT k, n FROM seed UNION SELECT e.k, e.t FROM c JOIN e ON e.k = c.k AND e.o = c.n),
d(k, n) AS (SELECT k, n FROM x WHERE (k, n) NOT IN (SELECT (k, n) FROM c) UNION SELECT e.k, e.t FROM d JOIN e ON e.k = d.k AND e.o = d.n), gone AS (SELECT k, n FROM c EXCEPT SELECT k, n FROM d),
loose AS (SELECT k, o AS n FROM g GROUP BY 1, 2 HAVING bool_and((k, t) IN (SELECT (k, n) FROM gone))),
bad AS (SELECT k FROM c WHERE n = 1 UNION SELECT k FROM seed WHERE (k, n) IN (SELECT (k, n) FROM d) UNION SELECT k FROM loose JOIN x USING (k, n) WHERE m = 6 AND (k, n) NOT IN (SELECT (k, n) FROM gone))
SELECT k, n AS node, CASE WHEN k IN (SELECT k FROM bad) THEN 'refused' WHEN (k, n) IN (SELECT (k, n) FROM gone) OR (k, n) IN (SELECT (k, n) FROM loose) THEN 'removed' ELSE 'kept' END AS fate FROM x""")
def stratified_removal(spark, d):
    lines, built, describes = _parts(spark, d)
    items = lines.select("k", "node", (F.col("node") == 1).alias("is_primary"), (F.col("mode") == 5).alias("may_describe"))
    return graph.stratified_removal(items, built, lines.filter("returnflag = 'R' AND node > 1"), describes, ("k",))


_TRACK_KINDS = ("vide", "vide", "soun", "soun", "text", "meta", "clcp")
_REF_KINDS = ("chap", "thmb", "rndr", "cdsc")


@query(f"""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, {list(_TRACK_KINDS)}[1 + min(l_quantity::BIGINT) % 7] AS kind, min(l_returnflag) <> 'N' AS enabled, min(l_partkey) AS p, {list(_REF_KINDS)}[1 + min(l_suppkey) % 4] AS ref FROM lineitem GROUP BY 1, 2),
r AS (SELECT k, n AS o, ref, 1 + p % 7 AS t FROM x WHERE p % 3 = 0 AND 1 + p % 7 <> n AND (k, 1 + p % 7) IN (SELECT (k, n) FROM x)),
a AS (SELECT k, n, kind, kind = 'meta' OR (k, n) IN (SELECT (k, t) FROM r WHERE ref = 'chap') AND (kind = 'text' OR kind = 'vide' AND NOT enabled AND (k, n) NOT IN (SELECT (k, t) FROM r WHERE ref <> 'chap')) AS goes FROM x),
h AS (SELECT k, n, kind, goes OR (k, n) IN (SELECT (r.k, r.o) FROM r JOIN a y ON y.k = r.k AND y.n = r.t WHERE ref = 'thmb' AND NOT y.goes) AS goes FROM a),
j AS (SELECT h.k, CASE WHEN NOT h.goes AND h.kind NOT IN ('vide', 'soun', 'clcp') THEN 'a kind' WHEN h.goes AND ref = 'rndr' AND NOT y.goes THEN 'b needed' WHEN NOT h.goes AND y.goes AND ref NOT IN ('chap', 'cdsc') THEN 'c depends' END AS reason
  FROM h LEFT JOIN r ON r.k = h.k AND r.o = h.n LEFT JOIN h y ON y.k = r.k AND y.n = r.t)
SELECT k, n AS node, CASE WHEN goes THEN 'removed' ELSE 'kept' END AS fate, (SELECT substr(min(reason), 3) FROM j WHERE j.k = h.k) AS reason FROM h""")
def track_selection(spark, d):
    lines, _, _ = _parts(spark, d)
    named = lambda number, names: F.get(F.array(*map(F.lit, names)), (number % len(names)).cast("int"))
    tracks = lines.select("k", "node", named(F.col("mode"), _TRACK_KINDS).alias("kind"), (F.col("returnflag") != "N").alias("enabled"))
    refs = lines.filter("partkey % 3 = 0").select("k", F.col("node").alias("origin"), named(F.col("suppkey"), _REF_KINDS).alias("kind"), (1 + F.col("partkey") % 7).alias("target"))
    here = refs.filter("origin <> target").join(lines.select("k", F.col("node").alias("target")), ["k", "target"], "left_semi")
    return graph.selected_tracks(tracks, here, ("k",), ["meta"], ["vide", "soun", "clcp"], ["chap", "cdsc"])


_CHUNKS = """c AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS chunk, o_orderkey FROM orders),
s AS (SELECT o_custkey AS k, l_quantity::BIGINT AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT k, chunk AS first, 1 + o_orderkey % 7 AS per FROM c WHERE chunk % 3 = 2),
f AS (SELECT k, chunk, chunk * 1000 AS "at", coalesce((SELECT per FROM r WHERE r.k = c.k AND r.first <= c.chunk ORDER BY first DESC LIMIT 1), 0) AS n_samples FROM c),
p AS (SELECT *, coalesce(sum(n_samples) OVER (PARTITION BY k ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_sample FROM f),
z AS (SELECT k, chunk, "at", first_sample::BIGINT AS first_sample, n_samples::BIGINT AS n_samples, "at" AS start, ("at" + coalesce((SELECT sum(size) FROM s WHERE s.k = p.k AND n >= first_sample AND n < first_sample + n_samples), 0))::BIGINT AS "end",
  (SELECT count(*) FROM s WHERE s.k = p.k) >= first_sample + n_samples AS complete FROM p)"""


def _chunk_spans(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    chunks = sequence.Sliced.of(orders, ["k"], ["o_orderkey"]).before(chunk=("count", F.lit(True))).done().withColumn("chunk", F.col("chunk") + 1)
    lines = _t(spark, d, "lineitem")
    lines = sliced.dealt(lines, lines.count(), "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("k", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.col("l_quantity").cast("long").alias("size"))
    samples = sequence.Sliced.of(lines, ["k"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]).before(n=("count", F.lit(True))).done()
    runs = chunks.filter("chunk % 3 = 2").select("k", F.col("chunk").alias("first"), (1 + F.col("o_orderkey") % 7).alias("per_chunk"))
    return sequence.chunk_spans(chunks.select("k", "chunk", (F.col("chunk") * 1000).alias("at")), runs, samples, ["k"])


@query(f"WITH {_CHUNKS} SELECT * FROM z")
def chunk_spans(spark, d):
    return _chunk_spans(spark, d)


@query(f"""WITH {_CHUNKS}, m AS (SELECT DISTINCT o_custkey AS k, 0 AS s, 4000 + o_custkey % 50 AS e FROM orders UNION SELECT DISTINCT o_custkey, 4000 + o_custkey % 50, 8050 FROM orders WHERE o_custkey % 2 = 0)
SELECT k, chunk, start, "end" FROM z WHERE "end" > start AND NOT EXISTS (SELECT 1 FROM (SELECT k, min(s) AS s, CASE WHEN k % 2 = 0 THEN 8050 ELSE min(e) END AS e FROM m GROUP BY k) w WHERE w.k = z.k AND w.s <= z.start AND z."end" <= w.e)""")
def chunks_outside_media(spark, d):
    keys = _t(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    edge = 4000 + F.col("k") % 50
    media = keys.select("k", F.lit(0).cast("long").alias("start"), edge.alias("end")).unionByName(keys.filter("k % 2 = 0").select("k", edge.alias("start"), F.lit(8050).cast("long").alias("end")))
    return intervals.not_inside(_chunk_spans(spark, d), media, ["k"]).select("k", "chunk", "start", "end")


@query(f"WITH {_CRC_TABLE}, w AS (SELECT conv_id, hex(encode(string_agg(text, '' ORDER BY turn))) AS h FROM conversations GROUP BY 1) SELECT conv_id, {_crc_sql('h')} AS crc, strlen(h) // 2 AS size FROM w, t")
def crc_of_parts(spark, d):
    from tessera.functions.crc import crc_of_parts as combined

    turns = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("part"))
    return combined(turns, ["conv_id"], ["turn"], F.col("part"))


#: Bytes of a block in the queries over values: small, so that texts have several.
VALUE_BLOCK = 1000

_VALUES = """v AS (SELECT doc_id, hex(encode(text)) || repeat('00', CAST(doc_id % 200 AS INTEGER)) AS h, strlen(text) AS n, strlen(text) + doc_id % 200 AS size FROM documents)"""


def _values(spark, d):
    """Documents with zero bytes behind their text, and spans that leave out some bytes of the middle and the end of it."""
    n = F.octet_length("text")
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.col("text").cast("binary"), F.unhex(F.repeat(F.lit("00"), (F.col("doc_id") % 200).cast("int")))).alias("value"), n.alias("n"))
    half = F.floor(F.col("n") / 2)
    parts = F.array(F.struct(F.lit(0).cast("long").alias("start"), half.alias("end")), F.struct((half + F.col("doc_id") % 5).alias("start"), (F.col("n") - F.col("doc_id") % 4).alias("end")))
    return docs, docs.select("doc_id", F.explode(parts).alias("s")).select("doc_id", "s.start", "s.end")


@query(f"""WITH {_VALUES}, u AS (SELECT doc_id, h, size, n // 2 AS a, greatest(n // 2, least(n // 2 + doc_id % 5, n - doc_id % 4)) AS b, CASE WHEN n // 2 + doc_id % 5 < n - doc_id % 4 THEN n - doc_id % 4 ELSE n // 2 END AS c FROM v),
g AS (SELECT doc_id, h, a AS s, b AS e FROM u WHERE n_second UNION ALL SELECT doc_id, h, CASE WHEN n_second THEN c ELSE a END, size FROM u)
SELECT doc_id, count(*) FILTER (e > s) AS n_gaps, coalesce(bool_and(regexp_full_match(substring(h, 2 * s + 1, 2 * (e - s)), '0*')) FILTER (e > s), true) AS covered FROM g GROUP BY 1""".replace("FROM u WHERE n_second", "FROM u WHERE c > a").replace("WHEN n_second", "WHEN c > a"))
def unused_is_zero(spark, d):
    docs, used = _values(spark, d)
    return blobs.unused_is_zero(docs, ["doc_id"], F.col("value"), used, VALUE_BLOCK)


@query("""WITH v AS (SELECT doc_id, hex(encode(text)) AS a, hex(encode(translate(text, 'AEIOUQXZ', 'aeiouqxz'))) AS b, strlen(text) AS n FROM documents),
s AS (SELECT doc_id, a, b, n, k * n // 12 + k AS s, (k + 1) * n // 12 + 1 AS e FROM v, range(12) r(k))
SELECT doc_id, s AS start, e AS "end", e <= n AND substring(a, CAST(2 * s + 1 AS BIGINT), CAST(2 * (e - s) AS BIGINT)) = substring(b, CAST(2 * s + 1 AS BIGINT), CAST(2 * (e - s) AS BIGINT)) AS same FROM s WHERE e > s GROUP BY ALL""")
def equal_spans(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", F.octet_length("text").cast("long").alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(11)))
    spans = docs.select("doc_id", "n", k.alias("k")).select("doc_id", (F.floor(F.col("k") * F.col("n") / 12) + F.col("k")).alias("start"), (F.floor((F.col("k") + 1) * F.col("n") / 12) + 1).alias("end"))
    one, two = (blobs.blocks(docs, ["doc_id"], value, VALUE_BLOCK) for value in (F.col("text"), F.translate("text", "AEIOUQXZ", "aeiouqxz")))
    return blobs.equal_spans(one, two, spans, ["doc_id"], VALUE_BLOCK)


@query("""WITH f AS (SELECT event_id, 'd' || user_id % 4 AS folder, 'p' || user_id % 7 AS base, row_number() OVER (PARTITION BY user_id % 4, user_id % 7 ORDER BY event_id) - 1 AS r FROM events WHERE event_id % 3 = 0),
t AS (SELECT DISTINCT 'd' || user_id % 4 AS folder, 'p' || user_id % 7 AS base, event_id * 7 % 150 AS k FROM events WHERE event_id % 3 = 1),
z AS (SELECT folder, base, k, row_number() OVER (PARTITION BY folder, base ORDER BY k) - 1 AS r FROM (SELECT folder, base, unnest(range(n)) AS k FROM (SELECT folder, base, count(*) + 151 AS n FROM f GROUP BY 1, 2)) a WHERE (folder, base, k) NOT IN (SELECT (folder, base, k) FROM t))
SELECT event_id AS file_id, folder, base || '_clean' || CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.png' AS name FROM f JOIN z USING (folder, base, r)""")
def batch_names(spark, d):
    from tessera.sources.naming import batch_names as dealt

    e = _t(spark, d, "events").select("event_id", F.concat(F.lit("d"), F.col("user_id") % 4).alias("folder"), F.concat(F.lit("p"), F.col("user_id") % 7).alias("base"))
    files = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("file_id"), "folder", "base", F.lit(".png").alias("suffix"))
    k = F.col("event_id") * 7 % 150
    name = F.concat("base", F.lit("_clean"), F.when(k == 0, "").otherwise(F.concat(F.lit("_"), k)), F.lit(".png"))
    return dealt(files, e.filter("event_id % 3 = 1").select("folder", name.alias("name")))


@query("""WITH c AS (SELECT conv_id, (turn * 7919 + conv_id) % 1009 AS place, CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN 9999 ELSE turn + 1 END AS number, text FROM conversations),
g AS (SELECT conv_id FROM c GROUP BY 1 HAVING count(*) = count(DISTINCT number) AND min(number) = 1 AND max(number) = count(*)),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS slot FROM c WHERE conv_id IN (SELECT conv_id FROM g))
SELECT s.conv_id, s.place, sha256(t.text) AS digest FROM s JOIN s t ON t.conv_id = s.conv_id AND t.number = s.slot""")
def two_orders(spark, d):
    number = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 2), 9999).otherwise(F.col("turn") + 1)
    turns = _t(spark, d, "conversations").select("conv_id", ((F.col("turn") * 7919 + F.col("conv_id")) % 1009).alias("place"), number.alias("number"), "text")
    return sequence.two_orders(turns, ["conv_id"], "place", "number", ["text"]).select("conv_id", "place", F.sha2("text", 256).alias("digest"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS digest, text LIKE '%@%' AS odd FROM documents), a AS (SELECT DISTINCT digest FROM d WHERE doc_id % 3 <> 0)
SELECT doc_id, digest, CASE WHEN odd THEN 'refused' ELSE 'cleaned' END AS status, CASE WHEN digest IN (SELECT digest FROM a) THEN 'run1' ELSE 'run2' END AS run FROM d""")
def incremental_outcomes(spark, d):
    """Two runs over growing documents: the second works on new contents only, as the run of each outcome tells."""
    import uuid

    from tessera.operators.lineage import shared_folder
    from tessera.sources.history import by_content

    work = lambda rows: rows.select("digest", F.when(F.col("text").contains("@"), "refused").otherwise("cleaned").alias("status"))
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "text")
    by_content(docs.filter("doc_id % 3 <> 0"), folder, "v1", "run1", work)
    return by_content(docs, folder, "v1", "run2", work).drop("text")


_REPORT_GROUPS = ("EXIF:IFD0", "GPS", "XMP:XMP-hdrgm", "MakerNotes:Apple", "File", "PNG", "QuickTime:Track1", "ICC_Profile", "IPTC", "File:System", "XMP:XMP-dc")
_REPORT_TAGS = ("Orientation", "Model", "GPSLatitude", "Gamma", "Comment", "HDRHeadroom", "Unknown_0x0011", "ImageWidth", "CreateDate", "BitsPerSample", "Version", "MediaTag", "OwnerName")


def _remaining_sql() -> str:
    from tessera.operators import tag_report

    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    return f"""WITH r AS (SELECT event_id, CASE WHEN user_id % 2 = 1 THEN 'TIFF' ELSE 'JPEG' END AS kind, [{quoted(_REPORT_GROUPS)}][1 + event_id % {len(_REPORT_GROUPS)}] AS place, [{quoted(_REPORT_TAGS)}][1 + user_id % {len(_REPORT_TAGS)}] AS tag,
CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN '1 2' ELSE CAST(event_id % 1000 AS VARCHAR) || '.5' END AS v FROM events),
p AS (SELECT *, split_part(place, ':', 1) AS g, regexp_full_match(v, '[0-9]+[.]5') AS is_number FROM r)
SELECT event_id, kind, place || ':' || tag AS key FROM p WHERE g NOT IN ({quoted(tag_report.PASSED_GROUPS)}) AND place <> 'File:System'
AND NOT (is_number AND (place = 'MakerNotes:Apple' AND tag = 'HDRHeadroom' OR place = 'XMP:XMP-hdrgm' AND tag IN ('Gamma', 'Version')))
AND (g IN ({quoted(tag_report.PRIVATE_GROUPS)}) OR g = 'EXIF' AND tag <> 'Orientation' AND NOT (kind = 'TIFF' AND tag IN ('ImageWidth', 'BitsPerSample')) AND tag <> 'Gamma'
  OR g <> 'EXIF' AND v <> '' AND tag IN ('Model', 'GPSLatitude', 'Comment', 'CreateDate', 'OwnerName') OR tag = 'Unknown_0x0011')"""


@query(_remaining_sql())
def tag_report_remaining(spark, d):
    from tessera.operators import tag_report

    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (F.col(by) % len(names)).cast("int"))
    value = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 5 == 0, "1 2").otherwise(F.concat((F.col("event_id") % 1000).cast("string"), F.lit(".5")))
    key = F.concat_ws(":", pick(_REPORT_GROUPS, "event_id"), pick(_REPORT_TAGS, "user_id"))
    report = _t(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 1, "TIFF").otherwise("JPEG").alias("kind"), key.alias("key"), F.array(value).alias("values"))
    return tag_report.remaining(report).select("event_id", "kind", "key")
