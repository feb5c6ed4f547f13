"""Queries over the page operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages, scopes
from ..sources.tables import checkpoint_folder, table
from .registry import query


@query(
    """SELECT l_orderkey, min(l_quantity) AS llx, min(l_linenumber)::DOUBLE AS lly, max(l_quantity) AS urx, max(l_linenumber)::DOUBLE AS ury FROM lineitem GROUP BY 1"""
)
def path_bbox(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"))
    return pages.bounding_boxes(points, ["l_orderkey"])


@query(
    """SELECT user_id, event_id, round(sum(value) OVER w, 3) AS x, sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) OVER w::DOUBLE AS y FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
)
def subpath_relative(spark, sf_dir):
    steps = table(spark, sf_dir, "events").withColumn("dy", F.when(F.col("event_type") == "click", 1.0).otherwise(-1.0))
    rows = pages.relative_positions(steps, ["user_id"], ["ts", "event_id"], "value", "dy")
    return rows.select("user_id", "event_id", F.round("x", 3).alias("x"), "y")


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p"""
)
def state_dedupe(spark, sf_dir):
    return pages.changed_only(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query(
    """SELECT event_id, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM events"""
)
def clip_depth(spark, sf_dir):
    kind = F.col("event_type")
    return pages.nesting_depth(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], kind == "signup", kind == "error").select("event_id", "depth")


@query(
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS width FROM events"""
)
def state_at_paint(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("set_to", F.when(F.col("event_type") == "purchase", F.col("value")))
    return pages.state_at(events, ["user_id"], ["ts", "event_id"], "set_to", "width").select("event_id", "width")


@query(
    """SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_no FROM events"""
)
def page_boundaries(spark, sf_dir):
    return pages.page_numbers(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "page_no")


@query("SELECT p_type, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS number FROM part GROUP BY p_type")
def resource_intern(spark, sf_dir):
    return pages.interned(table(spark, sf_dir, "part"), "p_type", ["p_partkey"])


@query(
    """SELECT lang, count(*) AS n, string_agg(CAST(c AS VARCHAR), ' ' ORDER BY c) AS codes FROM (SELECT DISTINCT lang, unicode(ch) AS c FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '') GROUP BY lang"""
)
def used_glyphs(spark, sf_dir):
    codes = pages.used_codes(table(spark, sf_dir, "documents"), ["lang"], "text").select("lang", F.ascii("code").cast("bigint").alias("c"))
    listed = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")))
    return codes.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), listed.alias("codes"))


@query(
    """SELECT min(k) AS first, max(k) AS last, count(*) AS n FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 7 <> 0)) GROUP BY g"""
)
def cid_width_runs(spark, sf_dir):
    return pages.runs_by_ends(table(spark, sf_dir, "orders").where("o_custkey % 7 <> 0"), "o_custkey")


@query(
    """SELECT o_orderkey, coalesce((SELECT CASE r.kind WHEN 'notdef' THEN r.cid ELSE r.cid + o.code - r.low END FROM
   (SELECT p_partkey * 13 AS low, p_partkey * 13 + p_size % 9 AS high, p_partkey * 100 AS cid, CASE WHEN p_size % 9 = 0 THEN 'exact' WHEN p_size % 5 = 0 THEN 'notdef' ELSE 'range' END AS kind FROM part) r
   WHERE o.code BETWEEN r.low AND r.high ORDER BY CASE r.kind WHEN 'exact' THEN 0 WHEN 'range' THEN 1 ELSE 2 END, r.low LIMIT 1), 0) AS cid
FROM (SELECT o_orderkey, o_custkey * 7 % 26000 AS code FROM orders) o"""
)
def cmap_range_lookup(spark, sf_dir):
    width = F.col("p_size") % 9
    kind = F.when(width == 0, "exact").when(F.col("p_size") % 5 == 0, "notdef").otherwise("range")
    ranges = table(spark, sf_dir, "part").select((F.col("p_partkey") * 13).alias("low"), (F.col("p_partkey") * 13 + width).alias("high"), (F.col("p_partkey") * 100).alias("cid"), kind.alias("kind"), F.lit(0).alias("depth"))
    codes = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 7 % 26000).alias("code"))
    return pages.mapped_codes(codes, ranges).select("o_orderkey", "cid")


@query(
    """SELECT l_linenumber::BIGINT AS image, bx AS block_x, bz AS block_y, CAST((sum(v) + count(*) // 2) // count(*) AS BIGINT) AS mean FROM (SELECT l_linenumber, (l_partkey % 64) // 4 AS bx, (l_suppkey % 64) // 4 AS bz, CAST(l_quantity * 5 AS BIGINT) AS v FROM lineitem) GROUP BY 1, 2, 3"""
)
def image_block_average(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("image"), (F.col("l_partkey") % 64).alias("px"), (F.col("l_suppkey") % 64).alias("py"), (F.col("l_quantity") * 5).cast("bigint").alias("v"))
    return pages.block_means(pixels, ["image"], "px", "py", "v", 4).withColumnsRenamed({"bx": "block_x", "by": "block_y"})


@query(
    """SELECT user_id, event_type AS key, max(CASE WHEN k = 1 AND event_type <> 'error' THEN value END) AS value, count(CASE WHEN event_type = 'error' THEN 1 END) AS refused
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY 1, 2"""
)
def params_merge_locked(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), "value", "ts", "event_id")
    locked = spark.createDataFrame([("error",)], "key string")
    return scopes.merged_parameters(requests, locked, ["user_id"], ["ts", "event_id"])


@query("SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS programs FROM events GROUP BY 1")
def mark_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("programs"))


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS whole, count(*) AS pieces FROM conversations GROUP BY 1")
def job_split_transparency(spark, sf_dir):
    """Pieces of a job in order make the whole job, however it was split."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.concat_ws("", pieces)).alias("whole"), F.count(F.lit(1)).alias("pieces"))


@query(
    """SELECT r_regionkey AS root, 'r' || r_regionkey AS node FROM region UNION SELECT r_regionkey, 'n' || n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey
UNION SELECT r_regionkey, 's' || s_suppkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey"""
)
def resource_closure(spark, sf_dir):
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    links = table(spark, sf_dir, "nation").select(named("r", "n_regionkey").alias("from"), named("n", "n_nationkey").alias("to"))
    links = links.unionByName(table(spark, sf_dir, "supplier").select(named("n", "s_nationkey").alias("from"), named("s", "s_suppkey").alias("to")))
    roots = table(spark, sf_dir, "region").select(named("r", "r_regionkey").alias("root"))
    checkpoint_folder(spark)
    return pages.reached(roots, links).select(F.substring("root", 2, 9).cast("int").alias("root"), "node")


@query(
    """SELECT o_orderkey, CASE WHEN g.o_orderkey IS NULL THEN 'missing' WHEN s1 = s2 AND p1 = p2 THEN 'pass' ELSE 'fail' END AS verdict,
  CASE WHEN g.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN s1 <> s2 THEN 'status' END, CASE WHEN p1 <> p2 THEN 'priority' END) END AS differing
FROM (SELECT o_orderkey, o_orderstatus AS s1, o_orderpriority AS p1 FROM orders) e LEFT JOIN
 (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s2, CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE o_orderpriority END AS p2 FROM orders WHERE o_orderkey % 11 <> 0) g USING (o_orderkey)"""
)
def golden_comparison(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    key = F.col("o_orderkey")
    got = orders.where(key % 11 != 0).select("o_orderkey", F.when(key % 5 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(key % 3 == 0, "Y").otherwise(F.col("priority")).alias("priority"))
    return pages.compared(orders, got, ["o_orderkey"], ["status", "priority"])


@query(
    """SELECT p_partkey, CAST(greatest(1, floor(least(p_size * 40 / hypot(a, b) * 72, p_size * 30 / hypot(c, d) * 72) / 72)) AS INTEGER) AS factor FROM (SELECT p_partkey, p_size, 100.0::DOUBLE AS a, (p_partkey % 50)::DOUBLE AS b, -(p_partkey % 50)::DOUBLE AS c, 80.0::DOUBLE AS d FROM
 (SELECT p_partkey, p_size FROM part))""".replace("hypot(a, b)", "sqrt(a * a + b * b)").replace("hypot(c, d)", "sqrt(c * c + d * d)")
)
def image_reduction_factor(spark, sf_dir):
    skew = (F.col("p_partkey") % 50).cast("double")
    factor = pages.reduction_factor(F.col("p_size") * 40, F.col("p_size") * 30, F.lit(100.0), skew, -skew, F.lit(80.0), F.lit(72.0))
    return table(spark, sf_dir, "part").select("p_partkey", factor.alias("factor"))
