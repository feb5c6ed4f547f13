"""Queries over the scalar, string, stack and dictionary functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, lists, numbers
from ..sources.tables import table
from .registry import query


def _r(c, digits: int = 4):
    return F.round(c.cast("double"), digits)


@query(
    """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_suppkey,
  CASE WHEN s BETWEEN -2147483648 AND 2147483647 THEN s END::DOUBLE AS sum_int,
  CASE WHEN s NOT BETWEEN -2147483648 AND 2147483647 THEN round(CAST(CAST(s AS FLOAT) AS DOUBLE), 0) END AS sum_real,
  CASE WHEN d BETWEEN -2147483648 AND 2147483647 THEN d END::DOUBLE AS diff_int
FROM (SELECT *, CAST(l_partkey AS BIGINT) * 1000000 % 2147483648 + CAST(l_orderkey AS BIGINT) * 100000 % 2147483648 AS s,
  -(CAST(l_partkey AS BIGINT) * 1000000 % 2147483648) - (CAST(l_orderkey AS BIGINT) * 100000 % 2147483648) AS d FROM lineitem)"""
)
def arith_add_promote(spark, sf_dir):
    a = (F.col("l_partkey") * 1000000) % 2147483648
    b = (F.col("l_orderkey") * 100000) % 2147483648
    x, y = numbers.integer(a), numbers.integer(b)
    total, less = numbers.add(x, y), numbers.sub(numbers.neg(x), y)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_suppkey", total.alias("t"), less.alias("u"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_suppkey", F.col("t.i").cast("double").alias("sum_int"), _r(F.col("t.r"), 0).alias("sum_real"), F.col("u.i").cast("double").alias("diff_int"))


@query(
    """SELECT o_orderkey, CASE WHEN p BETWEEN -2147483648 AND 2147483647 THEN p END::DOUBLE AS product_int,
  CASE WHEN p NOT BETWEEN -2147483648 AND 2147483647 THEN CAST(CAST(p AS FLOAT) AS DOUBLE) END AS product_real
FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * (CAST(o_custkey AS BIGINT) * 700 + 1) AS p FROM orders)"""
)
def arith_mul_promote(spark, sf_dir):
    p = numbers.mul(numbers.integer(F.col("o_orderkey")), numbers.integer(F.col("o_custkey") * 700 + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p.i").cast("double").alias("product_int"), F.col("p.r").cast("double").alias("product_real"))


@query(
    """SELECT p_partkey, CASE WHEN y <> 0 THEN x // y END::DOUBLE AS quotient, CASE WHEN y <> 0 THEN x % y END::DOUBLE AS remainder,
  CASE WHEN y = 0 THEN 'undefinedresult' END AS error
FROM (SELECT p_partkey, CAST(p_partkey AS BIGINT) - 1000 AS x, CAST(p_size AS BIGINT) % 7 - 3 AS y FROM part)"""
)
def arith_idiv_mod(spark, sf_dir):
    x, y = numbers.integer(F.col("p_partkey") - 1000), numbers.integer(F.col("p_size") % 7 - 3)
    rows = table(spark, sf_dir, "part").select("p_partkey", numbers.idiv(x, y).alias("q"), numbers.mod(x, y).alias("m"))
    return rows.select("p_partkey", F.col("q.i").cast("double").alias("quotient"), F.col("m.i").cast("double").alias("remainder"), F.col("q.error").alias("error"))


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CASE WHEN l_tax <> 0 THEN round(CAST(CAST(l_discount AS FLOAT) / CAST(l_tax AS FLOAT) AS DOUBLE), 4) END AS quotient,
  CASE WHEN l_tax = 0 THEN 'undefinedresult' END AS error FROM lineitem"""
)
def arith_div(spark, sf_dir):
    q = numbers.div(numbers.real(F.col("l_discount")), numbers.real(F.col("l_tax")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", q.alias("q"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", _r(F.col("q.r")).alias("quotient"), F.col("q.error").alias("error"))


@query(
    """SELECT c_custkey, floor(CAST(x AS DOUBLE)) AS floored, ceil(CAST(x AS DOUBLE)) AS ceiled, floor(CAST(x + CAST(0.5 AS FLOAT) AS DOUBLE)) AS rounded,
  CASE WHEN x < 0 THEN ceil(CAST(x AS DOUBLE)) ELSE floor(CAST(x AS DOUBLE)) END AS truncated, CAST(abs(x) AS DOUBLE) AS absolute, CAST(-x AS DOUBLE) AS negated
FROM (SELECT c_custkey, CAST(floor(c_acctbal * 2) / 4 AS FLOAT) AS x FROM customer)"""
)
def arith_rounding(spark, sf_dir):
    x = numbers.real(F.floor(F.col("c_acctbal") * 2) / 4)
    f = {"floored": numbers.floor, "ceiled": numbers.ceiling, "rounded": numbers.rounded, "truncated": numbers.truncate, "absolute": numbers.absolute, "negated": numbers.neg}
    return table(spark, sf_dir, "customer").select("c_custkey", *[numbers.value(g(x)).alias(n) for n, g in f.items()])


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CASE l_linenumber % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE -1.0 END::DOUBLE AS sine,
  CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN -1.0 ELSE 0.0 END::DOUBLE AS cosine,
  round(CASE WHEN degrees(atan2(l_linenumber - 3, l_quantity - 25)) < 0 THEN degrees(atan2(l_linenumber - 3, l_quantity - 25)) + 360
    WHEN l_linenumber = 3 AND l_quantity = 25 THEN NULL ELSE degrees(atan2(l_linenumber - 3, l_quantity - 25)) END, 2) AS angle
FROM lineitem"""
)
def trig_degrees(spark, sf_dir):
    turn = numbers.integer(F.col("l_linenumber") * 90)
    angle = numbers.atan(numbers.integer(F.col("l_linenumber") - 3), numbers.real(F.col("l_quantity") - 25))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", numbers.value(numbers.sin(turn)).alias("sine"), numbers.value(numbers.cos(turn)).alias("cosine"), _r(numbers.value(angle), 2).alias("angle"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(sqrt(c_acctbal), 1) END AS root,
  CASE WHEN c_acctbal <= 0 THEN NULL ELSE round(ln(c_acctbal), 3) END AS natural, CASE WHEN c_acctbal <= 0 THEN NULL ELSE round(log10(c_acctbal), 3) END AS decimal,
  round(pow(1.5, c_nationkey), 0) AS power, CASE WHEN c_acctbal < 0 THEN 'rangecheck' END AS error FROM (SELECT c_custkey, c_nationkey, floor(c_acctbal) AS c_acctbal FROM customer)"""
)
def arith_roots_and_logs(spark, sf_dir):
    x = numbers.integer(F.floor("c_acctbal"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", numbers.sqrt(x).alias("s"), numbers.ln(x).alias("n"), numbers.log(x).alias("d"), numbers.exp(numbers.real(F.lit(1.5)), numbers.integer(F.col("c_nationkey"))).alias("p"))
    return rows.select("c_custkey", _r(F.col("s.r"), 1).alias("root"), _r(F.col("n.r"), 3).alias("natural"), _r(F.col("d.r"), 3).alias("decimal"), _r(F.col("p.r"), 0).alias("power"), F.col("s.error").alias("error"))


@query(
    """SELECT o_orderkey, CASE WHEN abs(k) >= 32 THEN 0 WHEN k >= 0 THEN CASE WHEN l > 2147483647 THEN l - 4294967296 ELSE l END ELSE CASE WHEN r > 2147483647 THEN r - 4294967296 ELSE r END END AS shifted
FROM (SELECT o_orderkey, k, ((n & 4294967295) << CASE WHEN k BETWEEN 0 AND 31 THEN k ELSE 0 END) & 4294967295 AS l,
  (n & 4294967295) >> CASE WHEN k BETWEEN -31 AND 0 THEN -k ELSE 0 END AS r
 FROM (SELECT o_orderkey, CAST(o_custkey AS BIGINT) - 700 AS n, CAST(o_orderkey % 71 AS INTEGER) - 35 AS k FROM orders))"""
)
def bitshift_logical(spark, sf_dir):
    out = numbers.bitshift(numbers.integer(F.col("o_custkey") - 700), numbers.integer(F.col("o_orderkey") % 71 - 35))
    return table(spark, sf_dir, "orders").select("o_orderkey", out["i"].cast("bigint").alias("shifted"))


@query(
    """SELECT o_orderkey, CAST(o_custkey & (o_orderkey % 1024) AS BIGINT) AS both, CAST(o_custkey | (o_orderkey % 1024) AS BIGINT) AS either,
  CAST(xor(o_custkey, o_orderkey % 1024) AS BIGINT) AS one, CAST(-o_custkey - 1 AS BIGINT) AS complement FROM orders"""
)
def bitwise_ops(spark, sf_dir):
    a, b = numbers.integer(F.col("o_custkey")), numbers.integer(F.col("o_orderkey") % 1024)
    f = {"both": numbers.bit_and(a, b), "either": numbers.bit_or(a, b), "one": numbers.bit_xor(a, b), "complement": numbers.bit_not(a)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[v["i"].cast("bigint").alias(k) for k, v in f.items()])


@query(
    """SELECT p_partkey, upper(to_hex((p_partkey - 1000) & 4294967295)) AS hexadecimal, to_base((p_partkey - 1000) & 4294967295, 2) AS binary_digits, to_base((p_partkey - 1000) & 4294967295, 36) AS base36 FROM part"""
)
def cvrs_radix(spark, sf_dir):
    n = numbers.integer(F.col("p_partkey") - 1000)
    return table(spark, sf_dir, "part").select("p_partkey", numbers.in_radix(n, 16).alias("hexadecimal"), numbers.in_radix(n, 2).alias("binary_digits"), numbers.in_radix(n, 36).alias("base36"))


@query(
    """SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(CAST(o_orderkey AS FLOAT) AS DOUBLE) AS parted,
  CASE WHEN abs(o_totalprice * 100000) > 2147483647 THEN 'rangecheck' END AS error FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS o_totalprice FROM orders)"""
)
def cvi_cvr(spark, sf_dir):
    x = numbers.real(F.col("o_totalprice"))
    wide = numbers.to_integer(numbers.real(numbers.value(x) * 100000))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.to_integer(x)["i"].cast("bigint").alias("whole"), numbers.value(numbers.to_real(numbers.integer(F.col("o_orderkey")))).alias("parted"), wide["error"].alias("error"))


@query(
    """SELECT s.s_suppkey, c.c_custkey, s.s_acctbal > c.c_acctbal AS gt, s.s_acctbal >= c.c_acctbal AS ge, s.s_acctbal < c.c_acctbal AS lt, s.s_acctbal <= c.c_acctbal AS le,
  s.s_nationkey = c.c_nationkey AS eq, s.s_nationkey <> c.c_nationkey AS ne
FROM (SELECT s_suppkey, s_nationkey, CAST(s_acctbal AS FLOAT) AS s_acctbal FROM supplier) s JOIN (SELECT c_custkey, c_nationkey, CAST(c_acctbal AS FLOAT) AS c_acctbal FROM customer) c ON s.s_suppkey = c.c_custkey"""
)
def relational_ops(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    a, b = numbers.real(F.col("s_acctbal")), numbers.real(F.col("c_acctbal"))
    m, n = numbers.integer(F.col("s_nationkey")), numbers.integer(F.col("c_nationkey"))
    return rows.select("s_suppkey", "c_custkey", *[numbers.compare(a, b, k).alias(k) for k in ("gt", "ge", "lt", "le")], *[numbers.compare(m, n, k).alias(k) for k in ("eq", "ne")])


@query(
    """SELECT doc_id, strpos(text, 'the') > 0 AS found, length(CASE WHEN strpos(text, 'the') > 0 THEN substr(text, 1, strpos(text, 'the') - 1) ELSE text END) AS n_pre,
  md5(CASE WHEN strpos(text, 'the') > 0 THEN substr(text, strpos(text, 'the') + 3) END) AS post FROM documents"""
)
def string_search(spark, sf_dir):
    hit = lists.search(F.col("text"), "the")
    rows = table(spark, sf_dir, "documents").select("doc_id", hit.alias("s"))
    return rows.select("doc_id", F.col("s.found").alias("found"), F.length("s.pre").cast("bigint").alias("n_pre"), F.md5("s.post").alias("post"))


@query("SELECT doc_id, starts_with(text, 'The') AS found, md5(CASE WHEN starts_with(text, 'The') THEN substr(text, 4) ELSE text END) AS post FROM documents")
def string_anchorsearch(spark, sf_dir):
    hit = lists.anchor_search(F.col("text"), "The")
    return table(spark, sf_dir, "documents").select("doc_id", hit.alias("s")).select("doc_id", F.col("s.found").alias("found"), F.md5("s.post").alias("post"))


@query("SELECT doc_id, CASE WHEN length(text) >= 60 THEN substr(text, 11, 50) END AS part FROM documents")
def string_getinterval(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lists.string_interval(F.col("text"), 10, 50).alias("part"))


_STACKS = "SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS s FROM lineitem GROUP BY 1"


def _stacks(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("q"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["q"]).alias("s"))


def _text(stack):
    return F.concat_ws(" ", F.transform(stack, lambda x: x.cast("string")))


@query(
    f"""SELECT l_orderkey, array_to_string(CASE WHEN n < 3 THEN s ELSE list_concat(list_concat(s[1:n-3], s[n:n]), s[n-2:n-1]) END, ' ') AS rolled_up,
  array_to_string(CASE WHEN n < 3 THEN s ELSE list_concat(list_concat(s[1:n-3], s[n-1:n]), s[n-2:n-2]) END, ' ') AS rolled_down
FROM (SELECT *, len(s) AS n FROM ({_STACKS}))"""
)
def stack_roll(spark, sf_dir):
    s = F.col("s")
    return _stacks(spark, sf_dir).select("l_orderkey", _text(lists.roll(s, 3, 1)).alias("rolled_up"), _text(lists.roll(s, 3, -1)).alias("rolled_down"))


@query(
    f"""SELECT l_orderkey, s[n - 1]::DOUBLE AS under, array_to_string(s[1:n-1], ' ') AS popped, array_to_string(list_concat(s, s[n:n]), ' ') AS dupped,
  array_to_string(CASE WHEN n < 2 THEN s ELSE list_concat(s[1:n-2], [s[n], s[n-1]]) END, ' ') AS exchanged,
  array_to_string(list_concat(s, s[greatest(1, n-1):n]), ' ') AS copied, n AS depth FROM (SELECT *, len(s) AS n FROM ({_STACKS}))"""
)
def stack_index(spark, sf_dir):
    s = F.col("s")
    return _stacks(spark, sf_dir).select("l_orderkey", lists.index(s, 1).cast("double").alias("under"), _text(lists.pop(s)).alias("popped"), _text(lists.dup(s)).alias("dupped"), _text(lists.exch(s)).alias("exchanged"), _text(lists.copy(s, 2)).alias("copied"), F.size(s).cast("bigint").alias("depth"))


@query(
    f"""SELECT l_orderkey, CASE WHEN list_contains(s, 7) THEN list_position(list_reverse(s), 7) - 1 END::DOUBLE AS above,
  CASE WHEN list_contains(s, 7) THEN array_to_string(s[1:n - list_position(list_reverse(s), 7)], ' ') END AS cleared FROM (SELECT *, len(s) AS n FROM ({_STACKS}))"""
)
def stack_marks(spark, sf_dir):
    mark, s = F.lit(7).cast("bigint"), F.col("s")
    n = lists.count_to_mark(s, mark)
    return _stacks(spark, sf_dir).select("l_orderkey", n.cast("double").alias("above"), F.when(n.isNotNull(), _text(lists.clear_to_mark(s, mark))).alias("cleared"))


@query(f"SELECT l_orderkey, count(*) AS n, CAST(sum(x * x) AS BIGINT) AS squares, max(x) AS most FROM (SELECT l_orderkey, unnest(s) AS x FROM ({_STACKS})) GROUP BY 1")
def array_forall(spark, sf_dir):
    s = F.col("s")
    square = F.aggregate(s, F.lit(0).cast("bigint"), lambda acc, x: acc + x * x)
    return _stacks(spark, sf_dir).select("l_orderkey", F.size(s).cast("bigint").alias("n"), square.alias("squares"), F.array_max(s).alias("most"))


@query(
    f"""SELECT l_orderkey, CASE WHEN n >= 3 THEN array_to_string(s[2:3], ' ') END AS part,
  CASE WHEN n >= 3 THEN array_to_string(list_concat(list_concat(s[1:1], [0, -1]), s[4:n]), ' ') END AS overwritten FROM (SELECT *, len(s) AS n FROM ({_STACKS}))"""
)
def array_intervals(spark, sf_dir):
    s, part = F.col("s"), F.array(F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"))
    cut, put = lists.get_interval(s, 1, 2), lists.put_interval(s, 1, part)
    return _stacks(spark, sf_dir).select("l_orderkey", F.when(cut.isNotNull(), _text(cut)).alias("part"), F.when(put.isNotNull(), _text(put)).alias("overwritten"))


@query(
    """SELECT user_id, event_type, v AS value, first AS first_seq FROM (SELECT user_id, event_type, value AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k,
  min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events) WHERE k = 1"""
)
def dict_def_last_wins(spark, sf_dir):
    """A user's events as definitions: the last value of each key wins; partial aggregates, so no key is gathered."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.min("event_id").alias("first_seq"))


@query(
    """SELECT u.user_id, k.key, coalesce(own.value, wide.value) AS value, CASE WHEN own.value IS NOT NULL THEN 1 WHEN wide.value IS NOT NULL THEN 0 END::DOUBLE AS depth
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type AS key FROM events) k
LEFT JOIN (SELECT user_id, event_type, max(value) AS value FROM events WHERE value > 50 GROUP BY 1, 2) own ON own.user_id = u.user_id AND own.event_type = k.key
LEFT JOIN (SELECT event_type, max(value) AS value FROM events WHERE event_type <> 'error' GROUP BY 1) wide ON wide.event_type = k.key"""
)
def dict_where(spark, sf_dir):
    """Looks keys up in a user's own dictionary first, in the shared one below it second."""
    from ..operators.scopes import looked_up

    events = table(spark, sf_dir, "events")
    own = events.where("value > 50").groupBy("user_id", F.col("event_type").alias("key")).agg(F.max("value").alias("value")).withColumn("depth", F.lit(1.0))
    wide = events.where("event_type <> 'error'").groupBy(F.col("event_type").alias("key")).agg(F.max("value").alias("value")).withColumn("depth", F.lit(0.0))
    keys = events.select(F.col("event_type").alias("key")).distinct().agg(F.collect_set("key").alias("keys"))
    users = events.select("user_id").distinct()
    asked = users.join(F.broadcast(keys)).select("user_id", F.explode("keys").alias("key"))
    return looked_up(asked, [(own, ["user_id"]), (wide, [])])


@query(
    """SELECT c_custkey, round(0.3 * r + 0.59 * g + 0.11 * b, 6) AS gray, round(1 - r, 6) AS c, round(1 - g, 6) AS m, round(1 - b, 6) AS y FROM (
  SELECT c_custkey, (c_custkey % 11) / 10.0::DOUBLE AS r, (c_custkey % 7) / 6.0::DOUBLE AS g, (c_custkey % 5) / 4.0::DOUBLE AS b FROM customer)"""
)
def color_rgb_gray(spark, sf_dir):
    r, g, b = (F.col("c_custkey") % 11) / 10.0, (F.col("c_custkey") % 7) / 6.0, (F.col("c_custkey") % 5) / 4.0
    ink = geometry.rgb_to_cmyk(r, g, b)
    return table(spark, sf_dir, "customer").select("c_custkey", _r(geometry.rgb_to_gray(r, g, b), 6).alias("gray"), *[_r(ink[n], 6).alias(n) for n in "cmy"])


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, round(1 - least(1.0, c + k), 6) AS r, round(1 - least(1.0, m + k), 6) AS g, round(1 - least(1.0, y + k), 6) AS b,
  round(1 - least(1.0, 0.3 * c + 0.59 * m + 0.11 * y + k), 6) AS gray
FROM (SELECT *, l_discount * 10 AS c, l_tax * 10 AS m, (l_quantity - 1) / 49 AS y, l_discount AS k FROM lineitem)"""
)
def color_cmyk_rgb(spark, sf_dir):
    c, m, y, k = F.col("l_discount") * 10, F.col("l_tax") * 10, (F.col("l_quantity") - 1) / 49, F.col("l_discount")
    rgb = geometry.cmyk_to_rgb(c, m, y, k)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", *[_r(rgb[n], 6).alias(n) for n in "rgb"], _r(geometry.cmyk_to_gray(c, m, y, k), 6).alias("gray"))


@query(
    """SELECT c_custkey, round(CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (CASE WHEN (g - b) / (hi - lo) < 0 THEN (g - b) / (hi - lo) + 6 ELSE (g - b) / (hi - lo) END) / 6
   WHEN hi = g THEN ((b - r) / (hi - lo) + 2) / 6 ELSE ((r - g) / (hi - lo) + 4) / 6 END, 6) AS h,
  round(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END, 6) AS s, round(hi, 6) AS b, round(r, 6) AS back_r, round(g, 6) AS back_g, round(b, 6) AS back_b
FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT c_custkey, (c_custkey % 11) / 10.0::DOUBLE AS r, (c_custkey % 7) / 6.0::DOUBLE AS g, (c_custkey % 5) / 4.0::DOUBLE AS b FROM customer))"""
)
def color_hsb(spark, sf_dir):
    r, g, b = (F.col("c_custkey") % 11) / 10.0, (F.col("c_custkey") % 7) / 6.0, (F.col("c_custkey") % 5) / 4.0
    rows = table(spark, sf_dir, "customer").select("c_custkey", geometry.rgb_to_hsb(r, g, b).alias("x"))
    rows = rows.select("c_custkey", "x", geometry.hsb_to_rgb(F.col("x.h"), F.col("x.s"), F.col("x.b")).alias("z"))
    return rows.select("c_custkey", *[_r(F.col(f"x.{n}"), 6).alias(n) for n in "hsb"], *[_r(F.col(f"z.{n}"), 6).alias(f"back_{n}") for n in "rgb"])


@query(
    """SELECT c_custkey, round(CASE WHEN yy > 0.008856451679035631 THEN 116 * cbrt(yy) - 16 ELSE 116 * (yy / 0.12841854934601665 + 4.0 / 29.0) - 16 END, 3) AS l
FROM (SELECT c_custkey, (c_custkey % 101) / 100.0::DOUBLE AS yy FROM customer)"""
)
def color_lab(spark, sf_dir):
    y = (F.col("c_custkey") % 101) / 100.0
    lab = geometry.xyz_to_lab(y * 0.9505, y, y * 1.089, (0.9505, 1.0, 1.089))
    return table(spark, sf_dir, "customer").select("c_custkey", _r(lab["l"], 3).alias("l"))


@query(
    """SELECT c_custkey, round(2 * x - 3 * y + 10, 3) AS x, round(2 * y + 3 * x - 5, 3) AS y, round(x, 3) AS back_x, round(y, 3) AS back_y, round(13.0::DOUBLE, 3) AS det
FROM (SELECT c_custkey, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer)"""
)
def matrix_transform(spark, sf_dir):
    m = geometry.matrix(2.0, 3.0, -3.0, 2.0, 10.0, -5.0)
    rows = table(spark, sf_dir, "customer").select("c_custkey", m.alias("m"), F.col("c_acctbal").alias("x0"), F.col("c_nationkey").cast("double").alias("y0"))
    rows = rows.select("c_custkey", "m", geometry.applied(F.col("m"), F.col("x0"), F.col("y0")).alias("p"))
    rows = rows.select("c_custkey", "p", geometry.determinant(F.col("m")).alias("d"), geometry.applied(geometry.inverse(F.col("m")), F.col("p.x"), F.col("p.y")).alias("q"))
    return rows.select("c_custkey", _r(F.col("p.x"), 3).alias("x"), _r(F.col("p.y"), 3).alias("y"), _r(F.col("q.x"), 3).alias("back_x"), _r(F.col("q.y"), 3).alias("back_y"), _r(F.col("d"), 3).alias("det"))


@query(
    """SELECT user_id, round(exp(sum(ln(1 + value / 1000))), 4) AS a, count(*) AS n FROM events GROUP BY 1"""
)
def matrix_product(spark, sf_dir):
    """The product of each user's scalings in order of time."""
    scale = geometry.scaling(1 + F.col("value") / 1000, F.lit(1.0))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", scale.alias("m")))), lambda x: x["m"])
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(geometry.product(steps).alias("m"), F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", _r(F.col("m.a")).alias("a"), "n")


@query(
    """SELECT o_orderkey, xor(s1, s1 >> 15) AS r1, xor(s2, s2 >> 15) AS r2, s2 AS state FROM (SELECT o_orderkey, s1, (s1 * 977734693 + 458173539) & 2147483647 AS s2
 FROM (SELECT o_orderkey, ((CAST(o_orderkey AS BIGINT) & 2147483647) * 977734693 + 458173539) & 2147483647 AS s1 FROM orders))"""
)
def rand_lcg(spark, sf_dir):
    seed = F.col("o_orderkey").bitwiseAND(F.lit(numbers.MASK))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", numbers.rand_sequence(seed, 2).alias("r"), numbers.next_state(numbers.next_state(seed)).alias("state"))
    return rows.select("o_orderkey", F.get("r", F.lit(0)).alias("r1"), F.get("r", F.lit(1)).alias("r2"), "state")


@query("SELECT doc_id, upper(hex(encode(text))) AS encoded FROM documents")
def hex_encode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("encoded"))


@query("SELECT doc_id, lower(hex(encode(text))) AS written, text AS back FROM documents")
def writehexstring(spark, sf_dir):
    written = F.lower(F.hex(F.encode("text", "UTF-8")))
    return table(spark, sf_dir, "documents").select("doc_id", written.alias("written"), F.decode(F.unhex(written), "UTF-8").alias("back"))


