"""Queries that run programs made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages
from ..operators import programs as p
from ..sources.tables import table
from ..streaming.jobs import whole_jobs
from .registry import query


def _polylines(spark, sf_dir):
    """A program per order that strokes a line through (quantity, line number) of its items."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").cast("string").alias("x"), F.col("l_linenumber").cast("string").alias("y"))))
    steps = F.transform(rows, lambda r, i: F.concat_ws(" ", r["x"], r["y"], F.when(i == 0, "moveto").otherwise("lineto")))
    made = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.concat_ws(" ", steps), F.lit(" stroke showpage")).alias("program"))
    return p.programs(made, "l_orderkey", "program")


@query("SELECT l_orderkey, min(l_quantity) AS llx, min(l_linenumber)::DOUBLE AS lly, max(l_quantity) AS urx, max(l_linenumber)::DOUBLE AS ury FROM lineitem GROUP BY 1")
def program_bbox(spark, sf_dir):
    """Programs are run, and the boxes of what they painted are the answer."""
    points = p.path_points(p.ir_ops(p.run_programs(_polylines(spark, sf_dir), only=("ops",))))
    boxes = pages.bounding_boxes(points.select("program_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), ["program_id"])
    return boxes.select(F.col("program_id").cast("bigint").alias("l_orderkey"), "llx", "lly", "urx", "ury")


@query(
    """SELECT c_custkey, CAST(c_custkey * 3 - 7 AS VARCHAR) || ' ' || CAST((c_custkey * 3 - 7) // 5 AS VARCHAR) || ' ' || CAST((c_custkey * 3 - 7) % 5 AS VARCHAR) AS line, 'ok' AS outcome FROM customer"""
)
def program_arithmetic(spark, sf_dir):
    text = F.concat(F.col("c_custkey").cast("string"), F.lit(" 3 mul 7 sub dup =only ( ) print dup 5 idiv =only ( ) print 5 mod ="))
    runs = p.run_programs(p.programs(p.spread(table(spark, sf_dir, "customer").select("c_custkey")).withColumn("program", text), "c_custkey", "program"))
    lines = p.output_lines(runs).select("program_id", "line")
    return p.outcomes(runs).join(lines, "program_id").select(F.col("program_id").cast("bigint").alias("c_custkey"), "line", "outcome")


def _outcomes(parts):
    kind = F.col("p_size") % 4
    text = F.when(kind == 0, "1 2 add =").when(kind == 1, "1 0 div").when(kind == 2, "1 (a) add").otherwise("{ } loop")
    runs = p.run_programs(p.programs(p.spread(parts.select("p_partkey", "p_size")).withColumn("program", text), "p_partkey", "program"), p.Config(budget=20_000))
    return p.outcomes(runs).select(F.col("program_id").cast("bigint").alias("p_partkey"), "outcome", F.col("error_name").alias("error"))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ok' WHEN 3 THEN 'budget' ELSE 'error' END AS outcome, CASE p_size % 4 WHEN 1 THEN 'undefinedresult' WHEN 2 THEN 'typecheck' END AS error FROM part"""
)
def program_outcomes(spark, sf_dir):
    """Programs that end well, fail in two ways, or never end."""
    return _outcomes(table(spark, sf_dir, "part"))


@query(
    """SELECT user_id, string_agg(event_type || ' ' || CAST(n AS VARCHAR), ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"""
)
def program_dictionaries(spark, sf_dir):
    """A program per user counts its events in a dictionary."""
    bump = F.concat(F.lit("/"), F.col("event_type"), F.lit(" bump"))
    body = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", bump.alias("b")))), lambda x: x["b"]))
    head = "/d 5 dict def /bump { d 1 index known { d exch 2 copy get 1 add put } { d exch 1 put } ifelse } def "
    made = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit(head), body, F.lit(" d { exch =only ( ) print = } forall")).alias("program"))
    runs = p.run_programs(p.programs(made, "user_id", "program"))
    lines = p.output_lines(runs).groupBy("program_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("line"))).alias("counts"))
    return lines.select(F.col("program_id").cast("bigint").alias("user_id"), "counts")


@query(
    """SELECT l_orderkey, count(*) * 3 + 2 AS tokens, count(*) * 2 AS numbers, sum(l_quantity)::BIGINT + sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1"""
)
def program_tokens(spark, sf_dir):
    found = p.tokens(_polylines(spark, sf_dir))
    out = found.groupBy("program_id").agg(F.count(F.lit(1)).alias("tokens"), F.count("int_v").alias("numbers"), F.sum("int_v").alias("total"))
    return out.select(F.col("program_id").cast("bigint").alias("l_orderkey"), "tokens", "numbers", "total")


@query(
    """SELECT l_orderkey, 'q' AS kind, 0::BIGINT AS n FROM lineitem WHERE false UNION ALL SELECT l_orderkey, 'S', 1 FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'sa', 1 FROM lineitem GROUP BY 1"""
)
def program_op_counts(spark, sf_dir):
    """Operations by kind: stroke adjustment is stated once before the first stroke."""
    ops = p.ir_ops(p.run_programs(_polylines(spark, sf_dir), only=("ops",)))
    return ops.groupBy(F.col("program_id").cast("bigint").alias("l_orderkey"), F.col("op").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, md5(string_agg('(' || turn || ') ', '' ORDER BY turn)) AS said, count(*) AS pieces FROM conversations GROUP BY 1")
def program_jobs_in_pieces(spark, sf_dir):
    """Jobs that come in pieces are put together and run."""
    rows = table(spark, sf_dir, "conversations")
    cut = F.concat(F.lit("((\\()) 1 get pop (\\("), F.col("turn").cast("string"), F.lit("\\) ) print "))
    pieces = rows.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("chunk_no"), cut.cast("binary").alias("bytes"))
    runs = p.run_programs(whole_jobs(pieces))
    n = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pieces"))
    said = runs.select(F.col("program_id").cast("bigint").alias("conv_id"), F.md5("stdout").alias("said"))
    return said.join(n, "conv_id")


def _documents(orders):
    text = F.concat(F.lit("/Helvetica 12 selectfont 72 700 moveto ("), F.col("o_orderpriority"), F.lit(") show 72 72 "), F.col("o_custkey").cast("string"), F.lit(" 40 rectfill showpage"))
    out = p.distill(p.programs(p.spread(orders.select("o_orderkey", "o_custkey", "o_orderpriority")).withColumn("program", text), "o_orderkey", "program"))
    whole = F.expr("startswith(document, X'255044462D') and endswith(document, X'2525454F460A')")
    return out.select(F.col("program_id").cast("bigint").alias("o_orderkey"), "outcome", "pages", whole.alias("complete"))


@query("SELECT o_orderkey, 'ok' AS outcome, 1 AS pages, true AS complete FROM orders")
def program_documents(spark, sf_dir):
    """Programs as documents; each begins and ends as a document does."""
    return _documents(table(spark, sf_dir, "orders"))


def _round_trip(codec: str):
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
        back = p.encode_column(p.encode_column(docs, "doc_id", "bytes", codec), "doc_id", "bytes", codec, decode=True)
        return back.select("doc_id", F.md5("bytes").alias("digest"), F.octet_length("bytes").cast("bigint").alias("n"))

    run.__name__ = f"codec_{codec}"
    return query("SELECT doc_id, md5(text) AS digest, octet_length(encode(text))::BIGINT AS n FROM documents")(run)


for _codec in p.CODECS:
    _round_trip(_codec)
