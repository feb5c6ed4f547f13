"""A query for each family of operators: every case of it, run for every supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import programs as p
from ..sources.tables import table
from .operator_cases import DOCUMENTS, DUMPS, FAMILIES
from .registry import query


def said(runs):
    """(program_id, said): lines of output, '!' and the error's name, and the operations of pages, '/' between pages."""
    printed = F.regexp_replace(F.trim(F.decode("stdout", "ISO-8859-1"), F.lit("\n")), "\n", " ")
    error = F.when(F.col("outcome") != "ok", F.concat(F.lit("!"), F.coalesce("error_name", "outcome")))
    by_page = F.transform(F.col("pages"), lambda x: F.concat_ws(" ", F.transform(F.filter("ops", lambda o: o["page_no"] == x["page_no"]), lambda o: o["op"])))
    pages = F.when(F.size("pages") > 0, F.concat(F.lit("|"), F.concat_ws("/", by_page))).otherwise(F.lit(""))
    text = F.concat_ws(" ", F.when(printed != "", printed), error)
    return runs.select("program_id", F.concat(text, pages).alias("said"))


def _sql(cases) -> str:
    each = [f"SELECT s_suppkey, {k} AS no, '{names.replace(chr(39), chr(39) * 2)}' AS operators, CAST({sql} AS VARCHAR) AS said FROM s" for k, (names, _, sql) in enumerate(cases)]
    return "WITH s AS (SELECT s_suppkey, s_suppkey + 1 AS a, s_nationkey AS b FROM supplier) " + " UNION ALL ".join(each)


def _made(spark, sf_dir, cases):
    """(program_id, bytes) of every case for every supplier."""
    rows = p.spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"))
    filled = lambda text: F.replace(F.replace(F.lit(text), F.lit("@a"), (F.col("s_suppkey") + 1).cast("string")), F.lit("@b"), F.col("s_nationkey").cast("string"))
    made = rows.select("s_suppkey", F.posexplode(F.array(*[filled(case[1]) for case in cases])).alias("no", "program"))
    return p.programs(made.withColumn("program_id", F.concat_ws(":", "s_suppkey", "no")), "program_id", "program")


def _told(out, cases):
    """(s_suppkey, no, operators, said) of (program_id, said)."""
    part = F.split("program_id", ":")
    no = part[1].cast("int")
    return out.select(part[0].cast("bigint").alias("s_suppkey"), no.alias("no"), F.element_at(F.array(*[F.lit(case[0]) for case in cases]), no + 1).alias("operators"), "said")


def _family(name: str, cases) -> None:
    def run(spark, sf_dir):
        return _told(said(p.run_programs(_made(spark, sf_dir, cases), only=("outcome", "error_name", "stdout", "pages", "ops"))), cases)

    run.__name__ = f"program_{name}_ops"
    run.__doc__ = f"What the operators of the family {name} say."
    query(_sql(cases))(run)


for _name, _cases in FAMILIES.items():
    _family(_name, _cases)


@query(_sql(DUMPS))
def program_dumps(spark, sf_dir):
    """Whole pages as canonical text, for each kind of operation and resource."""
    pages = F.array_join(F.transform("pages", lambda x: F.replace(F.trim(x["ir"], F.lit("\n")), F.lit("\n"), F.lit(";"))), "/")
    return _told(p.run_programs(_made(spark, sf_dir, DUMPS), only=("pages",)).select("program_id", pages.alias("said")), DUMPS)


@query(_sql([(what, program, sql) for what, program, _, sql in DOCUMENTS]))
def program_document_parts(spark, sf_dir):
    """Parts of the documents that programs become."""
    out = p.distill(_made(spark, sf_dir, DOCUMENTS), p.Config(compress=False))
    text = F.decode("document", "ISO-8859-1")
    no = F.split("program_id", ":")[1].cast("int")
    found = F.coalesce(*[F.when(no == k, F.regexp_extract(text, pattern, 1)) for k, (_, _, pattern, _) in enumerate(DOCUMENTS)])
    return _told(out.select("program_id", F.trim(F.regexp_replace(found, r"\s+", " ")).alias("said")), DOCUMENTS)


@query(
    "SELECT s_suppkey, 'cs' AS kind, 0 AS ref, 'DeviceRGB' AS \"text\" FROM supplier UNION ALL SELECT s_suppkey, 'font', 0, 'Courier' FROM supplier "
    "UNION ALL SELECT s_suppkey, 'font', 1, 'Times-Roman' FROM supplier UNION ALL SELECT s_suppkey, 'form', 0, 'bbox 0 0 ' || (s_suppkey + 1) || ' 10 {;  q;  m 0 0;  l ' || (s_suppkey + 1) || ' 0;  l ' || "
    "(s_suppkey + 1) || ' 10;  l 0 10;  h;  W n;  m 0 0;  l 5 0;  l 5 5;  l 0 5;  h;  f;  Q;}' FROM supplier UNION ALL SELECT s_suppkey, 'img', 0, '8x1 bpc=1 cs=mask decode=[1 0] 1 bytes' FROM supplier"
)
def program_resources(spark, sf_dir):
    """What pages use, one row each."""
    program = (
        "1 0 0 setrgbcolor 1 1 @a 2 rectfill /Courier @a selectfont 0 0 moveto (a) show /Times-Roman 9 selectfont (b) show 8 1 true [8 0 0 1 0 0] {<8F>} imagemask "
        "<< /FormType 1 /BBox [0 0 @a 10] /Matrix [1 0 0 1 0 0] /PaintProc {pop 0 0 5 5 rectfill} >> execform showpage"
    )
    found = p.page_resources(p.run_programs(_made(spark, sf_dir, [("all", program)])))
    return found.select(F.split("program_id", ":")[0].cast("bigint").alias("s_suppkey"), "kind", "ref", F.replace("text", F.lit("\n"), F.lit(";")).alias("text"))
