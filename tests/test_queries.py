"""Every query that SQL can express has the rows of its SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from pagemill.operators import pages
from pagemill.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    db.sql("set TimeZone='UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        db.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    plain = lambda x: None if pd.isna(x) else x.item() if hasattr(x, "item") else x
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, small, name):
    got, expected = QUERIES[name](spark, small).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_a_key_with_many_rows(spark, tmp_path):
    n = 40_000
    events = spark.range(n).selectExpr("id AS event_id", "1L AS user_id", "timestamp_seconds(id) AS ts", "if(id % 4 = 0, 'buy', 'view') AS event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["program_dictionaries"](spark, str(tmp_path)).collect()] == [(1, f"buy {n // 4},view {n - n // 4}")]
    lines = spark.range(2 * n).selectExpr("7L AS l_orderkey", "id AS l_linenumber", "1L AS l_partkey", "1L AS l_suppkey", "1.0D AS l_extendedprice", "double(id % 50) AS l_quantity")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in QUERIES["program_bbox"](spark, str(tmp_path)).collect()] == [(7, 0, 0, 49, 2 * n - 1)]


@pytest.mark.parametrize("name, source", [("program_outcomes", "part"), ("program_documents", "orders")])
def test_no_row_is_left_out(spark, small, name, source):
    assert QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/{source}.parquet").count()


def test_a_long_chain_of_references(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(36)] + [("n36", "n30")], "`from` string, `to` string")
    found = pages.reached(spark.createDataFrame([("n0",)], "root string"), links).collect()
    assert sorted(r.node for r in found) == sorted(f"n{i}" for i in range(37))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_operator_has_a_case():
    from pagemill.plans.operator_cases import FAMILIES
    from pagemill.vm import fonts, interp, ops_data, ops_graphics, ops_io  # noqa: F401

    registered = {*interp.OPERATORS, *interp.GRAPHICS, *(x for names in interp.PROCSETS.values() for x in names)}
    named = {x for cases in FAMILIES.values() for names, _, _ in cases for x in names.split()}
    assert len(named) >= 314
    # ways to print and to reach a resource that the language has beside these
    assert registered - named <= {*"==only =only beginnotdefchar currenthalftone deletefile echo endnotdefchar filenameforall renamefile run sethalftone".split()}


FAR = [0, 1, 150, 1999, 2000, 2902, 4931, 5923, 43638, 99_999, 189_151, 255_806, 322_461, 359_999]


@pytest.mark.parametrize("name", ["program_arithmetic_ops", "program_paint_ops", "program_path_ops"])
def test_families_for_far_suppliers(spark, tmp_path, name):
    spark.createDataFrame([(k, k % 25) for k in FAR], "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    db.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(db.sql(SQL[name]).df())


def test_only_the_columns_that_are_wanted(spark):
    from pagemill.operators import programs as p

    made = p.programs(spark.createDataFrame([(1, "1 2 moveto 3 4 5 6 7 8 curveto [1 2] 3 setdash stroke 1 setgray 0 0 5 5 rectfill showpage"), (2, "1 0 div"), (3, "showpage")], "id int, program string"), "id", "program")
    whole, part = p.run_programs(made), p.run_programs(made, only=("ops", "outcome"))
    assert part.columns == ["program_id", "ops", "outcome"]
    assert part.orderBy("program_id").collect() == whole.select("program_id", "ops", "outcome").orderBy("program_id").collect()
    one = p.one_run(b"1 2 moveto 3 4 5 6 7 8 curveto [1 2] 3 setdash stroke 1 setgray 0 0 5 5 rectfill showpage", p.Config())
    assert [o.asDict(True) for o in whole.where("program_id = 1").first().ops] == [{k: o[k] for k in ("page_no", "seq", "op", "nums", "ref", "path")} for o in one["ops"]]
