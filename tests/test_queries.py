"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from lodestone.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = db.sql(Q.ORACLE_SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert ordered(tuple(x[c] for c in cols) for x in df.collect()) == ordered(tuple(x[k] for k in at) for x in r.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.QUERIES) == set(Q.ORACLE_SQL)
    assert entry.entry(spark).columns == ["order_id", "component", "value", "residual", "status"]


def test_one_scan_per_recipe_and_native_expressions(spark):
    plan = Q.QUERIES["xml_item_mapping"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    native = Q.QUERIES["accumulations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in native and "Python" not in native
    pruned = Q.QUERIES["dsl_arithmetic"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in pruned.split("ReadSchema")[1]


def test_extraction_without_errors_of_columns_has_no_shuffle(spark):
    from lodestone.plans.queries import BASIC, LINES, recipe, run

    docs = spark.range(3).selectExpr("id as doc", "'<Order id=\"1\"><Total>2</Total></Order>' as content")
    plan = run(spark, docs, recipe([*BASIC, LINES])).data._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_results_do_not_depend_on_partitions(spark):
    from lodestone.plans.queries import customer_xml, recipe, run

    docs = customer_xml(spark, SF)
    r = recipe([Q.BASIC[0]])
    few, many = (sorted((x.doc, x.record_num, x.order_id) for x in run(spark, docs.repartition(n), r).data.collect()) for n in (1, 7))
    assert few == many
