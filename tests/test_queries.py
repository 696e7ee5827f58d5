"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from quillspan import fixtures, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith("runs_tree_filter") or n == "runs_trace_filter"))
def test_tree_filters_link_the_runs_once_and_join_nothing(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapIn") <= 1


@pytest.mark.parametrize("name", ["runs_tree_filter_filtered_only_child", "runs_tree_filter_child", "runs_tree_filter_most_relevant_root", "runs_tree_filter_most_relevant", "runs_tree_filter_most_relevant_child", "runs_tree_filter_most_relevant_descendant"])
def test_tree_filters_shuffle_once_and_link_no_trace_in_vain(spark, name):
    """From the tables to the keys: one shuffle by trace; the second window leaves out traces where no hit can count."""
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 2
    assert plan.index("MapInArrow") < plan.index("Filter (isnotnull(_linked") < plan.index("Exchange hashpartitioning")


def test_tree_events_are_all_orders_and_grouped_lines(spark, tmp_path):
    """Orders aren't grouped; null keys, flags and days stay apart from other rows."""
    day = lambda d: f"timestamp_ntz'1970-01-0{d + 1}'"
    orders = [(1, "'F'", day(1)), (1, "'O'", day(2)), (2, "null", "null"), ("null", "'P'", day(1))]
    lines = [(1, 1, "'R'", day(3)), (1, 1, "'A'", day(4)), (1, 2, "null", "null"), (1, 0, "'N'", day(1)), (2, "null", "'R'", day(1)), ("null", 3, "'R'", day(1))]
    for table, columns, rows_ in (("orders", "o_orderkey, o_orderstatus, o_orderdate", orders), ("lineitem", "l_orderkey, l_linenumber, l_returnflag, l_shipdate", lines)):
        values = ", ".join(f"({', '.join(map(str, r))})" for r in rows_)
        spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})").write.parquet(f"{tmp_path}/{table}.parquet")
    got = fixtures.tree_events(spark, str(tmp_path)).selectExpr("trace_id", "span_id", "parent_span_id", "name", "start_time_unix_nano div 86400000000000", "run_type", "project_name").collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(
        [("o1", "l0", None, "order-F", 1), ("o1", "l0", None, "order-O", 2), ("o2", "l0", None, None, None), (None, "l0", None, "order-P", 1),
         ("o1", "l1", "l0", "line-A", 3), ("o1", "l2", "l0", None, None), ("o1", "l0", "l0", "line-N", 1), ("o2", None, None, "line-R", 1), (None, "l3", "l1", "line-R", 1)], key=repr)
    assert {(r["run_type"], str(r["name"])[:4]) for r in got} == {("chain", "orde"), ("chain", "None"), ("tool", "line"), ("tool", "None")} and {r["project_name"] for r in got} == {"orders"}


def test_entry_module_names_every_query():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_wanted_conditions_reach_the_scan(spark, tmp_path):
    """A typed condition over a written heads table is pushed down, and unread columns are pruned."""
    from quillspan.plans import runs

    path = str(tmp_path / "heads")
    queries.metric_heads(spark, DATA).write.parquet(path)
    q = runs.RunQuery(["flag-A"], run_type="llm", limit=5)
    plan = runs.list_runs(spark.read.parquet(path), q)._jdf.queryExecution().toString()
    assert "EqualTo(run_type,llm)" in plan and "TakeOrderedAndProject" in plan
    assert "attributes_json#" not in plan.split("ReadSchema")[1] and "total_cost" not in plan.split("ReadSchema")[1]
