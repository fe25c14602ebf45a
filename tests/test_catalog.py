import re

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from parlance.catalog.base import trade_graph, trade_lines
from parlance.operators.filters import with_endpoints

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    problem, *_ = compare(spark, con, QUERIES[name], SQL.get(name), SF)
    # A query may be empty on the smallest tables; that it is not on larger ones is checked there.
    assert problem in (None, "no rows"), problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture
def shuffled_joins(spark):
    """Joins as large tables have them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt(df, keys):
    return re.findall(rf"Exchange hashpartitioning\({keys}[^)]*?(\d+)\)", df._jdf.queryExecution().executedPlan().toString())


def test_trade_graph_is_dealt_once_by_node(shuffled_joins):
    nodes, edges = trade_graph(shuffled_joins, SF)
    # Two sides, each with one shuffle of the nodes and one of the edges; keys are made unique, texts are not compared.
    joined = with_endpoints(edges, nodes)
    assert len(dealt(joined, "res_id#[0-9]+L, (?:source|target)_id#")) == 4 and not dealt(joined, "res_id#[0-9]+L, id#")
    assert not any("part.parquet" in f for f in edges.inputFiles())
    assert nodes.count() == nodes.select("res_id", "id").distinct().count()
    told = with_endpoints(edges, nodes).groupBy("res_id", "src_text", "src_type", "type", "tgt_text", "tgt_type").count()
    lines = trade_lines(shuffled_joins, SF).groupBy("res_id", "src_text", "src_type", "type", "tgt_text", "tgt_type").count()
    assert told.exceptAll(lines).isEmpty() and lines.exceptAll(told).isEmpty()


def test_unify_exact_deals_lines_by_order(shuffled_joins):
    plan = QUERIES["unify_exact"](shuffled_joins, SF)
    # Mentions are counted where an order's lines lie; no mention is shuffled by its text and order.
    assert not dealt(plan, "text#[0-9]+, type#[0-9]+, res_id#") and len(dealt(plan, "res_id#[0-9]+L, (?=[0-9])")) == 1


def test_trade_graph_tasks_grow_with_its_lines(shuffled_joins):
    nodes, edges = trade_graph(shuffled_joins, SF, task_rows=500)
    n = -(-shuffled_joins.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    joined = with_endpoints(edges, nodes)
    # Nodes are dealt once for both sides, edges once for each.
    assert set(dealt(joined, "res_id#[0-9]+L, (?:id|source_id|target_id)#")) == {str(n)}
    assert len(dealt(joined, "res_id#[0-9]+L, (?:id|source_id|target_id)#")) == 4
    plain = with_endpoints(*reversed(trade_graph(shuffled_joins, SF)))
    assert joined.exceptAll(plain).isEmpty() and joined.count() == plain.count() > 0
