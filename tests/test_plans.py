"""Plans that must not grow in the driver: what they read, and that nothing is broadcast for its file's size."""

import pytest

import __spark_entry__
from symlens.operators import places, store
from tests.test_queries import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_snapshot_of_a_root_reads_the_edges_once(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([("a", "b", "call"), ("a", "x", "call"), ("x", "b", "import"), ("x", "y", "call"), (None, "a", "call")], "caller_symbol_id string, callee_symbol_id string, edge_kind string").write.parquet(f"{path}/edges")
    spark.createDataFrame([("a", "file:///r/1"), ("a", "file:///r/1"), ("b", "file:///r/2"), ("x", "file:///o/1")], "symbol_id string, request_uri string").write.parquet(f"{path}/symbols")
    hot = spark.createDataFrame([("file:///r/1", 1.0)], "uri string, score double")
    edges = store.under_prefix(spark.read.parquet(f"{path}/symbols"), hot, spark.read.parquet(f"{path}/edges"), "file:///r/")[2]
    plan = _plan(edges)
    assert plan.count("/edges") == 1 and "Broadcast" not in plan
    assert sorted(map(str, edges.collect())) == sorted(f"Row(caller_symbol_id={a!r}, callee_symbol_id={b!r}, edge_kind={k!r})" for a, b, k in [("a", "b", "call"), ("a", "x", "call"), ("x", "b", "import"), (None, "a", "call")])


def test_figures_broadcast_nothing(spark, tmp_path):
    path = f"file://{tmp_path}"
    node = "file string, node_id string, lang string, type string, operators array<string>, lft long, rgt long, start_line long, start_char long, end_line long, end_char long"
    spark.createDataFrame([("u", "n", "lua", "function_declaration", [], 0, 5, 0, 0, 9, 9), ("u", "i", "lua", "if_statement", [], 1, 2, 3, 0, 4, 0)], node).write.parquet(f"{path}/nodes")
    spark.createDataFrame([("s", "u", 12, 2, 0), ("t", "u", 5, 2, 0)], "symbol_id string, uri string, kind long, start_line long, start_char long").write.parquet(f"{path}/symbols")
    out = places.with_metrics(spark.read.parquet(f"{path}/symbols"), spark.read.parquet(f"{path}/nodes"))
    assert sorted((r.symbol_id, r.cyclomatic_complexity, r.lines_of_code, r.nesting_depth) for r in out.collect()) == [("s", 2, 10, 1), ("t", None, None, None)]
    assert "Broadcast" not in _plan(out)


@pytest.mark.parametrize("name", ["graph_answer_edges", "graph_from_answers"])
def test_graphs_from_answers_broadcast_neither_symbols_nor_centres(spark, name):
    plan = _plan(__spark_entry__.queries()[name](spark, SF))
    # the number of parts, one row, is all that is broadcast
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
