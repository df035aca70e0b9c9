"""Shapes of physical plans, and hot customers in the derived tree."""

import pytest

from riskloom.operators import graph, scan, summary
from riskloom.workload import corpus

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tree(spark):
    return corpus.source_files(spark, SF)


@pytest.mark.parametrize("profile", ["line", "span", "block"])
def test_content_scan_is_one_map_only_pass(tree, profile):
    plan = plan_of(scan.scan_content(tree, profile))
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_floor_removes_rules_from_the_plan(tree):
    plan = plan_of(scan.scan_security(tree, "line", "CRITICAL"))
    assert "echo" not in plan and "passthru" in plan


def test_listing_queries_read_only_paths(tree):
    plan = plan_of(summary.file_stats(tree, "line"))
    assert "ReadSchema: struct<path:string>" in plan


def test_hubs_need_one_shuffle(spark, tree):
    nodes = tree.select("path")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    plan = plan_of(graph.top_hubs(nodes, edges))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "TakeOrderedAndProject" in plan and "Join" not in plan


def test_in_degree_combines_before_the_shuffle(spark, tree):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    plan = plan_of(graph.in_degree(tree.select("path"), edges))
    assert "partial_sum" in plan


def test_hot_customer_is_split_into_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FILE_LINES", 7)
    monkeypatch.setattr(corpus, "RANK_RANGE", 10)
    spark.createDataFrame([(i,) for i in range(6)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, 3 if k % 3 else k % 6, "2000-01-01") for k in range(120)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    positions = corpus.numbered_orders(spark.read.parquet(f"{tmp_path}/orders.parquet")).collect()
    by_customer = {}
    for key, customer, _ in orders:
        by_customer.setdefault(customer, []).append(key)
    want = {(c, k): i + 1 for c, keys in by_customer.items() for i, k in enumerate(sorted(keys))}
    assert {(r.o_custkey, r.o_orderkey): r.pos for r in positions} == want
    files = corpus.derive_files(spark, str(tmp_path)).collect()
    assert len({f.path for f in files}) == len(files) == 6 + sum(
        (len(keys) - 1) // 7 for keys in by_customer.values()
    )
    assert max(f.content.count("\n") for f in files) < 30
