"""Plans are what they should be: pruned and pushed down, aggregated in parts, without cross joins or Python in the hot path."""

import re

import pytest

from ravelin.operators import kpi, quality, why
from ravelin.plans.compile import compile_plan
from ravelin.plans.ir import Filter, Operation, QueryPlan
from ravelin.queries import KPIS, QUERIES, ROLES


def explained(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def orders(spark, data):
    return spark.read.parquet(f"{data}/orders.parquet")


def test_filters_and_columns_reach_the_scan(orders):
    p = explained(compile_plan(QueryPlan(Operation.SUM, "o_totalprice", (Filter("o_orderstatus", "=", "F"), Filter("o_totalprice", ">", 1000.0)), group_by="o_orderpriority"), orders))
    assert "EqualTo(o_orderstatus,F)" in p and "GreaterThan(o_totalprice,1000.0)" in p
    assert re.search(r"ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>", p)
    assert p.count("(1) Scan parquet") == 1 and "partial_sum" in p


def test_top_n_is_a_top_k(orders):
    p = explained(compile_plan(QueryPlan(Operation.TOP_N, "o_totalprice", subject="o_custkey", limit=5), orders))
    assert "TakeOrderedAndProject" in p


def test_profile_and_key_figures_read_a_table_once(spark, data, orders):
    assert len(re.findall(r"^\(\d+\) Scan parquet", explained(quality.profile(orders)), re.M)) == 2  # statistics, distinct values
    p = explained(kpi.evaluate({"orders": orders}, ROLES, KPIS[:5], "M"))
    assert len(re.findall(r"^\(\d+\) Scan parquet", p, re.M)) == 1


def test_breakdown_shuffles_groups_not_rows(orders):
    p = explained(why.breakdown(orders, "o_orderdate", "Y", "1996-01-01", "1997-01-01", "sum", "o_totalprice", ["o_orderpriority", "o_orderstatus"]))
    assert "partial_sum" in p and "Cartesian" not in p


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("backtest", "forecast_theta", "isolation_forest", "owner_assignment", "daily_plan", "model_scores", "cluster_customers", "segment_plane", "quality_findings", "column_roles", "insights", "variance_inflation", "why_drill_down", "chart_recommendations", "target_candidates", "leak_findings", "target_signals", "link_discovery")))
def test_no_python_and_no_cartesian_product(spark, data, name):
    p = explained(QUERIES[name](spark, data))
    assert not re.search(r"CartesianProduct|PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow", p)
