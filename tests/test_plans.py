"""Scale guards on the physical plans of every registered query: no cross
product or nested-loop join, no Python evaluation, no row caps or sampling,
filters pushed into the scans."""

import os

import pytest

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "Sample", "GlobalLimit", "CollectLimit",
             "LocalLimit")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_physical_plans_are_scale_safe(spark):
    from expcurve.plans.catalog import queries

    bad = {}
    for name, fn in queries().items():
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        hits = [op for op in FORBIDDEN if op in plan]
        if hits:
            bad[name] = hits
    assert not bad


def formatted(spark, df) -> str:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stored_query_filters_reach_the_scan(spark):
    from expcurve.plans.catalog import queries

    plan = formatted(spark, queries()["new_vintage_generation"](spark, SF))
    assert "StringContains(sector,elec_)" in plan and "Not(StringContains(sector,water_td))" in plan
    assert "ReadSchema: struct<scenario:string,region:string,sector:string" in plan
    plan = formatted(spark, queries()["path_cooling_generation"](spark, SF))
    assert "StringStartsWith(sector,elec_)" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_fact_table_is_never_broadcast(spark):
    from expcurve.sources.testdata import TestDomain

    d = TestDomain(spark, SF, materialize=False)
    plan = d.base._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    # the lineitem scan feeds a shuffle, not a broadcast
    li = [i for i, line in enumerate(plan.splitlines()) if "lineitem.parquet" in line]
    assert li
    above = plan.splitlines()[max(0, li[0] - 3):li[0]]
    assert not any("BroadcastExchange" in line for line in above)


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan: str, table: str) -> int:
    """Scans of a stored table in an executed plan; what is reused is listed without its scan."""
    final = plan.split("\n+- == Initial Plan ==")[0]
    return sum("FileScan parquet" in line and f"/{table}]" in line for line in final.splitlines())


@pytest.fixture(scope="module")
def ctx(spark):
    from expcurve.plans.catalog import Ctx

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return Ctx(spark, SF)


def test_calibration_scans_each_fact_once(ctx):
    plan = final_plan(ctx.calibration().adders)
    assert scans(plan, "input_costs") == 1 and scans(plan, "capacity_factors") <= 2
    assert plan.split("\n+- == Initial Plan ==")[0].count("Exchange hashpartitioning") <= 6


def test_generation_union_is_one_scan(ctx):
    from expcurve.operators.techmap import generation_union

    plan = final_plan(generation_union(ctx.d.outputs, ctx.d.cooling_tech_map))
    assert scans(plan, "outputs") == 1 and "Union" not in plan


def test_update_has_one_vintage_chain(ctx):
    plan = final_plan(ctx.cost_update_one_period(1999))
    assert scans(plan, "outputs") == 1 and scans(plan, "capacity_factors") == 2   # vintages and the next period


def test_component_sums_are_partial_before_the_exchange(ctx):
    from expcurve.operators import capacity as C

    plan = C.component_rollup(ctx.capacity(), ctx.params["deployment_map"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "REPARTITION" not in plan


def test_plans_are_built_without_jobs(ctx):
    """Year lists are scalar subqueries: building a query runs nothing."""
    tracker = ctx.d.spark.sparkContext.statusTracker()
    ctx.calibration_params()                       # stored tables are written on first use
    group = "plan-building"
    ctx.d.spark.sparkContext.setJobGroup(group, group)
    try:
        built = [ctx.learned_components(), ctx.cost_update()]
        assert tracker.getJobIdsForGroup(group) in ([], ()) and len(built) == 2
    finally:
        ctx.d.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_fuel_sums_shuffle_once_and_pivots_once_more(spark):
    from expcurve.plans.catalog import queries

    for name, most in (("generation_by_fuel", 2), ("diff_to_reference", 3), ("diff_pair", 3)):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most, name
