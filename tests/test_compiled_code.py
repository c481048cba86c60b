"""What the JVM has to compile, and what a task has to hold."""

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
# HotSpot leaves longer methods to the interpreter.
JIT_LIMIT = 8000


def longest_method(df):
    stages = df._jdf.queryExecution().debug().codegenToSeq().iterator()
    sizes = []
    while stages.hasNext():
        sizes.append(stages.next()._3().maxMethodCodeSize())
    return max(sizes)


def test_cost_view_is_compiled(spark):
    assert longest_method(queries()["V1_cost_daily_view"](spark, SF)) < JIT_LIMIT


def test_credit_types_build_no_credits_in_a_filter(spark):
    plan = queries()["P24_code_texts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "size(" not in plan


def test_usage_keeps_no_hash_table_of_counter_cells(spark):
    plan = queries()["K1_usage_from_samples"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    by_cell = [line for line in plan.splitlines() if "HashAggregate(keys=" in line and "grid#" in line.split("functions=")[0]]
    assert not by_cell
