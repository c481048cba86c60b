"""What the entry registers, and the plans of the operators that stay with built-in expressions."""

import pytest

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_every_corpus_query_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in queries()
    assert {n for n in queries() if n.startswith("op")} - set(oracle_sql()) == {"op3_lm_scoring", "op6_token_counts", "op9_language_id"}


@pytest.mark.parametrize("name", ["op2_quality_rules", "op7_line_dedup", "op10_benchmark_decontamination"])
def test_native_operators_have_no_python(spark, name):
    text = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("PythonUDF", "EvalPython", "InArrow", "InPandas", "CartesianProduct"):
        assert bad not in text
