"""The driver's contract."""

import __spark_entry__ as entry


def test_every_query_has_a_name_and_sql_names_a_query():
    found, sql = entry.queries(), entry.oracle_sql()
    assert len(found) > 100 and set(sql) <= set(found) and all(map(callable, found.values()))


def test_flagship(spark, sf_dir):
    rows = entry.entry(spark)
    assert rows.count() > 0 and {"unit_id", "sys_id", "found", "q", "h"} <= set(rows.columns)


def test_plans_prune_columns(spark, sf_dir):
    plan = entry.queries()["q_conf_mean"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan
    plan = entry.queries()["q_interp_linear"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan.split("Window")[0] and "Window" in plan
