"""Rows are dealt to tasks by the rows of the table, where the session's shuffles have too few."""

import pytest

from quarrylight import queries
from quarrylight.proxies import Tables


@pytest.mark.parametrize("name", ["incremental_ownership", "ownership_runs"])
def test_tasks_grow_with_the_table(spark, small, monkeypatch, name):
    monkeypatch.setattr(Tables, "parts", lambda self, table, most_rows=0: 7)
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line and ("path#" in line or "l_partkey#" in line)]
    assert keys and sum(", 7)" in k for k in keys) >= len(keys) / 2
