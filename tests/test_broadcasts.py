"""Tables that grow are not broadcast by sizes that Spark guesses."""

import re

import pytest

from tesseral.llm import names
from tesseral.operators import clusters, lookup
from tesseral.session import materialise

SYLLABLES = ["ba", "ke", "li", "mo", "tru", "shna"]


@pytest.fixture
def wide(spark):
    """Every table is small enough for a broadcast, if Spark decides."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1g")
    yield
    spark.conf.set(key, before)


def stages(monkeypatch, module):
    """Name and plan of each stage that the module stores."""
    plans, store = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name="stage": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or store(df, name))
    return plans


@pytest.mark.parametrize("of", [names.linked_pairs, names.name_members])
def test_names_are_not_broadcast(spark, wide, monkeypatch, of):
    monkeypatch.setattr(lookup, "FEW_ROWS", 0, raising=False)
    plans = stages(monkeypatch, names)
    family = [a + b + c for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES]
    rows = [(3 * i + k, "person", f"{given} {f.title()}") for i, f in enumerate(family) for k, given in enumerate(("Kate", "Katherine", "Robert"))]
    got = of(spark.createDataFrame(rows, "id long, kind string, text string"))
    plans.append(("out", got._jdf.queryExecution().executedPlan().toString()))
    assert got.count() == (len(family) if of is names.linked_pairs else len(rows))
    # only join_back broadcasts: its few hot keys
    back = "ids" if of is names.linked_pairs else "out"
    assert {name for name, plan in plans if "BroadcastHashJoin" in plan} <= {back}
    assert all(len(re.findall("BroadcastHashJoin", plan)) <= 2 for _, plan in plans)


def test_counted_tables_may_be_broadcast(spark, wide, monkeypatch):
    rows = spark.createDataFrame([(i, i % 40) for i in range(400)], "id long, k long")
    known = materialise(spark.createDataFrame([(k, -k, 10) for k in range(40)], "k long, v long, n long"))
    joins = lambda: re.findall(r"(\w+Join) ", lookup.join_back(rows, known, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString())
    few = joins()
    monkeypatch.setattr(lookup, "FEW_ROWS", 39, raising=False)
    assert few == ["BroadcastHashJoin"] * 3 and sorted(joins()) == ["BroadcastHashJoin", "BroadcastHashJoin", "SortMergeJoin"]


@pytest.mark.parametrize("edge_task", [clusters.EDGE_TASK, 0])
def test_cells_are_not_broadcast(spark, wide, monkeypatch, edge_task):
    monkeypatch.setattr(lookup, "FEW_ROWS", 0, raising=False)
    monkeypatch.setattr(clusters, "EDGE_TASK", edge_task)
    plans = stages(monkeypatch, clusters)
    rows = [(i, i // 3 * 0.4, 0.01 * (i % 3)) for i in range(90)] + [(90 + i, 0.0, 50.0 + 3 * i) for i in range(9)]
    got = clusters.density_clusters(spark.createDataFrame(rows, "id long, x double, y double"), "id", ["x", "y"], 0.5)
    plans.append(("out", got._jdf.queryExecution().executedPlan().toString()))
    assert got.count() == 90 and got.select("cluster").distinct().count() == 1
    assert [name for name, plan in plans if "BroadcastHashJoin" in plan] == []
