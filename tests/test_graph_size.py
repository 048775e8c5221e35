"""Graph operators whose tasks and shuffles grow no faster than the edges."""

from __future__ import annotations

import math
from itertools import combinations

from tessera.operators import graph, shared
from tessera.sources import adapters

SF = "/root/testdata/sf0.001"


def test_tasks_of_edges_grow_with_the_lines(spark, monkeypatch):
    """What a task sorts and groups has a bound, whatever the session's number of partitions."""
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    n = adapters.line_tasks(spark, SF)
    assert n == -(-adapters.table(spark, SF, "lineitem").count() // 100)
    assert adapters.prerequisite_edges(spark, SF).rdd.getNumPartitions() == n
    assert graph.both_ways(adapters.prerequisite_steps(spark, SF), n).rdd.getNumPartitions() == n


def test_common_neighbours_send_lists_and_no_wedges(spark):
    edges = [(0, k) for k in range(1, 40)] + [(a, b) for a, b in combinations(range(1, 40), 2) if (a * b) % 7 < 2] + [(5, 0), (3, 3), (50, 51)]
    found = graph.common_neighbours(spark.createDataFrame(edges, "source long, target long"))
    assert "array_intersect" in found._jdf.queryExecution().optimizedPlan().toString()
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(a, b): near[a] & near[b] for a in near for b in near[a] if a < b and near[a] & near[b]}
    got = {(r["a"], r["b"]): (r["common"], r["adamic_adar"]) for r in found.collect()}
    assert got.keys() == want.keys()
    for pair, both in want.items():
        assert got[pair][0] == len(both) and abs(got[pair][1] - sum(1 / math.log(len(near[z])) for z in both)) < 2e-6
