"""Every registered query of the engine against its SQL, or against brute force where it has none."""

from __future__ import annotations

import pytest

from tessera.operators import graph
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, same_as_sql, name):
    same_as_sql(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_queries_without_sql_have_tests_of_their_own():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {
        "connected_components", "pruned_graph", "circles_broken", "term_mentions", "cooccurring_terms", "near_terms", "relation_candidates", "repaired_relations", "component_bridges",
        "louvain_communities", "propagated_communities", "found_communities", "community_insights", "question_evidence", "built_graph",
    }


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)], [(k, k + 1) for k in range(40)], []])
def test_components(spark, edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = graph.connected_components(spark.createDataFrame(edges, "source long, target long"))
    assert {tuple(r) for r in got.collect()} == {(x, find(x)) for x in root}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
