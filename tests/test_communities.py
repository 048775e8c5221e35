"""Communities against sequential runs of the same methods."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, communities, shared
from tessera.sources import adapters

SF = "/root/testdata/sf0.001"


def planted(groups, size, inside, outside, seed=1):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b, float(rng.randint(1, 3))) for a, b in itertools.combinations(range(n), 2) if rng.random() < (inside if a // size == b // size else outside)]


def plain_modularity(edges, member):
    total, strength, inside = 0.0, defaultdict(float), 0.0
    for a, b, w in edges:
        total += 2 * w
        strength[member[a]] += w
        strength[member[b]] += w
        inside += 2 * w * (member[a] == member[b])
    return inside / total - sum(s * s for s in strength.values()) / total**2


def sequential_louvain(edges):
    """The method as it is usually run: node by node, then contracted, until nothing moves."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    member = {x: x for x in names}
    links = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        links[a][b] += w
        links[b][a] += w
    total = sum(w for row in links.values() for w in row.values())
    while True:
        of, k = {x: x for x in links}, {x: sum(row.values()) for x, row in links.items()}
        strength, moved, again = dict(k), False, True
        while again:
            again = False
            for x in sorted(links):
                to = defaultdict(float)
                for y, w in links[x].items():
                    if y != x:
                        to[of[y]] += w
                strength[of[x]] -= k[x]
                best = max([of[x], *sorted(to)], key=lambda c: to.get(c, 0.0) - k[x] * strength[c] / total)
                if to.get(best, 0.0) - k[x] * strength[best] / total > to.get(of[x], 0.0) - k[x] * strength[of[x]] / total + 1e-9:
                    of[x], moved, again = best, True, True
                strength[of[x]] += k[x]
        if not moved:
            return member
        member = {x: of[c] for x, c in member.items()}
        smaller = defaultdict(lambda: defaultdict(float))
        for a, row in links.items():
            for b, w in row.items():
                smaller[of[a]][of[b]] += w
        links = smaller


def plain_propagation(pairs, turns):
    """Labels after sweeps of two rounds; turns[round] are the nodes that may move in it."""
    label = {x: x for x in pairs}
    for sweep in range(communities.SWEEPS):
        changed = False
        for half in (0, 1):
            new = dict(label)
            for x in turns[2 * sweep + half]:
                votes = defaultdict(float)
                for y, w in pairs[x].items():
                    votes[label[y]] += w
                new[x] = min(votes, key=lambda c: (-votes[c], c != label[x], c))
            changed |= new != label
            label = new
        if not changed:
            break
    least: dict = {}
    for x in sorted(label):
        least.setdefault(label[x], x)
    return {x: least[c] for x, c in label.items()}


def members(found):
    return {r["node"]: r["community"] for r in found.collect()}


@pytest.mark.parametrize("edges", [planted(6, 15, 0.6, 0.02), planted(3, 20, 0.3, 0.05, 2), [(k, k + 1, 1.0) for k in range(30)]])
def test_louvain_is_as_good_as_a_sequential_run(spark, edges):
    df = spark.createDataFrame(edges, "source long, target long, weight double")
    found = communities.louvain(df)
    got = members(found)
    want = plain_modularity(edges, sequential_louvain(edges))
    assert plain_modularity(edges, got) >= 0.95 * want
    assert abs(communities.modularity(df, found) - plain_modularity(edges, got)) < 1e-9
    assert all(got[c] == c and c <= x for x, c in got.items())
    spread = df.repartition(7).select("source", "target", F.col("weight").cast("float").alias("weight"))
    assert members(communities.louvain(spread)) == got
    assert plain_modularity(edges, got) >= plain_modularity(edges, members(communities.label_propagation(df))) - 1e-9


def test_louvain_on_parts(spark):
    df = adapters.prerequisite_edges(spark, SF)
    edges = [(r["source"], r["target"], float(r["weight"])) for r in df.collect()]
    got = members(communities.louvain(df))
    assert plain_modularity(edges, got) >= 0.95 * plain_modularity(edges, sequential_louvain(edges)) > 0


def test_odd_graphs(spark):
    df = spark.createDataFrame([("a", "a", 2.0), ("b", "c", 1.0), ("c", "b", 1.0), (None, "b", 1.0), ("d", "zz", 5.0)], "source string, target string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,), ("a",)], "node string")
    assert members(communities.louvain(df, nodes)) == {"a": "a", "b": "b", "c": "b", "d": "d"}
    assert members(communities.label_propagation(df, nodes)) == {"a": "a", "b": "b", "c": "b", "d": "d"} or members(communities.label_propagation(df, nodes))["b"] == members(communities.label_propagation(df, nodes))["c"]
    for run in (communities.louvain, communities.label_propagation):
        assert members(run(df.limit(0))) == {}
        assert members(run(df.limit(0), nodes)) == {x: x for x in "abcd"}


@pytest.mark.parametrize("edges", [planted(5, 12, 0.6, 0.03, 4), [(0, k, 1.0) for k in range(1, 30)]])
def test_label_propagation_is_that_of_the_same_rounds(spark, edges):
    df = spark.createDataFrame(edges, "source long, target long, weight double")
    pairs = defaultdict(dict)
    for a, b, w in edges:
        pairs[a][b] = pairs[b][a] = w
    ids = spark.createDataFrame([(x,) for x in pairs], "node long")
    turns = {k: [r["node"] for r in ids.where(communities._turn("node", 0, k)).collect()] for k in range(2 * communities.SWEEPS)}
    assert members(communities.label_propagation(df, weight="weight")) == plain_propagation(pairs, turns)


def test_hubs_and_giants_are_joined_apart(spark, monkeypatch):
    """With every key counted as hot, results stay."""
    edges = planted(4, 10, 0.7, 0.05, 5)
    df = spark.createDataFrame(edges, "source long, target long, weight double")
    want = members(communities.louvain(df)), members(communities.label_propagation(df))
    monkeypatch.setattr(communities, "HOT_ROWS", 1)
    monkeypatch.setattr(communities, "hot_keys", lambda rows, key: __import__("tessera.operators.shared", fromlist=["hot_keys"]).hot_keys(rows, key, 1))
    assert (members(communities.louvain(df)), members(communities.label_propagation(df))) == want


def test_described(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "node long, community long")
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (9, 9)], "source long, target long")
    sizes = spark.createDataFrame([(3, 2), (2, 2)], "node long, size long")
    rows = {tuple(r) for r in communities.described(found, edges, sizes).collect()}
    assert rows == {(1, 3, 2, 0.667, 2), (9, 1, 1, 1.0, 9)}


@pytest.mark.parametrize("run", [communities.louvain, communities.label_propagation])
def test_a_round_moves_the_edges_once(spark, monkeypatch, run):
    """Rounds of joins that shuffled the edges six times each took too long over 27 million edges."""
    moves, observed = [], communities.observed

    def watched(df, name, **metrics):
        if "_go" in df.columns:
            moves.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(a#"))
        return observed(df, name, **metrics)

    monkeypatch.setattr(communities, "observed", watched)
    monkeypatch.setattr(shared, "TASK_ROWS", 100, raising=False)
    run(spark.createDataFrame(planted(4, 10, 0.7, 0.05, 5), "source long, target long, weight double"))
    assert max(moves) == 1


def test_blocks_of_pairs_stay_where_they_are(spark, monkeypatch):
    """Rounds that join all pairs took too long over 27 million edges; blocks, or one task, make the same ones."""
    edges = [(a * 7 - 20, b * 7 - 20, w) for a, b, w in planted(4, 10, 0.6, 0.05, 6)] + [(1, 1, 2.0), (1, 8, 0.5)]
    df = spark.createDataFrame(edges, "source long, target long, weight double")
    joined, of_joins = [], communities._settled
    monkeypatch.setattr(communities, "_settled", lambda *given: joined.append(1) or of_joins(*given))
    one = members(communities.louvain(df))
    monkeypatch.setattr(shared, "TASK_ROWS", 60)
    monkeypatch.setattr(blocks, "BLOCK_PAIRS", 60)
    several = members(communities.louvain(df))
    assert not joined
    monkeypatch.setattr(blocks, "BLOCK_PAIRS", 1)
    assert one == several == members(communities.louvain(df))
    assert joined
