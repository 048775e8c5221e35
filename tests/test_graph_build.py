"""The learning graph against one pair of pages at a time."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from tessera.operators import graph_build, relevance, shared
from tessera.plans import knowledge, retrieval
from tests.test_graph_text import greedy

SF = "/root/testdata/sf0.001"


def plain_graph(nodes, links, before, stated):
    kind, held = {n: t for n, t, _ in nodes}, {n: set(s) for n, _, s in nodes}
    links = {(a, b) for a, b in links if a != b and a in kind and b in kind}
    before = {(a, b) for a, b in before if a != b and a in kind and b in kind}
    near = {n: {b for a, b in links if a == n} | {a for a, b in links if b == n} for n in kind}
    pairs = {tuple(sorted(p)) for p in links | before}
    for src in set().union(*held.values()) - {None}:
        own = sorted(n for n in kind if src in held[n])
        stars = [n for n in own if kind[n] == "source"]
        pairs |= {tuple(sorted((s, n))) for s in stars for n in own if s != n} if stars else {p for k, n in enumerate(own) for p in [(n, m) for m in own[k + 1 : k + 4]]}
    said: dict = {}
    for n, o, forward, k in sorted(stated, key=lambda s: (-graph_build.RANKS.get(s[3], 0), s[0], not s[2])):
        if n != o and n in kind and o in kind and k in graph_build.RANKS:
            said.setdefault(tuple(sorted((n, o))), (k, n if forward else o))
    out = set()
    at = lambda t: relevance.TYPES.index(t) if t in relevance.TYPES else None
    for a, b in pairs | set(said):
        direct = ((a, b) in links) + ((b, a) in links)
        shared = len((held[a] & held[b]) - {None})
        common = sum(1 / math.log(max(2, len(near[z]))) for z in near[a] & near[b])
        affinity = 0.5 if None in (at(kind[a]), at(kind[b])) else relevance.AFFINITY[at(kind[a])][at(kind[b])]
        source, target = a, b
        if (a, b) in said:
            type_, first = said[a, b]
        elif (a, b) in before or (b, a) in before:
            type_, first = "prerequisite", a if (a, b) in before else b
        else:
            type_, first = "direct" if direct else "teaches" if shared and "source" in (kind[a], kind[b]) else "related", None
        if type_ == "prerequisite" and first == b:
            source, target = b, a
        out.add((source, target, type_, round(direct * 3 + shared * 4 + common * 1.5 + affinity, 2)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scored_graph(spark, seed):
    rng = random.Random(seed)
    nodes = [(n, rng.choice([*relevance.TYPES, "odd"]), rng.choice([[], ["s1"], ["s2", "s3"], ["s4", None]])) for n in range(40)]
    pair = lambda: (rng.randrange(43), rng.randrange(40))
    links, before = [pair() for _ in range(60)] + [(0, n) for n in range(40)], [pair() for _ in range(25)]
    stated = [(*pair(), rng.random() < 0.5, rng.choice([*graph_build.RANKS, "odd"])) for _ in range(40)]
    got = graph_build.scored_graph(
        spark.createDataFrame(nodes, "node long, type string, sources array<string>"), spark.createDataFrame(links, "a long, b long"), spark.createDataFrame(before, "a long, b long"), spark.createDataFrame(stated, "node long, other long, forward boolean, edge_type string")
    )
    rows = sorted(tuple(r) for r in got.collect())
    want = sorted(plain_graph(nodes, links, before, stated))
    assert [r[:3] for r in rows] == [w[:3] for w in want]
    assert all(abs(r[3] - w[3]) < 0.0101 for r, w in zip(rows, want, strict=True))


def test_built_graph(spark):
    scored = [tuple(r) for r in knowledge.scored_graph(spark, SF).collect()]
    assert {e[2] for e in scored} == {"prerequisite", "derives", "teaches", "applies_to", "scaffolds", "related", "direct"}
    ahead: dict = {}
    for s, t, k, _ in scored:
        if k == "prerequisite":
            ahead.setdefault(s, set()).add(t)

    def reaches(a, b):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for y in ahead.get(x, ()):
                if y == b:
                    return True
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return False

    free = [(s, t, "related", min(0.8, w)) if k == "prerequisite" and reaches(t, s) else (s, t, k, w) for s, t, k, w in scored]
    assert sorted(tuple(r) for r in knowledge.built_graph(spark, SF).collect()) == greedy(free, 8)


@pytest.mark.parametrize(("many", "few_rows"), [(64, 100_000), (3, 100_000), (64, 5)])
def test_stars_are_not_written(spark, monkeypatch, many, few_rows):
    """Pairs of a source with its own pages are made where they are read: all of them in files and shuffles filled the disk."""
    rng = random.Random(7)
    nodes = [(n, "source" if n % 10 == 0 else "concept", ["s1", "s2"] if n % 3 else ["s1"]) for n in range(120)]
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(60)] + [(n, 5) for n in range(0, 120, 2)] + [(n, 10) for n in range(30)]
    most, written = [], graph_build.written
    monkeypatch.setattr(graph_build, "MANY", many, raising=False)
    monkeypatch.setattr(shared, "FEW_ROWS", few_rows)

    def watched(df, name):
        table = written(df, name)
        most.append(table.count())
        return table

    monkeypatch.setattr(graph_build, "written", watched)
    edges = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, other long, forward boolean, edge_type string")
    got = graph_build.scored_graph(spark.createDataFrame(nodes, "node long, type string, sources array<string>"), spark.createDataFrame(links, "a long, b long"), *edges)
    rows, want = sorted(tuple(r) for r in got.collect()), sorted(plain_graph(nodes, links, [], []))
    assert [r[:3] for r in rows] == [w[:3] for w in want]
    assert all(abs(r[3] - w[3]) < 0.0101 for r, w in zip(rows, want, strict=True))
    assert many < 64 or max(most) < 900 < len(want)


def test_pairs_of_a_source_are_not_shuffled(spark):
    """Stars as large as their sources were sorted out by a shuffle of all pairs."""
    plan = retrieval.shared_source_pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
