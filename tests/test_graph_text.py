"""Pruning, mentions and places against brute force; streams and quotes on small fixtures."""

from __future__ import annotations

import random
import re

import pytest

from tessera.functions import grading, markup
from tessera.operators import cycles, ordering, relevance, shared
from tessera.plans import knowledge
from tessera.plans.retrieval import quotes_found
from tessera.sources import adapters

SF = "/root/testdata/sf0.001"


def greedy(edges, cap):
    """The pass as stated, one edge after the other."""
    degree, seen, out = {}, set(), []
    for s, t, kind, w in sorted(edges, key=lambda e: (-relevance.PRIORITY.get(e[2], 1), -e[3], e[0], e[1], e[2])):
        pair = (min(s, t), max(s, t))
        if pair in seen:
            continue
        if kind in relevance.ALWAYS or (degree.get(s, 0) < cap and degree.get(t, 0) < cap):
            seen.add(pair)
            out.append((s, t, kind, w))
            for x in pair:
                degree[x] = degree.get(x, 0) + 1
    return sorted(out)


@pytest.mark.parametrize("cap", [2, 8])
def test_pruned(spark, cap):
    draw = random.Random(3)
    kinds = [*relevance.PRIORITY, "unknown"]
    pairs = {(min(a, b), max(a, b)) for a, b in ((draw.randrange(25), draw.randrange(25)) for _ in range(160)) if a != b}
    edges = [(a, b, draw.choice(kinds), float(draw.randrange(4))) for a, b in sorted(pairs)]
    got = relevance.pruned(spark.createDataFrame(edges, "source long, target long, edge_type string, weight double"), cap)
    assert sorted(tuple(r) for r in got.collect()) == greedy(edges, cap)


def test_pruned_graph_takes_every_edge(spark):
    """Edges of weight 1 were left out but for those of every fifth part."""
    kind = lambda s, t: "prerequisite" if s % 9 == 0 else "scaffolds" if t % 7 == 0 else "related"
    edges = [(r["source"], r["target"], kind(r["source"], r["target"]), float(r["weight"])) for r in adapters.prerequisite_edges(spark, SF).collect()]
    assert sorted(tuple(r) for r in knowledge.pruned_graph(spark, SF).collect()) == greedy(edges, 8)


@pytest.mark.parametrize("rows", [0, 20])
def test_pruning_by_rounds_and_at_once(spark, monkeypatch, rows):
    """Rounds go on while what is left doesn't fit a task; decided there or by rounds, the same edges stay."""
    monkeypatch.setattr(shared, "TASK_ROWS", rows)
    edges = [(f"n{a}", f"n{b}", "related" if (a + b) % 5 else "direct", float(a % 3)) for a in range(12) for b in range(a + 1, 12)]
    got = relevance.pruned(spark.createDataFrame(edges, "source string, target string, edge_type string, weight double"), 4)
    assert sorted(tuple(r) for r in got.collect()) == greedy(edges, 4)


def test_pruning_rounds_join_nothing(spark, monkeypatch):
    """What a round reads and writes is short, and it looks no edge up; held edges and shared weights change nothing."""
    rounds = []

    def observed(df, name, **metrics):
        if name == "prune-round":
            rounds.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return shared.observed(df, name, **metrics)

    monkeypatch.setattr(relevance, "observed", observed)
    draw = random.Random(4)
    edges = sorted({(draw.randrange(20), draw.randrange(20), draw.choice(["related", "scaffolds", "direct"]), 1.0) for _ in range(150)})
    edges = [e for k, e in enumerate(edges) if e[0] != e[1] and not any({e[0], e[1]} == {f[0], f[1]} for f in edges[:k])]
    table = spark.createDataFrame(edges, "source long, target long, edge_type string, weight double")
    assert sorted(tuple(r) for r in relevance.pruned(table, 3).collect()) == greedy(edges, 3)
    assert rounds and all("Join" not in plan and "edge_type" not in columns for columns, plan in rounds)
    held = [(0, 99, "direct", 9.0), (0, 98, "direct", 9.0)]
    got = relevance.pruned(table, 3, spark.createDataFrame([(0, 2)], "node long, n long"))
    assert sorted([*(tuple(r) for r in got.collect()), *held]) == greedy([*edges, *held], 3)


@pytest.mark.parametrize("n_edges", [0, 12, 30])
def test_circles(spark, n_edges):
    draw = random.Random(n_edges)
    edges = sorted({(draw.randrange(15), draw.randrange(15)) for _ in range(n_edges)})
    reach = {a: {a} for a in range(15)}
    for _ in range(15):
        for a, b in edges:
            for seen in reach.values():
                if a in seen:
                    seen.add(b)
    want = {(a, min(b for b in reach[a] if a in reach[b])) for a in range(15) if any(b != a and a in reach[b] for b in reach[a])}
    rows = spark.createDataFrame(edges, "source long, target long")
    assert {tuple(r) for r in cycles.circles(rows).collect()} == want
    kinds = [(a, b, "related" if k % 5 == 0 else "prerequisite", 2.0) for k, (a, b) in enumerate(edges)]
    got = cycles.without_circles(spark.createDataFrame(kinds, "source long, target long, edge_type string, weight double")).collect()
    assert len(got) == len(kinds)


def spans(text, labels):
    found = [(m.start(), m.start() + len(x), x) for x in labels for m in re.finditer(re.escape(x), text)]
    return [(a, x) for a, b, x in found if not any(len(y) > len(x) and c <= a and b <= d for c, d, y in found)]


def test_mentions_and_nearest_pairs(spark):
    draw = random.Random(5)
    labels = ["ab", "abc", "ca", "bcab", "dd"]
    texts = [(k, "".join(draw.choice("abcd ") for _ in range(120))) for k in range(20)] + [(20, ""), (21, None), (22, "abcab")]
    places = relevance.mentions(spark.createDataFrame(texts, "doc_id long, text string"), labels, ["doc_id"])
    want = {(k, x, a) for k, t in texts for a, x in spans(t or "", labels)}
    assert {(r["doc_id"], r["label"], r["start"]) for r in places.collect()} == want
    pairs = {}
    for k, _ in texts:
        mine = [(x, a) for kk, x, a in want if kk == k]
        for x, a in mine:
            for y, b in mine:
                if labels.index(x) < labels.index(y):
                    pairs[k, x, y] = min(pairs.get((k, x, y), 10**9), abs(a - b))
    got = relevance.nearest_pairs(places, labels, ["doc_id"])
    assert {(r["doc_id"], r["a"], r["b"]): r["distance"] for r in got.collect()} == pairs


def test_positions(spark):
    rows = [(draw, k) for k, draw in enumerate(random.Random(1).choices("abc", k=200))]
    got = ordering.positions(spark.createDataFrame(rows, "g string, k long"), ["g", "k"]).collect()
    assert [(r["g"], r["k"]) for r in sorted(got, key=lambda r: r["position"])] == sorted(rows)
    assert sorted(r["position"] for r in got) == list(range(1, 201))


def test_quotes(spark):
    docs = [(1, "aa aa aa aa aa aa aa"), (2, "aaaa"), (3, "中文引用。中文"), (4, None), (5, "")]
    quotes = [(1, "aa"), (2, "中文"), (3, ""), (4, "none"), (5, "aa")]
    got = quotes_found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string"))
    assert {(r["item_id"], r["doc_id"]): list(r["places"]) for r in got.collect()} == {(1, 1): [1, 4, 7, 10, 13], (5, 1): [1, 4, 7, 10, 13], (1, 2): [1, 3], (5, 2): [1, 3], (2, 3): [1, 6]}


def test_markup_edges(spark):
    from pyspark.sql import functions as F

    one = lambda text, what: spark.createDataFrame([(text,)], "t string").select(what(F.col("t")).alias("x")).first()["x"]
    assert one("no front", markup.body) == "no front" and one("---\na: b\n---\nrest", markup.body) == "rest"
    assert one("A [7] B [1] C [2][8]", markup.renumbered)["text"] == "A [1] B [2] C [3][4]"
    assert one("Hello, World!", markup.anchor) == "hello-world" and one("  ", markup.anchor) == "section"
    assert one("$$ x $$ and $$ open", markup.inline_math) == "$x$ and $$ open"
    assert one("二十三", grading.numeral) == 23 and one("十", grading.numeral) == 10 and one("x", grading.numeral) is None


def test_mentions_stay_in_their_task_and_are_given_in_parts(spark, monkeypatch):
    """No place is shuffled or written to see what lies in what, and a task holds few places at once."""
    monkeypatch.setattr(relevance, "PLACES", 3)
    texts = spark.createDataFrame([(k, "there the others er " * 2) for k in range(5)], "doc_id long, text string").coalesce(1)
    found = relevance.mentions(texts, ["the", "there", "er", "ere"], ["doc_id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "Join" not in plan
    got = sorted((r["label"], r["start"]) for r in found.where("doc_id = 3").collect())
    assert got == [("er", 13), ("er", 17), ("er", 33), ("er", 37), ("the", 6), ("the", 11), ("the", 26), ("the", 31), ("there", 0), ("there", 20)]
    assert found.count() == 50
