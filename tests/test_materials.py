"""Queries over atoms, bridges, highlights and found communities, on tables and small fixtures."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import communities
from tessera.plans import assessment, materials
from tessera.sources import adapters
from tests.test_candidates import greedy_bridges, near, plain_candidates
from tests.test_communities import members, plain_modularity, sequential_louvain

SF = "/root/testdata/sf0.001"


def plain_places(text, query, most=3):
    """By the regular expressions that say the same: the query itself, then its characters with any white space between."""
    if not query:
        return []
    exact = [m.span() for m in re.finditer(re.escape(query), text)][:most]
    bare = re.sub(r"\s+", "", query)
    loose = [m.span() for m in re.finditer(r"\s*".join(map(re.escape, bare)), text)] if bare else []
    if len(exact) < most:
        exact += [(a, b + len(text[b:]) - len(text[b:].lstrip())) for a, b in loose]
    return exact[:most]


CASES = [("a b  c ab c", "ab c"), ("abc abc abc abc", "abc"), ("ab", "abc"), ("", "a"), ("a", ""), ("a\n b", "a b"), (" x y ", "xy"), ("aaaa", "aa"), ("é è è", "éè"), ("a b", " ")]


@pytest.mark.parametrize("text, query", CASES)
def test_places(text, query):
    assert materials.places(text, query) == plain_places(text, query)


def test_highlights(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)] + [(0, "ab c"), (None, "x\ny"), (50, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, q) for k, (_, q) in enumerate(CASES)] + [(99, None)], "item_id long, query string")
    got = sorted(((r["item_id"], r["doc_id"], [tuple(p) for p in r["places"]]) for r in materials.highlights(docs, asked).collect()), key=repr)
    want = [(i, r["doc_id"], found) for r in docs.collect() if r["text"] for i, (_, q) in enumerate(CASES) if q.strip() and (found := plain_places(r["text"], q))]
    assert got == sorted(want, key=repr)


def test_candidates_of_documents(spark):
    texts, nodes = materials._atoms(spark, SF)
    atoms: dict = {}
    for r in nodes.orderBy("doc", "place").collect():
        atoms.setdefault(r["doc"], []).append((r["node"], r["label"], r["node_type"], None))
    found: dict = {}
    for r in materials.relation_candidates(spark, SF).orderBy("doc_id", "place").collect():
        found.setdefault(r["doc_id"], []).append((r["source"], r["target"], r["edge_type"], r["evidence"], r["score"], r["reason"]))
    short = [r for r in texts.collect() if len(r["text"] or "") < 3000 and r["doc"] in atoms][:40]
    assert len(short) > 5 and sum(len(found.get(r["doc"], [])) for r in short) > 20
    for r in short:
        got, want = found.get(r["doc"], []), plain_candidates(r["text"], atoms[r["doc"]])
        if len(want) < 48:
            near(sorted(got), sorted(want))
        assert len(got) == len(want)


def test_repaired_relations_keep_to_the_ontology(spark):
    rows = materials.repaired_relations(spark, SF).collect()
    assert len(rows) > 20 and {r["edge_type"] for r in rows} > {"related"}
    assert len({(r["doc_id"], r["source"], r["target"], r["edge_type"]) for r in rows}) == len(rows)


def test_bridges_of_parts(spark):
    edges = [(r["source"], r["target"], r["weight"]) for r in adapters.prerequisite_edges(spark, SF).collect()]
    parts = {r["p_partkey"]: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    offered = []
    for s, t, w in edges:
        if w == 1:
            names = [parts[x]["p_name"] for x in (s, t)]
            alike = names[0].split(" ")[0] == names[1].split(" ")[0]
            offered.append((s, t, "related", " / ".join(names) if alike else None, round(1 / (1 + abs(float(parts[s]["p_retailprice"]) - float(parts[t]["p_retailprice"])) / 100), 3), "ordered together"))
    want = {x[:2] for x in greedy_bridges(list(parts), [(s, t) for s, t, w in edges if w > 1], offered)}
    assert {(r["source"], r["target"]) for r in materials.component_bridges(spark, SF).collect()} == want and want


def test_found_communities(spark):
    edges = adapters.prerequisite_edges(spark, SF)
    plain = [(r["source"], r["target"], float(r["weight"])) for r in edges.collect()]
    found = materials.louvain_communities(spark, SF)
    got = members(found)
    assert plain_modularity(plain, got) >= 0.95 * plain_modularity(plain, sequential_louvain(plain))
    assert plain_modularity(plain, got) >= communities.modularity(edges, materials.propagated_communities(spark, SF)) - 1e-9
    rows = materials.found_communities(spark, SF).collect()
    assert {r["community"]: r["member_count"] for r in rows} == {c: list(got.values()).count(c) for c in set(got.values())}
    placed = sorted(rows, key=lambda r: int(r["label"].split()[1]))
    assert [r["member_count"] for r in placed] == sorted((r["member_count"] for r in rows), reverse=True)
    for r in rows:
        inside = sum(got[s] == got[t] == r["community"] for s, t, _ in plain)
        assert r["internal"] == inside and abs(r["cohesion"] - inside / max(1, r["member_count"] * (r["member_count"] - 1) / 2)) < 0.00051
    told = materials.community_insights(spark, SF).orderBy("place").collect()
    near_to = {x: {got[y] for s, t, _ in plain for y in ((t,) if s == x else (s,) if t == x else ())} for x in got}
    assert {r["title"]: r["score"] for r in told if r["insight_type"] == "bridge"} == {f"Bridge concept: {x}": 1.5 * len(c) for x, c in near_to.items() if len(c) >= 3}
    assert [r["score"] for r in told] == sorted((r["score"] for r in told), reverse=True)


def test_times_of_many_questions(spark, monkeypatch):
    """Microseconds of ten thousand attempts add up beyond a long."""
    rows = spark.range(10_000).select(F.lit(1).alias("user_id"), F.lit(2).alias("kc_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    monkeypatch.setattr(assessment, "attempts", lambda *_: rows)
    assert assessment.question_times(spark, SF).first()["total"] == float(sum(range(10_000)))
