"""Evidence for many questions against one question at a time."""

from __future__ import annotations

import random

import pytest

from tessera.operators import evidence


def plain_evidence(seeds, nodes, edges, said, budget, most):
    """One question: a list of pages, two rounds, every edge looked at."""
    title, size = {n: t for n, t, _ in nodes}, {n: s or 0 for n, _, s in nodes}
    rank = lambda k: evidence.PRIORITY.index(k) if k in evidence.PRIORITY else len(evidence.PRIORITY)
    pages, used, links, status = [], 0, set(), {"rounds": 0, "sufficient": False}

    def add(node, *more):
        nonlocal used
        if used >= budget or node in [p[0] for p in pages] or not size.get(node):
            return False
        limit = min(most, max(1, budget - used))
        cut = size[node] > limit
        chars = limit + len(evidence.CUT) if cut else size[node]
        if used + chars > budget:
            return False
        used += chars
        pages.append((node, *more, chars, cut))
        return True

    for node, match, score in sorted(seeds, key=lambda s: (not s[1], -(s[2] or 0), s[0]))[:8]:
        add(node, "seed", 0 if match else 1, score or 0.0)
    calls = False
    for number in (1, 2):
        status["rounds"] = number
        have = {p[0] for p in pages}
        best: dict = {}
        for s, t, kind, w in edges:
            for here, there in ((s, t), (t, s)):
                if w >= 0.45 and s != t and here in have and there not in have and there in title:
                    best[there] = min(best.get(there, (9e9,)), (-w, rank(kind), (s, t, kind)))
        front = sorted(best, key=lambda n: (best[n][0], best[n][1], title[n], n))[:36]
        if not front:
            break
        wanted: list = []
        if number in said:
            calls = True
            ids, enough = said[number]
            wanted = [n for n in ids if n in title]
            status["sufficient"] = enough and not wanted
        if not calls:
            wanted = front[:1]
        added = 0
        for node in [n for n in front if n in wanted]:
            if added < 4 and add(node, "graph", 2, -best[node][0]):
                added += 1
                links.add(best[node][2])
        if not added or used >= budget:
            break
    return [(k + 1, *p) for k, p in enumerate(pages)], links, {**status, "used": used, "exhausted": used >= budget}


@pytest.mark.parametrize("budget, most", [(20_000, 5_000), (900, 300), (100, 5_000)])
def test_evidence_is_that_of_one_question_at_a_time(spark, budget, most):
    rng = random.Random(budget)
    nodes = [(n, f"t{rng.randrange(30)}", rng.choice([0, None, 10, 200, 350, 6000])) for n in range(80)]
    edges = [(rng.randrange(85), rng.randrange(80), rng.choice([*evidence.PRIORITY, "odd"]), rng.choice([0.4, 0.45, 0.5, 0.9, 2.0])) for _ in range(250)]
    edges += [(0, n, "related", 0.6 + n / 1000) for n in range(1, 80)]  # a hub
    seeds = {q: [(rng.randrange(83), rng.random() < 0.3, rng.choice([None, 0.1, 0.5, 2.0])) for _ in range(rng.choice([0, 1, 3, 5, 12]))] for q in range(25)}
    said: dict = {q: {} for q in seeds}
    for q in range(0, 25, 2):
        for number in (1, 2)[: rng.randint(0, 2)]:
            said[q][number] = ([rng.randrange(85) for _ in range(rng.choice([0, 2, 60]))], rng.random() < 0.5)
    rows = [(q, number, n, enough) for q, by in said.items() for number, (ids, enough) in by.items() for n in (ids or [None])]
    frame = spark.createDataFrame
    given = (
        frame([(q,) for q in seeds] + [(None,)], "question long"),
        frame([(q, *s) for q, own in seeds.items() for s in own], "question long, node long, title_match boolean, score double"),
        frame(nodes, "node long, title string, size long"),
        frame(edges, "source long, target long, edge_type string, weight double"),
    )
    for use in (said, {q: {} for q in seeds}):
        told = frame(rows, "question long, round int, node long, sufficient boolean") if use is said else None
        found = evidence.collect_evidence(*given, told, page_budget=budget, max_page_size=most)
        pages, links = {q: [] for q in seeds}, {q: set() for q in seeds}
        for r in found.pages.orderBy("question", "place").collect():
            pages[r["question"]].append(tuple(r)[1:])
        for r in found.relations.collect():
            links[r["question"]].add(tuple(r)[1:])
        status = {r["question"]: r.asDict() for r in found.status.collect()}
        assert set(status) == set(seeds)
        for q in seeds:
            want = plain_evidence(seeds[q], nodes, edges, use[q], budget, most)
            assert (pages[q], links[q]) == want[:2]
            assert {k: status[q][k] for k in want[2]} == want[2]


def test_texts_are_cut(spark):
    pages = spark.createDataFrame([(1, 5, 5 + len(evidence.CUT), True), (1, 6, 3, False)], "question long, node long, chars long, cut boolean")
    texts = spark.createDataFrame([(5, "abcdefgh"), (6, "abc")], "node long, text string")
    assert {r["content"] for r in evidence.with_texts(pages, texts).collect()} == {"abcde" + evidence.CUT, "abc"}
