"""Queries that join search with the graph: fusion of hits, expansion over edges, related pages, frontiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans import retrieval
from tessera.sources.adapters import PAGE_EDGES_SQL, page_edges, table, wiki_pages

#: The hits that are expanded, neighbours for each, and the least weight of an edge that leads to one.
SEEDS, NEIGHBOURS, RELEVANT = 10, 3, 0.5
#: Other names of edge types; what is not listed is related.
ALIASES = {"prerequisite": "prerequisite", "direct": "related", "source": "related", "related": "related", "teaches": "teaches", "enables": "enables", "scaffolds": "scaffolds", "applies_to": "applies_to", "derives": "derives"}
#: Edge types in order of preference; others come last.
PRIORITY = ["prerequisite", "teaches", "enables", "derives", "applies_to", "scaffolds", "related", "direct", "source"]
_H = f"""
kw AS ({retrieval.SQL['keyword_search']}), vt AS ({retrieval.SQL['vector_topk']}),
vs AS (SELECT 'doc/' || vec_id || '.md' AS path, greatest(0.0::DOUBLE, least(1.0::DOUBLE, similarity)) AS s, row_number() OVER (ORDER BY similarity DESC, vec_id) - 1 AS i FROM vt),
hy AS (SELECT path, coalesce(kw.score, 0.0::DOUBLE) + coalesce(round(s * 5, 3), 0.0::DOUBLE) AS score, round(s, 3) AS vector_score, coalesce(title_match, false) AS title_match FROM kw FULL JOIN vs USING (path))"""
SQL: dict[str, str] = {}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, s): the nearest vectors as pages, similarities kept between 0 and 1."""
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity")))
    return retrieval.vector_topk(spark, sf_dir).select(F.concat(F.lit("doc/"), F.col("vec_id").cast("string"), F.lit(".md")).alias("path"), near.alias("s"), "similarity", "vec_id")


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits and nearest vectors by path: five times the similarity is added to a score, or makes one. 40 rows at most."""
    words = retrieval.keyword_search(spark, sf_dir).select("path", "score", "title_match")
    both = words.join(_vectors(spark, sf_dir).select("path", "s"), "path", "full")
    score = F.coalesce("score", F.lit(0.0)) + F.coalesce(F.round(F.col("s") * 5, 3), F.lit(0.0))
    return both.select("path", score.alias("score"), F.round("s", 3).alias("vector_score"), F.coalesce("title_match", F.lit(False)).alias("title_match"))


SQL["hybrid_fusion"] = f"WITH {_H} SELECT * FROM hy"


def rag_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 pages that an answer starts from: nearest vectors by rank, and keyword hits at 0.7 of their score, these two up for all hits."""
    place = F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")) - 1  # 20 rows
    near = _vectors(spark, sf_dir).select("path", (15.0 - place * 0.5).alias("v"))
    words = retrieval.keyword_search(spark, sf_dir).orderBy(F.desc("score"), "path").limit(10).select("path", "score")
    score = F.coalesce("v", F.greatest(F.lit(1.0), F.col("score") * 0.7)) + F.when(F.col("score").isNotNull(), 2.0).otherwise(0.0)
    return near.join(words, "path", "full").select("path", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "path").limit(20)


SQL["rag_fusion"] = f"""WITH {_H}, k AS (SELECT path, score FROM kw ORDER BY score DESC, path LIMIT 10)
SELECT path, round(coalesce(15.0::DOUBLE - i * 0.5::DOUBLE, greatest(1.0::DOUBLE, k.score * 0.7::DOUBLE)) + CASE WHEN k.score IS NULL THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END, 6) AS score FROM vs FULL JOIN k USING (path) ORDER BY score DESC, path LIMIT 20"""


def expanded(hits: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, score, hop): ``hits`` (path, score, rank) and what edges lead to from the first SEEDS of these.

    Each hit takes, in order of rank, its NEIGHBOURS heaviest edges of at least RELEVANT to pages that
    are no hit and that none before it took. What others take can hide SEEDS * NEIGHBOURS edges at most,
    so each hit's edges up to that rank suffice, and the choice is made among some hundred rows.
    """
    found = hits.select("path", "score", "rank")
    node = lambda c: F.concat(F.lit("doc/"), F.col(c).cast("string"), F.lit(".md"))
    ways = edges.where(F.col("weight") >= RELEVANT).select(node("source").alias("a"), node("target").alias("b"), "weight")
    ways = ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    seeds = F.broadcast(found.where(F.col("rank") <= SEEDS))
    near = ways.join(seeds, F.col("a") == F.col("path")).select("rank", "score", "b", "weight").distinct()
    near = near.join(F.broadcast(found.select(F.col("path").alias("b"))), "b", "left_anti").join(pages.select(F.col("path").alias("b")), "b", "left_semi")
    most = SEEDS * NEIGHBOURS + 2 * NEIGHBOURS
    order = Window.partitionBy("rank").orderBy(F.desc("weight"), "b")
    near = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most * 2)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for _, mine in frame.sort_values(["rank", "k"]).groupby("rank"):
            free = mine[~mine["b"].isin(taken)].head(NEIGHBOURS)
            taken.update(free["b"])
            out.append(free)
        chosen = pd.concat(out) if out else frame
        return pd.DataFrame({"path": chosen["b"], "score": chosen["score"] * 0.5 + chosen["weight"], "hop": 1})

    new = near.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(choose, "path string, score double, hop int").withColumn("score", F.round("score", 2))
    return found.select("path", "score", F.lit(0).alias("hop")).unionByName(new)


def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits with the pages that the graph adds to them."""
    first = Window.orderBy(F.desc("score"), "path")  # 20 rows
    hits = retrieval.keyword_search(spark, sf_dir).select("path", "score").withColumn("rank", F.row_number().over(first))
    return expanded(hits, page_edges(spark, sf_dir), wiki_pages(spark, sf_dir)).withColumn("score", F.round("score", 2))


def _expand_sql(hits: str) -> str:
    return f"""{PAGE_EDGES_SQL}, ht AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM {hits}),
wy AS (SELECT source AS a, target AS b, weight FROM pe WHERE weight >= 0.5 UNION SELECT target, source, weight FROM pe WHERE weight >= 0.5),
nr AS (SELECT DISTINCT rank, score, 'doc/' || b || '.md' AS b, weight FROM ht JOIN wy ON path = 'doc/' || a || '.md' WHERE rank <= 10 AND b IN (SELECT doc_id FROM documents) AND 'doc/' || b || '.md' NOT IN (SELECT path FROM ht)),
li AS (SELECT rank, list(struct_pack(b := b, s := round(score * 0.5::DOUBLE + weight, 2)) ORDER BY weight DESC, b) AS l FROM nr GROUP BY rank),
st AS (SELECT 0::BIGINT AS i, []::STRUCT(b VARCHAR, s DOUBLE)[] AS taken UNION ALL
  SELECT i + 1, list_concat(taken, coalesce(list_filter(l, lambda x: NOT list_contains(list_transform(taken, lambda t: t.b), x.b))[1:3], [])) FROM st LEFT JOIN li ON rank = i + 1 WHERE i < 10),
nw AS (SELECT unnest(taken, recursive := true) FROM st WHERE i = 10)"""


SQL["graph_expand"] = f"WITH RECURSIVE kw AS ({retrieval.SQL['keyword_search']}), {_expand_sql('kw')} SELECT path, round(score, 2) AS score, 0 AS hop FROM ht UNION ALL SELECT b, s, 1 FROM nw"


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: hits fused, expanded over the graph, the 20 best."""
    first = Window.orderBy(F.desc("score"), "path")  # 40 rows
    hits = hybrid_fusion(spark, sf_dir).select("path", F.round("score", 6).alias("score")).withColumn("rank", F.row_number().over(first))
    found = expanded(hits, page_edges(spark, sf_dir), wiki_pages(spark, sf_dir))
    return found.orderBy(F.desc("score"), "hop", "path").limit(20)


SQL["hybrid_search"] = f"WITH RECURSIVE {_H}, hr AS (SELECT path, round(score, 6) AS score FROM hy), {_expand_sql('hr')} SELECT * FROM (SELECT path, score, 0 AS hop FROM ht UNION ALL SELECT b, s, 1 FROM nw) ORDER BY score DESC, hop, path LIMIT 20"


def related_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight pages most related to page 7: three for its source, four for a name or link in its text, two for its title in their beginning."""
    pages = wiki_pages(spark, sf_dir).withColumn("title", F.trim(F.substring("title", 1, 12)))
    mine = F.broadcast(pages.where("path = 'doc/7.md'").limit(1).select(F.col("path").alias("own"), F.col("title").alias("named"), F.col("content").alias("text"), F.col("source").alias("from")))  # one row
    link = F.concat(F.lit("[["), F.regexp_replace("path", r"\.md$", ""))
    rows = pages.join(mine, F.col("path") != F.col("own"))
    same = F.when(F.col("source") == F.col("from"), 3).otherwise(0)
    held = F.when(F.contains("text", link) | F.contains("text", F.col("title")), 4).otherwise(0)
    told = F.when((F.col("named") != "") & F.contains(F.substring("content", 1, 200), F.col("named")), 2).otherwise(0)
    return rows.select("path", "title", (same + held + told).alias("score")).where("score > 0").orderBy(F.desc("score"), "title", "path").limit(8)


SQL["related_pages"] = f"""WITH p AS (SELECT path, trim(substring(title, 1, 12)) AS title, content, source FROM ({retrieval._PAGES})), m AS (SELECT * FROM p WHERE path = 'doc/7.md'),
s AS (SELECT p.path, p.title, CASE WHEN p.source = m.source THEN 3 ELSE 0 END + CASE WHEN contains(m.content, '[[' || replace(p.path, '.md', '')) OR contains(m.content, p.title) THEN 4 ELSE 0 END + CASE WHEN m.title <> '' AND contains(substring(p.content, 1, 200), m.title) THEN 2 ELSE 0 END AS score FROM p, m WHERE p.path <> m.path)
SELECT path, title, score FROM s WHERE score > 0 ORDER BY score DESC, title, path LIMIT 8"""


def edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between known pages, by their types' own names, the least weights marked: (source, target, edge_type, weight, strong, shown_in_search, shown_in_answers)."""
    name = F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[F.col("kind")], F.lit("related"))
    known = table(spark, sf_dir, "documents").select("doc_id")
    edges = page_edges(spark, sf_dir).join(known.withColumnRenamed("doc_id", "target"), "target", "left_semi")
    strong = F.col("kind").isin("direct", "prerequisite") | (F.col("weight") >= 8)
    return edges.select("source", "target", "kind", name.alias("edge_type"), "weight", strong.alias("strong"), (F.col("weight") >= RELEVANT).alias("shown_in_search"), (F.col("weight") >= 0.45).alias("shown_in_answers"))


SQL["edge_types"] = f"""WITH {PAGE_EDGES_SQL} SELECT source, target, kind, CASE WHEN kind IN ('prerequisite', 'teaches', 'derives') THEN kind ELSE 'related' END AS edge_type, weight, kind IN ('direct', 'prerequisite') AS strong, weight >= 0.5 AS shown_in_search, weight >= 0.45 AS shown_in_answers
FROM pe WHERE target IN (SELECT doc_id FROM documents)"""


def evidence_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 36 pages next to what is chosen (pages 1 to 5) by the best edge to each: weight, then preferred types, then title."""
    chosen = [1, 2, 3, 4, 5]
    rank = F.coalesce(F.create_map(*[x for i, t in enumerate(PRIORITY) for x in (F.lit(t), F.lit(i))])[F.col("kind")], F.lit(len(PRIORITY)))
    edges = page_edges(spark, sf_dir).withColumn("priority", rank)
    out = edges.where(F.col("source").isin(chosen)).select(F.col("target").alias("node"), "kind", "weight", "priority")
    back = edges.where(F.col("target").isin(chosen)).select(F.col("source").alias("node"), "kind", "weight", "priority")
    best = out.unionByName(back).where(~F.col("node").isin(chosen)).groupBy("node").agg(F.max_by(F.struct("weight", "priority"), F.struct("weight", -F.col("priority"))).alias("e"))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    found = best.join(pages, "node", "left_semi").select("node", F.concat(F.lit("Page "), F.col("node").cast("string")).alias("title"), "e.weight", "e.priority")
    return found.orderBy(F.desc("weight"), "priority", "title").limit(36)


_RANK = "CASE kind " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(PRIORITY)) + f" ELSE {len(PRIORITY)} END"
SQL["evidence_frontier"] = f"""WITH {PAGE_EDGES_SQL}, n AS (SELECT target AS node, weight, {_RANK} AS priority FROM pe WHERE source BETWEEN 1 AND 5 UNION ALL SELECT source, weight, {_RANK} FROM pe WHERE target BETWEEN 1 AND 5),
b AS (SELECT * FROM n WHERE node NOT BETWEEN 1 AND 5 AND node IN (SELECT doc_id FROM documents) QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, priority) = 1)
SELECT node, 'Page ' || node AS title, weight, priority FROM b ORDER BY weight DESC, priority, title LIMIT 36"""


def neighbour_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's neighbours over edges of at least 1.0, heaviest first: (node, neighbour, weight, place)."""
    edges = page_edges(spark, sf_dir).where("weight >= 1.0").groupBy("source", "target").agg(F.max("weight").alias("weight"))
    ways = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "weight")
    ways = ways.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "weight"))
    return ways.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "neighbour")))


SQL["neighbour_list"] = f"WITH {PAGE_EDGES_SQL}, e AS (SELECT source, target, max(weight) AS weight FROM pe WHERE weight >= 1.0 GROUP BY ALL), w AS (SELECT source AS node, target AS neighbour, weight FROM e UNION ALL SELECT target, source, weight FROM e) SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbour)::INT AS place FROM w"

QUERIES = {f.__name__: f for f in (hybrid_fusion, rag_fusion, graph_expand, hybrid_search, related_pages, edge_types, evidence_frontier, neighbour_list)}
