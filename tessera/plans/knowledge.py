"""Queries over the knowledge graph: edge relevance, pruning, insights, learning paths, merged plans, mentions, source removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cycles, graph, graph_build, learner, relevance, stages
from tessera.operators.shared import written
from tessera.plans import graphs, learners, mastery, readiness
from tessera.sources import adapters
from tessera.sources.adapters import PAGE_EDGES_SQL, attempts, page_edges, table

_N = f"""{PAGE_EDGES_SQL}, nd AS (SELECT doc_id AS node, CASE WHEN doc_id % 61 = 0 THEN 'source' ELSE {[t for t in relevance.TYPES if t != 'source']!r}[doc_id % 6 + 1] END AS type, CASE WHEN source IS NULL THEN [] ELSE [source, 'set' || doc_id % 40] END AS sources FROM documents),
lk AS (SELECT DISTINCT source AS a, target AS b FROM pe WHERE target IN (SELECT node FROM nd))"""
SQL: dict[str, str] = {}


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, type, sources): documents as nodes."""
    plain = [t for t in relevance.TYPES if t != "source"]
    n = F.col("doc_id")
    kind = F.when(n % 61 == 0, "source").otherwise(F.element_at(F.array(*[F.lit(t) for t in plain]), (n % 6 + 1).cast("int")))
    sources = F.when(F.col("source").isNull(), F.array().cast("array<string>")).otherwise(F.array("source", F.concat(F.lit("set"), (n % 40).cast("string"))))
    return table(spark, sf_dir, "documents").select(n.alias("node"), kind.alias("type"), sources.alias("sources"))


def _links(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    edges = page_edges(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    return edges.join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")


def edge_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked pages with their type of edge and weight from four signals."""
    nodes = _nodes(spark, sf_dir)
    links = _links(spark, sf_dir, nodes)
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return relevance.scored_edges(nodes, links, pairs)


_AFF = "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in row) + "]" for row in relevance.AFFINITY) + "]"
_AT = lambda c: f"list_position({relevance.TYPES!r}, {c})"
SQL["edge_relevance"] = f"""WITH {_N}, wy AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), dg AS (SELECT a AS z, greatest(count(*), 2) AS d FROM wy GROUP BY a), pr AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM lk),
cm AS (SELECT pr.a, pr.b, sum(1 / ln(d::DOUBLE)) AS aa FROM pr JOIN wy x ON x.a = pr.a JOIN wy y ON y.a = pr.b AND y.b = x.b JOIN dg ON z = x.b GROUP BY ALL),
sg AS (SELECT pr.a, pr.b, (pr.a, pr.b) IN (SELECT (a, b) FROM lk) AS there, (pr.b, pr.a) IN (SELECT (a, b) FROM lk) AS back, len(list_intersect(x.sources, y.sources)) AS shared, x.type AS ta, y.type AS tb FROM pr JOIN nd x ON x.node = pr.a JOIN nd y ON y.node = pr.b)
SELECT sg.a, sg.b, CASE WHEN there OR back THEN 'direct' ELSE 'related' END AS edge_type, round((there::INT + back::INT) * 3.0::DOUBLE + shared * 4.0::DOUBLE + coalesce(aa, 0.0::DOUBLE) * 1.5::DOUBLE + {_AFF}[{_AT('ta')}][{_AT('tb')}], 2) AS weight FROM sg LEFT JOIN cm ON cm.a = sg.a AND cm.b = sg.b"""


#: What pages state of one another here, by the remainder of their id.
_STATED = list(graph_build.RANKS)


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, links, prerequisites, relations) of documents as pages; every third one states a relation."""
    nodes, edges = _nodes(spark, sf_dir), page_edges(spark, sf_dir)
    before = edges.where("kind = 'prerequisite'").select(F.col("target").alias("a"), F.col("source").alias("b"))
    kind = F.element_at(F.array(*map(F.lit, _STATED)), (F.floor(F.col("source") / 3) % len(_STATED) + 1).cast("int"))
    stated = edges.where("source % 3 = 0 AND kind <> 'prerequisite'").select(F.col("source").alias("node"), F.col("target").alias("other"), (F.col("source") % 2 == 0).alias("forward"), kind.alias("edge_type"))
    return nodes, edges.where("source % 4 > 0").select(F.col("source").alias("a"), F.col("target").alias("b")), before.where("b % 5 = 0"), stated


def scored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, edge_type, weight): all pairs of pages that links, sources, prerequisites or stated relations connect."""
    return graph_build.scored_graph(*_parsed(spark, sf_dir))


SQL["scored_graph"] = f"""WITH {_N.split('lk AS')[0]}
lk AS (SELECT DISTINCT source AS a, target AS b FROM pe WHERE source % 4 > 0 AND target IN (SELECT node FROM nd)),
bf AS (SELECT least(source, target) AS a, greatest(source, target) AS b, min(target) AS first FROM pe WHERE kind = 'prerequisite' AND source % 5 = 0 AND target IN (SELECT node FROM nd) GROUP BY ALL),
st AS (SELECT source AS node, target AS other, source % 2 = 0 AS forward, source // 3 % {len(_STATED)} AS r FROM pe WHERE source % 3 = 0 AND kind <> 'prerequisite' AND target IN (SELECT node FROM nd)),
sd AS (SELECT least(node, other) AS a, greatest(node, other) AS b, {_STATED!r}[r + 1] AS said, CASE WHEN forward THEN node ELSE other END AS said_from FROM st QUALIFY row_number() OVER (PARTITION BY least(node, other), greatest(node, other) ORDER BY r, node, NOT forward) = 1),
ps AS (SELECT DISTINCT node, type, unnest(sources) AS src FROM nd), hs AS (SELECT * FROM ps WHERE type = 'source'),
pl AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY node) AS k FROM ps WHERE src NOT IN (SELECT src FROM hs)),
pr AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM lk UNION SELECT a, b FROM bf UNION SELECT a, b FROM sd
  UNION SELECT x.node, y.node FROM pl x JOIN pl y ON x.src = y.src AND y.k BETWEEN x.k + 1 AND x.k + {graph_build.AHEAD} UNION SELECT least(x.node, y.node), greatest(x.node, y.node) FROM ps x JOIN hs y ON x.src = y.src AND x.node <> y.node),
wy AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), dg AS (SELECT a AS z, greatest(count(*), 2) AS d FROM wy GROUP BY a),
cm AS (SELECT pr.a, pr.b, sum(1 / ln(d::DOUBLE)) AS aa FROM pr JOIN wy x ON x.a = pr.a JOIN wy y ON y.a = pr.b AND y.b = x.b JOIN dg ON z = x.b GROUP BY ALL),
sg AS (SELECT pr.a, pr.b, (pr.a, pr.b) IN (SELECT (a, b) FROM lk) AS there, (pr.b, pr.a) IN (SELECT (a, b) FROM lk) AS back, len(list_intersect(x.sources, y.sources)) AS shared, x.type AS ta, y.type AS tb FROM pr JOIN nd x ON x.node = pr.a JOIN nd y ON y.node = pr.b),
cl AS (SELECT sg.a, sg.b, coalesce(said, CASE WHEN first IS NOT NULL THEN 'prerequisite' WHEN there OR back THEN 'direct' WHEN shared > 0 AND 'source' IN (ta, tb) THEN 'teaches' ELSE 'related' END) AS edge_type, coalesce(said_from, first) AS first,
  round((there::INT + back::INT) * 3.0::DOUBLE + shared * 4.0::DOUBLE + coalesce(aa, 0.0::DOUBLE) * 1.5::DOUBLE + {_AFF}[{_AT('ta')}][{_AT('tb')}], 2) AS weight
  FROM sg LEFT JOIN cm ON cm.a = sg.a AND cm.b = sg.b LEFT JOIN sd ON sd.a = sg.a AND sd.b = sg.b LEFT JOIN bf ON bf.a = sg.a AND bf.b = sg.b)
SELECT CASE WHEN edge_type = 'prerequisite' AND first = b THEN b ELSE a END AS source, CASE WHEN edge_type = 'prerequisite' AND first = b THEN a ELSE b END AS target, edge_type, weight FROM cl"""


def built_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored graph as it is kept: no circles of prerequisites, eight edges a page where types allow it."""
    return graph_build.built_graph(*_parsed(spark, sf_dir))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages by stage; bridges are pages with neighbours of three types or more."""
    nodes = _nodes(spark, sf_dir).select("node", "type", F.concat(F.lit("Page "), F.col("node").cast("string")).alias("title"))
    ends = [nodes.select(F.col("node").alias(c)) for c in ("source", "target")]
    edges = page_edges(spark, sf_dir).select("source", "target", F.col("kind").alias("edge_type")).join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi")
    near = graph.both_ways(edges).join(nodes.select(F.col("node").alias("b"), "type"), "b").groupBy(F.col("a").alias("node")).agg(F.count_distinct("type").alias("n")).where("n >= 3")
    return stages.staged(nodes, edges, near, nodes.where("node % 97 = 0"))


def learning_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by learning stage, with their place in it and why; pages whose id 97 divides are named as gaps."""
    return _staged(spark, sf_dir)


_CASES = lambda column, of: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in of.items())
_STAGED = f"""{_N}, pg AS (SELECT source, target, kind FROM pe WHERE target IN (SELECT node FROM nd) AND source IN (SELECT node FROM nd)),
ws AS (SELECT source AS node, target AS other FROM pg UNION SELECT target, source FROM pg), fi AS (SELECT DISTINCT source, target FROM pg WHERE kind = 'prerequisite'),
dg AS (SELECT node, count(*) AS degree FROM ws GROUP BY node), br AS (SELECT ws.node FROM ws JOIN nd ON nd.node = other WHERE ws.node <> other GROUP BY ws.node HAVING count(DISTINCT type) >= 3),
x AS (SELECT nd.node, type, 'Page ' || nd.node AS title, coalesce(degree, 0) AS degree, (SELECT count(*) FROM fi WHERE target = nd.node) AS prerequisites, (SELECT count(*) FROM fi WHERE source = nd.node) AS dependents,
  nd.node IN (SELECT node FROM br) AS is_bridge, nd.node % 97 = 0 OR coalesce(degree, 0) <= 1 AS is_gap FROM nd LEFT JOIN dg ON dg.node = nd.node),
y AS (SELECT *, degree + dependents * 2 + CASE WHEN is_bridge THEN 4 ELSE 0 END - CASE WHEN is_gap THEN 1 ELSE 0 END AS score,
  CASE WHEN type IN ('source', 'synthesis') THEN type WHEN is_gap THEN 'gap' WHEN dependents >= 2 THEN 'needed' WHEN prerequisites = 0 THEN 'free' WHEN type IN ('formula', 'principle') THEN 'applied' ELSE 'spine' END AS why FROM x),
z AS (SELECT *, CASE why WHEN 'source' THEN 'overview' WHEN 'synthesis' THEN 'overview' WHEN 'gap' THEN 'review' WHEN 'needed' THEN 'foundations' WHEN 'free' THEN 'foundations' ELSE 'core' END AS stage FROM y),
sg AS (SELECT node, title, stage, row_number() OVER (PARTITION BY stage ORDER BY {_CASES('type', stages.TYPE_ORDER)} ELSE 9 END, score DESC, title, node) AS place, {_CASES('why', stages.REASONS)} END AS reason, prerequisites, score, is_bridge, is_gap FROM z)"""
SQL["learning_stages"] = f"WITH {_STAGED} SELECT * FROM sg"


def next_learning_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, goal, node, stage): what each learner looks at next by goal; a page is done by whoever purchased or clicked in the event of its number."""
    events = table(spark, sf_dir, "events")
    done = events.where("event_type IN ('purchase', 'click')").select("user_id", F.col("event_id").alias("node"))
    return stages.next_items(_staged(spark, sf_dir), events.select("user_id"), done)


SQL["next_learning_items"] = f"""WITH {_STAGED}, us AS (SELECT DISTINCT user_id FROM events), gl AS (SELECT * FROM (VALUES {", ".join(f"('{g}', '{s}', {k})" for g, order in stages.GOALS.items() for k, s in enumerate(order))}) AS v(goal, stage, k))
SELECT user_id, goal, node, sg.stage FROM us CROSS JOIN sg JOIN gl ON gl.stage = sg.stage WHERE (user_id, node) NOT IN (SELECT (user_id, event_id) FROM events WHERE event_type IN ('purchase', 'click'))
QUALIFY row_number() OVER (PARTITION BY user_id, goal ORDER BY k, place) = 1"""


def pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts, a third of them of strong types, pruned to a degree of 8."""
    edges = adapters.prerequisite_edges(spark, sf_dir)
    kind = F.when(F.col("source") % 9 == 0, "prerequisite").when(F.col("target") % 7 == 0, "scaffolds").otherwise("related")
    return relevance.pruned(edges.select("source", "target", kind.alias("edge_type"), F.col("weight").cast("double").alias("weight")))


def circles_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites between parts; those that run in a circle as weaker, related edges."""
    edges = adapters.prerequisite_edges(spark, sf_dir).where("weight >= 2 or source % 5 = 0")
    return cycles.without_circles(edges.select("source", "target", F.when(F.col("source") % 4 > 0, "prerequisite").otherwise("related").alias("edge_type"), F.col("weight").cast("double").alias("weight")))


def community_top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(community, member_count, top_node): brands as communities; the node drawn largest, the first by key of these."""
    size = graph.degrees(adapters.prerequisite_edges(spark, sf_dir)).select(F.col("node").alias("p_partkey"), "size")
    parts = table(spark, sf_dir, "part").join(size, "p_partkey", "left").fillna(1, ["size"])
    return parts.groupBy(F.col("p_brand").alias("community")).agg(F.count(F.lit(1)).alias("member_count"), F.max_by("p_partkey", F.struct("size", -F.col("p_partkey"))).alias("top_node"))


SQL["community_top_nodes"] = f"""WITH d AS ({graphs.SQL['node_degree_size']}), p AS (SELECT p_brand AS community, p_partkey, coalesce(size, 1) AS size FROM part LEFT JOIN d ON node = p_partkey)
SELECT community, count(*) AS member_count, arg_max(p_partkey, (size, -p_partkey)) AS top_node FROM p GROUP BY community"""


def graph_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(insight_type, title, score) of at least 1.5: few-linked nodes, sparse communities, nodes between communities, cross-type edges."""
    edges = written(adapters.prerequisite_edges(spark, sf_dir), "part-edges")
    pairs = written(graph.both_ways(edges, adapters.line_tasks(spark, sf_dir)), "part-pairs")
    parts = table(spark, sf_dir, "part")
    degree = parts.select(F.col("p_partkey").alias("a")).join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("d")), "a", "left").fillna(0, ["d"])
    few = degree.agg(F.count_if(F.col("d") <= 1).alias("n")).where("n > 0").select(F.lit("knowledge_gap").alias("insight_type"), F.concat("n", F.lit(" isolated knowledge points")).alias("title"), (F.col("n") * 0.5).alias("score"))
    sparse = readiness.cohesion(spark, sf_dir).where("cohesion < 0.15 and member_count >= 3").select(F.lit("knowledge_gap").alias("insight_type"), F.concat(F.lit("Sparse community: "), "community").alias("title"), F.round((1 - F.round("cohesion", 3)) * 2, 6).alias("score"))
    near = pairs.join(parts.select(F.col("p_partkey").alias("b"), "p_type"), "b").groupBy("a").agg(F.count_distinct("p_type").alias("n")).where("n >= 3")
    bridges = near.join(parts.select(F.col("p_partkey").alias("a"), "p_name"), "a").select(F.lit("bridge").alias("insight_type"), F.concat(F.lit("Bridge concept: "), F.col("a").cast("string"), F.lit(" "), "p_name").alias("title"), (F.col("n") * 1.5).alias("score"))
    kinds = [parts.select(F.col("p_partkey").alias(c), F.col("p_type").alias(f"type_{c}")) for c in ("source", "target")]
    cross = edges.join(kinds[0], "source").join(kinds[1], "target").where("type_source <> type_target")
    crossed = cross.select(F.lit("surprising_connection").alias("insight_type"), F.concat(F.lit("Cross-type: "), F.col("source").cast("string"), F.lit(" <-> "), F.col("target").cast("string")).alias("title"), F.lit(2.0).alias("score"))
    return few.unionByName(sparse).unionByName(bridges).unionByName(crossed).where("score >= 1.5")


SQL["graph_insights"] = f"""WITH {graphs._E}, w AS (SELECT a, b FROM u), c AS ({readiness.SQL['cohesion']}), d AS (SELECT p_partkey, (SELECT count(*) FROM w WHERE a = p_partkey) AS d FROM part)
SELECT * FROM (SELECT 'knowledge_gap' AS insight_type, count(*) || ' isolated knowledge points' AS title, count(*) * 0.5::DOUBLE AS score FROM d WHERE d <= 1 HAVING count(*) > 0
UNION ALL SELECT 'knowledge_gap', 'Sparse community: ' || community, round((1 - round(cohesion, 3)) * 2, 6) FROM c WHERE cohesion < 0.15 AND member_count >= 3
UNION ALL SELECT 'bridge', 'Bridge concept: ' || a || ' ' || any_value(x.p_name), count(DISTINCT y.p_type) * 1.5::DOUBLE FROM w JOIN part y ON y.p_partkey = b JOIN part x ON x.p_partkey = a GROUP BY a HAVING count(DISTINCT y.p_type) >= 3
UNION ALL SELECT 'surprising_connection', 'Cross-type: ' || source || ' <-> ' || target, 2.0::DOUBLE FROM e JOIN part x ON x.p_partkey = source JOIN part y ON y.p_partkey = target WHERE x.p_type <> y.p_type) WHERE score >= 1.5"""


def learner_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, insight_type, title, score) of at least 1.5 from each learner's state: three of each kind at most."""
    state = learners.weak_kcs(spark, sf_dir).where("rank <= 3").select("user_id", F.lit("readiness").alias("insight_type"), F.concat(F.lit("Prereq not ready: "), F.col("kc_id").cast("string")).alias("title"), F.lit(1.8).alias("score"))
    errors = mastery.misconception_clusters(spark, sf_dir).where("rank <= 3").select("user_id", F.lit("misconception_cluster").alias("insight_type"), F.concat(F.lit("Frequent error: "), "tag").alias("title"), F.round(F.col("n") * 0.7, 6).alias("score"))
    windows = readiness.transfer_windows(spark, sf_dir).where("rank <= 3").select("user_id", F.lit("transfer_window").alias("insight_type"), F.concat(F.lit("Try "), F.col("target").cast("string")).alias("title"), F.lit(2.0).alias("score"))
    drift = learners.overconfidence_gap(spark, sf_dir).where("gap > 0.2").select("user_id", F.lit("overconfidence").alias("insight_type"), F.lit("Calibration drift detected").alias("title"), F.lit(2.0).alias("score"))
    return state.unionByName(errors).unionByName(windows).unionByName(drift).where("score >= 1.5")


SQL["learner_insights"] = f"""WITH w AS ({learners.SQL['weak_kcs']}), c AS ({mastery.SQL['misconception_clusters']}), t AS ({readiness.SQL['transfer_windows']}), g AS ({learners.SQL['overconfidence_gap']})
SELECT * FROM (SELECT user_id, 'readiness' AS insight_type, 'Prereq not ready: ' || kc_id AS title, 1.8::DOUBLE AS score FROM w WHERE rank <= 3 UNION ALL SELECT user_id, 'misconception_cluster', 'Frequent error: ' || tag, round(n * 0.7::DOUBLE, 6) FROM c WHERE rank <= 3
UNION ALL SELECT user_id, 'transfer_window', 'Try ' || target, 2.0::DOUBLE FROM t WHERE rank <= 3 UNION ALL SELECT user_id, 'overconfidence', 'Calibration drift detected', 2.0::DOUBLE FROM g WHERE gap > 0.2) WHERE score >= 1.5"""


def learning_path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight steps towards part 1 for learner 1: deep prerequisites first, then weak ones; with reason and minutes.

    Levels come from the learner's beliefs; minutes are five and one for each edge that leads to a step.
    """
    edges = adapters.prerequisite_edges(spark, sf_dir)
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    found = graph.reachable(back, spark.createDataFrame([(1,)], "node long"), 3).where("hops > 0")
    known = learner.bkt(attempts(spark, sf_dir).where("user_id = 1")).select(F.col("kc_id").cast("long").alias("kc"), F.round("p_known", 9).alias("p"))
    level = F.when(F.col("p") >= 0.85, "mastered").when(F.col("p") >= 0.6, "proficient").when(F.col("p") >= 0.3, "learning").when(F.col("p") > 0, "exposed").otherwise("new")
    rank = F.create_map(*[F.lit(x) for pair in {"mastered": 4, "proficient": 3, "learning": 2, "exposed": 1, "new": 0}.items() for x in pair])
    steps = found.withColumn("kc", F.col("node") % 20).join(F.broadcast(known), "kc", "left").withColumn("mastery", level)
    steps = steps.orderBy(F.desc("hops"), rank[F.col("mastery")], "node").limit(8)
    minutes = edges.groupBy(F.col("target").alias("node")).agg((F.count(F.lit(1)) + 5).alias("minutes"))
    named = steps.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_name"), "node").join(minutes, "node", "left")
    reason = F.when(F.col("hops") <= 1, F.concat(F.lit("前置知识：理解 "), "p_name", F.lit(" 后才能继续 1"))).otherwise(F.concat(F.lit("前置链第 "), F.col("hops").cast("string"), F.lit(" 层：补齐 "), "p_name", F.lit(" 以打通 1 的学习路径")))
    return named.select("node", "hops", "mastery", reason.alias("reason"), F.coalesce("minutes", F.lit(5)).cast("long").alias("minutes"))


SQL["learning_path_steps"] = f"""{learners._BKT.replace('WITH RECURSIVE', f'WITH RECURSIVE {graphs._E}, e3 AS (SELECT * FROM e), rc AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT source, hops + 1 FROM rc JOIN e3 ON target = node AND hops < 3),')},
h AS (SELECT node, min(hops) AS hops FROM rc GROUP BY node HAVING min(hops) > 0),
m AS (SELECT node, hops, CASE WHEN p >= 0.85 THEN 'mastered' WHEN p >= 0.6 THEN 'proficient' WHEN p >= 0.3 THEN 'learning' WHEN p > 0 THEN 'exposed' ELSE 'new' END AS mastery, CASE WHEN p >= 0.85 THEN 4 WHEN p >= 0.6 THEN 3 WHEN p >= 0.3 THEN 2 WHEN p > 0 THEN 1 ELSE 0 END AS r
  FROM h LEFT JOIN (SELECT kc_id, round(p_known, 9) AS p FROM b WHERE user_id = 1) k ON kc_id = node % 20 ORDER BY hops DESC, r, node LIMIT 8)
SELECT node, hops, mastery, CASE WHEN hops <= 1 THEN '前置知识：理解 ' || p_name || ' 后才能继续 1' ELSE '前置链第 ' || hops || ' 层：补齐 ' || p_name || ' 以打通 1 的学习路径' END AS reason, 5 + (SELECT count(*) FROM e3 WHERE target = node) AS minutes FROM m JOIN part ON p_partkey = node"""


def neighbourhood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, weight, depth): edges that lead on from part 1, by steps before them, two at most."""
    edges = adapters.prerequisite_edges(spark, sf_dir)
    found = graph.reachable(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), spark.createDataFrame([(1,)], "node long"), 1)
    return edges.join(found, F.col("source") == F.col("node")).select("source", "target", "weight", (F.col("hops") + 1).alias("depth"))


SQL["neighbourhood_edges"] = f"WITH {graphs._E}, e3 AS (SELECT * FROM e), f AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT target, 1 FROM e3 WHERE source = 1), g AS (SELECT node, min(hops) AS hops FROM f GROUP BY node) SELECT source, target, weight, hops + 1 AS depth FROM e3 JOIN g ON node = source"


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: nodes, edges, and their types in order."""
    nodes, edges = _nodes(spark, sf_dir), page_edges(spark, sf_dir)
    a = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("node_types"))
    b = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("edge_types"))
    return a.join(F.broadcast(b))  # a row each


SQL["graph_stats"] = f"WITH {_N} SELECT (SELECT count(*) FROM nd) AS n_nodes, (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM nd) AS node_types, (SELECT count(*) FROM pe) AS n_edges, (SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM pe) AS edge_types"


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_type, created, value): edges as an upserted table reads, the first time kept and the newest value."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(at).alias("created"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


SQL["edge_upsert"] = "SELECT user_id, event_type, epoch_us(min(ts)) AS created, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type"


def merged_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, name, definition_md5, related, n): items by their names in lower case: the first name, the longest definition (the first of those), all sources in order.

    Items are the documents, named by their first word.
    """
    word = F.regexp_extract("text", r"^\s*([^\s.,]+)", 1)
    items = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", word.alias("name"), F.lower(word).alias("key"), "text", "source").where("name <> ''")
    best = items.groupBy("key").agg(F.min_by("name", "doc_id").alias("name"), F.max_by("text", F.struct(F.length("text"), -F.col("doc_id"))).alias("text"), F.count(F.lit(1)).alias("n"))
    seen = items.where("source is not null").groupBy("key", "source").agg(F.min("doc_id").alias("since"))
    related = seen.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("since", "source"))), lambda x: x["source"]), ",").alias("related"))
    return best.join(related, "key", "left").select("key", "name", F.md5(F.col("text").cast("binary")).alias("definition_md5"), F.coalesce("related", F.lit("")).alias("related"), "n")


SQL["merged_plans"] = r"""
WITH i AS (SELECT doc_id, regexp_extract(text, '^\s*([^\s.,]+)', 1) AS name, text, source FROM documents WHERE text IS NOT NULL), k AS (SELECT *, lower(name) AS key FROM i WHERE name <> ''),
s AS (SELECT key, source, min(doc_id) AS since FROM k WHERE source IS NOT NULL GROUP BY ALL)
SELECT key, arg_min(name, doc_id) AS name, md5(arg_max(text, (length(text), -doc_id))) AS definition_md5, coalesce((SELECT string_agg(source, ',' ORDER BY since) FROM s WHERE s.key = k.key), '') AS related, count(*) AS n FROM k GROUP BY key"""

#: Terms that are looked for in texts; some lie within others.
TERMS = ["the", "there", "tion", "water", "er", "ere", "eaux", "schen"]


def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, n, first, last): where terms stand in documents, not counting those within longer ones."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return relevance.mentions(texts, TERMS, ["doc_id"]).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, k, sid, text): sentences of documents in lower case, numbered together."""
    parts = F.split(F.lower("text"), r"[\n。！？；;!?]+")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(parts).alias("k", "text"))
    return d.withColumn("text", F.trim("text")).where("text <> ''")


def cooccurring_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, a, b, n, score): terms that stand in one sentence, how many sentences, and the best score by their distance there."""
    places = relevance.mentions(_sentences(spark, sf_dir), TERMS, ["doc_id", "k"])
    pairs = relevance.nearest_pairs(places, TERMS, ["doc_id", "k"])
    score = F.least(F.lit(0.95), 0.52 * 0.55 + 0.24 + F.greatest(F.lit(0.0), 1.0 - F.col("distance") / 1000.0) * 0.22)
    return pairs.groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(score), 3).alias("score"))


def near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, a, b, distance, score): terms within 700 characters of each other in a document."""
    places = relevance.mentions(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")), TERMS, ["doc_id"])
    pairs = relevance.nearest_pairs(places, TERMS, ["doc_id"]).where("distance <= 700")
    score = F.least(F.lit(0.95), 0.42 * 0.55 + 0.08 + F.greatest(F.lit(0.0), 1.0 - F.col("distance") / 1000.0) * 0.22)
    return pairs.select("doc_id", "a", "b", "distance", F.round(score, 3).alias("score"))


def source_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, why): pages that go with source src3: its own, and those that its pages of type source link to; the first reason counts."""
    nodes, edges = _nodes(spark, sf_dir), page_edges(spark, sf_dir)
    own = nodes.where(F.arrays_overlap("sources", F.array(F.lit("src3")))).select("node", "type")
    linked = edges.join(own.where("type = 'source'").select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).join(nodes, "node", "left_semi")
    both = own.select("node", F.lit(0).alias("k")).unionByName(linked.select("node", F.lit(1).alias("k")))
    return both.groupBy("node").agg(F.min("k").alias("k")).select(F.col("node").alias("doc_id"), F.when(F.col("k") == 0, "source").otherwise("link").alias("why"))


SQL["source_removal"] = f"WITH {_N}, o AS (SELECT node, type FROM nd WHERE list_contains(sources, 'src3')), l AS (SELECT target AS node FROM pe WHERE source IN (SELECT node FROM o WHERE type = 'source') AND target IN (SELECT node FROM nd)) SELECT node AS doc_id, CASE WHEN node IN (SELECT node FROM o) THEN 'source' ELSE 'link' END AS why FROM (SELECT node FROM o UNION SELECT node FROM l)"

QUERIES = {
    f.__name__: f
    for f in (edge_relevance, scored_graph, built_graph, learning_stages, next_learning_items, pruned_graph, circles_broken, community_top_nodes, graph_insights, learner_insights, learning_path_steps, neighbourhood_edges, graph_stats, edge_upsert, merged_plans, term_mentions, cooccurring_terms, near_terms, source_removal)
}
