"""Queries over the prerequisite graph: degrees, neighbourhoods, components, common neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources import adapters
from tessera.sources.adapters import table

_E = """
s AS (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem),
e AS (SELECT source, target, count(*) AS weight FROM s WHERE target IS NOT NULL AND source <> target GROUP BY source, target),
u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e)"""
SQL: dict[str, str] = {}


def prerequisite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.prerequisite_edges(spark, sf_dir)


SQL["prerequisite_edges"] = f"WITH {_E} SELECT * FROM e"


def edge_dedupe_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each undirected pair: the heavier direction, the one from the smaller node if they are even."""
    edges = adapters.prerequisite_edges(spark, sf_dir)
    first = F.max_by(F.struct("source", "target", "weight"), F.struct("weight", (-F.col("source")).alias("s")))
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(first.alias("e")).select("e.*")


SQL["edge_dedupe_priority"] = f"WITH {_E} SELECT source, target, weight FROM e QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY weight DESC, source) = 1"


def node_degree_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(adapters.prerequisite_edges(spark, sf_dir))


SQL["node_degree_size"] = f"WITH {_E} SELECT node, count(*) AS degree, greatest(1, round_even(1 + ln(1 + count(*)::DOUBLE) * 1.2::DOUBLE, 0))::BIGINT AS size FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node"


def orphan_edges_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which an end is no node, as if only parts that cost 1000 or more were nodes."""
    edges = adapters.prerequisite_edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "part").where("p_retailprice >= 1000")
    known = edges.join(nodes.select(F.col("p_partkey").alias("source")), "source", "left_semi").join(nodes.select(F.col("p_partkey").alias("target")), "target", "left_semi")
    return edges.join(known.select("source", "target"), ["source", "target"], "left_anti").select("source", "target", "weight")


SQL["orphan_edges_anti"] = f"WITH {_E}, n AS (SELECT p_partkey FROM part WHERE p_retailprice >= 1000) SELECT * FROM e WHERE source NOT IN (FROM n) OR target NOT IN (FROM n)"


def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were never ordered together with another one twice."""
    ends = adapters.prerequisite_edges(spark, sf_dir).where("weight > 1").select(F.explode(F.array("source", "target")).alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(ends, "p_partkey", "left_anti")


SQL["isolated_nodes"] = f"WITH {_E} SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT unnest([source, target]) FROM e WHERE weight > 1)"


def _neighbourhood(depth: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        start = spark.createDataFrame([(1,)], "node long")
        return graph.reachable(graph.turned(adapters.prerequisite_steps(spark, sf_dir)), start, depth)

    return run


_REACH = "WITH RECURSIVE {0}, r AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT {1}, hops + 1 FROM r JOIN {2} AND hops < {3}) SELECT node, min(hops) AS hops FROM r GROUP BY node"
for _d in (1, 2, 3):
    SQL[f"bfs_neighborhood_d{_d}"] = _REACH.format(_E, "b", "u ON a = node", _d)


def learning_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leads to part 1 in three steps at most, with its rank: steps before the goal."""
    back = adapters.prerequisite_edges(spark, sf_dir).select(F.col("target").alias("a"), F.col("source").alias("b"))
    return graph.reachable(back, spark.createDataFrame([(1,)], "node long"), 3)


SQL["learning_path"] = _REACH.format(_E, "source", "e ON target = node", 3)


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(adapters.prerequisite_steps(spark, sf_dir), adapters.line_tasks(spark, sf_dir))


def adamic_adar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.common_neighbours(adapters.prerequisite_steps(spark, sf_dir), adapters.line_tasks(spark, sf_dir))


SQL["adamic_adar"] = f"""
WITH {_E}, d AS (SELECT a, count(*) AS d FROM u GROUP BY a)
SELECT x.a, x.b, count(*) AS common, round(sum(1 / ln(d.d::DOUBLE)), 6) AS adamic_adar
FROM u x JOIN u y ON x.a = y.a JOIN u z ON z.a = x.b AND z.b = y.b JOIN d ON d.a = y.b WHERE x.a < x.b GROUP BY x.a, x.b"""


def region_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, children): nations of each region, by name."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.groupBy(F.col("r_name").alias("parent")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("children"))


SQL["region_hierarchy"] = "SELECT r_name AS parent, string_agg(n_name, ',' ORDER BY n_name) AS children FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"

QUERIES = {f.__name__: f for f in (prerequisite_edges, edge_dedupe_priority, node_degree_size, orphan_edges_anti, isolated_nodes, learning_path, connected_components, adamic_adar, region_hierarchy)} | {f"bfs_neighborhood_d{d}": _neighbourhood(d) for d in (1, 2, 3)}
