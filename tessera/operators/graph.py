"""Graph operators: degrees, neighbourhoods, learning paths, components, common neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.shared import discard, hot_keys, join_spread, observed, written


def turned(edges: DataFrame) -> DataFrame:
    """(a, b) for each edge in both directions, without loops; repeats stay."""
    there = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    return there.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def both_ways(edges: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """(a, b) for each edge in both directions, without repeats or loops; repeats are found among one direction of each, in ``n_tasks`` if given."""
    one = edges.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return turned((one.repartition(n_tasks, "source", "target") if n_tasks else one).distinct())


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, size): edges at each node and its drawn size, which grows with their logarithm."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    counted = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return counted.withColumn("size", F.greatest(F.lit(1.0), F.rint(1 + F.log1p(F.col("degree").cast("double")) * 1.2)).cast("long"))


def reachable(steps: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops): what is at most ``depth`` steps (a, b) away from ``start`` (node), by the fewest hops.

    Each hop joins only the newest nodes; nodes seen before leave by an anti-join.
    """
    steps = written(steps, "reachable-steps")  # each hop reads it
    seen = written(start.select("node", F.lit(0).alias("hops")).distinct(), "reachable")
    for hop in range(1, depth + 1):
        last = seen.where(F.col("hops") == hop - 1)
        new = steps.join(last, steps["a"] == last["node"]).select(F.col("b").alias("node")).distinct()
        seen = written(seen.unionByName(new.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hops"))), "reachable")
    return seen


def connected_components(edges: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """(node, component): the smallest node that edges lead to, whatever their direction.

    Labels fall to the least of the neighbours' and then to their own label's label, until none falls.
    Nodes with very many neighbours, and labels that very many nodes have, are joined apart, so neither
    a hub nor a giant component meets in one task.
    """
    pairs = written(both_ways(edges, n_tasks), "component-pairs")
    hubs = hot_keys(pairs, "b")
    labels = written(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "component-labels")
    while True:
        near = join_spread(pairs, "b", labels.select(F.col("node").alias("b"), "label"), hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        fell = written(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low")), "component-labels")
        far = fell.select(F.col("node").alias("low"), F.col("low").alias("far"))
        step = join_spread(fell, "low", far, hot_keys(fell, "low")).select("node", "label", F.least("low", "far").alias("low"))
        step, seen = observed(step, "component-labels", falls=F.count_if(F.col("low") != F.col("label")))
        discard(labels, fell)
        labels = step.select("node", F.col("low").alias("label"))
        if not seen["falls"]:
            return labels.select("node", F.col("label").alias("component"))


def common_neighbours(edges: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """(a, b, common, adamic_adar) for linked pairs a < b with common neighbours.

    Every edge leads to its end of higher degree (of even ones, to the larger node), so no node has more than the
    root of twice the edges ahead of it. Of each triangle the first node tells the second which others lie ahead
    of both, one list for each edge, and those that the second one has too close it.
    """
    pairs = written(both_ways(edges, n_tasks), "neighbour-pairs")  # what follows reads it twice
    degree = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("d")), "neighbour-degrees")
    da, db = degree.select("a", F.col("d").alias("da")), degree.select(F.col("a").alias("b"), F.col("d").alias("db"))
    led = pairs.join(db, "b").join(da, "a").where(F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a")))
    ahead = written(led.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("db", "b"))), lambda x: x["b"]).alias("ahead")), "neighbours-ahead")
    asked = ahead.select(F.col("a").alias("first"), "ahead", F.posexplode("ahead").alias("k", "a")).where(F.col("k") + 1 < F.size("ahead")).select("a", "first", F.expr("slice(ahead, k + 2, size(ahead))").alias("others"))
    closed = asked.join(ahead, "a").select(F.col("first").alias("x"), F.col("a").alias("y"), F.explode(F.array_intersect("others", "ahead")).alias("z"))
    corner = lambda a, b, z: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(z).alias("z"))
    shared = closed.select(F.explode(F.array(corner("x", "y", "z"), corner("x", "z", "y"), corner("y", "z", "x"))).alias("t")).select("t.*")
    scored = shared.join(degree.select(F.col("a").alias("z"), "d"), "z")
    return scored.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.round(F.sum(1 / F.log(F.col("d").cast("double"))), 6).alias("adamic_adar"))
