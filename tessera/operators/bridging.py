"""Joining the components of a graph by careful candidate edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.operators.shared import discard, hot_keys, join_spread, observed, written

#: Bounds of a bridge's confidence, its share of the score, and its weight's base and share of the confidence.
LOWEST, HIGHEST, SHARE, BASE, SLOPE = 0.25, 0.45, 0.5, 0.2, 0.8


def bridges(nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source, target, edge_type, evidence, confidence, weight): the candidates that a greedy pass adds to join components.

    The pass takes candidates with evidence first, then those of higher score, then by (source, target, edge_type),
    and keeps each whose ends are still in different components. What it keeps is the spanning forest of that
    order, so every component may take its own first candidate at once: components at least halve in each round,
    and of parallel candidates between two of them only the first goes on.

    ``nodes`` (node); ``edges`` (source, target); ``candidates`` (source, target, edge_type, evidence, score,
    reason). Candidates to what is no node, and null scores (taken as 0), are as any other pass has them: the
    former are left out. Bridges are of type related, never sure: .25 to .45 confident.
    """
    known = nodes.select("node").where("node IS NOT NULL").distinct()
    source, target = (known.withColumnRenamed("node", x) for x in ("source", "target"))
    inner = edges.select("source", "target").join(source, "source", "left_semi").join(target, "target", "left_semi")
    found = connected_components(inner)
    part = written(known.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("part")), "bridge-parts")
    lacks = F.length(F.coalesce("evidence", F.lit(""))) == 0
    order = F.struct(lacks.alias("lacks"), (-F.coalesce("score", F.lit(0.0))).alias("loss"), "source", "target", "edge_type")
    offered = written(candidates.select("source", "target", "evidence", "reason", order.alias("order")), "bridge-offers")  # read three times
    rows, taken, spent = offered, None, [part]
    for x in ("source", "target"):
        rows = join_spread(rows, x, part.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}")), hot_keys(offered, x))
    open_ = rows
    while True:
        sides = (F.least("part_source", "part_target").alias("a"), F.greatest("part_source", "part_target").alias("b"))
        apart = open_.where("part_source <> part_target").select(*sides, F.struct("order", "evidence", "reason").alias("c"))
        pairs, seen = observed(apart.groupBy("a", "b").agg(F.min_by("c", "c.order").alias("c")), "bridge-pairs", n=F.count(F.lit(1)))
        discard(*spent)
        if not seen["n"]:
            break
        best = pairs.select(F.explode(F.array("a", "b")).alias("part"), "a", "b", "c").groupBy("part").agg(F.min_by(F.struct("a", "b", "c"), "c.order").alias("pick"))
        picks = written(best.select("pick.*").dropDuplicates(["a", "b"]), "bridge-picks")
        joined = connected_components(picks.select(F.col("a").alias("source"), F.col("b").alias("target")))
        taken = picks.select("c.*") if taken is None else taken.unionByName(picks.select("c.*"))
        moves = written(joined.select(F.col("node").alias("part"), F.col("component").alias("to")), "bridge-moves")

        def moved(pairs: DataFrame, side: str, moves: DataFrame = moves) -> DataFrame:
            hot = hot_keys(pairs, side)
            return join_spread(pairs, side, moves.select(F.col("part").alias(side), F.col("to").alias(f"to_{side}")), hot)

        # a component that is left without candidates took none and keeps out of all that follows
        after = moved(moved(pairs, "a"), "b")
        open_ = after.select(F.col("to_a").alias("part_source"), F.col("to_b").alias("part_target"), "c.*")
        spent = [pairs, moves]
    if taken is None:
        taken = offered.where(F.lit(False)).select("order", "evidence", "reason")
    sure = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), -F.col("order.loss") * SHARE))
    said = F.trim(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"(?U)\s+", " "))
    why = F.concat(F.lit("Conservative relation candidate: "), F.coalesce("reason", F.lit("ontology/text co-occurrence")))
    return taken.select("order.source", "order.target", F.lit("related").alias("edge_type"), F.when(said != "", said).otherwise(why).alias("evidence"), F.round(sure, 3).alias("confidence"), F.round(BASE + sure * SLOPE, 3).alias("weight"))
